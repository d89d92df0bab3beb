"""Personal information in free text: found, and replaced by typed placeholders.

Shapes and name-like pairs only propose spans. Whether a span is removed is decided by how strongly it discloses a protected entity, estimated in bits from the corpus:

* an e-mail address, number or street address by the entities (accounts) whose texts it co-occurs with: the divergence of their distribution given the term from their distribution over all texts. A
  hotline that stands in everybody's texts tells nothing about anybody and stays; a number met with one or few discloses them.
* a name by its given name: how much likelier the term is among the people that the columns name than among the name-like pairs of the texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.names import folded
from caselight.session import cut_lineage

#: Bits of divergence from which a span discloses an entity (a term met once does unless its entity holds seven tenths of all texts); bits from which a given name discloses a person: up to four times rarer
#: among people than among the pairs of the texts, for there it also stands for the many people no column names; and its least count in the columns.
SPAN_BITS, NAME_BITS, LEAST_COUNT = 0.5, -2.0, 2
KINDS = ("EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME")

_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_AT, _DOT = r"(?:\s?@\s?|\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+)", r"(?:\.|\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+)"
_EMAIL = re.compile(rf"(?<![\w.+%-])[\w][\w.+%-]*?(?:(?:\s*[\[({{]\s*dot\s*[\])}}]\s*|\s+dot\s+)[\w.+%-]+)*{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,}}(?![\w])", re.UNICODE)
_EMAIL_HINT = re.compile(r"@|[\[({]\s*at\s*[\])}]|\sat\s\S+\sdot\s")

_DIGIT = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_PHONE = re.compile(
    r"(?<![\w./+-])(?<!\d:)(?:"
    r"\+\d{1,3}[ .\-/]?(?:\(\d{1,4}\)[ .\-/]?)?\d{1,5}(?:[ .\-/]\d{2,5}){1,5}"
    r"|(?:1[ .-])?\(\d{3}\)\s?\d{3}[ .-]\d{4}"
    r"|(?:1[ .-])?\d{3}([ .-])\d{3}\1\d{4}"
    r"|0\d{1,4}/\d{3,8}(?:-\d{1,5})?"
    r"|0\d{2,4} \d{3,4} \d{3,4}"
    r")(?![\w-]|\.\d)"
)
_SPOKEN_PHONE = re.compile(rf"\b{_DIGIT}(?:[ ,]+{_DIGIT}){{6,}}\b", re.IGNORECASE)
_ID = re.compile(
    r"(?<![\w.+\-/@])(?<!\d:)(?:"
    r"[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]"
    r"|[A-Z]\d{8}"
    r"|[A-Z]\d{2,3}[A-Z]\d{4,5}"
    r"|\d{3}-\d{2}-\d{4}"
    r"|\d{3} \d{2} \d{4}"
    r"|\d{2} \d{3} \d{3} \d{3}"
    r"|\d{2}-\d{3}\.\d{3}-\d"
    r")(?![\w-]|\.\d)"
)
_STREET = r"(?:street|st\.?|road|rd\.?|avenue|ave\.?|boulevard|blvd\.?|drive|dr\.?|lane|ln\.?|court|ct\.?|row|way|place|terrace|square|close|crescent)"
_NAMED = r"[^\W\d_][\w'’-]*(?: [^\W\d_][\w'’-]*){0,2}?"
_CITY, _CODE = r"[^\W\d_][\w'’-]+", r"(?:\d{5}|[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2})\b"
_TAIL = rf"(?:, ?(?:flat|apt\.?|apartment|unit|suite) \w+)?(?:,? {_CITY},? {_CODE}|, ?{_CITY})?"
_ADDRESS = re.compile(
    r"(?<![\w-])(?:"
    rf"(?:(?:flat|apt\.?|apartment|unit|suite) \w+, ?)?\d{{1,5}}[a-z]? {_NAMED} {_STREET}(?![\w])(?=,| [^\W\d_]){_TAIL}"
    r"|\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|impasse|quai) [^\W\d_][\w'’-]*(?: [\w'’-]+){0,3}, ?\d{5}(?: [^\W\d_][\w'’-]+)?"
    r"|[^\W\d_][\w'’-]*(?:gasse|stra(?:ß|ss)e|weg|allee|platz|ring|damm|ufer) \d{1,4}[a-z]?, ?\d{5}(?: [^\W\d_][\w'’-]+)?"
    r")",
    re.IGNORECASE,
)
_SPACES = re.compile(r"\s+")
_ADDRESS_HINT = re.compile(r"\d[\d ,]*[^\d]*(?:" + _STREET + r"|\d{5})", re.IGNORECASE)

_WORD = r"[^\W\d_a-zß-öø-ÿ][\w'’-]*[^\W_]"
_PARTICLE = r"(?:(?:van|von|zu|de la|de|der|den|del|di|da|du|la|le|ter) )?(?:al-|el-|d'|O')?"
_PAIR = re.compile(rf"(?<![\w@.+'’-])(?=({_WORD})(?P<mid> [^\W\d_]\.)? (?P<rest>{_PARTICLE}{_WORD})(?![\w@]))")
_COMMA = re.compile(rf"(?<![\w@.+'’-])(?=(?P<sur>{_PARTICLE}{_WORD}), ({_WORD})(?: [^\W\d_]\.)?(?![\w@]))")
_HEAD = re.compile(r"^\s*(?:[\[(]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])]?(?:\s*-->\s*\S+)?\s*)?(?:>>\s*)?[^:\n.!?,]{1,60}(?:, [^:\n.!?]{1,30})?:(?=\s|$)")


def shaped(text: str, labelled: bool) -> list[tuple[str, int, int, str, str]]:
    """The items in ``text``: kind, start, end, and for a NAME candidate the folded terms (given, rest) it would disclose; ``labelled``: a speaker label may head it."""
    found: list[tuple[str, int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def take(kind: str, start: int, end: int) -> None:
        if all(end <= a or b <= start for a, b in taken):
            taken.append((start, end))
            found.append((kind, start, end, _SPACES.sub("", text[start:end]).lower(), ""))

    if _EMAIL_HINT.search(text):
        for m in _EMAIL.finditer(text):
            take("EMAIL", m.start(), m.end())
    if any(c.isdigit() for c in text):
        for m in _ID.finditer(text):
            take("ID_NUMBER", m.start(), m.end())
        for m in _PHONE.finditer(text):
            take("PHONE", m.start(), m.end())
        if _ADDRESS_HINT.search(text):
            for m in _ADDRESS.finditer(text):
                take("ADDRESS", m.start(), m.end())
    for m in _SPOKEN_PHONE.finditer(text):
        take("PHONE", m.start(), m.end())
    head = _HEAD.match(text).end() if labelled and _HEAD.match(text) else 0
    free = lambda a, b: a >= head and all(b <= x or y <= a for x, y in taken)
    for m in _PAIR.finditer(text):
        if free(m.start(), m.end("rest")):
            found.append(("given_first", m.start(), m.end("rest"), folded(m[1]), folded(m["rest"])))
    for m in _COMMA.finditer(text):
        if free(m.start(), m.end(2)):
            found.append(("surname_first", m.start(), m.end(2), folded(m[2]), folded(m["sur"])))
    return found


_ITEM_SCHEMA = "src_table string, row_id long, entity string, text_hash long, kind string, start_char long, end_char long, given string, rest string"


def shaped_items(texts: DataFrame) -> DataFrame:
    """The items and name candidates of ``texts`` (src_table, row_id, entity, text, labelled); one pass without a shuffle over whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, r, e, h, *x) for s, r, e, h, t, lab in zip(b.src_table, b.row_id, b.entity, b.text_hash, b.text, b.labelled, strict=True) for x in shaped(t, lab)]
            yield pd.DataFrame(rows, columns=["src_table", "row_id", "entity", "text_hash", "kind", "start_char", "end_char", "given", "rest"])

    return texts.filter(F.col("text").rlike(r"\S")).select("src_table", "row_id", "entity", F.xxhash64("text").alias("text_hash"), "text", "labelled").mapInPandas(run, _ITEM_SCHEMA)


def divergence(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """term, bits: how far the entities that a term's texts belong to differ from those of all texts (relative entropy).

    ``spans``: term, entity, text_hash, a row per occurrence; ``texts``: entity. Copies of a text of one entity count once. With a single entity nothing can diverge, and the term's
    own information, by the share of texts it stands in, takes the place. Counts are combined before each shuffle; a term has a row per entity it meets."""
    by_entity = texts.groupBy(F.coalesce("entity", F.lit("")).alias("entity")).agg(F.count("*").alias("n_texts"))
    by_entity = cut_lineage(by_entity)
    n, entities = by_entity.agg(F.sum("n_texts"), F.count("*")).first()  # two numbers
    met = spans.select("term", F.coalesce("entity", F.lit("")).alias("entity"), "text_hash").distinct().groupBy("term", "entity").agg(F.count("*").alias("c"))
    if entities < 2:
        return met.groupBy("term").agg(F.log2(F.lit(float(n or 1)) / F.sum("c")).alias("bits"))
    part = F.col("c") * F.log2(F.col("c") * F.lit(float(n)) / F.col("n_texts"))
    return met.join(by_entity, "entity").groupBy("term").agg((F.sum(part) / F.sum("c") - F.log2(F.sum("c"))).alias("bits"))


def disclosure(people: DataFrame, candidates: DataFrame) -> DataFrame:
    """term, bits: how much likelier a term is as a given name among ``people`` (name) than in the name-shaped pairs of the texts.

    Only names that state the order of their parts (``Surname, Given``, ``given.surname``, a middle initial) count, by their distinct spellings, weighted by rows.
    """

    @F.pandas_udf("struct<given:string,surname:string>")
    def split_name(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ordered_parts(n) for n in names], columns=["given", "surname"])

    spelled = people.filter(F.col("name").rlike(r"\S")).groupBy("name").agg(F.count("*").alias("n")).withColumn("p", split_name("name")).filter("p.given IS NOT NULL")
    named = spelled.select(F.explode(F.array(F.struct(F.col("p.given").alias("term"), F.lit(1).alias("g")), F.struct(F.col("p.surname").alias("term"), F.lit(0).alias("g")))).alias("t"), "n")
    named = named.groupBy(F.col("t.term").alias("term")).agg(F.sum(F.when(F.col("t.g") == 1, F.col("n")).otherwise(0)).alias("as_given"), F.sum("n").alias("in_names"))
    # By distinct pairs: copies of a text, or one person spoken of everywhere, say no more about a term than one occurrence.
    seen = candidates.select("given", "rest").distinct().groupBy(F.col("given").alias("term")).agg(F.count("*").alias("in_texts"))
    all_given, all_texts = (float(x.first()[0] or 0) for x in (named.agg(F.sum("as_given")), seen.agg(F.sum("in_texts"))))  # two numbers
    scored = seen.join(named, "term")
    share = F.col("as_given") / F.col("in_names")
    bits = F.log2((F.col("as_given") + 0.5) / (all_given + 1)) - F.log2((F.col("in_texts") + 0.5) / (all_texts + 1)) + F.log2(share)
    return scored.filter(F.col("as_given") >= LEAST_COUNT).filter(share >= 0.5).select("term", bits.alias("bits"))


def ordered_parts(name: str | None) -> tuple[str | None, str | None]:
    """(given, surname) of a spelling that states their order, folded; else Nones."""
    if not name:
        return None, None
    text = re.sub(r"\s*(?:\[[^\]]*\]|\([^)]*\)|\s-\s+\w+)\s*$", "", name).strip()
    if "@" in text:
        text = text.split("@")[0]
    if m := re.fullmatch(rf"([^\W\d_][\w'’-]+), ([^\W\d_][\w'’-]+)", text):
        return folded(m[2]), folded(m[1])
    if m := re.fullmatch(r"([^\W\d_][\w'’-]+) [^\W\d_]\. ([^\W\d_][\w'’-]+)", text):
        return folded(m[1]), folded(m[2])
    if m := re.fullmatch(r"([^\W\d_]+(?:-[^\W\d_]+)?)\.([^\W\d_]+)", text):
        return folded(m[1]), folded(m[2])
    return None, None


def find_pii(texts: DataFrame, people: DataFrame, span_bits: float = SPAN_BITS, name_bits: float = NAME_BITS) -> DataFrame:
    """src_table, row_id, pii_type, start_char, end_char (zero-based, end exclusive) of every item in ``texts`` whose disclosure reaches the threshold of its kind.

    ``texts``: src_table, row_id, entity (whom a text is about, such as its account), text, labelled; null and blank texts hold nothing, a null entity is one of its own. ``people``: name, a row per mention
    in a column that names people. Repeated rows count by their own id. The statistics cover all rows. Terms are joined by value; AQE splits a hot term.
    """
    items = cut_lineage(shaped_items(texts))  # read several times below; the texts are scanned once
    spans = items.filter(F.col("kind").isin(*KINDS[:4])).withColumnRenamed("given", "term")
    # Those that disclose nobody are few, so they are what is joined.
    harmless = divergence(spans.select("term", "entity", "text_hash"), texts.filter(F.col("text").rlike(r"\S")).select("entity")).filter(F.col("bits") < span_bits).select("term")
    plain = spans.join(harmless, "term", "left_anti").select("src_table", "row_id", "start_char", "end_char", "kind")
    candidates = items.filter(F.col("kind").isin("given_first", "surname_first"))
    scores = disclosure(people, candidates).filter(F.col("bits") >= name_bits)
    named = candidates.join(scores.select(F.col("term").alias("given")), "given")
    # A surname-first pair whose first word is itself a given name is a list of two people.
    listed = scores.select(F.col("term").alias("rest"))
    first = named.filter("kind = 'given_first'")
    last = named.filter("kind = 'surname_first'").join(listed, "rest", "left_anti")
    names = first.unionByName(last.select(first.columns)).groupBy("src_table", "row_id", "start_char").agg(F.max("end_char").alias("end_char")).withColumn("kind", F.lit("NAME"))
    return plain.unionByName(names).select("src_table", "row_id", F.col("kind").alias("pii_type"), "start_char", "end_char")


def sanitised(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``texts`` with every item replaced by ``[TYPE]``, the rest unchanged: src_table, row_id, clean_text. Items that overlap are replaced together, under the type of the first. Texts without items come out as they are, null stays null."""

    @F.pandas_udf("string")
    def replace(text: pd.Series, items: pd.Series) -> pd.Series:
        return pd.Series([_replaced(t, x) for t, x in zip(text, items, strict=True)], dtype="object")

    spans = found.groupBy("src_table", "row_id").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "pii_type"))).alias("items"))
    joined = texts.join(spans, ["src_table", "row_id"], "left")
    return joined.select("src_table", "row_id", F.when(F.col("items").isNull(), F.col("text")).otherwise(replace("text", "items")).alias("clean_text"))


def _replaced(text: str | None, items) -> str | None:  # noqa: ANN001
    if text is None or items is None:
        return text
    out, at = [], 0
    for x in items:
        start, end, kind = (x["start_char"], x["end_char"], x["pii_type"])
        if start < at:  # it overlaps the one before: both are one span
            at = max(at, end)
            continue
        out += [text[at:start], f"[{kind}]"]
        at = end
    return "".join([*out, text[at:]])
