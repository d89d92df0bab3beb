"""Claims checked against their context: facts, classes, judge verdicts, citations, flags and warnings.

The claims are the sentences of ticket resolutions, their context is the ticket's own description and comments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators import text as X
from caselight.operators.ranking import top_per_group
from caselight.plans.frames import AS_OF, CHUNKS, COMMITMENTS, DOC_TYPES, TICKETS, chunks, commitments, quoted, tickets
from caselight.plans.questions import judged
from caselight.plans.sections import is_stale
from caselight.session import cut_lineage
from caselight.tables import table

# Verbs that say who did what, which no pattern can check.
RELATIONAL_VERBS = ("said", "told", "asked", "agreed", "refused", "confirmed", "denied", "stated", "reported", "claimed", "acknowledged", "committed", "caused", "blocked", "approved", "rejected", "flagged", "raised", "escalated", "owns", "manages", "reports to")

_FACTS_SQL = " || ".join(f"regexp_extract_all(lower(coalesce({{0}}, '')), '(?i){p}')" for p in X.FACTS)


def facts_sql(c: str) -> str:
    return f"list_distinct({_FACTS_SQL.replace('{0}', c)})"


def claim_sentences(c: Column) -> Column:
    """The claims of an answer: its pieces between sentence marks of more than 20 characters."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?]"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)


def is_relational(claim: Column) -> Column:
    """Whether a claim has a relational verb with a blank on either side (so one before a mark doesn't count)."""
    padded = F.concat(F.lit(" "), F.lower(claim), F.lit(" "))
    return F.exists(F.array(*map(F.lit, RELATIONAL_VERBS)), lambda v: F.contains(padded, F.concat(F.lit(" "), v, F.lit(" "))))


_CLAIMS = "cl AS (SELECT ticket_row_id, ticket_id, CAST(n - 1 AS INTEGER) AS claim_no, s[n] AS claim FROM (SELECT *, unnest(range(1, len(s) + 1)) AS n FROM (SELECT ticket_row_id, ticket_id, list_filter(list_transform(regexp_split_to_array(coalesce(resolution, ''), '[.!?]'), lambda x: trim(x)), lambda x: length(x) > 20) AS s FROM tickets)))"
_CONTEXT = "cx AS (SELECT ticket_id, lower(description) AS low FROM tickets WHERE description IS NOT NULL UNION ALL SELECT ticket_id, lower(body) FROM ticket_comments WHERE body IS NOT NULL)"
_VERBS = "(" + " OR ".join(f"contains(' ' || lower(claim) || ' ', ' {v} ')" for v in RELATIONAL_VERBS) + ")"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    """ticket_row_id, ticket_id, claim_no, claim."""
    return table(spark, d, "tickets").select("ticket_row_id", "ticket_id", F.posexplode(claim_sentences(F.col("resolution"))).alias("claim_no", "claim"))


def _context(spark: SparkSession, d: str) -> DataFrame:
    """ticket_id, low: a row per text."""
    t = table(spark, d, "tickets").select("ticket_id", F.lower("description").alias("low"))
    return t.unionByName(table(spark, d, "ticket_comments").select("ticket_id", F.lower("body").alias("low"))).filter("low IS NOT NULL")


def checked_claims(claims: DataFrame, context: DataFrame, key: str) -> DataFrame:
    """``claims`` (``key``, claim_id columns, claim) with n_facts, unsupported (facts that no text of the context holds), and bucket: ``flagged`` for an unsupported fact, ``verified`` where all facts are
    supported and no relational verb stands, else ``needs_judge``. ``context``: ``key``, low; a row per text.

    Facts meet the texts by key and are tested one by one, so a context of any size is never put into one value."""
    own = [c for c in claims.columns if c != "claim"]
    fact = claims.select(*own, F.explode(X.facts(F.col("claim"))).alias("fact"))
    held = fact.join(context, key).filter(F.contains("low", F.col("fact"))).select(*own, "fact").distinct().withColumn("held", F.lit(True))
    by_claim = fact.join(held, [*own, "fact"], "left").groupBy(*own).agg(F.count("*").cast("int").alias("n_facts"), F.array_join(F.sort_array(F.collect_list(F.when(F.col("held").isNull(), F.col("fact")))), ";").alias("unsupported"))
    out = claims.join(by_claim, own, "left").withColumns({"n_facts": F.coalesce("n_facts", F.lit(0)), "unsupported": F.coalesce("unsupported", F.lit(""))})
    return out.withColumn("bucket", F.when(F.col("unsupported") != "", "flagged").when((F.col("n_facts") > 0) & ~is_relational(F.col("claim")), "verified").otherwise("needs_judge"))


_CHECKED = f"""{_CLAIMS}, {_CONTEXT}, cf AS (SELECT ticket_row_id, ticket_id, claim_no, unnest({facts_sql('claim')}) AS fact FROM cl),
  ch AS (SELECT cf.*, EXISTS (SELECT 1 FROM cx WHERE cx.ticket_id = cf.ticket_id AND contains(cx.low, cf.fact)) AS held FROM cf),
  cg AS (SELECT ticket_row_id, claim_no, count(*) AS n_facts, coalesce(string_agg(fact, ';' ORDER BY fact) FILTER (WHERE NOT held), '') AS unsupported FROM ch GROUP BY ALL),
  ck AS (SELECT cl.ticket_row_id, cl.claim_no, cl.claim, CAST(coalesce(n_facts, 0) AS INTEGER) AS n_facts, coalesce(unsupported, '') AS unsupported, CASE WHEN coalesce(unsupported, '') <> '' THEN 'flagged' WHEN coalesce(n_facts, 0) > 0 AND NOT {_VERBS} THEN 'verified' ELSE 'needs_judge' END AS bucket FROM cl LEFT JOIN cg ON cg.ticket_row_id = cl.ticket_row_id AND cg.claim_no = cl.claim_no)"""


def _checked(spark: SparkSession, d: str) -> DataFrame:
    return checked_claims(_claims(spark, d), _context(spark, d), "ticket_id")


@query("q_extract_facts", f"SELECT doc_id, array_to_string(list_sort({facts_sql('text')}), ';') AS facts FROM documents")
def extract_facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(X.facts(F.col("text")), ";").alias("facts"))


@query("q_classify_claims", f"WITH {_CHECKED} SELECT ticket_row_id, claim_no, n_facts, bucket FROM ck")
def classify_claims(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).select("ticket_row_id", "claim_no", "n_facts", "bucket")


@query("q_claim_support", f"WITH {_CHECKED} SELECT ticket_row_id, claim_no, unsupported FROM ck WHERE n_facts > 0")
def claim_support(spark: SparkSession, d: str) -> DataFrame:
    return _checked(spark, d).filter("n_facts > 0").select("ticket_row_id", "claim_no", "unsupported")


@query("q_judge_gate", f"WITH {_CHECKED}, n AS (SELECT ticket_row_id, count(*) FILTER (WHERE bucket = 'needs_judge') AS n FROM ck GROUP BY 1) SELECT n.ticket_row_id, n.n AS n_claims, n.n > 3 OR regexp_matches(coalesce(t.subject, ''), '(?i)\\b(?:agreed?|committed?|promised?|told|said|confirmed?|denied?|refused?|stated?|approved?|rejected?|escalated?)\\b') AS judged FROM n JOIN tickets t ON t.ticket_row_id = n.ticket_row_id")
def judge_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether an answer's open claims go to the judge, at a faithfulness of 0.9."""
    n = _checked(spark, d).groupBy("ticket_row_id").agg(F.count_if(F.col("bucket") == "needs_judge").alias("n_claims"))
    return n.join(table(spark, d, "tickets").select("ticket_row_id", "subject"), "ticket_row_id").select("ticket_row_id", "n_claims", judged(F.col("subject"), F.lit(0.9), F.col("n_claims")).alias("judged"))


_VERDICT_SCHEMA = "struct<verdicts:array<struct<index:int,verdict:string,reason:string>>,conflicts:array<struct<topic:string,source_a:string,source_b:string>>>"


def judge_verdicts(answer: Column, claims: Column) -> Column:
    """(unsupported, conflicts, status) of a judge's answer about an array of claims, numbered from 1. An answer may be a list of verdicts or an object; numbers outside the claims and conflicts without topic or sources are dropped; unreadable ones give ``parse_error``."""
    whole = F.from_json(answer, _VERDICT_SCHEMA)
    listed = F.from_json(answer, "array<struct<index:int,verdict:string,reason:string>>")
    is_list = F.ltrim(answer).startswith("[")
    ok = F.try_parse_json(answer).isNotNull()
    verdicts = F.coalesce(F.when(is_list, listed).otherwise(whole["verdicts"]), F.array().cast("array<struct<index:int,verdict:string,reason:string>>"))
    bad = F.filter(verdicts, lambda v: (F.lower(v["verdict"]) == "unsupported") & v["index"].between(1, F.size(claims)))
    filled = lambda x: F.nullif(x, F.lit("")).isNotNull()
    conflicts = F.filter(F.coalesce(F.when(is_list, None).otherwise(whole["conflicts"]), F.array().cast("array<struct<topic:string,source_a:string,source_b:string>>")), lambda c: filled(c["topic"]) & filled(c["source_a"]) & filled(c["source_b"]))
    return F.struct(F.when(ok, F.transform(bad, lambda v: F.get(claims, v["index"] - 1))).alias("unsupported"), F.when(ok, conflicts).alias("conflicts"), F.when(ok, "ok").otherwise("parse_error").alias("status"))


@query("q_judge_parse", f"""WITH {_CHECKED}, j AS (SELECT ticket_row_id, claim, claim_no, row_number() OVER (PARTITION BY ticket_row_id ORDER BY claim_no) AS i FROM ck WHERE bucket = 'needs_judge')
  SELECT ticket_row_id, 'ok' AS status, coalesce(string_agg(claim, '|' ORDER BY i) FILTER (WHERE length(claim) > 60), '') AS unsupported, CAST(count(*) FILTER (WHERE length(claim) > 90) AS INTEGER) AS n_conflicts FROM j GROUP BY ticket_row_id""")
def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """The answers of a stand-in judge (claims of more than 60 characters are unsupported, those of more than 90 in conflict; one number lies outside the claims), parsed."""
    claims = _checked(spark, d).filter("bucket = 'needs_judge'").groupBy("ticket_row_id").agg(F.sort_array(F.collect_list(F.struct("claim_no", "claim"))).alias("c")).select("ticket_row_id", F.transform("c", lambda x: x["claim"]).alias("claims"))
    verdicts = F.transform("claims", lambda c, i: F.struct((i + 1).alias("index"), F.when(F.length(c) > 60, "Unsupported").otherwise("supported").alias("verdict"), F.lit("r").alias("reason")))
    outside = F.array(F.struct((F.size("claims") + 1).alias("index"), F.lit("unsupported").alias("verdict"), F.lit("r").alias("reason")))
    conflicts = F.transform("claims", lambda c: F.struct(F.lit("t").alias("topic"), F.when(F.length(c) > 90, "a").otherwise("").alias("source_a"), F.lit("b").alias("source_b")))
    answered = claims.withColumn("answer", F.to_json(F.struct(F.concat(verdicts, outside).alias("verdicts"), conflicts.alias("conflicts"))))
    return answered.select("ticket_row_id", judge_verdicts(F.col("answer"), F.col("claims")).alias("v")).select("ticket_row_id", "v.status", F.array_join("v.unsupported", "|").alias("unsupported"), F.size("v.conflicts").alias("n_conflicts"))


# --- faithfulness -----------------------------------------------------------------------------------------------------

def faithfulness(sentences: DataFrame, grounds: DataFrame, threshold: float, key: str) -> DataFrame:
    """``key``, faithfulness: the share of ``sentences`` (``key``, no, e) that some vector of ``grounds`` (``key``, g) of the same answer reaches, rounded to 2 half-even. Sentences without grounds are not grounded."""
    dot = F.aggregate(F.zip_with("e", "g", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    best = sentences.join(grounds, key, "left").groupBy(key, "no").agg(F.max(F.round(dot, 6)).alias("best"))
    return best.groupBy(key).agg(F.bround(F.avg(F.coalesce(F.col("best") >= threshold, F.lit(False)).cast("double")), 2).alias("faithfulness"))


@query("q_faithfulness", """WITH s AS (SELECT vec_id % 100 AS answer, vec_id AS no, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 300), g AS (SELECT vec_id % 100 AS answer, CAST(embedding AS DOUBLE[]) AS g FROM embeddings WHERE vec_id >= 300),
  b AS (SELECT s.answer, s.no, max(round(list_dot_product(e, g), 6)) AS best FROM s LEFT JOIN g ON g.answer = s.answer GROUP BY ALL) SELECT answer, round_even(avg(CAST(coalesce(best >= 0.2, false) AS DOUBLE)), 2) AS faithfulness FROM b GROUP BY answer""")
def q_faithfulness(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with ids below 300 stand for the sentences of a hundred answers, the others for the chunks that each answer rests on. The threshold is a parameter (0.65, 0.45 or 0.50 by the model); 0.2 suits these vectors."""
    v = table(spark, d, "embeddings").select((F.col("vec_id") % 100).alias("answer"), F.col("vec_id").alias("no"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return faithfulness(v.filter("no < 300"), v.filter("no >= 300").select("answer", F.col("e").alias("g")), 0.2, "answer")


# --- citations and answers --------------------------------------------------------------------------------------------

#: An answer per ticket: it cites the ticket itself, its first comments and a forged id; the retrieved set are the ticket and its comments.
_CITED = """ci AS (SELECT ticket_row_id, ticket_id, 0 AS ix, 'T' || ticket_row_id AS chunk_id FROM tickets UNION ALL SELECT t.ticket_row_id, t.ticket_id, c.comment_no, 'M' || c.comment_row_id FROM tickets t JOIN ticket_comments c ON c.ticket_id = t.ticket_id WHERE c.comment_no <= 3 UNION ALL SELECT ticket_row_id, ticket_id, 9, 'X' || ticket_row_id FROM tickets),
  re AS (SELECT t.ticket_row_id, 'T' || t.ticket_row_id AS chunk_id, t.source_system AS document, left(CAST(t.loaded_at AS VARCHAR), 10) AS doc_date FROM (SELECT *, coalesce(assignee, 'unknown') AS source_system FROM tickets) t UNION ALL SELECT t.ticket_row_id, 'M' || c.comment_row_id, coalesce(c.author, 'unknown'), left(CAST(c.loaded_at AS VARCHAR), 10) FROM tickets t JOIN ticket_comments c ON c.ticket_id = t.ticket_id)"""


def _cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(answer_id, ix, chunk_id) cited, and (answer_id, chunk_id, document, doc_date) retrieved."""
    t, c = table(spark, d, "tickets"), table(spark, d, "ticket_comments")
    pairs = t.select("ticket_row_id", "ticket_id").join(c.select("ticket_id", "comment_row_id", "comment_no", "author", F.col("loaded_at").alias("at")), "ticket_id")
    cite = lambda df, ix, mark, i: df.select(F.col("ticket_row_id").alias("answer_id"), ix.alias("ix"), F.concat(F.lit(mark), F.col(i).cast("string")).alias("chunk_id"))
    cited = cite(t, F.lit(0), "T", "ticket_row_id").unionByName(cite(pairs.filter("comment_no <= 3"), F.col("comment_no"), "M", "comment_row_id")).unionByName(cite(t, F.lit(9), "X", "ticket_row_id"))
    doc = lambda df, mark, i, name, at: df.select(F.col("ticket_row_id").alias("answer_id"), F.concat(F.lit(mark), F.col(i).cast("string")).alias("chunk_id"), F.coalesce(name, F.lit("unknown")).alias("document"), F.substring(F.col(at).cast("string"), 1, 10).alias("doc_date"))
    return cited, doc(t, "T", "ticket_row_id", "assignee", "loaded_at").unionByName(doc(pairs, "M", "comment_row_id", "author", "at"))


@query("q_citation_validate", f"WITH {_CITED} SELECT ci.ticket_row_id AS answer_id, count(*) FILTER (WHERE re.chunk_id IS NOT NULL) AS n_valid, count(*) FILTER (WHERE re.chunk_id IS NULL) AS n_forged FROM ci LEFT JOIN (SELECT DISTINCT ticket_row_id, chunk_id FROM re) re ON re.ticket_row_id = ci.ticket_row_id AND re.chunk_id = ci.chunk_id GROUP BY 1")
def citation_validate(spark: SparkSession, d: str) -> DataFrame:
    """Cited ids that were retrieved, and forged ones."""
    cited, retrieved = _cited(spark, d)
    known = cited.join(retrieved.select("answer_id", "chunk_id", F.lit(True).alias("known")).distinct(), ["answer_id", "chunk_id"], "left")
    return known.groupBy("answer_id").agg(F.count_if("known").alias("n_valid"), F.count_if(F.col("known").isNull()).alias("n_forged"))


_CITATIONS = f"""{_CITED}, va AS (SELECT ci.ticket_row_id AS answer_id, ci.ix, ci.chunk_id, re.document, re.doc_date FROM ci JOIN re ON re.ticket_row_id = ci.ticket_row_id AND re.chunk_id = ci.chunk_id WHERE re.document <> ''),
  fi AS (SELECT answer_id, document, min(struct_pack(ix := ix, chunk_id := chunk_id, doc_date := doc_date)) AS f FROM va GROUP BY ALL), cc AS (SELECT answer_id, document, f.ix AS ix, f.chunk_id AS chunk_id, f.doc_date AS doc_date FROM fi)"""


def citations(cited: DataFrame, retrieved: DataFrame) -> DataFrame:
    """answer_id, position, document, doc_date: the documents of valid citations, each once, in the order of citation. ``cited``: answer_id, ix, chunk_id; ``retrieved``: answer_id, chunk_id, document, doc_date."""
    valid = cited.join(retrieved.filter("document <> ''"), ["answer_id", "chunk_id"])
    first = valid.groupBy("answer_id", "document").agg(F.min(F.struct("ix", "chunk_id", "doc_date")).alias("f"))
    place = F.row_number().over(W.partitionBy("answer_id").orderBy("f.ix", "f.chunk_id")).cast("long")
    return first.select("answer_id", place.alias("position"), "document", F.col("f.doc_date").alias("doc_date"))


def with_fallback(found: DataFrame, answers: DataFrame, retrieved: DataFrame, k: int = 4) -> DataFrame:
    """``found``, and for ``answers`` without any citation the documents of their first ``k`` retrieved chunks (in order of chunk_id, parents before children of one id)."""
    rest = answers.select("answer_id").join(found.select("answer_id").distinct(), "answer_id", "left_anti")
    some = top_per_group(retrieved.join(rest, "answer_id", "left_semi"), ["answer_id"], [F.asc("chunk_id")], k)
    first = some.filter("document <> ''").groupBy("answer_id", "document").agg(F.min(F.struct("rank", "doc_date")).alias("f"))
    place = F.row_number().over(W.partitionBy("answer_id").orderBy("f.rank")).cast("long")
    return found.unionByName(first.select("answer_id", place.alias("position"), "document", F.col("f.doc_date").alias("doc_date")))


@query("q_citations", f"WITH {_CITATIONS} SELECT answer_id, row_number() OVER (PARTITION BY answer_id ORDER BY ix, chunk_id) AS position, document, doc_date, coalesce(datediff('day', try_cast(doc_date AS DATE), DATE '{AS_OF}') > 30, false) AS is_stale FROM cc")
def q_citations(spark: SparkSession, d: str) -> DataFrame:
    cited, retrieved = _cited(spark, d)
    answers = table(spark, d, "tickets").select(F.col("ticket_row_id").alias("answer_id"))
    return with_fallback(cut_lineage(citations(cited, retrieved)), answers, retrieved).withColumn("is_stale", is_stale(F.col("doc_date")))


@query("q_answer_status", f"""WITH {_CHECKED}, {_CITATIONS}, b AS (SELECT ticket_row_id, count(*) FILTER (WHERE bucket = 'flagged') AS n_flagged, string_agg(unsupported, ', ' ORDER BY claim_no) FILTER (WHERE bucket = 'flagged') AS facts FROM ck GROUP BY 1),
  l AS (SELECT answer_id, max(doc_date) AS latest, arg_min(doc_date, struct_pack(ix := ix, chunk_id := chunk_id)) AS first_date FROM cc GROUP BY 1)
  SELECT t.ticket_row_id AS answer_id, CASE WHEN t.resolution IS NULL THEN 'error' WHEN trim(t.resolution) = '' THEN 'not_found' WHEN coalesce(n_flagged, 0) > 0 THEN 'partial' ELSE 'ok' END AS status,
  CASE WHEN t.resolution IS NOT NULL AND trim(t.resolution) <> '' THEN l.latest END AS latest_source_date,
  CASE WHEN t.resolution IS NULL THEN 'unavailable' WHEN trim(t.resolution) = '' THEN 'no clear answer' ELSE nullif(concat_ws(' | ', CASE WHEN coalesce(n_flagged, 0) > 0 THEN 'not in the sources: ' || facts END, CASE WHEN datediff('day', try_cast(first_date AS DATE), DATE '{AS_OF}') > 30 THEN 'source older than 30 days (' || first_date || ')' END), '') END AS explanation
  FROM tickets t LEFT JOIN b ON b.ticket_row_id = t.ticket_row_id LEFT JOIN l ON l.answer_id = t.ticket_row_id""")
def answer_status(spark: SparkSession, d: str) -> DataFrame:
    """The state of each answer (a resolution; null stands for a failed call): error, not_found, partial where a fact isn't in the sources, else ok; with the latest cited date and what lowers confidence."""
    flagged = _checked(spark, d).filter("bucket = 'flagged'").groupBy("ticket_row_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("claim_no", "unsupported"))), lambda x: x["unsupported"]), ", ").alias("facts"))
    cited, retrieved = _cited(spark, d)
    dates = citations(cited, retrieved).groupBy(F.col("answer_id").alias("ticket_row_id")).agg(F.max("doc_date").alias("latest"), F.min_by("doc_date", "position").alias("first_date"))
    t = table(spark, d, "tickets").select("ticket_row_id", "resolution").join(flagged, "ticket_row_id", "left").join(dates, "ticket_row_id", "left")
    failed, empty = F.col("resolution").isNull(), F.trim("resolution") == ""
    wrong = F.col("facts").isNotNull()
    status = F.when(failed, "error").when(empty, "not_found").when(wrong, "partial").otherwise("ok")
    why = F.concat_ws(" | ", F.when(wrong, F.concat(F.lit("not in the sources: "), "facts")), F.when(is_stale(F.col("first_date")), F.concat(F.lit("source older than 30 days ("), "first_date", F.lit(")"))))
    explanation = F.when(failed, "unavailable").when(empty, "no clear answer").otherwise(F.nullif(why, F.lit("")))
    return t.select(F.col("ticket_row_id").alias("answer_id"), status.alias("status"), F.when(~failed & ~empty, F.col("latest")).alias("latest_source_date"), explanation.alias("explanation"))


# --- flags and warnings -----------------------------------------------------------------------------------------------

#: Open items: a ticket's source is the site that exported it (blank ones have none), its date that of its delivery.
_ITEMS = f"""it AS (SELECT k.ticket_row_id, k.user_id, coalesce(nullif(trim(k.subject), ''), k.ticket_id) AS title, coalesce(nullif(trim(k.assignee), ''), 'unknown') AS source_doc, left(CAST(k.loaded_at AS VARCHAR), 10) AS doc_date FROM tkt k WHERE k.is_open)"""


def _items(spark: SparkSession, d: str) -> DataFrame:
    given = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), other)
    return tickets(spark, d).filter("is_open").select("ticket_row_id", "user_id", given("subject", F.col("ticket_id")).alias("title"), given("assignee", F.lit("unknown")).alias("source_doc"), F.substring(F.col("loaded_at").cast("string"), 1, 10).alias("doc_date"))


#: Conflicts: the two latest states of one commitment whose target dates differ.
_CONFLICTS = """sn AS (SELECT commitment_id, customer_slug, snapshot_row_id, current_target_date AS claim, feed AS source, row_number() OVER (PARTITION BY commitment_id ORDER BY loaded_at DESC, snapshot_row_id DESC) AS rank FROM commitment_snapshots QUALIFY rank <= 2),
  rc AS (SELECT commitment_id, any_value(customer_slug) AS user_id, max(claim) FILTER (WHERE rank = 1) AS claim_a, max(source) FILTER (WHERE rank = 1) AS source_a, max(claim) FILTER (WHERE rank = 2) AS claim_b, max(source) FILTER (WHERE rank = 2) AS source_b FROM sn GROUP BY 1)"""


def _raw_conflicts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "commitment_snapshots").select("commitment_id", F.col("customer_slug").alias("user_id"), "loaded_at", "snapshot_row_id", F.col("current_target_date").alias("claim"), F.col("feed").alias("source"))
    last = top_per_group(s, ["commitment_id"], [F.desc("loaded_at"), F.desc("snapshot_row_id")], 2)
    side = lambda c, n: F.max(F.when(F.col("rank") == n, F.col(c)))
    return last.groupBy("commitment_id").agg(F.any_value("user_id").alias("user_id"), side("claim", 1).alias("claim_a"), side("source", 1).alias("source_a"), side("claim", 2).alias("claim_b"), side("source", 2).alias("source_b"))


def conflicts(raw: DataFrame) -> DataFrame:
    """``raw`` (claim_a, source_a, claim_b, source_b and others) without those that miss a claim; missing sources are ``unknown``."""
    known = lambda c: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("unknown"))
    kept = raw.filter("trim(coalesce(claim_a, '')) <> '' AND trim(coalesce(claim_b, '')) <> ''")
    return kept.withColumns({"source_a": known("source_a"), "source_b": known("source_b")})


@query("q_conflicts", f"WITH {_CONFLICTS} SELECT commitment_id, claim_a, coalesce(nullif(trim(source_a), ''), 'unknown') AS source_a, claim_b, coalesce(nullif(trim(source_b), ''), 'unknown') AS source_b FROM rc WHERE trim(coalesce(claim_a, '')) <> '' AND trim(coalesce(claim_b, '')) <> '' AND claim_a <> claim_b")
def q_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return conflicts(_raw_conflicts(spark, d)).filter("claim_a <> claim_b").select("commitment_id", "claim_a", "source_a", "claim_b", "source_b")


_OWNERS = f"ow AS (SELECT DISTINCT k.user_id, k.owner FROM com k JOIN rc ON rc.commitment_id = k.commitment_id WHERE trim(coalesce(claim_a, '')) <> '' AND trim(coalesce(claim_b, '')) <> '' AND claim_a <> claim_b AND k.owner IS NOT NULL)"


def _conflicting(spark: SparkSession, d: str) -> DataFrame:
    """user_id, source_doc: whose commitments are in conflict."""
    wrong = conflicts(_raw_conflicts(spark, d)).filter("claim_a <> claim_b").select("commitment_id")
    return commitments(spark, d).join(wrong, "commitment_id", "left_semi").filter("owner IS NOT NULL").select("user_id", F.col("owner").alias("source_doc")).distinct()


@query("q_conflict_items", f"WITH {TICKETS}, {COMMITMENTS}, {_ITEMS}, {_CONFLICTS}, {_OWNERS} SELECT it.ticket_row_id FROM it SEMI JOIN ow ON ow.user_id = it.user_id AND ow.owner = it.source_doc")
def conflict_items(spark: SparkSession, d: str) -> DataFrame:
    """Open items whose source is part of a conflict of the account."""
    return _items(spark, d).join(_conflicting(spark, d), ["user_id", "source_doc"], "left_semi").select("ticket_row_id")


_FLAGGED = f"""{TICKETS}, {COMMITMENTS}, {_ITEMS}, {_CONFLICTS}, {_OWNERS}, {_CONTEXT}, tf AS (SELECT it.ticket_row_id, k.ticket_id, unnest({facts_sql('it.title')}) AS fact FROM it JOIN tkt k ON k.ticket_row_id = it.ticket_row_id),
  vq AS (SELECT DISTINCT ticket_row_id FROM tf WHERE NOT EXISTS (SELECT 1 FROM cx WHERE cx.ticket_id = tf.ticket_id AND contains(cx.low, tf.fact))),
  fl AS (SELECT it.*, CASE WHEN source_doc = 'unknown' THEN 'no_source' WHEN coalesce(datediff('day', try_cast(doc_date AS DATE), DATE '{AS_OF}') > 30, false) THEN 'stale_source' WHEN ticket_row_id IN (SELECT ticket_row_id FROM vq) THEN 'verify_before_quoting' WHEN EXISTS (SELECT 1 FROM ow WHERE ow.user_id = it.user_id AND ow.owner = it.source_doc) THEN 'conflict' END AS flag FROM it)"""


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """The open items with the first flag that holds: no_source, stale_source, verify_before_quoting, conflict."""
    items = _items(spark, d)
    named = tickets(spark, d).select("ticket_row_id", "ticket_id")
    claims = items.select("ticket_row_id", F.col("title").alias("claim")).join(named, "ticket_row_id").select("ticket_row_id", "ticket_id", "claim")
    verify = checked_claims(claims, _context(spark, d), "ticket_id").filter("bucket = 'flagged'").select("ticket_row_id", F.lit(True).alias("_verify"))
    marked = items.join(verify, "ticket_row_id", "left").join(_conflicting(spark, d).withColumn("_conflict", F.lit(True)), ["user_id", "source_doc"], "left")
    flag = F.when(F.col("source_doc") == "unknown", "no_source").when(is_stale(F.col("doc_date")), "stale_source").when(F.col("_verify"), "verify_before_quoting").when(F.col("_conflict"), "conflict")
    return marked.withColumn("flag", flag).drop("_verify", "_conflict")


@query("q_open_item_flags", f"WITH {_FLAGGED} SELECT ticket_row_id, flag, coalesce(flag NOT IN ('no_source', 'conflict'), true) AS verified FROM fl")
def open_item_flags(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("ticket_row_id", "flag", F.coalesce(~F.col("flag").isin("no_source", "conflict"), F.lit(True)).alias("verified"))


_WARN = "' cites document older than 30 days (' || source_doc || ').'"
_WARNINGS = f"""wa AS (SELECT DISTINCT user_id, 'Open item ''' || left(title, 60) || {_WARN} AS warning FROM fl WHERE flag = 'stale_source' UNION SELECT DISTINCT user_id, 'Commitment ''' || left(description, 60) || '''' || ' cites document older than 30 days (' || coalesce(nullif(trim(source_doc), ''), 'unknown') || ').' FROM com WHERE is_open AND coalesce(datediff('day', try_cast(left(last_updated, 10) AS DATE), DATE '{AS_OF}') > 30, false))""".replace("' cites document older than 30 days (' || source_doc", "''' cites document older than 30 days (' || source_doc")


def _warnings(spark: SparkSession, d: str) -> DataFrame:
    say = lambda what, title, doc: F.concat(F.lit(f"{what} '"), F.substring(title, 1, 60), F.lit("' cites document older than 30 days ("), doc, F.lit(").")).alias("warning")
    i = _flagged(spark, d).filter("flag = 'stale_source'").select("user_id", say("Open item", "title", F.col("source_doc")))
    c = commitments(spark, d).filter("is_open").filter(is_stale(F.col("last_updated"))).select("user_id", say("Commitment", "description", F.coalesce(F.nullif(F.trim("source_doc"), F.lit("")), F.lit("unknown"))))
    return i.unionByName(c).distinct()


@query("q_stale_warnings", f"WITH {_FLAGGED}, {_WARNINGS} SELECT user_id, warning FROM wa")
def stale_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _warnings(spark, d)


@query("q_warnings_union", f"WITH {_FLAGGED}, {_WARNINGS}, u AS (SELECT user_id, warning FROM wa UNION SELECT customer_slug, 'No call since ' || coalesce(last_call_date, 'the start') || '.' FROM accounts) SELECT user_id, count(*) AS n, min(warning) AS first_warning FROM u GROUP BY user_id")
def warnings_union(spark: SparkSession, d: str) -> DataFrame:
    """The warnings already there with the new ones, each once."""
    before = table(spark, d, "accounts").select(F.col("customer_slug").alias("user_id"), F.concat(F.lit("No call since "), F.coalesce("last_call_date", F.lit("the start")), F.lit(".")).alias("warning"))
    return _warnings(spark, d).unionByName(before).distinct().groupBy("user_id").agg(F.count("*").alias("n"), F.min("warning").alias("first_warning"))


@query("q_evidence_gate", f"WITH {TICKETS}, {_ITEMS} SELECT ticket_row_id FROM it WHERE source_doc NOT IN ('', 'unknown')")
def evidence_gate(spark: SparkSession, d: str) -> DataFrame:
    return with_evidence(_items(spark, d)).select("ticket_row_id")


def with_evidence(items: DataFrame, source: str = "source_doc") -> DataFrame:
    """``items`` without those whose source is null, empty or unknown."""
    return items.filter(~F.coalesce(F.col(source), F.lit("")).isin("", "unknown"))


# The verbs of a directive, and the degrees of urgency.
VERBS, URGENCY = ("Lead", "Acknowledge", "Defer", "Push"), ("high", "medium", "low")


def valid_verb(c: Column) -> Column:
    """The verb of a directive in its one spelling; null for any other."""
    v = F.initcap(F.lower(F.trim(F.coalesce(c, F.lit("")))))
    return F.when(v.isin(*VERBS), v)


def urgency(c: Column) -> Column:
    return F.when(c.isin(*URGENCY), c).otherwise("medium")




@query("q_posture_validate", f"WITH v AS (SELECT ticket_row_id, upper(left(w, 1)) || substr(w, 2) AS verb FROM (SELECT ticket_row_id, lower(trim(coalesce(CASE ticket_row_id % 5 WHEN 0 THEN ' lead ' WHEN 1 THEN 'PUSH' WHEN 2 THEN 'defer' WHEN 3 THEN 'Acknowledge' ELSE status END, ''))) AS w FROM tickets)) SELECT ticket_row_id, verb FROM v WHERE verb IN ({quoted(VERBS)})")
def posture_validate(spark: SparkSession, d: str) -> DataFrame:
    """Directives typed in four spellings, and statuses, which are no verbs."""
    typed = F.when(F.col("ticket_row_id") % 5 == 0, " lead ").when(F.col("ticket_row_id") % 5 == 1, "PUSH").when(F.col("ticket_row_id") % 5 == 2, "defer").when(F.col("ticket_row_id") % 5 == 3, "Acknowledge").otherwise(F.col("status"))
    return table(spark, d, "tickets").select("ticket_row_id", valid_verb(typed).alias("verb")).filter("verb IS NOT NULL")


@query("q_urgency_default", f"SELECT ticket_row_id, CASE WHEN priority IN ({quoted(URGENCY)}) THEN priority ELSE 'medium' END AS urgency FROM tickets")
def urgency_default(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tickets").select("ticket_row_id", urgency(F.col("priority")).alias("urgency"))


_HEALTH = f"""hl AS (SELECT a.customer_slug, t.doc_type, count(x.doc_id) AS n, CASE WHEN count(x.doc_id) = 0 THEN 'missing' WHEN coalesce(datediff('day', try_cast(max(x.doc_date) AS DATE), DATE '{AS_OF}'), 0) > 30 THEN 'stale' ELSE 'current' END AS state FROM accounts a CROSS JOIN (VALUES {', '.join(f'({quoted((x,))})' for x in sorted(DOC_TYPES))}) t(doc_type) LEFT JOIN documents x ON x.customer_slug = a.customer_slug AND x.doc_type = t.doc_type GROUP BY ALL),
  oh AS (SELECT customer_slug, CASE WHEN bool_and(state = 'missing') THEN 'empty' WHEN bool_or(state = 'stale') THEN 'stale' ELSE 'current' END AS overall, string_agg(doc_type, ', ' ORDER BY doc_type) FILTER (WHERE state = 'stale') AS stale_types, coalesce(string_agg(doc_type, ';' ORDER BY doc_type) FILTER (WHERE state = 'missing'), '') AS missing FROM hl GROUP BY 1)"""


def corpus_states(spark: SparkSession, d: str) -> DataFrame:
    """customer_slug, doc_type, n, last_date, state (missing, stale, current) of every account and type."""
    wanted = table(spark, d, "accounts").select("customer_slug", F.explode(F.array(*map(F.lit, sorted(DOC_TYPES)))).alias("doc_type"))
    held = table(spark, d, "documents").filter("doc_type IS NOT NULL").groupBy("customer_slug", "doc_type").agg(F.count("*").alias("n"), F.max("doc_date").alias("last_date"))
    every = wanted.join(held, ["customer_slug", "doc_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    age = F.coalesce(F.datediff(F.lit(AS_OF).cast("date"), F.try_to_date("last_date", "yyyy-MM-dd")), F.lit(0))
    return every.withColumn("state", F.when(F.col("n") == 0, "missing").when(age > 30, "stale").otherwise("current"))


def corpus_overall(states: DataFrame) -> DataFrame:
    """customer_slug, overall (empty, stale, current), stale_types, missing."""
    listed = lambda state, sep: F.array_join(F.sort_array(F.collect_list(F.when(F.col("state") == state, F.col("doc_type")))), sep)
    overall = F.when(F.bool_and(F.col("state") == "missing"), "empty").when(F.bool_or(F.col("state") == "stale"), "stale").otherwise("current")
    return states.groupBy("customer_slug").agg(overall.alias("overall"), F.nullif(listed("stale", ", "), F.lit("")).alias("stale_types"), listed("missing", ";").alias("missing"))  # six types at most


@query("q_corpus_health", f"WITH {_HEALTH} SELECT customer_slug, doc_type, n, state FROM hl")
def corpus_health(spark: SparkSession, d: str) -> DataFrame:
    return corpus_states(spark, d).select("customer_slug", "doc_type", "n", "state")


@query("q_corpus_overall", f"WITH {_HEALTH} SELECT customer_slug, overall, missing FROM oh")
def q_corpus_overall(spark: SparkSession, d: str) -> DataFrame:
    return corpus_overall(corpus_states(spark, d)).select("customer_slug", "overall", "missing")


@query("q_corpus_warning", f"WITH {_HEALTH} SELECT customer_slug, CASE overall WHEN 'empty' THEN 'No documents uploaded for this customer.' WHEN 'stale' THEN 'Corpus is stale: ' || stale_types || ' not updated in 30+ days.' END AS warning FROM oh")
def corpus_warning(spark: SparkSession, d: str) -> DataFrame:
    o = corpus_overall(corpus_states(spark, d))
    return o.select("customer_slug", F.when(F.col("overall") == "empty", "No documents uploaded for this customer.").when(F.col("overall") == "stale", F.concat(F.lit("Corpus is stale: "), "stale_types", F.lit(" not updated in 30+ days."))).alias("warning"))


@query("q_context_str", f"""WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(doc_date, '1970-01-01') DESC, file_id) AS rank FROM chunks WHERE is_latest_version = 1 QUALIFY rank <= 6)
  SELECT user_id, md5(string_agg('[C' || rank || ' | ' || coalesce(nullif(doc_date, ''), '?') || ' | ' || coalesce(nullif(split_part(filename, '/', -1), ''), '?') || ']' || chr(10) || page_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context FROM r GROUP BY user_id""")
def q_context_str(spark: SparkSession, d: str) -> DataFrame:
    """The newest six documents of each account as the context of an answer."""
    c = chunks(spark, d).filter("is_latest_version = 1").withColumn("_date", F.coalesce("doc_date", F.lit("1970-01-01")))
    newest = top_per_group(c, ["user_id"], [F.desc("_date"), F.asc("file_id")], 6).withColumn("chunk_id", F.concat(F.lit("C"), F.col("rank").cast("string")))
    return context_strings(newest, "user_id").select("user_id", F.md5("context").alias("context"))


def context_strings(ranked: DataFrame, group: str) -> DataFrame:
    """``group``, context of a ranked list cut to a bounded length (rank, chunk_id, doc_date, filename, page_content): each text under its id, date and file name, ``?`` for what is missing."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("?"))
    head = F.format_string("[%s | %s | %s]\n%s", F.coalesce("chunk_id", F.concat(F.lit("chunk_"), (F.col("rank") - 1).cast("string"))), known(F.col("doc_date")), known(X.base_name(F.col("filename"))), F.coalesce("page_content", F.lit("")))
    parts = ranked.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", head.alias("part")))).alias("parts"))
    return parts.select(group, F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n---\n\n").alias("context"))


