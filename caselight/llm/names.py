"""Variant spellings of people's and teams' names linked by merge-and-rematch resolution.

Spellings with the same words form profiles. In each round every profile emits blocking keys made from all the spellings merged into it so far;
profiles that meet in a block and match are merged, and the richer profiles enter blocking again until a round merges nothing.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.session import cut_lineage

# Nicknames and the given names they stand for.
NICKNAMES = {
    "alex": "alexander alexandra", "sasha": "alexander alexandra", "lex": "alexander", "ben": "benjamin", "benny": "benjamin", "beth": "elizabeth", "liz": "elizabeth", "eliza": "elizabeth", "betty": "elizabeth", "lisa": "elizabeth",
    "bill": "william", "will": "william", "billy": "william", "liam": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "chris": "christopher christine", "kit": "christopher", "chuck": "charles", "charlie": "charles",
    "debbie": "deborah", "deb": "deborah", "dick": "richard", "rick": "richard", "rich": "richard", "ricky": "richard", "eddie": "edward", "ned": "edward", "ed": "edward", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore",
    "fred": "frederick alfred", "fritz": "frederick friedrich", "freddy": "frederick", "gabi": "gabriela", "gaby": "gabriela", "hannes": "johannes", "hans": "johannes", "jo": "josephine joseph", "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine",
    "lena": "magdalena helena", "magda": "magdalena", "leo": "leonardo leonard", "maggie": "margaret", "peggy": "margaret", "meg": "margaret", "greta": "margaret", "mike": "michael", "mick": "michael", "micky": "michael", "nate": "nathaniel", "nat": "nathaniel natalie",
    "paco": "francisco", "pancho": "francisco", "frank": "francisco francis", "pat": "patricia patrick", "trish": "patricia", "patty": "patricia", "sam": "samantha samuel", "sammy": "samantha samuel", "sue": "susannah susan", "susie": "susannah susan", "vicky": "victoria", "vic": "victoria victor", "tori": "victoria",
    "tom": "thomas", "jim": "james", "joe": "joseph", "nick": "nicholas nikolai", "tony": "anthony", "dan": "daniel", "dave": "david", "steve": "stephen", "andy": "andrew", "matt": "matthew", "jen": "jennifer", "becky": "rebecca", "bea": "beatriz beatrice",
}

# Words of team names with their short forms, and words that add nothing to one.
TEAM_WORDS = {
    "ops": "operations", "op": "operations", "oper": "operations", "eng": "engineering", "engg": "engineering", "plat": "platform", "cust": "customer", "sec": "security", "integ": "integration", "integrations": "integration", "int": "integration",
    "migr": "migration", "rel": "reliability", "comp": "compliance", "supp": "support", "bill": "billing", "succ": "success",
    "operations": "operations", "engineering": "engineering", "platform": "platform", "customer": "customer", "security": "security", "integration": "integration", "migration": "migration", "reliability": "reliability",
    "compliance": "compliance", "support": "support", "billing": "billing", "success": "success", "site": "site", "data": "data", "service": "service", "desk": "desk", "network": "network", "finance": "finance", "legal": "legal", "product": "product", "delivery": "delivery",
}
TEAM_FILLERS = frozenset("team squad group dept department crew unit and the of".split())

_REMARK = re.compile(r"\s*(?:\[[^\]]*\]|\([^)]*\)|\s-\s+(?:FDE|CSM|Support|host|Customer|contractor)\b.*)\s*$", re.IGNORECASE)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W\d_]+)*\.?")
_FOLD = str.maketrans({"ø": "o", "Ø": "O", "ß": "ss", "æ": "ae", "Æ": "AE", "đ": "d", "ł": "l", "Ł": "L", "ð": "d", "þ": "th", "’": "'"})


def folded(s: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", s.translate(_FOLD)) if not unicodedata.combining(c)).lower()


#: Team words that can end a team's name behind a word that isn't known; the others say what a team is for.
TEAM_HEADS = frozenset("operations engineering support success security reliability compliance billing integration migration desk delivery finance".split())


def team_key(text: str) -> str | None:
    """The words of a team's name in full; None for what may as well be a person's.

    All words are team words, full, short or with a slip; or the name says that it is a team; or it ends in a head word written in full behind a word that is no given name or nickname. Short
    forms alone (``Bill``, ``Sec``) never make a team of a name with an unknown word."""
    words = re.findall(r"[a-z]+", folded(_CAMEL.sub(" ", text)))
    said = any(w in TEAM_FILLERS - {"the", "and", "of", "it"} for w in words)
    words = [w for w in words if w not in TEAM_FILLERS]
    if not words or len(words) > 4:
        return None
    full = [TEAM_WORDS.get(w) or _near_team_word(w) for w in words]
    known = sum(x is not None for x in full)
    spelled = [x or w for x, w in zip(full, words, strict=True)]
    if known == len(words) and (len(words) > 1 or words[0] in _FULL_TEAM_WORDS or said):
        return " ".join(spelled)
    if known and said:
        return " ".join(spelled)
    if len(words) > 1 and words[-1] in TEAM_HEADS and words[0] not in NICKNAMES and not _FORMAL & set(words) and "," not in text:
        return " ".join(spelled)
    return None


_FULL_TEAM_WORDS = frozenset(TEAM_WORDS.values())
_FORMAL = frozenset(x for v in NICKNAMES.values() for x in v.split())


def _near_team_word(word: str) -> str | None:
    """The team word that ``word`` is with one slip: a letter lost, added, replaced or swapped."""
    if len(word) < 5:
        return None
    return next((t for t in sorted(_FULL_TEAM_WORDS) if abs(len(t) - len(word)) <= 1 and _one_slip_apart(word, t)), None)


def _one_slip_apart(a: str, b: str) -> bool:
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    rest = (a[i + 1 :] == b[i + 1 :], a[i:] == b[i + 1 :], a[i + 1 :] == b[i:], a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return any(rest)


def parsed(name: str | None) -> tuple[str, str, list[str], list[str]]:
    """kind (``full``, ``part``, ``team``, ``none``), full, links and partial keys of a spelling.

    ``full`` is what spellings of one name share after case, accents, order, middle initials and remarks are set aside. ``links`` has the fulls that a nickname may
    stand for. Partial keys are ``I`` (initial and surname; a login says the same) and ``G`` (given name and initial of the surname); a full name
    of unknown order emits them for both orders.
    """
    if name is None or not name.strip():
        return "none", "", [], []
    text = name.strip()
    while (shorter := _REMARK.sub("", text)) != text and shorter.strip():
        text = shorter.strip()
    is_mail = "@" in text
    if is_mail:
        text = text.split("@")[0]
    plain = folded(text)
    if not is_mail and (team := team_key(text)):
        return "team", "t:" + team, [], []
    given_first = False
    if "," in plain and not is_mail:
        surname, _, given = plain.partition(",")
        words = [*_WORD.findall(given), *_WORD.findall(surname)]
        given_first = True
    elif " " not in plain and "." in plain.strip("."):
        words = [w for w in plain.split(".") if w]
        given_first = True
    else:
        words = _WORD.findall(plain)
    bare = [w.rstrip(".") for w in words]
    if len(bare) > 2 and any(len(w) == 1 for w in bare[1:-1]):
        bare = [bare[0], *[w for w in bare[1:-1] if len(w) > 1], bare[-1]]
        given_first = True
    if len(bare) > 2:
        bare = [bare[0], " ".join(bare[1:])]
        given_first = True
    if len(bare) == 1:
        w = bare[0]
        return ("part", "", [], [f"I:{w[0]}|{w[1:]}"]) if len(w) > 2 else ("none", "", [], [])
    if len(bare) != 2:
        return "none", "", [], []
    a, b = bare
    if len(a) == 1 and len(b) > 1:
        return "part", "", [], [f"I:{a}|{b}"]
    if len(b) == 1 and len(a) > 1:
        keys = [f"G:{g}|{b}" for g in (a, *NICKNAMES.get(a, "").split())]
        return "part", "", [], keys
    if len(a) == 1:
        return "none", "", [], []
    orders = [(a, b)] if given_first else [(a, b), (b, a)]
    links, parts = [], []
    for given, surname in orders:
        parts += [f"I:{given[0]}|{surname}", f"G:{given}|{surname[0]}"]
        for formal in NICKNAMES.get(given, "").split():
            links.append("|".join(sorted((formal, surname))))
            parts.append(f"G:{formal}|{surname[0]}")
    return "full", "|".join(sorted((a, b))), links, parts


_KEYS = "array<struct<key:string,exact:int>>"


def _near_keys(full: Column) -> Column:
    """Keys under which spellings one slip apart meet, and others don't.

    ``D``: the spelling without one letter, and its place: two that share one differ in that letter only. ``E``: a spelling itself, marked exact, and, not marked, what comes out when a
    letter of it is lost or two neighbours in the wrong order are swapped: all of those are one slip from the exact one. A slip in a word's first letter can change the order of the
    words in ``full``, so these letters are also tried word by word (``R`` for one that is replaced)."""
    n = F.length(full)
    without = lambda i: F.concat(F.substring(full, F.lit(1), i - 1), F.substring(full, i + 1, n))
    letter = lambda i: F.substring(full, i, F.lit(1))
    each, pairs = F.sequence(F.lit(1), n), F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    key = lambda tag, c, exact: F.struct(F.concat(F.lit(tag), c).alias("key"), F.lit(exact).alias("exact"))
    replaced = F.transform(each, lambda i: key("D:", F.concat(i.cast("string"), F.lit(":"), without(i)), 0))
    lost = F.transform(each, lambda i: key("E:", without(i), 0))
    swapped = F.transform(F.filter(pairs, lambda i: letter(i) > letter(i + 1)), lambda i: key("E:", F.concat(F.substring(full, F.lit(1), i - 1), letter(i + 1), letter(i), F.substring(full, i + 2, n)), 0))
    words = F.split(full, r"\|")
    sides = [(words[0], F.get(words, F.lit(1))), (F.get(words, F.lit(1)), words[0])]
    joined = lambda x, y: F.array_join(F.array_sort(F.array(x, y)), "|")
    tail = lambda w: F.substring(w, F.lit(2), F.length(w))
    turned = lambda w: F.concat(F.substring(w, 2, 1), F.substring(w, 1, 1), F.substring(w, F.lit(3), F.length(w)))
    first = [k for w, other in sides for k in (key("R:", F.concat(tail(w), F.lit("|"), other), 0), key("E:", joined(tail(w), other), 0), key("E:", joined(turned(w), other), 0))]
    heads = F.when(F.size(words) == 2, F.array(*first)).otherwise(F.array().cast(_KEYS))
    return F.concat(replaced, lost, swapped, heads, F.array(key("E:", full, 1)))


def _edges(units: DataFrame) -> DataFrame:
    """grp, a, b: the pairs of units that a slip or a nickname links, as stars: each member of a block with its hub.

    A block's members are as many as there are spellings one slip from one string, or nicknames of one name, whatever the number of rows, so its list is short and no link
    is lost to a choice of hub: in a block all are linked, or all to the exact one."""
    named = F.transform(F.concat(F.array("full"), "links"), lambda x: F.struct(F.concat(F.lit("N:"), x).alias("key"), F.lit(0).alias("exact")))
    keys = F.concat(_near_keys(F.col("full")), F.when(F.col("kind") == "full", named).otherwise(F.array().cast(_KEYS)))
    met = units.filter("kind IN ('full', 'team')").select("grp", "unit", "n", F.explode(F.array_distinct(keys)).alias("k")).select("grp", "unit", "n", "k.key", "k.exact")
    blocks = met.groupBy("grp", "key").agg(F.array_sort(F.collect_set(F.struct("exact", "n", "unit"))).alias("members")).filter("size(members) > 1")
    hub = F.element_at("members", -1)
    star = blocks.filter((F.substring("key", 1, 2) != "E:") | (hub["exact"] == 1)).select("grp", hub["unit"].alias("b"), F.explode("members").alias("m"))
    return star.select("grp", F.col("m.unit").alias("a"), "b").filter("a <> b").distinct()


def link_names(spellings: DataFrame) -> DataFrame:
    """The class of each distinct spelling: grp, name, class_id, kind. Input: grp, name (repeated rows are counted as support).

    Spellings of different ``grp`` are never linked. Null and blank names, and those that are no name (kind ``none``), are classes of their own or, if null
    or blank, give no row. A partial spelling whose block holds two whole profiles is linked to neither through it. Ties of support go to the larger id.

    Scale: spellings are counted before anything is shuffled. What a spelling's letters and nicknames link doesn't change and is found once; a round moves the profiles, of which
    the richer meet the partial spellings again. Blocks of partial spellings are reduced to their least and greatest whole profile. No group is collected into a task. Lineage is cut after every round.
    """

    @F.pandas_udf("struct<kind:string,full:string,links:array<string>,parts:array<string>>")
    def parse(names: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parsed(n) for n in names], columns=["kind", "full", "links", "parts"])

    counted = spellings.filter(F.col("grp").isNotNull() & F.col("name").rlike(r"[^\s ]")).groupBy("grp", "name").agg(F.count("*").alias("n"))
    read = counted.withColumn("p", parse("name")).select("grp", "name", "n", "p.kind", "p.full", "p.links", "p.parts")
    own_id = F.when(F.col("kind").isin("full", "team"), F.concat(F.lit("="), "full")).otherwise(F.concat(F.lit("~"), "name"))
    # One row per distinct content of a profile; the spellings themselves are joined again at the end.
    read = cut_lineage(read.withColumn("unit", own_id))
    # Where some spelling states the order of the words, the keys of the other order are dropped.
    sure = F.when((F.col("kind") == "full") & (F.size("parts") < 4) & (F.size("links") <= 1), F.col("parts"))
    units = read.groupBy("grp", "unit").agg(F.sum("n").alias("n"), F.first("kind").alias("kind"), F.first("full").alias("full"), F.flatten(F.collect_set("links")).alias("links"), F.flatten(F.collect_set("parts")).alias("every"), F.flatten(F.collect_set(sure)).alias("sure"))
    units = cut_lineage(units.withColumn("parts", F.array_distinct(F.when(F.size("sure") > 0, F.col("sure")).otherwise(F.col("every")))).drop("every", "sure"))
    edges = cut_lineage(_edges(units))
    # A profile is named by its strongest unit: whole before partial, then by support.
    label = F.struct(F.when(F.col("kind") == "part", 0).otherwise(1).alias("whole"), "n", "unit")
    state = units.select("grp", "unit", label.alias("pid"))
    parts = cut_lineage(units.select("grp", "unit", F.explode("parts").alias("key")))
    while True:  # every round but the last merges at least one profile into another, so it ends
        side = lambda c: state.select("grp", F.col("unit").alias(c), F.col("pid").alias(f"pid_{c}"))  # noqa: E731, B023
        apart = edges.join(side("a"), ["grp", "a"]).join(side("b"), ["grp", "b"]).filter("pid_a <> pid_b")
        slips = apart.select("grp", F.least("pid_a", "pid_b").alias("pid"), F.greatest("pid_a", "pid_b").alias("to"))
        blocks = parts.join(state, ["grp", "unit"])
        whole = F.when(F.col("pid.whole") == 1, F.col("pid"))
        hubs = blocks.groupBy("grp", "key").agg(F.max("pid").alias("to"), F.min(whole).alias("_least"), F.max(whole).alias("_most")).filter("_least <=> _most").select("grp", "key", "to")
        fits = blocks.filter("pid.whole = 0").join(hubs, ["grp", "key"]).filter("pid <> to").select("grp", "pid", "to")
        moves = cut_lineage(slips.unionByName(fits).groupBy("grp", "pid").agg(F.max("to").alias("to")))
        if moves.isEmpty():
            break
        # A profile that moves itself takes nobody in this round, so that none is left behind under its old name.
        moves = moves.join(moves.select("grp", F.col("pid").alias("to")), ["grp", "to"], "left_anti")
        state = cut_lineage(state.join(moves, ["grp", "pid"], "left").select("grp", "unit", F.coalesce("to", "pid").alias("pid")))
    return read.select("grp", "name", "unit", "kind").join(state.select("grp", "unit", "pid"), ["grp", "unit"]).select("grp", "name", F.col("pid.unit").alias("class_id"), "kind")


def linked_pairs(classes: DataFrame) -> DataFrame:
    """Pairs of different spellings of one class, name_a before name_b in byte order."""
    right = classes.select("grp", "class_id", F.col("name").alias("name_b"))
    pairs = classes.select("grp", "class_id", F.col("name").alias("name_a")).join(right, ["grp", "class_id"])
    return pairs.filter(F.col("name_a") < F.col("name_b")).select("grp", "name_a", "name_b")
