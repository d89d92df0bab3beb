"""The sections of a brief and of an executive brief, as rows, with their status; put together at the end. No model is called: where one would write prose, the section has the rows it would be given."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators.people import person_tiers
from caselight.operators.ranking import first_of, top_per_group
from caselight.plans.frames import AS_OF, CHUNKS, COMMITMENTS, TICKETS, chunks, commitments, tickets
from caselight.plans.health import _PEOPLE, people
from caselight.plans.retrieval import q_account_summary_docs
from caselight.plans.claims import _FLAGGED, _WARNINGS, _warnings, q_conflicts
from caselight.session import cut_lineage
from caselight.tables import table

# --- what changed ------------------------------------------------------------------------------------------------------

_TWO_WEEKS = "2025-06-16"  # AS_OF less 14 days
_SINCE = f"si AS (SELECT customer_slug AS user_id, coalesce(nullif(last_call_date, ''), '{_TWO_WEEKS}') AS since FROM accounts)"
_RESOLVED = ("closed", "resolved", "done", "complete", "completed", "fixed")
_DELIVERED = ("delivered", "done", "complete", "completed", "closed", "resolved", "fixed")
_in = lambda xs: ", ".join(f"'{x}'" for x in xs)


def since(spark: SparkSession, d: str) -> DataFrame:
    """user_id, since: the day of an account's last call, or two weeks before the fixed day."""
    start = F.date_format(F.date_sub(F.lit(AS_OF).cast("date"), 14), "yyyy-MM-dd")
    return table(spark, d, "accounts").select(F.col("customer_slug").alias("user_id"), F.coalesce(F.nullif("last_call_date", F.lit("")), start).alias("since"))


_CHANGES = f"""{_SINCE}, rt AS (SELECT k.user_id, 0 AS src, 'ticket' AS kind, k.ticket_id AS id, left(CAST(k.loaded_at AS VARCHAR), 10) AS day, k.ticket_row_id AS ix FROM tkt k JOIN si ON si.user_id = k.user_id WHERE k.status IN ({_in(_RESOLVED)}) AND left(CAST(k.loaded_at AS VARCHAR), 10) >= si.since),
  rc2 AS (SELECT k.user_id, 1 AS src, 'commitment' AS kind, k.commitment_id AS id, left(k.last_updated, 10) AS day, k.commit_row_id AS ix FROM com k JOIN si ON si.user_id = k.user_id WHERE k.status IN ({_in(_DELIVERED)}) AND left(k.last_updated, 10) >= si.since),
  rn AS (SELECT k.user_id, 2 AS src, 'document' AS kind, k.filename AS id, min(coalesce(nullif(k.doc_date, ''), '1970-01-01')) AS day, min(k.file_id) AS ix FROM chunks k JOIN si ON si.user_id = k.user_id WHERE k.is_latest_version = 1 AND k.doc_type NOT IN ('ticket', 'commitment_tracker') AND coalesce(nullif(k.doc_date, ''), '1970-01-01') >= si.since GROUP BY k.user_id, k.filename),
  ra AS (SELECT * FROM rt UNION ALL SELECT * FROM rc2 UNION ALL SELECT * FROM rn), rr2 AS (SELECT *, row_number() OVER (PARTITION BY user_id, src ORDER BY ix) AS rank FROM ra), re2 AS (SELECT * FROM rr2 WHERE rank <= CASE src WHEN 2 THEN 6 ELSE 5 END)"""


def recent_changes(spark: SparkSession, d: str) -> DataFrame:
    """user_id, kind, id, day, rank: since an account's last call, at most five resolved tickets, five delivered commitments and six documents, one row per file."""
    s = since(spark, d)
    row = lambda df, src, kind, i, day, ix: df.select("user_id", F.lit(src).alias("src"), F.lit(kind).alias("kind"), F.col(i).alias("id"), day.alias("day"), F.col(ix).alias("ix"))
    t = row(tickets(spark, d).filter(F.col("status").isin(*_RESOLVED)), 0, "ticket", "ticket_id", F.substring(F.col("loaded_at").cast("string"), 1, 10), "ticket_row_id")
    c = row(commitments(spark, d).filter(F.col("status").isin(*_DELIVERED)), 1, "commitment", "commitment_id", F.substring("last_updated", 1, 10), "commit_row_id")
    n = row(chunks(spark, d).filter((F.col("is_latest_version") == 1) & ~F.col("doc_type").isin("ticket", "commitment_tracker")), 2, "document", "filename", F.coalesce(F.nullif("doc_date", F.lit("")), F.lit("1970-01-01")), "file_id")
    recent = t.unionByName(c).unionByName(n).join(s, "user_id").filter("day >= since").drop("since")
    once = recent.groupBy("user_id", "src", "kind", "id").agg(F.min("day").alias("day"), F.min("ix").alias("ix"))
    ranked = top_per_group(once, ["user_id", "src"], [F.asc("ix")], 6)
    return ranked.filter("rank <= 5 OR src = 2").select("user_id", "kind", "id", "day", "rank")


@query("q_recent_changes", f"WITH {TICKETS}, {COMMITMENTS}, {CHUNKS}, {_CHANGES} SELECT user_id, kind, id, day, rank FROM re2")
def q_recent_changes(spark: SparkSession, d: str) -> DataFrame:
    return recent_changes(spark, d)


@query("q_recent_mix", f"WITH {TICKETS}, {COMMITMENTS}, {CHUNKS}, {_CHANGES} SELECT user_id, kind, count(*) AS n FROM re2 GROUP BY ALL")
def recent_mix(spark: SparkSession, d: str) -> DataFrame:
    return recent_changes(spark, d).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


# --- open items, commitments, anticipated questions --------------------------------------------------------------------

_ISO = r"^\d{4}-\d{2}-\d{2}$"
_PRIO = "CASE priority WHEN 'p0' THEN 0 WHEN 'p1' THEN 1 WHEN 'p2' THEN 2 ELSE 3 END"
_OPEN_ITEMS = f"""ot AS (SELECT user_id, 1 AS src, ticket_row_id AS ix, ticket_id AS id, coalesce(nullif(trim(subject), ''), ticket_id) AS title, {_PRIO} AS prio, row_number() OVER (PARTITION BY user_id ORDER BY {_PRIO}, ticket_row_id) AS r FROM tkt WHERE is_open),
  oc AS (SELECT k.user_id, 0 AS src, k.commit_row_id AS ix, k.commitment_id AS id, k.description AS title, CASE WHEN coalesce(t.cur < '{AS_OF}', false) THEN 0 ELSE 1 END AS prio FROM com k JOIN (SELECT commit_row_id, CASE WHEN regexp_matches(current_target_date, '{_ISO}') THEN current_target_date END AS cur FROM commitments) t ON t.commit_row_id = k.commit_row_id WHERE k.is_open AND (coalesce(t.cur < '{AS_OF}', false) OR k.slipped)),
  oa AS (SELECT user_id, src, ix, id, title, prio FROM oc UNION ALL SELECT user_id, src, ix, id, title, prio FROM ot WHERE r <= 10),
  od AS (SELECT user_id, src, ix, id, title, prio FROM (SELECT *, CASE WHEN trim(coalesce(title, '')) = '' THEN 1 ELSE row_number() OVER (PARTITION BY user_id, lower(trim(coalesce(title, ''))) ORDER BY prio, src, ix) END AS nth FROM oa) WHERE nth = 1)"""


def open_items(spark: SparkSession, d: str) -> DataFrame:
    """user_id, src (0 commitment, 1 ticket), ix, id, title, prio: open commitments that are overdue by their current target (first priority) or slipped (second), and the ten first open tickets of an account."""
    prio = F.when(F.col("priority") == "p0", 0).when(F.col("priority") == "p1", 1).when(F.col("priority") == "p2", 2).otherwise(3)
    t = tickets(spark, d).filter("is_open").select("user_id", F.lit(1).alias("src"), F.col("ticket_row_id").alias("ix"), F.col("ticket_id").alias("id"), F.coalesce(F.nullif(F.trim("subject"), F.lit("")), "ticket_id").alias("title"), prio.alias("prio"))
    t = top_per_group(t, ["user_id"], [F.asc("prio"), F.asc("ix")], 10).drop("rank")
    current = table(spark, d, "commitments").select("commit_row_id", F.when(F.col("current_target_date").rlike(_ISO), F.col("current_target_date")).alias("cur"))
    late = F.coalesce(F.col("cur") < AS_OF, F.lit(False))
    c = commitments(spark, d).join(current, "commit_row_id").filter("is_open").filter(late | F.col("slipped")).select("user_id", F.lit(0).alias("src"), F.col("commit_row_id").alias("ix"), F.col("commitment_id").alias("id"), F.col("description").alias("title"), F.when(late, 0).otherwise(1).alias("prio"))
    return c.unionByName(t)


def once_by_title(items: DataFrame) -> DataFrame:
    """The first of the items of one title, whatever its case; those without title are all kept."""
    key = F.lower(F.trim(F.coalesce("title", F.lit(""))))
    keyed = items.withColumn("_key", F.when(key == "", F.concat_ws("|", F.lit("\u0001"), "src", "ix")).otherwise(key))
    return first_of(keyed, ["user_id", "_key"], ["prio", "src", "ix"]).drop("_key")


@query("q_open_items", f"WITH {TICKETS}, {COMMITMENTS}, {_OPEN_ITEMS} SELECT user_id, id, prio, row_number() OVER (PARTITION BY user_id ORDER BY prio, src, ix) AS rank FROM oa QUALIFY rank <= 30")
def q_open_items(spark: SparkSession, d: str) -> DataFrame:
    """The first 30 open items of an account, as a page shows them."""
    return top_per_group(open_items(spark, d), ["user_id"], [F.asc("prio"), F.asc("src"), F.asc("ix")], 30).select("user_id", "id", "prio", "rank")


_SIGNALS = f"""sg AS (SELECT user_id, 'ticket' AS kind, ticket_id AS id, left(CAST(loaded_at AS VARCHAR), 10) AS day, coalesce(subject, '') AS topic, ticket_row_id AS ix FROM tkt WHERE status IN ('open', 'in_progress', '')
    UNION ALL SELECT user_id, doc_type, filename, coalesce(nullif(doc_date, ''), '1970-01-01'), split_part(page_content, chr(10), 1), file_id FROM chunks WHERE is_latest_version = 1 AND doc_type IN ('transcript', 'account_notes')),
  sr AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day DESC, kind, ix) AS rank FROM sg QUALIFY rank <= 8)"""


def customer_signals(spark: SparkSession, d: str) -> DataFrame:
    """user_id, kind, id, day, topic, rank: the newest eight of an account's open tickets, transcripts and notes."""
    t = tickets(spark, d).filter(F.col("status").isin("open", "in_progress", "")).select("user_id", F.lit("ticket").alias("kind"), F.col("ticket_id").alias("id"), F.substring(F.col("loaded_at").cast("string"), 1, 10).alias("day"), F.coalesce("subject", F.lit("")).alias("topic"), F.col("ticket_row_id").alias("ix"))
    c = chunks(spark, d).filter((F.col("is_latest_version") == 1) & F.col("doc_type").isin("transcript", "account_notes"))
    c = c.select("user_id", F.col("doc_type").alias("kind"), F.col("filename").alias("id"), F.coalesce(F.nullif("doc_date", F.lit("")), F.lit("1970-01-01")).alias("day"), F.substring_index("page_content", "\n", 1).alias("topic"), F.col("file_id").alias("ix"))
    return top_per_group(t.unionByName(c), ["user_id"], [F.desc("day"), F.asc("kind"), F.asc("ix")], 8).drop("ix")


@query("q_customer_signals", f"WITH {TICKETS}, {CHUNKS}, {_SIGNALS} SELECT user_id, kind, id, rank FROM sr")
def q_customer_signals(spark: SparkSession, d: str) -> DataFrame:
    return customer_signals(spark, d).select("user_id", "kind", "id", "rank")


@query("q_anticipated", f"WITH {TICKETS}, {CHUNKS}, {_SIGNALS} SELECT user_id, md5(topic) AS topic, CASE WHEN kind = 'ticket' THEN 'high' ELSE 'medium' END AS urgency, rank FROM sr WHERE rank <= 5")
def anticipated(spark: SparkSession, d: str) -> DataFrame:
    """At most five topics of an account's newest signals; without a model each topic is its signal's first line."""
    return customer_signals(spark, d).filter("rank <= 5").select("user_id", F.md5("topic").alias("topic"), F.when(F.col("kind") == "ticket", "high").otherwise("medium").alias("urgency"), "rank")


@query("q_commitment_desc", r"SELECT commit_row_id, coalesce(nullif(trim(regexp_replace(split_part('Commitment ' || commitment_id || ': ' || coalesce(description, ''), chr(10), 1), '^Commitment\s+[^\s:]+:\s*', '')), ''), split_part('Commitment ' || commitment_id || ': ' || coalesce(description, ''), chr(10), 1)) AS by_tracker, split_part('Commitment: ' || coalesce(description, ''), chr(10), 1) AS by_sheet FROM commitments")
def q_commitment_desc(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("Commitment "), "commitment_id", F.lit(": "), F.coalesce("description", F.lit("")))
    sheet = F.concat(F.lit("Commitment: "), F.coalesce("description", F.lit("")))
    return table(spark, d, "commitments").select("commit_row_id", commitment_desc(text).alias("by_tracker"), commitment_desc(sheet).alias("by_sheet"))


def commitment_desc(content: Column) -> Column:
    """The first line of a commitment's text without its number; the line itself where nothing else stands in it. The label of a sheet has no number and stays."""
    first = F.substring_index(content, "\n", 1)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(first, r"^Commitment\s+[^\s:]+:\s*", "")), F.lit("")), first)


# --- account summary and posture ---------------------------------------------------------------------------------------

_NO_GROUNDS = "Account summary unavailable — insufficient grounding in indexed documents."


@query("q_account_summary")
def account_summary(spark: SparkSession, d: str) -> DataFrame:
    """user_id, status, n_sources, as_of, summary of each account. Without a model the summary is the first 100 words of the nearest document; an account without near documents gets a fixed text. Its grounds are checked by ``q_account_summary_docs``."""
    near = cut_lineage(q_account_summary_docs(spark, d))
    docs = table(spark, d, "documents").select("doc_id", "filename", "doc_date", "text")
    held = near.join(docs, ["doc_id"])
    words = F.split(F.trim(F.regexp_replace(F.min_by("text", "rank"), r"\s+", " ")), " ")
    cut = F.when(F.size(words) > 100, F.concat(F.array_join(F.slice(words, 1, 100), " "), F.lit("…"))).otherwise(F.array_join(words, " "))
    by = held.groupBy("customer_slug").agg(F.count_distinct("filename").alias("n_sources"), F.max("doc_date").alias("as_of"), cut.alias("summary"))
    every = table(spark, d, "accounts").select("customer_slug").join(by, "customer_slug", "left")
    return every.select(F.col("customer_slug").alias("user_id"), F.when(F.col("summary").isNull(), "empty").otherwise("ok").alias("status"), F.coalesce("n_sources", F.lit(0)).alias("n_sources"), F.coalesce("as_of", F.lit("")).alias("as_of"), F.coalesce("summary", F.lit(_NO_GROUNDS)).alias("summary"))


_SECTIONS_SQL = f"""x AS (SELECT user_id, 'overdue_commitments' AS section, commitment_id AS item, target AS day, commit_row_id AS ix, 0 AS prio FROM com WHERE overdue UNION ALL SELECT user_id, 'outstanding_commitments', commitment_id, target, commit_row_id, 0 FROM com WHERE is_open
    UNION ALL SELECT user_id, 'open_items', id, NULL, src * 1000000000 + ix, prio FROM od UNION ALL SELECT user_id, 'recent_changes', kind || ':' || id, day, CASE kind WHEN 'ticket' THEN 0 WHEN 'commitment' THEN 1 ELSE 2 END * 100 + rank, 0 FROM re2 UNION ALL SELECT user_id, 'anticipated_questions', id, day, rank, 0 FROM sr WHERE rank <= 5)"""
_ALL = f"{TICKETS}, {COMMITMENTS}, {CHUNKS}, {_CHANGES}, {_OPEN_ITEMS}, {_SIGNALS}, {_SECTIONS_SQL}"
SECTIONS = ("overdue_commitments", "outstanding_commitments", "open_items", "recent_changes", "anticipated_questions")


def brief_rows(spark: SparkSession, d: str) -> DataFrame:
    """user_id, section, item, day, ix, prio: the rows of every section of every account's brief in one plan."""
    c = commitments(spark, d)
    of = lambda df, section: df.select("user_id", F.lit(section).alias("section"), F.col("commitment_id").alias("item"), F.col("target").alias("day"), F.col("commit_row_id").cast("long").alias("ix"), F.lit(0).alias("prio"))
    o = once_by_title(open_items(spark, d)).select("user_id", F.lit("open_items").alias("section"), F.col("id").alias("item"), F.lit(None).cast("string").alias("day"), (F.col("src").cast("long") * 1000000000 + F.col("ix")).alias("ix"), "prio")
    kind = F.when(F.col("kind") == "ticket", 0).when(F.col("kind") == "commitment", 1).otherwise(2).cast("long")
    r = recent_changes(spark, d).select("user_id", F.lit("recent_changes").alias("section"), F.concat_ws(":", "kind", "id").alias("item"), "day", (kind * 100 + F.col("rank")).alias("ix"), F.lit(0).alias("prio"))
    a = customer_signals(spark, d).filter("rank <= 5").select("user_id", F.lit("anticipated_questions").alias("section"), F.col("id").alias("item"), "day", F.col("rank").alias("ix"), F.lit(0).alias("prio"))
    return reduce(DataFrame.unionByName, [of(c.filter("overdue"), SECTIONS[0]), of(c.filter("is_open"), SECTIONS[1]), o, r, a])


@query("q_posture", f"WITH {_ALL} SELECT user_id, section, item, row_number() OVER (PARTITION BY user_id, section ORDER BY prio, ix) AS rank FROM x QUALIFY rank <= 5")
def posture(spark: SparkSession, d: str) -> DataFrame:
    """What a directive is made from: the first five rows of each section."""
    return top_per_group(brief_rows(spark, d), ["user_id", "section"], [F.asc("prio"), F.asc("ix")], 5).select("user_id", "section", "item", "rank")


@query("q_pre_meeting_brief", f"""WITH {_ALL}, n AS (SELECT user_id, section, count(*) AS n_items, max(day) AS latest FROM x GROUP BY ALL) SELECT a.customer_slug AS user_id, s.section, coalesce(n.n_items, 0) AS n_items, CASE WHEN n.n_items IS NULL THEN 'empty' ELSE 'ok' END AS status, n.latest
  FROM accounts a CROSS JOIN (VALUES {', '.join(f"('{s}')" for s in SECTIONS)}) s(section) LEFT JOIN n ON n.user_id = a.customer_slug AND n.section = s.section""")
def pre_meeting_brief(spark: SparkSession, d: str) -> DataFrame:
    """Every account's brief as a row per section: how many items, its status, and the latest day in it. ``brief_rows`` has the items."""
    n = brief_rows(spark, d).groupBy("user_id", "section").agg(F.count("*").alias("n_items"), F.max("day").alias("latest"))
    every = table(spark, d, "accounts").select(F.col("customer_slug").alias("user_id"), F.explode(F.array(*map(F.lit, SECTIONS))).alias("section"))
    return every.join(n, ["user_id", "section"], "left").select("user_id", "section", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.when(F.col("n_items").isNull(), "empty").otherwise("ok").alias("status"), "latest")


@query("q_brief_types", f"""WITH {_ALL}, p AS (SELECT section, count(DISTINCT user_id) AS n FROM x GROUP BY 1) SELECT s.section, round(coalesce(p.n, 0) / (SELECT count(*) FROM accounts), 2) AS population_rate FROM (VALUES {', '.join(f"('{s}')" for s in SECTIONS)}) s(section) LEFT JOIN p ON p.section = s.section""")
def brief_types(spark: SparkSession, d: str) -> DataFrame:
    """The share of briefs in which each section has rows."""
    b = pre_meeting_brief(spark, d)
    return b.groupBy("section").agg(F.round(F.avg((F.col("n_items") > 0).cast("double")), 2).alias("population_rate"))


@query("q_brief_notes", f"WITH {_FLAGGED}, {_WARNINGS}, k AS (SELECT user_id, count(*) AS n FROM wa GROUP BY 1), q AS (SELECT user_id, count(*) AS n FROM rc WHERE trim(coalesce(claim_a, '')) <> '' AND trim(coalesce(claim_b, '')) <> '' AND claim_a <> claim_b GROUP BY 1) SELECT a.customer_slug AS user_id, coalesce(k.n, 0) AS n_warnings, coalesce(q.n, 0) AS n_conflicts FROM accounts a LEFT JOIN k ON k.user_id = a.customer_slug LEFT JOIN q ON q.user_id = a.customer_slug")
def brief_notes(spark: SparkSession, d: str) -> DataFrame:
    """How many warnings and conflicts a brief carries."""
    w = _warnings(spark, d).groupBy("user_id").agg(F.count("*").alias("w"))
    owner = table(spark, d, "commitment_snapshots").select("commitment_id", F.col("customer_slug").alias("user_id")).dropDuplicates(["commitment_id"])
    c = q_conflicts(spark, d).join(owner, "commitment_id").groupBy("user_id").agg(F.count("*").alias("c"))
    a = table(spark, d, "accounts").select(F.col("customer_slug").alias("user_id"))
    return a.join(w, "user_id", "left").join(c, "user_id", "left").select("user_id", F.coalesce("w", F.lit(0)).alias("n_warnings"), F.coalesce("c", F.lit(0)).alias("n_conflicts"))


# --- executive brief ---------------------------------------------------------------------------------------------------

_EDGE, _TAIL = r"(^|[^\p{L}\p{N}_])", r"([^\p{L}\p{N}_]|$)"
#: What is told of people: descriptions of tickets, comments as notes, documents, lines of calls.
_TOLD = """td AS (SELECT customer_slug AS user_id, 't' || ticket_row_id AS chunk_id, 'ticket' AS kind, left(CAST(loaded_at AS VARCHAR), 10) AS day, lower(description) AS low FROM tickets WHERE description IS NOT NULL
    UNION ALL SELECT customer_slug, 'c' || comment_row_id, 'account_notes', left(CAST(loaded_at AS VARCHAR), 10), lower(body) FROM ticket_comments WHERE body IS NOT NULL UNION ALL SELECT customer_slug, 'd' || doc_id, doc_type, coalesce(nullif(doc_date, ''), '1970-01-01'), lower(text) FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT t.customer_slug, 'l' || t.turn_row_id, 'transcript', left(CAST(c.call_day AS VARCHAR), 10), lower(t.text) FROM turns t JOIN calls c ON c.call_id = t.call_id WHERE t.text IS NOT NULL)"""


def told(spark: SparkSession, d: str) -> DataFrame:
    """user_id, chunk_id, kind, day, text."""
    part = lambda name, mark, i, kind, day, text: table(spark, d, name).select(F.col("customer_slug").alias("user_id"), F.concat(F.lit(mark), F.col(i).cast("string")).alias("chunk_id"), kind.alias("kind"), day.alias("day"), F.col(text).alias("text"))
    day = F.substring(F.col("loaded_at").cast("string"), 1, 10)
    t = part("tickets", "t", "ticket_row_id", F.lit("ticket"), day, "description").unionByName(part("ticket_comments", "c", "comment_row_id", F.lit("account_notes"), day, "body"))
    t = t.unionByName(part("documents", "d", "doc_id", F.col("doc_type"), F.coalesce(F.nullif("doc_date", F.lit("")), F.lit("1970-01-01")), "text"))
    days = table(spark, d, "calls").select("call_id", F.substring(F.col("call_day").cast("string"), 1, 10).alias("day"))
    lines = table(spark, d, "turns").join(days, "call_id").select(F.col("customer_slug").alias("user_id"), F.concat(F.lit("l"), F.col("turn_row_id").cast("string")).alias("chunk_id"), F.lit("transcript").alias("kind"), "day", "text")
    return t.unionByName(lines).filter("text IS NOT NULL")


def _tiers_sql(source: str, where: str) -> str:
    says = lambda c: f"regexp_matches(s.low, '{_EDGE}' || regexp_escape({c}) || '{_TAIL}')"
    return f"""SELECT * FROM (SELECT user_id, person, chunk_id, kind, day, tier, min(tier) OVER (PARTITION BY user_id, person) AS best FROM (SELECT s.user_id, s.chunk_id, s.kind, s.day, p.low AS person, CASE WHEN {says('p.low')} THEN 1 WHEN contains(p.low, ' ') AND {says("split_part(p.low, ' ', 1)")} THEN CASE WHEN {says("string_split(p.low, ' ')[-1]")} THEN 2 WHEN s.kind = 'transcript' THEN 3 END END AS tier
    FROM {source} s JOIN pe p ON p.customer_slug = s.user_id {where}) WHERE tier IS NOT NULL) WHERE tier = best"""


def _exec_sql(kinds: tuple[str, ...] | None, start: str, k: int) -> str:
    cond = (f"WHERE s.kind IN ({_in(kinds)}) AND " if kinds else "WHERE ") + start
    return f"WITH {_PEOPLE}, {_TOLD}, {_SINCE}, m AS ({_tiers_sql('td', cond)}) SELECT user_id, person, chunk_id, tier, row_number() OVER (PARTITION BY user_id, person ORDER BY day DESC, chunk_id) AS rank FROM m QUALIFY rank <= {k}"


_YEAR_AGO = "2024-06-30"


def _exec(chunks_: DataFrame, spark: SparkSession, d: str, k: int) -> DataFrame:
    found = person_tiers(chunks_.withColumnRenamed("user_id", "tenant"), people(spark, d).select(F.col("customer_slug").alias("tenant"), F.col("low").alias("person")), ["kind", "day"])
    return top_per_group(found.withColumnRenamed("tenant", "user_id"), ["user_id", "person"], [F.desc("day"), F.asc("chunk_id")], k).select("user_id", "person", "chunk_id", "tier", "rank")


@query("q_exec_role_tenure", _exec_sql(("account_notes",), "true", 6))
def exec_role_tenure(spark: SparkSession, d: str) -> DataFrame:
    """The notes on each person of an account, the six newest. (The similarity search that would follow them needs a model.)"""
    return _exec(told(spark, d).filter("kind = 'account_notes'"), spark, d, 6)


@query("q_exec_stated_position", _exec_sql(("transcript", "account_notes", "qbr_deck"), f"s.day >= '{_YEAR_AGO}'", 15))
def exec_stated_position(spark: SparkSession, d: str) -> DataFrame:
    return _exec(told(spark, d).filter(F.col("kind").isin("transcript", "account_notes", "qbr_deck") & (F.col("day") >= _YEAR_AGO)), spark, d, 15)


@query("q_exec_open_asks", _exec_sql(("transcript", "account_notes"), f"s.day >= '{_YEAR_AGO}'", 15))
def exec_open_asks(spark: SparkSession, d: str) -> DataFrame:
    return _exec(told(spark, d).filter(F.col("kind").isin("transcript", "account_notes") & (F.col("day") >= _YEAR_AGO)), spark, d, 15)


@query("q_exec_recent_signals", _exec_sql(None, "s.kind <> 'ticket' AND s.day >= coalesce((SELECT nullif(last_call_date, '') FROM accounts a WHERE a.customer_slug = s.user_id), '1970-01-01')", 6))
def exec_recent_signals(spark: SparkSession, d: str) -> DataFrame:
    """What was told of a person since the account's last call (ever, without one), tickets aside, the six newest."""
    last = table(spark, d, "accounts").select(F.col("customer_slug").alias("user_id"), F.coalesce(F.nullif("last_call_date", F.lit("")), F.lit("1970-01-01")).alias("since"))
    t = told(spark, d).filter("kind <> 'ticket'").join(last, "user_id").filter("day >= since").drop("since")
    return _exec(t, spark, d, 6)


@query("q_exec_brief")
def exec_brief(spark: SparkSession, d: str) -> DataFrame:
    """user_id, person, and the rows each section has; the approach is made from three of each, and is empty where there is none. The sections have oracles of their own."""
    part = lambda df, section: df.select("user_id", "person", F.lit(section).alias("section"))
    rows = reduce(DataFrame.unionByName, [part(exec_stated_position(spark, d), "stated_position"), part(exec_recent_signals(spark, d), "recent_signals"), part(exec_open_asks(spark, d), "open_asks"), part(exec_role_tenure(spark, d), "role_and_tenure")])
    n = lambda s: F.count_if(F.col("section") == s).alias(s)
    every = people(spark, d).select(F.col("customer_slug").alias("user_id"), F.col("low").alias("person"))
    counted = rows.groupBy("user_id", "person").agg(*map(n, ("role_and_tenure", "stated_position", "recent_signals", "open_asks")))
    filled = every.join(counted, ["user_id", "person"], "left").fillna(0)
    inputs = sum((F.least(F.col(c), F.lit(3)) for c in ("stated_position", "recent_signals", "open_asks")), F.lit(0))
    return filled.withColumn("approach_inputs", inputs).withColumn("approach", F.when(inputs == 0, "empty").otherwise("ok"))



