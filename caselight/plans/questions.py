"""What a question asks for: intent, predicates, recency, rewriting, missing types; and the guard that comes before any read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators.ranking import top_per_group
from caselight.operators.text import alternatives
from caselight.plans.frames import CHUNKS, COMMITMENTS, TICKETS, chunks, commitments, tickets
from caselight.tables import table

# The words by which a question is told to be about commitments, tickets, or what is recent or overdue.
COMMITMENT_WORDS = ("commitment", "commitments", "committed", "promise", "promised", "deliverable", "deliverables", "milestone", "milestones", "overdue", "slipped", "slip", "deadline", r"due\s+date", r"target\s+date", "delivered", "delivery", "outstanding")
TICKET_WORDS = ("ticket", "tickets", "issue", "issues", "bug", "bugs", "incident", "incidents", r"support\s+case", r"open\s+ticket", r"open\s+issue", "P0", "P1", "P2", "escalation", "escalated")
RECENT_WORDS = ("recent", "latest", "last (?:call|meeting|week|month|quarter|year)", "yesterday", "today", "this (?:week|month|quarter|year)", "current", "new(?:est)?", "since", "most recent", "just", "lately")
OVERDUE_WORDS = ("overdue", r"past[\s_-]?due", r"behind[\s_-]?schedule", r"missed[\s_-]?deadline", "slipped", r"late[\s_-]?commitment")
RELATIONAL_WORDS = ("agreed?", "committed?", "promised?", "told", "said", "confirmed?", "denied?", "refused?", "stated?", "approved?", "rejected?", "escalated?")

RECENT, RECENT_SQL = "(?iu)" + alternatives(RECENT_WORDS), "(?i)" + alternatives(RECENT_WORDS)
_OVERDUE_QUERY = "OVERDUE commitment overdue by days tracker"

#: Typed questions of the tables: what the evaluation asks, and the subjects under which tickets were opened.
ASKED = "asked AS (SELECT 'item' AS src, item_id AS id, question AS q FROM eval_items UNION ALL SELECT 'ticket', ticket_row_id, subject FROM tickets UNION ALL SELECT 'commitment', commit_row_id, description FROM commitments)"


def asked(spark: SparkSession, d: str) -> DataFrame:
    part = lambda name, src, i, q: table(spark, d, name).select(F.lit(src).alias("src"), F.col(i).alias("id"), F.col(q).alias("q"))
    return part("eval_items", "item", "item_id", "question").unionByName(part("tickets", "ticket", "ticket_row_id", "subject")).unionByName(part("commitments", "commitment", "commit_row_id", "description"))


def intent_of(q: Column) -> Column:
    """``commitment`` or ``ticket``, whichever has more words in ``q``; ``semantic`` on a tie, for none, and for null."""
    text = F.coalesce(q, F.lit(""))
    c, t = (F.regexp_count(text, F.lit("(?iu)" + alternatives(words))) for words in (COMMITMENT_WORDS, TICKET_WORDS))
    return F.when(c > t, "commitment").when(t > c, "ticket").otherwise("semantic")


_COUNT = "len(regexp_extract_all(coalesce(q, ''), '(?i){0}'))"
_INTENT = f"CASE WHEN {_COUNT.format(alternatives(COMMITMENT_WORDS))} > {_COUNT.format(alternatives(TICKET_WORDS))} THEN 'commitment' WHEN {_COUNT.format(alternatives(TICKET_WORDS))} > {_COUNT.format(alternatives(COMMITMENT_WORDS))} THEN 'ticket' ELSE 'semantic' END"


@query("q_intent", f"WITH {ASKED} SELECT src, id, {_INTENT} AS intent FROM asked")
def intent(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("src", "id", intent_of(F.col("q")).alias("intent"))


@query("q_wants_recency", f"WITH {ASKED} SELECT src, id, regexp_matches(coalesce(q, ''), '{RECENT_SQL}') AS wants FROM asked")
def wants_recency(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("src", "id", F.coalesce("q", F.lit("")).rlike(RECENT).alias("wants"))


@query("q_should_judge", f"WITH {ASKED} SELECT src, id, regexp_matches(coalesce(q, ''), '(?i){alternatives(RELATIONAL_WORDS)}') OR len(regexp_extract_all(coalesce(q, ''), '[.!?]')) > 3 AS judged, true AS judged_unsure FROM asked")
def should_judge(spark: SparkSession, d: str) -> DataFrame:
    """Whether the claims of an answer go to the judge: with a faithfulness of 0.9 and as many claims as sentences, and with one of 0.5."""
    q = F.coalesce("q", F.lit(""))
    return asked(spark, d).select("src", "id", *[judged(q, F.lit(f), F.regexp_count(q, F.lit("[.!?]"))).alias(n) for n, f in (("judged", 0.9), ("judged_unsure", 0.5))])


def judged(q: Column, faithfulness: Column, n_claims: Column, always: bool = False) -> Column:
    """Always, below a faithfulness of 0.7, for a relational verb in the question, or for more than three claims."""
    return F.lit(always) | (faithfulness < 0.7) | F.coalesce(q, F.lit("")).rlike("(?iu)" + alternatives(RELATIONAL_WORDS)) | (n_claims > 3)


def sub_queries(q: Column, rewritten: Column | None = None) -> Column:
    """At most four sub-queries: those of a rewriter (an array column), or the question alone; a question about what is overdue puts a fixed one before the first three."""
    given = F.array(F.coalesce(q, F.lit("")))
    if rewritten is not None:
        kept = F.slice(F.filter(rewritten, lambda s: F.trim(s) != ""), 1, 4)
        given = F.when(F.size(kept) > 0, kept).otherwise(given)
    first = F.lit(_OVERDUE_QUERY)
    late = F.coalesce(q, F.lit("")).rlike("(?iu)" + alternatives(OVERDUE_WORDS)) & ~F.array_contains(given, first)
    return F.when(late, F.concat(F.array(first), F.slice(given, 1, 3))).otherwise(given)


@query("q_query_rewrite", f"WITH {ASKED} SELECT src, id, CASE WHEN regexp_matches(coalesce(q, ''), '(?i){alternatives(OVERDUE_WORDS)}') THEN '{_OVERDUE_QUERY} | ' ELSE '' END || coalesce(q, '') AS sub_queries FROM asked")
def query_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return asked(spark, d).select("src", "id", F.array_join(sub_queries(F.col("q")), " | ").alias("sub_queries"))


# Month names and their numbers.
MONTHS = {
    "january": "01", "jan": "01", "february": "02", "feb": "02", "march": "03", "mar": "03", "april": "04", "apr": "04", "may": "05", "june": "06", "jun": "06", "july": "07", "jul": "07",
    "august": "08", "aug": "08", "september": "09", "sep": "09", "sept": "09", "october": "10", "oct": "10", "november": "11", "nov": "11", "december": "12", "dec": "12",
}
_OPEN_WORDS, _DONE_WORDS = r"\b(open|outstanding|pending|in.progress)\b", r"\b(delivered|completed|closed|done|resolved)\b"
_LIVE_WORDS, _SHUT_WORDS = r"\b(open|active|in.progress|unresolved)\b", r"\b(closed|resolved|done|fixed|completed)\b"
_BEFORE, _AFTER, _QUARTER = r"\bbefore\s+(\w+)\s+(\d{4})\b", r"\b(?:after|since)\s+(\w+)\s+(\d{4})\b", r"\bq([1-4])\s+(\d{4})\b"


def predicates(q: Column) -> Column:
    """The predicates a question states, as a struct: overdue, open, slipped, due_from, due_before (of commitments), ticket_open, priority (of tickets); null where it states none.

    Of two lower bounds (a month and a quarter) the later holds, of two upper bounds the earlier."""
    low = F.lower(F.coalesce(q, F.lit("")))
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    says = lambda p: low.rlike(p)
    month = lambda p: F.try_element_at(names, F.regexp_extract(low, p, 1))
    first_day = lambda p: F.when(month(p).isNotNull(), F.concat(F.regexp_extract(low, p, 2), F.lit("-"), month(p), F.lit("-01")))
    quarter, year = F.regexp_extract(low, _QUARTER, 1).try_cast("int"), F.regexp_extract(low, _QUARTER, 2).try_cast("int")
    start = F.when(quarter.isNotNull(), F.concat(year.cast("string"), F.lit("-"), F.lpad((quarter * 3 - 2).cast("string"), 2, "0"), F.lit("-01")))
    end = F.when(quarter == 4, F.concat((year + 1).cast("string"), F.lit("-01-01"))).when(quarter.isNotNull(), F.concat(year.cast("string"), F.lit("-"), F.lpad((quarter * 3 + 1).cast("string"), 2, "0"), F.lit("-01")))
    later, earlier = F.greatest(first_day(_AFTER), start), F.least(first_day(_BEFORE), end)
    priority = F.when(says(r"\bp0\b"), "P0").when(says(r"\bp1\b"), "P1").when(says(r"\bp2\b"), "P2")
    return F.struct(
        F.when(says(r"\boverdue\b"), True).alias("overdue"), F.when(says(_OPEN_WORDS), True).when(says(_DONE_WORDS), False).alias("open"), F.when(says(r"\b(slipped|slip)\b"), True).alias("slipped"),
        later.alias("due_from"), earlier.alias("due_before"), F.when(says(_LIVE_WORDS), True).when(says(_SHUT_WORDS), False).alias("ticket_open"), priority.alias("priority"),
    )


def _first_day_sql(p: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MONTHS.items())
    return f"regexp_extract(l, '{p}', 2) || '-' || (CASE regexp_extract(l, '{p}', 1) {cases} END) || '-01'"


_QN, _QY = f"TRY_CAST(regexp_extract(l, '{_QUARTER}', 1) AS INTEGER)", f"TRY_CAST(regexp_extract(l, '{_QUARTER}', 2) AS INTEGER)"
_PREDICATES = f"""CASE WHEN regexp_matches(l, '\\boverdue\\b') THEN true END AS overdue, CASE WHEN regexp_matches(l, '{_OPEN_WORDS}') THEN true WHEN regexp_matches(l, '{_DONE_WORDS}') THEN false END AS open,
  CASE WHEN regexp_matches(l, '\\b(slipped|slip)\\b') THEN true END AS slipped, greatest({_first_day_sql(_AFTER)}, {_QY} || '-' || lpad(CAST({_QN} * 3 - 2 AS VARCHAR), 2, '0') || '-01') AS due_from,
  least({_first_day_sql(_BEFORE)}, CASE WHEN {_QN} = 4 THEN ({_QY} + 1) || '-01-01' ELSE {_QY} || '-' || lpad(CAST({_QN} * 3 + 1 AS VARCHAR), 2, '0') || '-01' END) AS due_before,
  CASE WHEN regexp_matches(l, '{_LIVE_WORDS}') THEN true WHEN regexp_matches(l, '{_SHUT_WORDS}') THEN false END AS ticket_open,
  CASE WHEN regexp_matches(l, '\\bp0\\b') THEN 'P0' WHEN regexp_matches(l, '\\bp1\\b') THEN 'P1' WHEN regexp_matches(l, '\\bp2\\b') THEN 'P2' END AS priority"""
#: Questions that state predicates, beside the typed ones, of which few do.
STATED = ("Which commitments are overdue in Q4 2024?", "open commitments before April 2025", "What was delivered since March 2024 that slipped?", "closed P1 tickets", "active P0 issues", "Which deadline falls after sept 2024 in q2 2025?", "all promised deliverables", "outstanding and overdue milestones since June 2023", "resolved bugs", "P2 incidents in progress", "what changed today?")
_STATED_SQL = "stated AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(STATED)) + ") v(id, q))"


def stated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(STATED)), "id int, q string")


@query("q_nl_filters", f"WITH {ASKED}, {_STATED_SQL}, l AS (SELECT src, id, lower(coalesce(q, '')) AS l FROM asked UNION ALL SELECT 'stated', id, lower(q) FROM stated) SELECT src, id, {_PREDICATES} FROM l")
def nl_filters(spark: SparkSession, d: str) -> DataFrame:
    every = asked(spark, d).unionByName(stated(spark).select(F.lit("stated").alias("src"), F.col("id").cast("long").alias("id"), "q"))
    return every.select("src", "id", predicates(F.col("q")).alias("p")).select("src", "id", "p.*")


@query("q_nl_retrieve", f"""WITH {COMMITMENTS}, {TICKETS}, {_STATED_SQL}, l AS (SELECT id, q, lower(q) AS l FROM stated), p AS (SELECT id, {_INTENT} AS intent, {_PREDICATES} FROM l),
  c AS (SELECT p.id, c.user_id, c.commitment_id AS item, c.last_updated AS changed, c.commit_row_id AS ix FROM p JOIN com c ON p.intent = 'commitment' AND (p.overdue IS NULL OR c.overdue) AND (p.open IS NULL OR c.is_open = p.open) AND (p.slipped IS NULL OR c.slipped) AND (p.due_from IS NULL OR c.target >= p.due_from) AND (p.due_before IS NULL OR c.target < p.due_before)
    UNION ALL SELECT p.id, t.user_id, t.ticket_id, CAST(t.loaded_at AS VARCHAR), t.ticket_row_id FROM p JOIN tkt t ON p.intent = 'ticket' AND (p.ticket_open IS NULL OR t.is_open = p.ticket_open) AND (p.priority IS NULL OR t.priority = lower(p.priority)))
  SELECT id, user_id, item, row_number() OVER (PARTITION BY id, user_id ORDER BY changed DESC, ix) AS rank FROM c QUALIFY rank <= 30""")
def nl_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """The rows that meet a question's predicates, at most 30 of an account, the newest first.

    The stated questions are a short literal list, so each is folded into its own filter over one scan: a flag array, exploded, instead of a join of questions and rows."""
    stated_rows = stated(spark).select("id", intent_of(F.col("q")).alias("intent"), predicates(F.col("q")).alias("p")).collect()  # a literal list

    def meets(r, row: dict) -> Column:  # noqa: ANN001
        out = F.lit(True)
        for name, cond in row.items():
            if r.p[name] is not None:
                out = out & cond(r.p[name])
        return F.when(F.coalesce(out, F.lit(False)), F.lit(r.id))

    of_commitment = {"overdue": lambda v: F.col("overdue"), "open": lambda v: F.col("is_open") == v, "slipped": lambda v: F.col("slipped"), "due_from": lambda v: F.col("target") >= v, "due_before": lambda v: F.col("target") < v}
    of_ticket = {"ticket_open": lambda v: F.col("is_open") == v, "priority": lambda v: F.col("priority") == v.lower()}
    wanted = lambda kind, row: F.explode(F.array_compact(F.array(*[meets(r, row) for r in stated_rows if r.intent == kind]))).alias("id")
    c = commitments(spark, d).select(wanted("commitment", of_commitment), "user_id", F.col("commitment_id").alias("item"), F.col("last_updated").alias("changed"), F.col("commit_row_id").alias("ix"))
    t = tickets(spark, d).select(wanted("ticket", of_ticket), "user_id", F.col("ticket_id").alias("item"), F.col("loaded_at").cast("string").alias("changed"), F.col("ticket_row_id").alias("ix"))
    return top_per_group(c.unionByName(t), ["id", "user_id"], [F.desc_nulls_last("changed"), F.asc("ix")], 30).select("id", "user_id", "item", "rank")


# Words of a question with the document type that would answer it.
HINTS = (
    (("sla", "uptime", "availability", "commitment", "promised", "deliver"), "commitment_tracker"),
    (("ticket", "bug", "issue", "incident", "outage", "error", "p0", "p1"), "ticket"),
    (("call", "meeting", "said", "transcript", "discussed", "agreed"), "transcript"),
    (("architecture", "design", "integration", "solution", "infra"), "solution_architecture"),
    (("notes", "account", "crm", "internal"), "account_notes"),
)


def missing_hints(q: Column, held: Column, k: int = 3) -> Column:
    """The document types (at most ``k``) that the words of ``q`` hint at and that are not in the array ``held``."""
    low = F.lower(F.coalesce(q, F.lit("")))
    hints = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(kind)) for words, kind in HINTS]
    return F.slice(F.array_except(F.array_compact(F.array(*hints)), F.coalesce(held, F.array().cast("array<string>"))), 1, k)


_HINTS_SQL = "[" + ", ".join(f"CASE WHEN {' OR '.join(f'contains(lower(coalesce(t.subject, {chr(39) * 2})), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{kind}' END" for words, kind in HINTS) + "]"


@query("q_missing_hints", f"""WITH {CHUNKS}, h AS (SELECT user_id, list(DISTINCT doc_type) AS held FROM chunks WHERE is_latest_version = 1 GROUP BY user_id)
  SELECT t.ticket_row_id, array_to_string(list_filter({_HINTS_SQL}, lambda x: x IS NOT NULL AND NOT coalesce(list_contains(h.held, x), false))[1:3], ';') AS missing FROM tickets t LEFT JOIN h ON h.user_id = t.customer_slug""")
def q_missing_hints(spark: SparkSession, d: str) -> DataFrame:
    """The types that a ticket's subject hints at and that its account has no current document of."""
    held = chunks(spark, d).filter("is_latest_version = 1").groupBy("user_id").agg(F.collect_set("doc_type").alias("held"))  # at most six types
    t = table(spark, d, "tickets").select("ticket_row_id", F.col("customer_slug").alias("user_id"), "subject").join(held, "user_id", "left")
    return t.select("ticket_row_id", F.array_join(missing_hints(F.col("subject"), F.col("held")), ";").alias("missing"))


def require_tenant(tenant: str | None) -> str:
    """``tenant``, or an error before any read if it is null or blank."""
    if tenant is None or not tenant.strip():
        raise ValueError("a tenant is required")
    return tenant


def of_tenant(df: DataFrame, tenant: str | None, column: str = "user_id") -> DataFrame:
    """The rows of one tenant; the filter reaches the scan."""
    return df.filter(F.col(column) == require_tenant(tenant))


@query("q_tenant_guard", "SELECT doc_id, customer_slug, doc_type FROM documents WHERE customer_slug = 'northquay'")
def tenant_guard(spark: SparkSession, d: str) -> DataFrame:
    return of_tenant(table(spark, d, "documents"), "northquay", "customer_slug").select("doc_id", "customer_slug", "doc_type")


@query("q_retrieve_node", f"""WITH {ASKED}, i AS (SELECT id, {_INTENT} AS intent FROM asked WHERE src = 'ticket'), {CHUNKS},
  a AS (SELECT t.ticket_row_id AS id, t.customer_slug AS user_id, CASE i.intent WHEN 'commitment' THEN 'commitment_tracker' WHEN 'ticket' THEN 'ticket' END AS wanted FROM tickets t JOIN i ON i.id = t.ticket_row_id),
  r AS (SELECT user_id, doc_type, file_id, md5(page_content) AS content, row_number() OVER (PARTITION BY user_id, doc_type ORDER BY coalesce(doc_date, '1970-01-01') DESC, file_id) AS rank FROM chunks WHERE is_latest_version = 1 AND doc_type IN ('commitment_tracker', 'ticket') QUALIFY rank <= 30),
  f AS (SELECT a.id, r.file_id, r.rank, row_number() OVER (PARTITION BY a.id, r.content ORDER BY r.rank) AS nth FROM a JOIN r ON r.user_id = a.user_id AND r.doc_type = a.wanted)
  SELECT id, file_id, 'C' || row_number() OVER (PARTITION BY id ORDER BY rank) AS chunk_id FROM f WHERE nth = 1 UNION ALL SELECT a.id, NULL AS file_id, 'semantic' AS chunk_id FROM a WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.id = a.id)""")
def retrieve_node(spark: SparkSession, d: str) -> DataFrame:
    """The structured branch of retrieval for each ticket's subject: documents of the type it is about, the newest 30, each content once, numbered C1, C2, …; a subject without any goes to the semantic branch (``q_hybrid_full``) and is marked so."""
    kind = F.when(intent_of(F.col("subject")) == "commitment", "commitment_tracker").when(intent_of(F.col("subject")) == "ticket", "ticket")
    a = table(spark, d, "tickets").select(F.col("ticket_row_id").alias("id"), F.col("customer_slug").alias("user_id"), kind.alias("doc_type"))
    c = chunks(spark, d).filter((F.col("is_latest_version") == 1) & F.col("doc_type").isin("commitment_tracker", "ticket")).withColumn("_date", F.coalesce("doc_date", F.lit("1970-01-01")))
    newest = top_per_group(c, ["user_id", "doc_type"], [F.desc("_date"), F.asc("file_id")], 30).select("user_id", "doc_type", "file_id", F.md5("page_content").alias("content"), "rank")
    # Each content once per list, before the lists are multiplied by the questions.
    newest = top_per_group(newest.withColumnRenamed("rank", "_r"), ["user_id", "doc_type", "content"], [F.asc("_r")], 1).drop("rank")
    newest = top_per_group(newest, ["user_id", "doc_type"], [F.asc("_r")], 30)
    found = a.join(newest, ["user_id", "doc_type"], "left")
    return found.select("id", "file_id", F.when(F.col("file_id").isNull(), "semantic").otherwise(F.concat(F.lit("C"), F.col("rank").cast("string"))).alias("chunk_id"))
