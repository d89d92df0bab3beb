"""Domain frames over the tables, and the same frames as SQL for the oracles. Every query takes the fixed date AS_OF."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.tables import table

AS_OF = "2025-06-30"

# The six document types, and the statuses after which a ticket or commitment is closed.
DOC_TYPES = ("account_notes", "commitment_tracker", "qbr_deck", "solution_architecture", "ticket", "transcript")
TERMINAL_TICKETS = ("closed", "resolved", "done", "complete", "completed", "fixed", "won't fix", "wontfix", "duplicate", "cancelled", "canceled", "rejected", "invalid")
TERMINAL_COMMITMENTS = ("delivered", "deferred", "closed", "resolved", "done", "complete", "completed", "cancelled", "canceled", "won't_do")


# Raw statuses of tickets and of commitments with their canonical form.
STATUS = {
    "new": "open", "todo": "open", "backlog": "open", "wip": "in_progress", "in-progress": "in_progress", "in progress": "in_progress", "started": "in_progress", "working": "in_progress", "active": "in_progress", "investigating": "in_progress",
    "done": "closed", "complete": "closed", "completed": "closed", "resolved": "closed", "fixed": "closed", "won't fix": "closed", "wontfix": "closed", "duplicate": "closed", "cancelled": "closed", "canceled": "closed", "rejected": "closed", "invalid": "closed",
}
COMMITMENT_STATUS = {
    "wip": "in_progress", "in-progress": "in_progress", "in progress": "in_progress", "started": "in_progress", "working": "in_progress", "open": "active", "new": "active", "pending": "active", "on-hold": "deferred", "on_hold": "deferred", "blocked": "deferred", "hold": "deferred",
    "done": "delivered", "complete": "delivered", "completed": "delivered", "closed": "delivered", "resolved": "delivered", "fixed": "delivered", "cancelled": "deferred", "canceled": "deferred", "won't_do": "deferred", "wontdo": "deferred",
}
# Days after which a document of a type is stale.
STALE_DAYS = {"transcript": 30, "ticket": 30, "commitment_tracker": 14, "account_notes": 30, "qbr_deck": 90, "solution_architecture": 180}


def mapped(c: Column, names: dict) -> Column:
    """The value of ``c`` in ``names``, else ``c``."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), c), c)


def case_sql(c: str, names: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in names.items()) + f" ELSE {c} END"


def quoted(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def plain(c: str) -> Column:
    return F.lower(F.trim(F.coalesce(F.col(c), F.lit(""))))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """One chunk per document, flagged 1 where it is the latest of its tenant, type and file name."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.col("customer_slug").alias("user_id"), "filename", F.col("text").alias("page_content"), "doc_type", "doc_date")
    key = ["user_id", "doc_type", "filename"]
    newest = docs.groupBy(*key).agg(F.max("file_id").alias("newest"))
    return docs.join(newest, key).select("file_id", *key, "page_content", "doc_date", F.when(F.col("file_id") == F.col("newest"), 1).otherwise(0).alias("is_latest_version"))


CHUNKS = """chunks AS (SELECT doc_id AS file_id, customer_slug AS user_id, doc_type, filename, text AS page_content, doc_date,
  CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY customer_slug, doc_type, filename) THEN 1 ELSE 0 END AS is_latest_version FROM documents)"""


def tickets(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each ticket, with plain status and priority and whether it is open."""
    t = table(spark, d, "tickets")
    last = t.groupBy("ticket_id").agg(F.max_by("ticket_row_id", F.struct("loaded_at", "ticket_row_id")).alias("ticket_row_id"))
    t = t.join(last, ["ticket_id", "ticket_row_id"])
    return t.select(
        "ticket_row_id", "ticket_id", F.col("customer_slug").alias("user_id"), "subject", "description", plain("status").alias("status"), F.regexp_replace(plain("priority"), "[- ]", "").alias("priority"), "assignee", "reporter", "resolution", "loaded_at"
    ).withColumn("is_open", ~F.col("status").isin(*TERMINAL_TICKETS))


TICKETS = f"""tkt AS (SELECT ticket_row_id, ticket_id, customer_slug AS user_id, subject, description, lower(trim(coalesce(status, ''))) AS status,
  regexp_replace(lower(trim(coalesce(priority, ''))), '[- ]', '', 'g') AS priority, assignee, reporter, resolution, loaded_at,
  lower(trim(coalesce(status, ''))) NOT IN ({quoted(TERMINAL_TICKETS)}) AS is_open
  FROM tickets QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY loaded_at DESC, ticket_row_id DESC) = 1)"""

_ISO = r"^\d{4}-\d{2}-\d{2}$"


def commitments(spark: SparkSession, d: str) -> DataFrame:
    """The latest delivery of each commitment; target is the current target where it is an ISO date, else the promised date; overdue if open and due before AS_OF."""
    c = table(spark, d, "commitments")
    last = c.groupBy("commitment_id").agg(F.max_by("commit_row_id", F.struct("loaded_at", "commit_row_id")).alias("commit_row_id"))
    c = c.join(last, ["commitment_id", "commit_row_id"]).withColumn("status", plain("status"))
    target = F.when(F.col("current_target_date").rlike(_ISO), F.col("current_target_date")).otherwise(F.col("promised_date"))
    c = c.withColumn("target", target).withColumn("is_open", ~F.col("status").isin(*TERMINAL_COMMITMENTS))
    slipped = F.coalesce(F.col("is_slipped"), F.col("target") > F.col("promised_date"), F.lit(False))
    c = c.withColumns({"slipped": slipped, "overdue": F.coalesce(F.col("is_open") & (F.col("target") < AS_OF), F.lit(False))})
    return c.select("commit_row_id", "commitment_id", F.col("customer_slug").alias("user_id"), "description", "promised_date", "target", "status", "owner", "source_doc", "last_updated", "is_open", "slipped", "overdue", F.coalesce("customer_aware", F.lit(False)).alias("customer_aware"))


COMMITMENTS = rf"""com AS (SELECT *, coalesce(is_open AND target < '{AS_OF}', false) AS overdue FROM (SELECT commit_row_id, commitment_id, user_id, description, promised_date, target, status, owner, source_doc, last_updated,
  status NOT IN ({quoted(TERMINAL_COMMITMENTS)}) AS is_open, coalesce(is_slipped, target > promised_date, false) AS slipped, coalesce(customer_aware, false) AS customer_aware FROM (
  SELECT commit_row_id, commitment_id, customer_slug AS user_id, description, promised_date, CASE WHEN regexp_matches(current_target_date, '{_ISO}') THEN current_target_date ELSE promised_date END AS target,
  lower(trim(coalesce(status, ''))) AS status, owner, source_doc, last_updated, is_slipped, customer_aware
  FROM commitments QUALIFY row_number() OVER (PARTITION BY commitment_id ORDER BY loaded_at DESC, commit_row_id DESC) = 1) AS typed))"""


def logs(spark: SparkSession, d: str) -> DataFrame:
    """Events as an application log: an error is an escalation, the value its confidence."""
    e = table(spark, d, "events")
    return e.select("event_id", F.col("user_id"), F.col("ts").alias("created_at"), F.col("event_type").alias("node"), F.col("value").alias("elapsed_ms"), (F.col("event_type") == "error").cast("int").alias("escalated"))


LOGS = "logs AS (SELECT event_id, user_id, ts AS created_at, event_type AS node, value AS elapsed_ms, CAST(event_type = 'error' AS INTEGER) AS escalated FROM events)"
