"""The queries of the general data problems (1, 3 and 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators.history import version_history
from caselight.operators.nested import comment_table, nodes, said, ticket_table
from caselight.operators.timestamps import normalise_timestamps
from caselight.tables import table


@query("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return comment_table(nodes(table(spark, d, "raw_tickets"))).filter(said()).select("raw_id", "ticket_id", "comment_path", "parent_path", "author")


@query("p1_tickets")
def p1_tickets(spark: SparkSession, d: str) -> DataFrame:
    return ticket_table(nodes(table(spark, d, "raw_tickets")))


@query("p1_comments")
def p1_comments(spark: SparkSession, d: str) -> DataFrame:
    return comment_table(nodes(table(spark, d, "raw_tickets")))


@query("p1_variants")
def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    return nodes(table(spark, d, "raw_tickets")).groupBy("node_kind", "variant").agg(F.count("*").alias("n_nodes"), F.countDistinct("raw_id").alias("n_records"))


_SNAPSHOT_SQL = """
WITH u AS (
  SELECT commitment_id, coalesce(try_cast(left(trim(last_updated), 10) AS DATE), CAST(loaded_at AS DATE)) AS d, loaded_at, snapshot_row_id,
    regexp_replace(lower(trim(coalesce(promised_date, ''))), '^(\\d{4}-\\d{2}-\\d{2})[t ]00:00(:00(\\.0+)?)?z?$', '\\1') AS promised_date,
    regexp_replace(lower(trim(coalesce(current_target_date, ''))), '^(\\d{4}-\\d{2}-\\d{2})[t ]00:00(:00(\\.0+)?)?z?$', '\\1') AS current_target_date,
    regexp_replace(lower(trim(coalesce(status, ''))), '^(\\d{4}-\\d{2}-\\d{2})[t ]00:00(:00(\\.0+)?)?z?$', '\\1') AS status
  FROM commitment_snapshots WHERE commitment_id IS NOT NULL),
h AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY commitment_id, d ORDER BY loaded_at DESC, snapshot_row_id DESC) = 1),
b AS (SELECT *, lag(promised_date || '|' || current_target_date || '|' || status) OVER (PARTITION BY commitment_id ORDER BY d) AS before FROM h),
v AS (SELECT * FROM b WHERE before IS NULL OR before <> promised_date || '|' || current_target_date || '|' || status)
SELECT commitment_id, row_number() OVER w AS version_no, CAST(d AS VARCHAR) AS valid_from, coalesce(CAST(lead(d) OVER w AS VARCHAR), '9999-12-31') AS valid_to{more}
FROM v WINDOW w AS (PARTITION BY commitment_id ORDER BY d)
"""


def _history(spark: SparkSession, d: str) -> DataFrame:
    return version_history(table(spark, d, "commitment_snapshots"), "commitment_id", ["promised_date", "current_target_date", "status"], "last_updated", "loaded_at", "snapshot_row_id")


@query("p3_found", _SNAPSHOT_SQL.replace("{more}", ""))
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d).select("commitment_id", "version_no", "valid_from", "valid_to")


@query("p3_history", _SNAPSHOT_SQL.replace("{more}", ", promised_date, current_target_date, status"))
def p3_history(spark: SparkSession, d: str) -> DataFrame:
    return _history(spark, d)


_FIELDS = (("tickets", "ticket_row_id", ["created_at", "updated_at"]), ("ticket_comments", "comment_row_id", ["created_at"]), ("commitments", "commit_row_id", ["current_target_date"]))


@query("p7_found")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    sites = table(spark, d, "sites")
    return reduce(DataFrame.unionByName, [normalise_timestamps(table(spark, d, t), sites, fields, row_id, t) for t, row_id, fields in _FIELDS])
