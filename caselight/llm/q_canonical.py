from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.canonical import listed_aliases, map_values, mapped_rows
from caselight.llm.registry import query, table

_COLUMNS = (("tickets", "ticket_row_id", "status", "ticket_status"), ("tickets", "ticket_row_id", "priority", "ticket_priority"), ("commitments", "commit_row_id", "status", "commitment_status"))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    parts = [
        table(spark, d, t).select(F.lit(t).alias("src_table"), F.col(row_id).cast("long").alias("row_id"), F.lit(c).alias("field_name"), F.lit(g).alias("grp"), F.col(c).alias("value"))
        for t, row_id, c, g in _COLUMNS
    ]
    return reduce(DataFrame.unionByName, parts)


@query("p2_found")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return mapped_rows(_rows(spark, d), table(spark, d, "ref_entries"), listed_aliases(spark)).select("src_table", "row_id", "field_name", "canonical")


@query("p2_values")
def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct typed value with its entry and score, for review."""
    return map_values(_rows(spark, d), table(spark, d, "ref_entries"), aliases=listed_aliases(spark))


@query("p2_by_list")
def p2_by_list(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct values match by the canonical list alone (entries and glosses), and how many with the listed aliases."""
    rows, entries = _rows(spark, d), table(spark, d, "ref_entries")
    matched = lambda m, how: m.groupBy("grp").agg(F.count("*").alias("n_values"), F.count_if(F.col("canonical") != "UNMATCHED").alias("n_matched")).select("grp", F.lit(how).alias("forms"), "n_values", "n_matched")
    return matched(map_values(rows, entries), "list").unionByName(matched(map_values(rows, entries, aliases=listed_aliases(spark)), "list and aliases"))
