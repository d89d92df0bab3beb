from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.pii import find_pii, sanitised
from caselight.llm.registry import query, table

_TEXTS = (("tickets", "ticket_row_id", "description"), ("ticket_comments", "comment_row_id", "body"), ("turns", "turn_row_id", "text"))
_PEOPLE = (("tickets", "reporter"), ("tickets", "assignee"), ("ticket_comments", "author"), ("commitments", "owner"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t).select(F.lit(t).alias("src_table"), F.col(i).alias("row_id"), F.col("customer_slug").alias("entity"), F.col(c).alias("text"), F.lit(t == "turns").alias("labelled")) for t, i, c in _TEXTS]
    return reduce(DataFrame.unionByName, parts)


def _people(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, d, t).select(F.col(c).alias("name")) for t, c in _PEOPLE])


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pii(_texts(spark, d), _people(spark, d)).select("src_table", "row_id", "pii_type", "start_char")


@query("p5_sanitised")
def p5_sanitised(spark: SparkSession, d: str) -> DataFrame:
    texts = _texts(spark, d)
    return sanitised(texts, find_pii(texts, _people(spark, d)))
