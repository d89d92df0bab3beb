from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.packing import CAPACITY, packed, pieces
from caselight.llm.registry import query, table


@query("p8_packed")
def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    """Each text, or piece of a text of more than 2 048 tokens, with its container and its place there."""
    return packed(pieces(table(spark, d, "documents")))


@query("p8_fill")
def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, and which share of their space is used."""
    used = packed(pieces(table(spark, d, "documents"))).filter("n_tokens > 0").groupBy("container_id").agg(F.sum("n_tokens").alias("n"))
    return used.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), F.round(F.sum("n") / (F.count("*") * F.lit(float(CAPACITY))), 6).alias("used_share"))
