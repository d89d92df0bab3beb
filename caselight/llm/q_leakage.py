from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.leakage import leaked
from caselight.llm.registry import query, table


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items")
    texts = items.select(F.col("item_id").alias("id"), F.lit(0).alias("part"), F.col("question").alias("text")).unionByName(items.select(F.col("item_id").alias("id"), F.lit(1).alias("part"), F.col("reference_answer").alias("text")))
    return leaked(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), texts)


@query("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d)


@query("p9_items")
def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, with the number of documents they stand in."""
    return _leaked(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))
