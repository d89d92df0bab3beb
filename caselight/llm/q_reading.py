from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.reading import reading_levels
from caselight.llm.registry import query, table


@query("p10_found")
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "reading_level")


@query("p10_profile")
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean score by level."""
    levels = reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return levels.groupBy("reading_level").agg(F.count("*").alias("n_documents"), F.round(F.avg("score"), 4).alias("mean_score"))
