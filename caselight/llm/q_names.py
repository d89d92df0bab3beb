from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm.names import link_names, linked_pairs
from caselight.llm.registry import query, table

_FIELDS = (("tickets", "reporter"), ("tickets", "assignee"), ("ticket_comments", "author"), ("commitments", "owner"))


def _spellings(spark: SparkSession, d: str) -> DataFrame:
    return reduce(DataFrame.unionByName, [table(spark, d, t).select(F.col("customer_slug").alias("grp"), F.col(c).alias("name")) for t, c in _FIELDS])


@query("p4_found")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(link_names(_spellings(spark, d))).withColumnRenamed("grp", "customer_slug")


@query("p4_classes")
def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    return link_names(_spellings(spark, d)).withColumnRenamed("grp", "customer_slug")
