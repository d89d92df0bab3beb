from pyspark.sql import DataFrame, SparkSession

from caselight.llm.registry import query, table
from caselight.llm.turns import speaker_turns


@query("p6_found")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(table(spark, d, "turns"), table(spark, d, "calls")).select("call_id", "turn_no", "spk_id", "start_ms")


@query("p6_turns")
def p6_turns(spark: SparkSession, d: str) -> DataFrame:
    return speaker_turns(table(spark, d, "turns"), table(spark, d, "calls"))
