"""Mentions of people in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.session import cut_lineage


def person_tiers(chunks: DataFrame, people: DataFrame, carry: list[str]) -> DataFrame:
    """tenant, person, chunk_id, tier and ``carry`` of the chunks that mention a person, of each person only those of the best tier there is.

    ``chunks``: tenant, chunk_id, kind, text and others; ``people``: tenant, person (lower case). Tiers: 1 the whole name, 2 given name and surname apart, 3 the given name alone, in
    transcripts only; all as whole words. A name of one word has tier 1 only. Null and empty texts and names mention nobody.

    A text's distinct words meet the given names of its tenant (a name's other words are tested on what is met), so texts and people are never paired outright."""
    named = people.filter("trim(coalesce(person, '')) <> ''").select("tenant", F.lower(F.trim("person")).alias("person")).distinct()
    words = F.split("person", r"\s+")
    named = named.withColumns({"_given": words[0], "_surname": F.element_at(words, -1), "_parts": F.size(words)})
    named = named.withColumn("_word", F.regexp_extract("_given", r"[\p{L}\p{N}_]+", 0))
    low = F.lower("text")
    spoken = chunks.withColumn("_low", low).withColumn("_word", F.explode(F.array_distinct(F.regexp_extract_all("_low", F.lit(r"[\p{L}\p{N}_]+"), 0))))
    given = named.select("tenant", "_word").distinct()
    met = spoken.join(given, ["tenant", "_word"], "left_semi").join(named, ["tenant", "_word"])
    says = lambda c: F.contains("_low", F.col(c)) & F.regexp_like("_low", F.concat(F.lit(r"(?U)\b\Q"), c, F.lit(r"\E\b")))
    alone = F.when(F.col("kind") == "transcript", 3)
    tier = F.when(says("person"), 1).when((F.col("_parts") > 1) & says("_given"), F.when(says("_surname"), 2).otherwise(alone))
    found = cut_lineage(met.select("tenant", "person", "chunk_id", tier.alias("tier"), *carry).filter("tier IS NOT NULL"))
    best = found.groupBy("tenant", "person").agg(F.min("tier").alias("tier"))
    return found.join(best, ["tenant", "person", "tier"]).select("tenant", "person", "chunk_id", "tier", *carry)
