"""Ordering-dependent operators: top rows per group, first occurrences, version flags. Groups are cut down before they are shuffled wherever a bound is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (which must be total), with their rank from 1. Spark keeps only ``k`` rows of a group per task before the shuffle (window group limit)."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w).cast("long")).filter(F.col(rank) <= k)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; combined before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in key]
    kept = df.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("_first"))
    return kept.select(*[F.col(c) if c in key else F.col("_first")[c].alias(c) for c in df.columns])


def latest_flags(df: DataFrame, group: list[str], version: str, flag: str = "is_latest_version") -> DataFrame:
    """``df`` with ``flag`` 1 on the row of the greatest ``version`` of its group, else 0."""
    newest = df.groupBy(*group).agg(F.max(version).alias("_newest"))
    return df.drop(flag).join(newest, group).withColumn(flag, F.when(F.col(version) == F.col("_newest"), 1).otherwise(0)).drop("_newest")


def diversity_cap(ranked: DataFrame, group: list[str], source: str, order: Column, k: int = 2) -> DataFrame:
    """The rows of a ranked list without those behind the first ``k`` of their source; order and ranks stay."""
    return top_per_group(ranked, [*group, source], [order], k, "_nth").drop("_nth")


def recency_boost(ranked: DataFrame, group: str, position: str, date: str) -> DataFrame:
    """``ranked`` with ``score``: 0.4 by position (from 0) and 0.6 by age; a missing or bad date counts as 1970-01-01 and stretches the span."""
    w = W.partitionBy(group)
    days = F.unix_date(F.coalesce(F.try_to_date(F.substring(F.col(date), 1, 10), "yyyy-MM-dd"), F.lit("1970-01-01").cast("date")))
    n, oldest, newest = F.count("*").over(w), F.min("_days").over(w), F.max("_days").over(w)
    span = F.greatest(newest - oldest, F.lit(1))
    return ranked.withColumn("_days", days).withColumn("score", F.round(0.4 * (n - F.col(position)) / n + 0.6 * (F.col("_days") - oldest) / span, 6)).drop("_days")


def previous_in_blocks(df: DataFrame, group: str, block: Column, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in its group, by ``order`` (which must be total); null for the first.

    ``block`` must not decrease along ``order``. A group is worked on block by block and takes the last value of the blocks before from a summary of one row per block, so a
    group of any size is spread over tasks."""
    blocked = df.withColumn("_block", block)
    last = blocked.groupBy(group, "_block").agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("_last"))
    carried = last.select(group, "_block", F.lag("_last").over(W.partitionBy(group).orderBy("_block")).alias("_carry"))
    w = W.partitionBy(group, "_block").orderBy(*order)
    inside = blocked.withColumn("_in", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    return inside.join(carried, [group, "_block"]).withColumn(name, F.coalesce("_in", "_carry")["v"]).drop("_block", "_in", "_carry")


def cumulated(df: DataFrame, group: str, value: str) -> DataFrame:
    """``group``, ``value``, upto (rows of the group with at most this value), n (all of them): one row per distinct value that isn't null.

    Values are counted before the shuffle and ranked by running sums in two steps, over blocks of values and within them, so no group is collected or sorted by one task alone."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_c")).withColumn("_block", F.floor(F.col(value)))
    blocks = counted.groupBy(group, "_block").agg(F.sum("_c").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))
    offsets = blocks.select(group, "_block", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(W.partitionBy(group)).alias("n"))
    inside = F.sum("_c").over(W.partitionBy(group, "_block").orderBy(value))
    return counted.withColumn("_in", inside).join(offsets, [group, "_block"]).select(group, value, (F.col("_before") + F.col("_in")).alias("upto"), "n")


def nearest_ranks(df: DataFrame, group: str, value: str, percents: dict[int, float]) -> DataFrame:
    """``group``, n and ``p{k}`` for each of ``percents``: the value of rank ``int(n p)`` from 0, at most the last."""
    up = cumulated(df, group, value)
    at = {k: F.least(F.floor(F.col("n") * p), F.col("n") - 1) for k, p in percents.items()}
    return up.groupBy(group).agg(F.first("n").alias("n"), *[F.min(F.when(F.col("upto") > at[k], F.col(value))).alias(f"p{k}") for k in percents])


def numbered_in_blocks(df: DataFrame, group: str, blocks: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the place of each row in its group from 1, by ``blocks`` and then ``order`` (total within a block). Only a summary of one row per block is sorted per group."""
    counts = df.groupBy(group, *blocks).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy(*blocks).rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(group, *blocks, F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy(group, *blocks).orderBy(*order))
    return df.withColumn("_in", inside).join(offsets, [group, *blocks]).withColumn(name, F.col("_before") + F.col("_in")).drop("_in", "_before")
