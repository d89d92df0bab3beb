"""History of changing attributes, built from snapshots by a tree reduction over unit intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days (as a power of two) in a leaf of the tree, and of the root, which spans the years 1 to 9999 of the calendar.
LEAF_BITS, ROOT_BITS = 6, 22
#: The day, counted from 1970, at which the root begins: 0001-01-01.
FIRST_DAY = -719162


def plain_value(c: Column) -> Column:
    """The form in which two attribute values are compared: no outer blanks, case or midnight time part; null is empty."""
    v = F.lower(F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"^\s+|\s+$", "")))
    return F.regexp_replace(v, r"^(\d{4}-\d{2}-\d{2})[t ]00:00(:00(\.0+)?)?z?$", "$1")


def version_history(snapshots: DataFrame, entity: str, attributes: list[str], as_of: str, loaded_at: str, row_id: str, carry: list[str] | None = None) -> DataFrame:
    """The versions of each entity with the period in which each was valid.

    A snapshot states ``attributes`` as of the date in ``as_of``, or as of the date of ``loaded_at`` where ``as_of`` is null, blank or no
    date. For one entity and date the row loaded last holds (null loads come first; ties go to the larger ``row_id``). A version is a
    maximal run of consecutive stated dates with equal values (see ``plain_value``).

    Returns entity, version_no (from 1), valid_from, valid_to (``YYYY-MM-DD``; the start of the next version, ``9999-12-31`` for the last) and
    the attributes' plain values. Rows without entity or without any date are left out, since they state nothing. An empty table gives no rows.

    Method: each (entity, date) is a unit interval. Leaves hold the runs of 64 days; each round merges two neighbouring blocks of an
    entity, joining the runs that meet if their payloads are equal, until one block per entity is left: sixteen rounds for any date. All rounds
    keep the entity's hash partitioning, so only the first aggregation (which combines before it shuffles, whatever an entity's number of
    snapshots) and none of the rounds moves rows. A block holds at most one run per calendar day.
    """
    stated = F.try_to_date(F.substring(F.trim(F.col(as_of).cast("string")), 1, 10), "yyyy-MM-dd")
    payload = F.struct(*[plain_value(F.col(a)).alias(a) for a in attributes])
    units = (
        snapshots.select(
            F.col(entity).alias("_entity"),
            F.coalesce(stated, F.to_date(F.col(loaded_at))).alias("_date"),
            F.struct(F.coalesce(F.col(loaded_at).cast("timestamp"), F.lit("0001-01-01").cast("timestamp")).alias("at"), F.col(row_id).alias("id"), payload.alias("payload")).alias("_row"),
        )
        .filter("_entity IS NOT NULL AND _date IS NOT NULL")
        .groupBy("_entity", "_date")
        .agg(F.max(F.struct("_row.at", "_row.id", "_row.payload")).alias("_row"))
        .select("_entity", (F.unix_date("_date") - FIRST_DAY).alias("_day"), F.col("_row.payload").alias("_payload"))
    )
    run_type = f"array<struct<day:int,payload:struct<{','.join(f'`{a}`:string' for a in attributes)}>>>"

    def joined(left: Column, right: Column) -> Column:
        """Two neighbouring run lists as one; the right one's first run goes if it continues the left one's last."""
        meets = (F.size(left) > 0) & (F.size(right) > 0) & (F.element_at(left, -1)["payload"] == F.element_at(right, 1)["payload"])
        return F.when(meets, F.concat(left, F.slice(right, 2, F.greatest(F.size(right) - 1, F.lit(0))))).otherwise(F.concat(left, right))

    blocks = (
        units.repartition("_entity")
        .groupBy("_entity", F.shiftright("_day", LEAF_BITS).alias("_block"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("_day").alias("day"), F.col("_payload").alias("payload")))).cast(run_type).alias("_units"))
        .select("_entity", "_block", F.aggregate("_units", F.lit([]).cast(run_type), lambda acc, unit: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["payload"] == unit["payload"]), acc).otherwise(F.concat(acc, F.array(unit)))).alias("_runs"))
    )
    none = F.lit([]).cast(run_type)
    for _ in range(ROOT_BITS - LEAF_BITS):
        is_right = F.col("_block").bitwiseAND(1) == 1
        pairs = blocks.groupBy("_entity", F.shiftright("_block", 1).alias("_block")).agg(
            F.first(F.when(~is_right, F.col("_runs")), ignorenulls=True).alias("_left"), F.first(F.when(is_right, F.col("_runs")), ignorenulls=True).alias("_right")
        )
        blocks = pairs.select("_entity", "_block", joined(F.coalesce("_left", none), F.coalesce("_right", none)).alias("_runs"))
    versions = blocks.select("_entity", F.col("_runs"), F.posexplode("_runs").alias("_at", "_run"))
    following = F.try_element_at("_runs", F.col("_at") + 2)["day"]
    return versions.select(
        F.col("_entity").alias(entity),
        (F.col("_at") + 1).cast("long").alias("version_no"),
        F.date_from_unix_date(F.col("_run.day") + FIRST_DAY).cast("string").alias("valid_from"),
        F.coalesce(F.date_from_unix_date(following + FIRST_DAY).cast("string"), F.lit("9999-12-31")).alias("valid_to"),
        *[F.col("_run.payload")[a].alias(a) for a in attributes],
    )
