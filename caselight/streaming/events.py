"""Streaming forms of the event operators. Each takes a streaming (or batch) frame and returns the transformed one; ``drained`` runs one to the end of its input."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caselight.session import shared_folder


def table_stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parquet*")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    return table_stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def calls_per_minute(events: DataFrame) -> DataFrame:
    """Calls of a user per minute, the figure a rate limit compares; late events count for ten minutes."""
    g = events.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "1 minute"), "user_id").agg(F.count("*").alias("n_calls"))
    return g.select(F.col("window.start").cast("string").alias("minute"), "user_id", "n_calls")


# Calls a minute that each kind of request is allowed.
LIMITS = {"token": 5, "upload": 20, "brief": 10, "query": 20}


def over_limit(counts: DataFrame, kind: str) -> DataFrame:
    """``counts`` (minute, user_id, n_calls) with how many calls are refused under the limit of ``kind``."""
    return counts.withColumn("n_refused", F.greatest(F.lit(0), F.col("n_calls") - LIMITS[kind]))


def timings_per_hour(events: DataFrame) -> DataFrame:
    g = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("node")).agg(F.count("*").alias("n"), F.max("value").alias("slowest"))
    return g.select(F.col("window.start").cast("string").alias("hour"), "node", "n", "slowest")


def daily_digest(events: DataFrame) -> DataFrame:
    g = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return g.select(F.substring(F.col("window.start").cast("string"), 1, 10).alias("day"), "n_events", "n_errors")


class Breaker:
    """The three states of a circuit breaker: closed, open after ``threshold`` failures without a success between, half open ``recovery`` seconds after the last failure; a failure then opens it again, a success closes it."""

    def __init__(self, threshold: int = 10, recovery: float = 30.0, state: str = "closed", failures: int = 0, last: float = 0.0) -> None:
        self.threshold, self.recovery, self.state, self.failures, self.last = threshold, recovery, state, failures, last

    def refuses(self, now: float) -> bool:
        if self.state == "open" and now - self.last >= self.recovery:
            self.state = "half_open"
        return self.state == "open"

    def report(self, failed: bool, now: float) -> None:
        if not failed:
            self.state, self.failures = "closed", 0
            return
        self.failures, self.last = self.failures + 1, now
        if self.state == "half_open" or self.failures >= self.threshold:
            self.state = "open"


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    every = list(batches)
    return pd.concat(every).sort_values(["ts", "event_id"]) if every else pd.DataFrame(columns=["ts", "event_id"])


def circuit_breaker(events: DataFrame, service: str = "user_id", threshold: int = 10, recovery: float = 30.0) -> DataFrame:
    """service, event_id, state, refused: the breaker of each service after each of its calls (ts, event_id, event_type; an ``error`` is a failure). Calls it refuses don't reach the service, so they neither fail nor succeed.

    Each service's state is three values, kept between micro-batches; the events of a micro-batch are taken in order of time."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(threshold, recovery, *(state.get if state.exists else ()))
        rows = []
        for e in _in_order(batches).itertuples(index=False):
            now = e.ts.timestamp()
            refused = breaker.refuses(now)
            if not refused:
                breaker.report(e.event_type == "error", now)
            rows.append((str(key[0]), e.event_id, breaker.state, refused))
        state.update((breaker.state, breaker.failures, breaker.last))
        yield pd.DataFrame(rows, columns=["service", "event_id", "state", "refused"])

    needed = events.select(F.col(service).alias("_service"), "ts", "event_id", "event_type")
    return needed.groupBy("_service").applyInPandasWithState(fold, "service string, event_id long, state string, refused boolean", "state string, failures int, last double", "append", GroupStateTimeout.NoTimeout)


def ttl_cache(events: DataFrame, seconds: float = 1800.0, clears: str = "purchase") -> DataFrame:
    """user_id, event_id, hit: whether a cache of each user's answers (a key per event_type) had one not older than ``seconds``; a miss stores it, an event ``clears`` drops all of the user's and is neither.

    The state of a user is a time per key, of which there are as many as kinds of events."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, float] = dict(zip(*state.get, strict=True)) if state.exists else {}
        rows = []
        for e in _in_order(batches).itertuples(index=False):
            now = e.ts.timestamp()
            if e.event_type == clears:
                held = {}
                continue
            hit = e.event_type in held and now - held[e.event_type] <= seconds
            if not hit:
                held[e.event_type] = now
            rows.append((key[0], e.event_id, hit))
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "hit"])

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandasWithState(fold, "user_id long, event_id long, hit boolean", "keys array<string>, times array<double>", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The result of ``stream`` over the input there is now, as a batch frame.

    With ``keys`` the stream is an aggregation: each micro-batch writes the rows it changed (update mode, so the watermark drops what is past), and of each key the row of the last batch counts. Without, rows
    are appended. State and result go to the shared folder."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.sparkSession.createDataFrame([], _with_batch(stream)).write.parquet(f"{base}/out")

    def write(batch: DataFrame, n: int) -> None:
        batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(f"{base}/out")

    run = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    if keys is None:
        return out.drop("_batch")
    rest = [c for c in stream.columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return last.select(*keys, "_v.*").select(*stream.columns)


def _with_batch(stream: DataFrame):  # noqa: ANN202
    from pyspark.sql.types import IntegerType, StructField, StructType

    return StructType([*stream.schema.fields, StructField("_batch", IntegerType())])


def ingested(stream: DataFrame, key: list[str], version: str, then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The table that a stream of uploads leaves: of each ``key`` the row of the greatest ``version``, each micro-batch merged into it. A batch delivered again changes nothing, since the merge keeps the same row.

    ``then`` makes what hangs on the table (an index, statistics) from it, once after the batches that changed the number of rows. The table is written anew beside the old one and then named, so a reader never meets half of one."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    names: list[str] = []

    def merge(batch: DataFrame, n: int) -> None:
        both = spark.read.parquet(names[-1]).unionByName(batch) if names else batch
        rest = [c for c in both.columns if c not in key]
        merged = both.groupBy(*key).agg(F.max(F.struct(version, *[c for c in rest if c != version])).alias("_v")).select(*key, *[F.col("_v")[c].alias(c) for c in rest])
        path = f"{base}/table-{n}"
        merged.write.mode("overwrite").parquet(path)
        names.append(path)

    stream.writeStream.option("checkpointLocation", f"{base}/state").foreachBatch(merge).trigger(availableNow=True).start().awaitTermination()
    stored = spark.read.parquet(names[-1]) if names else spark.createDataFrame([], stream.schema)
    return then(stored) if then else stored
