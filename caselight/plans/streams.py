"""The streaming queries, drained over what there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators.text import tokens
from caselight.streaming.events import calls_per_minute, circuit_breaker, daily_digest, drained, event_stream, ingested, over_limit, table_stream, timings_per_hour, ttl_cache


@query("s_rate_limit", "SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S') AS minute, user_id, count(*) AS n_calls, greatest(0, count(*) - 5) AS n_refused FROM events GROUP BY 1, 2")
def rate_limit(spark: SparkSession, d: str) -> DataFrame:
    return over_limit(drained(calls_per_minute(event_stream(spark, d)), ["minute", "user_id"]), "token")


@query("s_timings", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type AS node, count(*) AS n, max(value) AS slowest FROM events GROUP BY 1, 2")
def timings(spark: SparkSession, d: str) -> DataFrame:
    return drained(timings_per_hour(event_stream(spark, d)), ["hour", "node"])


@query("s_daily_digest", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors FROM events GROUP BY 1")
def digest(spark: SparkSession, d: str) -> DataFrame:
    return drained(daily_digest(event_stream(spark, d)), ["day"])


@query("s_circuit_breaker")
def breaker(spark: SparkSession, d: str) -> DataFrame:
    """Each user as a service; two failures open its breaker for twelve hours, which suits how rare these events are. The state machine has no SQL form; tests fold it by hand."""
    return drained(circuit_breaker(event_stream(spark, d), threshold=2, recovery=43_200.0))


@query("s_ttl_cache")
def cache(spark: SparkSession, d: str) -> DataFrame:
    """Hits of a cache that holds an answer for a day. What is stored depends on what was, so there is no SQL form; tests fold it by hand."""
    return drained(ttl_cache(event_stream(spark, d), seconds=86_400.0))


@query("s_ingest", "SELECT customer_slug, doc_type, count(*) AS n_files, max(newest) AS newest FROM (SELECT customer_slug, filename, max(doc_id) AS newest, arg_max(doc_type, doc_id) AS doc_type FROM documents GROUP BY ALL) GROUP BY ALL")
def ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents arriving as a stream of uploads, merged by account and file name."""
    docs = table_stream(spark, d, "documents").select("customer_slug", "filename", "doc_id", "doc_type")
    return ingested(docs, ["customer_slug", "filename"], "doc_id").groupBy("customer_slug", "doc_type").agg(F.count("*").alias("n_files"), F.max("doc_id").alias("newest"))


@query("s_bm25_refresh", "WITH t AS (SELECT customer_slug, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents), s AS (SELECT customer_slug, count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS n_tokens FROM t GROUP BY 1), v AS (SELECT customer_slug, count(*) AS n_terms FROM (SELECT DISTINCT customer_slug, unnest(w) AS term FROM t) GROUP BY 1) SELECT s.customer_slug, n, n_tokens, n_terms FROM s JOIN v ON v.customer_slug = s.customer_slug")
def bm25_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of a lexical index, made anew from the table a stream of documents leaves."""

    def statistics(stored: DataFrame) -> DataFrame:
        t = stored.select("customer_slug", tokens(F.col("text")).alias("w"))
        s = t.groupBy("customer_slug").agg(F.count("*").alias("n"), F.sum(F.size("w").cast("long")).alias("n_tokens"))
        v = t.select("customer_slug", F.explode(F.array_distinct("w")).alias("term")).distinct().groupBy("customer_slug").agg(F.count("*").alias("n_terms"))
        return s.join(v, "customer_slug")

    docs = table_stream(spark, d, "documents").select("customer_slug", "doc_id", "text")
    return ingested(docs, ["customer_slug", "doc_id"], "doc_id", statistics)
