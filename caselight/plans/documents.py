"""Line filters, sentences, tokens and chunkers over the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators import text as X
from caselight.operators.nested import nodes, ticket_table
from caselight.tables import table

_LINES = "list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x))"
_KEPT = rf"""list_filter({_LINES}, lambda x: x <> '' AND NOT regexp_full_match(x, '(?:[-–—]+\s*\d+\s*[-–—]*|\d+\s*[-–—]+|(?i:page)\s+\d+(?:\s+(?i:of)\s+\d+)?)')
  AND (NOT (len(regexp_split_to_array(x, '\s+')) < 4 AND length(x) < 40) OR ends_with(x, ':') OR left(x, 1) IN ('•', '-', '*', '–', '○', '▸', '·')))"""


@query("q_noise_filter", f"SELECT doc_id, md5(array_to_string({_KEPT}, chr(10))) AS kept FROM documents")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.noise_filtered(F.col("text"))).alias("kept"))


@query("q_tokenize", "SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS joined FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM documents)")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("joined"))


@query("q_sentences", r"SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '')) AS INTEGER) AS n_sentences FROM documents")
def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n_sentences"))


@query("q_sentence_chunk")
def sentence_chunk(spark: SparkSession, d: str) -> DataFrame:
    return X.exploded_chunks(table(spark, d, "documents"), "doc_id", "text", X.sentence_chunks)


@query("q_recursive_split")
def recursive_split(spark: SparkSession, d: str) -> DataFrame:
    return X.exploded_chunks(table(spark, d, "documents"), "doc_id", "text", lambda t: X.recursive_chunks(t, 1000, 200))


@query("q_parent_child")
def parent_child(spark: SparkSession, d: str) -> DataFrame:
    parents = X.exploded_chunks(table(spark, d, "documents"), "doc_id", "text", lambda t: X.recursive_chunks(t, 2400, 200))
    parents = parents.select(F.concat_ws("_", F.lit("p"), "doc_id", "chunk_index").alias("parent_chunk_id"), "chunk")
    return X.exploded_chunks(parents, "parent_chunk_id", "chunk", lambda t: X.recursive_chunks(t, 800, 150))


@query("q_split_long")
def split_long(spark: SparkSession, d: str) -> DataFrame:
    return X.exploded_chunks(table(spark, d, "tickets"), "ticket_row_id", "description", X.long_text_chunks)


@query("q_slug", "SELECT customer_slug, regexp_full_match(customer_slug, '[a-z0-9-]+') AS valid FROM accounts")
def slug(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "accounts").select("customer_slug", F.col("customer_slug").rlike(r"^[a-z0-9-]+$").alias("valid"))


@query("q_jira_flatten")
def jira_flatten(spark: SparkSession, d: str) -> DataFrame:
    return ticket_table(nodes(table(spark, d, "raw_tickets"))).filter("variant = 'fields'")


@query("q_json_strings")
def json_strings(spark: SparkSession, d: str) -> DataFrame:
    return X.exploded_chunks(table(spark, d, "raw_tickets"), "raw_id", "payload", X.json_strings)


@query("q_word_cap", r"SELECT doc_id, md5(CASE WHEN len(w) > 100 THEN array_to_string(w[1:100], ' ') || '…' ELSE array_to_string(w, ' ') END) AS capped FROM (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents)")
def word_cap(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")
    return table(spark, d, "documents").select("doc_id", w.alias("w")).select("doc_id", F.md5(F.when(F.size("w") > 100, F.concat(F.array_join(F.slice("w", 1, 100), " "), F.lit("…"))).otherwise(F.array_join("w", " "))).alias("capped"))
