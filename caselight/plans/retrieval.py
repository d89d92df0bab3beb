"""Lexical, dense and hybrid retrieval over the documents, and the metrics of a ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators import text as X
from caselight.operators.ranking import diversity_cap, recency_boost, top_per_group
from caselight.operators.retrieval import bm25, bm25_of_heads, dense_topk, fusion_key, lexical_rerank, reciprocal_rank_fusion
from caselight.plans.questions import RECENT, RECENT_SQL
from caselight.session import cut_lineage
from caselight.tables import table

_TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


def _bm25_sql(docs: str, asks: str, tenant: bool = False) -> str:
    """CTEs up to ``bm`` (query_id, doc_id, score, rank)."""
    own, by, using = ("tenant, ", "tenant", "tenant, term") if tenant else ("", "1", "term")
    part = "PARTITION BY tenant" if tenant else ""
    return f"""t AS (SELECT doc_id, {own}{_TOKENS.format('text')} AS w FROM ({docs})),
  s AS (SELECT {own}count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM t {'GROUP BY tenant' if tenant else ''}),
  p AS (SELECT doc_id, {own}dl, term, count(*) AS tf FROM (SELECT doc_id, {own}len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
  f AS (SELECT {own}term, count(*) AS df FROM p GROUP BY ALL),
  r AS (SELECT {own}term, avgdl, ln((n - df + 0.5) / (df + 0.5)) AS raw FROM f {'JOIN s USING (tenant)' if tenant else 'CROSS JOIN s'}),
  i AS (SELECT {own}term, avgdl, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER ({part}) ELSE raw END AS idf FROM r),
  qt AS (SELECT query_id, {own}term, count(*) AS times FROM (SELECT query_id, {own}unnest({_TOKENS.format('text')}) AS term FROM ({asks})) GROUP BY ALL),
  sc AS (SELECT query_id, {own}doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 4) AS score FROM p JOIN qt USING ({using}) JOIN i USING ({using}) GROUP BY ALL),
  bm AS (SELECT query_id, {own}doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10)"""


_DOCS, _ASKS = "SELECT doc_id, text FROM documents", "SELECT item_id AS query_id, question AS text FROM eval_items"
_BM25 = _bm25_sql(_DOCS, _ASKS)
_DENSE = """de AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
    SELECT i.item_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score
    FROM eval_items i JOIN embeddings a ON a.vec_id = i.item_id CROSS JOIN embeddings b WHERE b.vec_id IN (SELECT doc_id FROM documents)) QUALIFY rank <= 10)"""
_FUSED = """fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(src * 100 + rank) AS seen FROM (SELECT query_id, doc_id, rank, 0 AS src FROM de UNION ALL SELECT query_id, doc_id, rank, 1 FROM bm) GROUP BY ALL),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS rank FROM fu)"""
_RERANKED = f"""rk AS (SELECT query_id, doc_id, rank AS before, round(len(list_intersect(list_distinct(asked), list_distinct(held))) / greatest(len(list_distinct(asked)), 1), 6) AS share, count(*) OVER (PARTITION BY query_id) AS n FROM (
    SELECT c.query_id, c.doc_id, c.rank, {_TOKENS.format('q.question')} AS asked, {_TOKENS.format('d.text')} AS held FROM {{0}} c JOIN documents d ON d.doc_id = c.doc_id JOIN eval_items q ON q.item_id = c.query_id)),
  rr AS (SELECT query_id, doc_id, share, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n <= 6 THEN -before ELSE share END DESC, before) AS rank FROM rk QUALIFY rank <= 6)"""
#: From ``li`` (query_id, doc_id, rank) the capped list in its final order.
_BOOSTED = f"""ca AS (SELECT query_id, doc_id, doc_date, row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS i FROM (SELECT li.*, d.doc_date, row_number() OVER (PARTITION BY query_id, coalesce(nullif(d.filename, ''), d.source, '') ORDER BY li.rank) AS c
    FROM li JOIN documents d ON d.doc_id = li.doc_id) WHERE c <= 2),
  bo AS (SELECT ca.*, regexp_matches(coalesce(q.question, ''), '{RECENT_SQL}') AS recent, coalesce(try_cast(left(ca.doc_date, 10) AS DATE), DATE '1970-01-01') AS day FROM ca JOIN eval_items q ON q.item_id = ca.query_id),
  bs AS (SELECT *, round(0.4 * (count(*) OVER w - i) / count(*) OVER w + 0.6 * datediff('day', min(day) OVER w, day) / greatest(datediff('day', min(day) OVER w, max(day) OVER w), 1), 6) AS score FROM bo WINDOW w AS (PARTITION BY query_id))
  SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN recent THEN -score ELSE 0 END, i) AS BIGINT) AS position FROM bs"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return bm25(_corpus(spark, d), _questions(spark, d)).select("query_id", "doc_id", "score", "rank")


def _dense(spark: SparkSession, d: str) -> DataFrame:
    """query_id, doc_id, score, rank by vectors. The tables hold no vectors of questions; as the survey has it, the row of ``embeddings`` with the question's id stands for it,
    and vec_id is the doc_id."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    held = rows.join(_corpus(spark, d).select(F.col("doc_id").alias("id")), "id", "left_semi")
    # Negative, because a search leaves out the row with the query's id, which here is another thing.
    asked = rows.join(_questions(spark, d).select(F.col("query_id").alias("id")), "id", "left_semi").select((-F.col("id") - 1).alias("query_id"), "vector")
    return dense_topk(held, asked).select((-F.col("query_id") - 1).alias("query_id"), F.col("id").alias("doc_id"), "score", "rank")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Both lists fused whole: query_id, doc_id, score, rank."""
    fused = reciprocal_rank_fusion([_dense(spark, d), _lexical(spark, d)])
    return top_per_group(fused, ["query_id"], [F.desc("score"), F.asc("first")], 20).select("query_id", "doc_id", "score", "rank")


def _boosted(spark: SparkSession, d: str, ranked: DataFrame) -> DataFrame:
    """``ranked`` (query_id, doc_id, rank) with at most two entries of one file, the newer first where the question asks for what is recent: query_id, doc_id, position from 1."""
    source = table(spark, d, "documents").select("doc_id", "doc_date", F.coalesce(F.nullif("filename", F.lit("")), "source", F.lit("")).alias("_source"))
    capped = diversity_cap(ranked.join(source, "doc_id"), ["query_id"], "_source", F.asc("rank"), 2)
    placed = capped.withColumn("_i", F.row_number().over(W.partitionBy("query_id").orderBy("rank")) - 1)
    asked = _questions(spark, d).select("query_id", F.coalesce(F.col("text").rlike(RECENT), F.lit(False)).alias("_recent"))
    boosted = recency_boost(placed, "query_id", "_i", "doc_date").join(asked, "query_id")
    position = F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("_recent"), -F.col("score")).otherwise(0.0), "_i")).cast("long")
    return boosted.select("query_id", "doc_id", position.alias("position"))


@query("q_bm25", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bm")
def q_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _lexical(spark, d)


_T_DOCS = "SELECT doc_id, customer_slug AS tenant, text FROM documents WHERE customer_slug IS NOT NULL"
_T_ASKS = "SELECT ticket_row_id AS query_id, customer_slug AS tenant, subject AS text FROM tickets"
_T_BM25 = _bm25_sql(_T_DOCS, _T_ASKS, tenant=True)


@query("q_bm25_tenant", f"""WITH {_T_BM25}, al AS (SELECT a.query_id, d.doc_id, 0.0 AS score FROM ({_T_ASKS}) a JOIN ({_T_DOCS}) d USING (tenant) WHERE NOT EXISTS (SELECT 1 FROM sc WHERE sc.query_id = a.query_id AND sc.doc_id = d.doc_id)),
  bo AS (SELECT query_id, doc_id, score FROM bm UNION ALL SELECT * FROM al WHERE query_id NOT IN (SELECT query_id FROM bm WHERE rank = 10))
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bo QUALIFY rank <= 10""")
def q_bm25_tenant(spark: SparkSession, d: str) -> DataFrame:
    """Each ticket's subject asked of the documents of its account, with that account's statistics; lists are filled with unscored documents."""
    corpus = table(spark, d, "documents").filter("customer_slug IS NOT NULL").select("doc_id", F.col("customer_slug").alias("tenant"), "text")
    asks = table(spark, d, "tickets").select(F.col("ticket_row_id").alias("query_id"), F.col("customer_slug").alias("tenant"), F.col("subject").alias("text"))
    return bm25(corpus, asks, tenant="tenant", unscored=True).select("query_id", "doc_id", "score", "rank")


@query("q_dense_topk", "WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_dot_product(a.e, b.e), 6) AS score FROM q a, q b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id), r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10")
def q_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set of a search: every row whose id is divisible by 50, against all rows."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return dense_topk(rows, rows.filter("id % 50 = 0").withColumnRenamed("id", "query_id"))


@query("q_rrf", f"WITH {_BM25}, {_DENSE}, {_FUSED} SELECT query_id, doc_id, score, rank FROM fr WHERE rank <= 6")
def q_rrf(spark: SparkSession, d: str) -> DataFrame:
    """The dense and the lexical ranking of each question, fused; ties keep the order in which the lists show the documents."""
    return _fused(spark, d).filter("rank <= 6")


@query("q_rrf_key", "SELECT doc_id, 'h|' || coalesce(nullif(filename, ''), '') || '|' || md5(coalesce(text, '')) AS by_content, 'c|' || doc_id || '|0' AS by_chunk, 'p|' || doc_id || '|p_' || doc_id || '_0' AS by_parent FROM documents")
def q_rrf_key(spark: SparkSession, d: str) -> DataFrame:
    """The identity of a list entry by content alone, with a chunk id, and with a parent."""
    docs = table(spark, d, "documents")
    none, file_id = F.lit(None).cast("long"), F.col("doc_id")
    chunk, parent = F.lit("0"), F.concat(F.lit("p_"), file_id, F.lit("_0"))
    whole = {"filename": F.col("filename"), "text": F.col("text")}
    return docs.select("doc_id", fusion_key(none, parent, chunk, **whole).alias("by_content"), fusion_key(file_id, F.lit(""), chunk, **whole).alias("by_chunk"), fusion_key(file_id, parent, chunk, **whole).alias("by_parent"))


@query("q_rerank", f"WITH {_BM25}, {_RERANKED.format('bm')} SELECT query_id, doc_id, share, rank FROM rr")
def q_rerank(spark: SparkSession, d: str) -> DataFrame:
    return lexical_rerank(_lexical(spark, d), _corpus(spark, d), _questions(spark, d))


@query("q_hybrid_dense", f"WITH {_DENSE}, li AS (SELECT query_id, doc_id, rank FROM de WHERE rank <= 6), {_BOOSTED}")
def q_hybrid_dense(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d, _dense(spark, d).filter("rank <= 6").select("query_id", "doc_id", "rank"))


@query("q_hybrid_dense_bm25", f"WITH {_BM25}, {_DENSE}, {_FUSED}, li AS (SELECT query_id, doc_id, rank FROM fr WHERE rank <= 6), {_BOOSTED}")
def q_hybrid_dense_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _boosted(spark, d, _fused(spark, d).filter("rank <= 6").select("query_id", "doc_id", "rank"))


@query("q_hybrid_files", f"WITH {_BM25}, {_DENSE}, {_FUSED}, {_RERANKED.format('fr')}, li AS (SELECT query_id, doc_id, rank FROM rr), {_BOOSTED}")
def q_hybrid_files(spark: SparkSession, d: str) -> DataFrame:
    """The full mode down to files: both lists fused, re-ranked, capped, boosted."""
    reranked = lexical_rerank(_fused(spark, d).select("query_id", "doc_id", "rank"), _corpus(spark, d), _questions(spark, d))
    return _boosted(spark, d, reranked.select("query_id", "doc_id", "rank"))


@query("q_hybrid_full")
def q_hybrid_full(spark: SparkSession, d: str) -> DataFrame:
    """The full mode down to parent chunks: both lists fused, re-ranked, at most two entries of one file, their parent chunks; the newer first where the question asks for what is recent."""
    documents = table(spark, d, "documents")
    reranked = lexical_rerank(_fused(spark, d).select("query_id", "doc_id", "rank"), _corpus(spark, d), _questions(spark, d))
    owners = documents.select("doc_id", "doc_date", F.coalesce(F.nullif("filename", F.lit("")), "source", F.lit("")).alias("_source"))
    capped = diversity_cap(reranked.withColumnRenamed("rank", "place").join(owners, "doc_id"), ["query_id"], "_source", F.asc("place"), 2).select("query_id", "doc_id", "share", "place", "doc_date")
    capped = cut_lineage(capped)
    chunks = X.exploded_chunks(documents.join(capped.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "text", lambda t: X.recursive_chunks(t, 2400, 200))
    parents = capped.join(chunks, "doc_id", "left").withColumn("_place", F.row_number().over(W.partitionBy("query_id").orderBy("place", "chunk_index")) - 1)
    boosted = recency_boost(parents, "query_id", "_place", "doc_date").join(_questions(spark, d).select("query_id", F.coalesce(F.col("text").rlike(RECENT), F.lit(False)).alias("_recent")), "query_id")
    position = F.row_number().over(W.partitionBy("query_id").orderBy(F.when(F.col("_recent"), -F.col("score")).otherwise(0.0), "_place"))
    parent_id = F.when(F.col("chunk_index").isNotNull(), F.concat_ws("_", F.lit("p"), "doc_id", "chunk_index"))
    return boosted.select("query_id", "doc_id", parent_id.alias("parent_chunk_id"), "chunk", "share", "place", position.alias("position"))


# Known-item search: the first 200 characters of every document whose id is divisible by 50 are asked of all documents, and its own file is the gold source.
_KNOWN = _bm25_sql(_DOCS, "SELECT doc_id AS query_id, left(text, 200) AS text FROM documents WHERE doc_id % 50 = 0")


def _known_items(spark: SparkSession, d: str) -> DataFrame:
    """query_id, gold, source, rank: a row per retrieved file."""
    docs = table(spark, d, "documents")
    asks = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 200).alias("text"))
    gold = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.lower("filename").alias("gold"))
    found = bm25(_corpus(spark, d), asks).select("query_id", "doc_id", "rank").join(docs.select("doc_id", F.lower("filename").alias("source")), "doc_id")
    return gold.join(found, "query_id", "left")


_HITS = f"""WITH {_KNOWN}, g AS (SELECT doc_id AS query_id, lower(filename) AS gold FROM documents WHERE doc_id % 50 = 0),
  h AS (SELECT g.query_id, min(CASE WHEN contains(lower(d.filename), g.gold) THEN rank END) AS hit FROM g LEFT JOIN bm ON bm.query_id = g.query_id LEFT JOIN documents d ON d.doc_id = bm.doc_id GROUP BY g.query_id)"""


@query("q_gold_eval", f"{_HITS} SELECT query_id, CAST(coalesce(hit <= 5, false) AS DOUBLE) AS recall_5, coalesce(round(1.0 / hit, 6), 0.0) AS reciprocal_rank FROM h")
def q_gold_eval(spark: SparkSession, d: str) -> DataFrame:
    """Whether the gold source is part of one of the first five sources' names, and the reciprocal rank of the first that has it."""
    hit = F.min(F.when(F.contains("source", F.col("gold")), F.col("rank")))
    h = _known_items(spark, d).groupBy("query_id").agg(hit.alias("hit"))
    return h.select("query_id", F.coalesce(F.col("hit") <= 5, F.lit(False)).cast("double").alias("recall_5"), F.coalesce(F.round(1.0 / F.col("hit"), 6), F.lit(0.0)).alias("reciprocal_rank"))


# The same search, of every document.
_ALL_KNOWN = _bm25_sql(_DOCS, "SELECT doc_id AS query_id, left(text, 200) AS text FROM documents")
_ALL_HITS = f"""WITH {_ALL_KNOWN}, g AS (SELECT doc_id AS query_id, lower(filename) AS gold FROM documents),
  h AS (SELECT g.query_id, min(CASE WHEN contains(lower(d.filename), g.gold) THEN rank END) AS hit FROM g LEFT JOIN bm ON bm.query_id = g.query_id LEFT JOIN documents d ON d.doc_id = bm.doc_id GROUP BY g.query_id)"""


@query("q_ir_metrics", f"{_ALL_HITS} SELECT count(*) AS n, round(avg(CAST(coalesce(hit <= 1, false) AS DOUBLE)), 3) AS recall_1, round(avg(CAST(coalesce(hit <= 5, false) AS DOUBLE)), 3) AS recall_5, round(avg(coalesce(round(1.0 / hit, 6), 0.0)), 3) AS mrr FROM h")
def q_ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Each document has its own name as gold, so what ranks behind it decides nothing; without a name nothing is a hit."""
    docs = table(spark, d, "documents")
    named = docs.select(F.col("doc_id").alias("query_id"), F.lower("filename").alias("gold"))
    found = bm25_of_heads(_corpus(spark, d), F.substring("text", 1, 200)).select("query_id", "doc_id", "rank").join(docs.select("doc_id", F.lower("filename").alias("source")), "doc_id")
    hit = F.min(F.when(F.contains("source", F.col("gold")), F.col("rank")))
    h = named.join(found, "query_id", "left").groupBy("query_id").agg(hit.alias("hit"))
    share = lambda k: F.round(F.avg(F.coalesce(F.col("hit") <= k, F.lit(False)).cast("double")), 3)
    return h.agg(F.count("*").alias("n"), share(1).alias("recall_1"), share(5).alias("recall_5"), F.round(F.avg(F.coalesce(F.round(1.0 / F.col("hit"), 6), F.lit(0.0))), 3).alias("mrr"))


@query("q_chunk_pr", f"""WITH {_BM25}, w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents),
  g AS (SELECT item_id AS query_id, doc_id FROM eval_items, w WHERE list_contains(w, split_part(key_facts, ';', 1)) AND list_contains(w, split_part(key_facts, ';', 2))),
  k AS (SELECT query_id, count(*) AS n FROM bm WHERE rank <= 5 GROUP BY 1), h AS (SELECT query_id, count(*) AS n FROM bm SEMI JOIN g USING (query_id, doc_id) WHERE rank <= 5 GROUP BY 1), c AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1)
  SELECT item_id AS query_id, CASE WHEN c.n IS NULL OR k.n IS NULL THEN 0.0 ELSE round(coalesce(h.n, 0) / k.n, 6) END AS precision_5, CASE WHEN c.n IS NULL THEN 0.0 ELSE round(coalesce(h.n, 0) / c.n, 6) END AS recall_5
  FROM eval_items LEFT JOIN k ON k.query_id = item_id LEFT JOIN h ON h.query_id = item_id LEFT JOIN c ON c.query_id = item_id""")
def q_chunk_pr(spark: SparkSession, d: str) -> DataFrame:
    """Precision and recall of the first five chunks against the gold chunks, here the texts that have an item's first two key facts as words; 0 without gold or without hits."""
    e = table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), F.split("key_facts", ";").alias("k")).select("query_id", F.get("k", F.lit(0)).alias("a"), F.get("k", F.lit(1)).alias("b"))
    words = _corpus(spark, d).select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("word"))
    wanted = e.select("query_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("word"), F.size(F.array_distinct(F.array("a", "b"))).alias("n"))
    gold = words.join(wanted, "word").groupBy("query_id", "doc_id").agg(F.count("*").alias("found"), F.first("n").alias("n")).filter("found = n").select("query_id", "doc_id")
    gold = cut_lineage(gold)
    top = cut_lineage(_lexical(spark, d).filter("rank <= 5"))
    k = top.groupBy("query_id").agg(F.count("*").alias("k"))
    h = top.join(gold, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("h"))
    c = gold.groupBy("query_id").agg(F.count("*").alias("c"))
    hits = F.coalesce("h", F.lit(0))
    every = e.select("query_id").join(k, "query_id", "left").join(h, "query_id", "left").join(c, "query_id", "left")
    return every.select("query_id", F.when(F.col("c").isNull() | F.col("k").isNull(), 0.0).otherwise(F.round(hits / F.col("k"), 6)).alias("precision_5"), F.when(F.col("c").isNull(), 0.0).otherwise(F.round(hits / F.col("c"), 6)).alias("recall_5"))


_FACTS_SQL = " || ".join(f"regexp_extract_all(lower(coalesce({{0}}, '')), '(?i){p}')" for p in X.FACTS)


@query("q_detect_hallucination", f"""WITH {_BM25}, {_DENSE}, {_FUSED}, fa AS (SELECT item_id, unnest(list_distinct({_FACTS_SQL.replace('{0}', 'reference_answer')})) AS fact FROM eval_items),
  x AS (SELECT DISTINCT fa.item_id, fa.fact FROM fa JOIN fr ON fr.query_id = fa.item_id AND fr.rank <= 6 JOIN documents d ON d.doc_id = fr.doc_id WHERE contains(lower(d.text), fa.fact)),
  u AS (SELECT item_id, string_agg(fact, ';' ORDER BY fact) AS facts FROM fa ANTI JOIN x USING (item_id, fact) WHERE item_id IN (SELECT query_id FROM fr) GROUP BY item_id)
  SELECT e.item_id, coalesce(u.facts, '') AS unsupported FROM eval_items e LEFT JOIN u ON u.item_id = e.item_id""")
def detect_hallucination(spark: SparkSession, d: str) -> DataFrame:
    """Facts of an answer that none of the documents retrieved for its question holds; none where nothing is retrieved."""
    found = cut_lineage(q_rrf(spark, d).select(F.col("query_id").alias("item_id"), "doc_id"))
    facts = table(spark, d, "eval_items").select("item_id", F.explode(X.facts(F.col("reference_answer"))).alias("fact"))
    held = facts.join(found, "item_id").join(_corpus(spark, d).select("doc_id", F.lower("text").alias("low")), "doc_id").filter(F.contains("low", F.col("fact"))).select("item_id", "fact").distinct()
    wrong = facts.join(held, ["item_id", "fact"], "left_anti").join(found.select("item_id").distinct(), "item_id", "left_semi")
    listed = wrong.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_list("fact")), ";").alias("unsupported"))
    return table(spark, d, "eval_items").select("item_id").join(listed, "item_id", "left").select("item_id", F.coalesce("unsupported", F.lit("")).alias("unsupported"))


@query("q_account_summary_docs", """WITH b AS (SELECT d.customer_slug, d.doc_id, d.doc_type, d.doc_date, 1 - list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS far FROM documents d JOIN embeddings v ON v.vec_id = d.doc_id CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
  t AS (SELECT *, 1 AS tier FROM b WHERE doc_type IN ('account_notes', 'transcript', 'qbr_deck') UNION ALL SELECT *, 2 FROM b),
  r AS (SELECT customer_slug, tier, doc_id, doc_date, round(far, 6) AS far, row_number() OVER (PARTITION BY customer_slug, tier ORDER BY round(far, 6), doc_id) AS rank FROM t QUALIFY rank <= 6),
  g AS (SELECT customer_slug, min(tier) AS tier FROM r WHERE far <= CASE tier WHEN 1 THEN 0.75 ELSE 0.85 END GROUP BY customer_slug)
  SELECT r.customer_slug, r.tier, r.doc_id, r.far, r.rank FROM r JOIN g ON g.customer_slug = r.customer_slug AND g.tier = r.tier""")
def q_account_summary_docs(spark: SparkSession, d: str) -> DataFrame:
    """The documents an account's summary rests on: the six nearest notes, transcripts and decks if any is within 0.75, else the six nearest of all types if any is within 0.85, else none.

    The vector with id 0 stands for the fixed question. Distances are computed row by row against that one vector, which every task gets."""
    one = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    asked = F.array(*[F.lit(float(x)) for x in (one.embedding if one else [])])
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    dot = F.aggregate(F.zip_with("e", asked, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    near = v.select("doc_id", F.round(1 - dot, 6).alias("far")).join(table(spark, d, "documents").select("doc_id", "customer_slug", "doc_type"), "doc_id")
    focused = F.col("doc_type").isin("account_notes", "transcript", "qbr_deck")
    tiers = near.withColumn("tier", F.explode(F.when(focused, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(2)))))
    ranked = cut_lineage(top_per_group(tiers, ["customer_slug", "tier"], [F.asc("far"), F.asc("doc_id")], 6).select("customer_slug", "tier", "doc_id", "far", "rank"))
    passes = F.col("far") <= F.when(F.col("tier") == 1, 0.75).otherwise(0.85)
    return ranked.join(ranked.filter(passes).groupBy("customer_slug").agg(F.min("tier").alias("tier")), ["customer_slug", "tier"])
