import math
import re
from collections import Counter

import numpy as np
import pytest

from caselight.operators.retrieval import bm25, dense_topk, reciprocal_rank_fusion


def test_bm25_against_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["the cat sat", "the dog sat on the mat", "a bird", "", None, "cat cat bird mat"])]
    queries = [(1, "cat mat"), (2, "the the bird"), (3, None)]
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in docs}
    n, avgdl = len(docs), sum(map(len, words.values())) / len(docs)
    df = Counter(w for ws in words.values() for w in set(ws))
    raw = {w: math.log((n - c + 0.5) / (c + 0.5)) for w, c in df.items()}
    idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
    want = {}
    for q, t in queries:
        for i, ws in words.items():
            shared = [w for w in re.findall("[a-z0-9]+", t or "") if w in ws]
            if shared:
                want[q, i] = sum(idf[w] * ws.count(w) * 2.5 / (ws.count(w) + 1.5 * (0.25 + 0.75 * len(ws) / avgdl)) for w in shared)
    out = bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")).collect()
    assert {(r.query_id, r.doc_id) for r in out} == set(want)
    assert all(abs(r.score - want[r.query_id, r.doc_id]) <= 5e-5 for r in out)


def test_dense_topk_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vector array<double>")
    out = dense_topk(rows, rows.filter("id < 5").withColumnRenamed("id", "query_id"), 4).collect()
    for q in range(5):
        scores = np.round(v @ v[q], 6)
        best = [i for i in sorted(range(60), key=lambda i: (-scores[i], i)) if i != q][:4]
        assert [r.id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] == best


def test_fusion(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank long")
    got = {r.doc_id: r.score for r in reciprocal_rank_fusion([a, a.filter("doc_id = 11").drop("rank").selectExpr("*", "1L AS rank")]).collect()}
    assert got[11] > got[10]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Ten documents of which the question shares words with the first alone; its vector is that of the last."""
    d = str(tmp_path_factory.mktemp("tables"))
    texts = ["zinc relay " * 300, *[f"other{i}" for i in range(2, 11)]]
    dates = ["2020-01-01", *["2025-01-01"] * 9]
    spark.createDataFrame([(i + 1, x, f"c{i}", f"f{i}.txt", "s", dates[i]) for i, x in enumerate(texts)], "doc_id long, text string, customer_slug string, filename string, source string, doc_date string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, [1.0, 0.0] if i in (1, 10) else [0.1 * i, 1.0]) for i in range(1, 11)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, "What is the latest on zinc relay?"), (2, "zinc")], "item_id long, question string").write.parquet(f"{d}/eval_items.parquet")
    return d


def test_fusion_has_a_dense_side(spark, tables):
    from caselight.plans.retrieval import q_rrf

    got = {r.doc_id for r in q_rrf(spark, tables).filter("query_id = 1").collect()}
    assert {1, 10} <= got  # 10 shares no word with the question; 1 has its id


def test_hybrid_gives_parents_and_the_recent_first(spark, tables):
    from caselight.plans.retrieval import q_hybrid_full

    got = q_hybrid_full(spark, tables).orderBy("query_id", "position").collect()
    assert {r.parent_chunk_id for r in got if r.doc_id == 1} >= {"p_1_0", "p_1_1"}
    assert [r.doc_id for r in got if r.query_id == 2][0] == 1
    assert [r.doc_id for r in got if r.query_id == 1][0] != 1


def test_bm25_by_tenant_and_unscored(spark):
    from caselight.operators.retrieval import with_unscored

    docs = spark.createDataFrame([(1, "a", "cat dog"), (2, "a", "dog"), (3, "b", "cat"), (4, "a", None)], "doc_id long, tenant string, text string")
    asks = spark.createDataFrame([(1, "a", "cat"), (2, "b", "dog"), (3, "c", "cat"), (4, "a", "")], "query_id long, tenant string, text string")
    ranked = bm25(docs, asks, tenant="tenant")
    assert [(r.query_id, r.doc_id) for r in ranked.collect()] == [(1, 1)]
    full = with_unscored(ranked, docs, asks, "tenant", 3)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in full.collect()) == [(1, 1, 1), (1, 2, 2), (1, 3, 4), (2, 1, 3), (4, 1, 1), (4, 2, 2), (4, 3, 4)]
    assert bm25(docs.limit(0), asks.drop("tenant")).count() == 0


def _random_tenants(spark):
    """Three tenants, one of which has most documents; few words, so that scores tie and some weigh nothing or less."""
    rng = np.random.default_rng(5)
    texts = lambda n, m: [" ".join(rng.choice(["the", "of", *(f"w{i}" for i in range(12))], p=[0.2, 0.2, *[0.05] * 12], size=rng.integers(0, m))) for _ in range(n)]
    docs = spark.createDataFrame([(i, "abc"[max(0, i - 237)], t) for i, t in enumerate(texts(240, 9))], "doc_id long, tenant string, text string")
    asks = spark.createDataFrame([(i, "aaab c"[i % 6], t) for i, t in enumerate(texts(60, 5))], "query_id long, tenant string, text string")
    return docs, asks


def test_bm25_in_blocks_is_bm25_of_the_whole(spark):
    """the blocks of a tenant's documents and queries decide nothing, nor does who fills the lists."""
    from caselight.operators.retrieval import with_unscored

    docs, asks = _random_tenants(spark)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    whole = bm25(docs, asks, tenant="tenant")
    want = rows(whole)
    assert len(want) > 100 and rows(bm25(docs, asks, tenant="tenant", block=50, asked=7)) == want
    filled = rows(with_unscored(whole, docs, asks, "tenant"))
    assert len(filled) > len(want)
    assert rows(bm25(docs, asks, tenant="tenant", unscored=True)) == filled == rows(bm25(docs, asks, tenant="tenant", unscored=True, block=50, asked=7))
    assert rows(bm25(docs.drop("tenant"), asks.drop("tenant"))) == rows(bm25(docs.drop("tenant"), asks.drop("tenant"), block=50, asked=7))


@pytest.fixture(scope="module")
def known(spark, tmp_path_factory):
    """150 documents that share words, each with one of its own; the documents 50, 100 and 150 are asked for."""
    d = str(tmp_path_factory.mktemp("known"))
    spark.createDataFrame([(i, f"the open plan of team word{i}", f"F{i}_x.txt") for i in range(1, 151)], "doc_id long, text string, filename string").write.parquet(f"{d}/documents.parquet")
    return d


def _shuffles_pairs(df):
    return re.search(r"hashpartitioning\([^)]*query_id#\d+L?, doc_id#", df._jdf.queryExecution().executedPlan().toString()) is not None


def test_gold_eval_shuffles_no_pair_of_query_and_document(spark, known):
    """every question shares words with every document, so such pairs are as many as the square of the documents."""
    from caselight.plans.retrieval import q_gold_eval

    df = q_gold_eval(spark, known)
    assert not _shuffles_pairs(df)
    assert sorted(map(tuple, df.collect())) == [(50, 1.0, 1.0), (100, 1.0, 1.0), (150, 1.0, 1.0)]


def test_bounds_of_common_terms_lose_no_document():
    """with common terms left to the candidates, the best are those of all documents."""
    from caselight.operators.retrieval import _Postings

    rng = np.random.default_rng(7)
    p = np.array([0.1] * 4 + [0.6 / 400] * 400)
    texts = [" ".join(f"w{i}" for i in rng.choice(404, p=p, size=rng.integers(2, 30))) for _ in range(5000)]
    queries = [Counter(texts[i].split()[:n]) for i in range(0, 5000, 100) for n in (1, 4, 30)]
    postings = _Postings(texts, {w for q in queries for w in q}, None)
    columns = postings.columns
    assert columns
    for q in queries:
        postings.columns = columns
        pruned = postings.best(q, 10, False)
        postings.columns = {}
        plain = postings.best(q, 10, False)
        assert sorted(zip(pruned[0].tolist(), pruned[1].tolist(), strict=True)) == sorted(zip(plain[0].tolist(), plain[1].tolist(), strict=True))


def test_ir_metrics_shuffle_no_pair_of_query_and_document(spark, known):
    """as for F2; all three items are found first."""
    from caselight.plans.retrieval import q_ir_metrics

    df = q_ir_metrics(spark, known)
    assert not _shuffles_pairs(df)
    assert tuple(df.first()) == (3, 1.0, 1.0, 1.0)


def _shuffles_texts(df):
    """Whether documents go to blocks, or any exchange has their texts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "FlatMapCoGroups" in plan or re.search(r"hashpartitioning\((?:_t|_b|_c|text)#", plan) is not None


def test_gold_eval_shuffles_no_text(spark, known):
    """the questions, a fiftieth of the documents, go to the documents, whose texts stay where they are read."""
    from caselight.plans.retrieval import q_gold_eval

    assert not _shuffles_texts(q_gold_eval(spark, known))


def test_bm25_by_scan_is_bm25_in_blocks(spark):
    """F2: whether the queries are sent to the documents or meet them in blocks decides nothing; some weights are 0 or less, scores tie."""
    docs, asks = (x.drop("tenant") for x in _random_tenants(spark))
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    want = rows(bm25(docs, asks, sent=-1, block=50))
    assert _shuffles_texts(bm25(docs, asks, sent=-1)) and not _shuffles_texts(bm25(docs, asks))
    assert len(want) > 100 and rows(bm25(docs, asks)) == want


def test_scanned_blocks_lose_no_document():
    """F2: single precision, common terms as columns and what is known from earlier blocks lose none of the best, whatever the order of the ids."""
    import pyarrow as pa

    from caselight.operators.retrieval import _Postings, _scan_scores, _Sent

    rng = np.random.default_rng(7)
    p = np.array([0.1] * 4 + [0.6 / 400] * 400)
    texts = [" ".join(f"w{i}" for i in rng.choice(404, p=p, size=rng.integers(0, 30))) for _ in range(5000)]
    texts[:200] = texts[200:400]
    queries = [Counter(texts[i].split()[:n]) for i in range(0, 5000, 100) for n in (1, 4, 30)]
    whole = _Postings(texts, {w for q in queries for w in q}, None)
    want = {(q, int(at), float(score)) for q, c in enumerate(queries) for at, score in zip(*whole.best(c, 10, False)[:2], strict=True)}
    sent = _Sent(pa.array(range(len(queries))), queries, {t: x for t, (_, _, x) in whole.terms.items()}, sum(len(t.split()) for t in texts) / 5000)
    ids = rng.permutation(5000)
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i : i + 700]), "text": [texts[j] or None for j in ids[i : i + 700]]}) for i in range(0, 5000, 700)]
    for scanned in (5000, 1500, 100):
        found = sorted((-s, d, q) for b in _scan_scores(iter(batches), sent, 10, scanned) for q, d, s in zip(*(c.to_pylist() for c in b.columns), strict=True))
        seen, got = Counter(), set()
        for s, d, q in found:
            seen[q] += 1
            if seen[q] <= 10:
                got.add((q, d, -s))
        assert got == want


def test_ir_metrics_shuffle_no_text(spark, known):
    """as for F2."""
    from caselight.plans.retrieval import q_ir_metrics

    assert not _shuffles_texts(q_ir_metrics(spark, known))


def test_what_leaves_the_scan_does_not_grow_with_the_files(spark):
    """a row per query, rank and task; tasks are as many as cores, not as the parts of the table."""
    import pyarrow as pa

    from caselight.operators.retrieval import _bm25_by_scan

    parts = 8 * spark.sparkContext.defaultParallelism
    docs = spark.createDataFrame([(i, f"plan of team word{i}") for i in range(4 * parts)], "doc_id long, text string").repartition(parts)
    asks = pa.table({"query_id": pa.array([1, 2], pa.int64()), "text": ["plan word3", "team word9"]})
    out = [(r.query_id, r.doc_id) for r in _bm25_by_scan(docs, asks, 2, "query_id long, doc_id long, score double").collect()]
    assert {(1, 3), (2, 9)} <= set(out) and len(out) <= 2 * 2 * spark.sparkContext.defaultParallelism


def test_words_are_those_of_the_pattern():
    """the faster split finds what the pattern finds, whatever the characters."""
    from caselight.operators.retrieval import _TERM, _words

    for text in (None, "", "A1-b2_c", "ÄÖ straßeİxKg", "tab\tx\x1cy z w", "\ud800a", "".join(map(chr, range(0x3100)))):
        assert _words(text) == _TERM.findall((text or "").lower())


def test_ir_metrics_ask_every_document(spark, known):
    """the metrics are of all 150 items, not of those whose id is divisible by 50; one that shares its head with an earlier one ranks behind it."""
    from caselight.plans.retrieval import q_ir_metrics

    assert tuple(q_ir_metrics(spark, known).first()) == (150, 1.0, 1.0, 1.0)


def test_heads_rank_as_questions_do(spark):
    """bounds lose none of the documents that rank no lower than the one that is asked for, whatever the blocks, the parts, the weights and how often a word occurs."""
    from pyspark.sql import functions as F

    from caselight.operators.retrieval import bm25_of_heads

    rng = np.random.default_rng(11)
    p = np.array([0.08] * 5 + [0.6 / 300] * 300)
    texts = [" ".join(f"w{i}" for i in rng.choice(305, p=p, size=rng.integers(0, 40))) for _ in range(900)]
    texts[:100] = texts[100:200]
    texts[200:203] = ["w3 " * 400, None, "longwordthatiscut" * 4]
    negative = [f"a b c {'d' if i % 5 else 'e'}" for i in range(60)]  # most words are in most documents
    for corpus in (texts, negative):
        docs = spark.createDataFrame([(i * 7919 % 1009, t) for i, t in enumerate(corpus)], "doc_id long, text string").repartition(3)
        asks = docs.select(F.col("doc_id").alias("query_id"), F.substring("text", 1, 30).alias("text"))
        lists = lambda df: {r.query_id: [(x.doc_id, x.score) for x in sorted(r.found, key=lambda x: x["rank"])] for r in df.groupBy("query_id").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("found")).collect()}
        want = lists(bm25(docs, asks, sent=-1))
        for at_once, scanned in ((10_000, 10_000), (300, 70)):
            got = lists(bm25_of_heads(docs, F.substring("text", 1, 30), at_once=at_once, scanned=scanned))
            assert got.keys() == want.keys()
            for q, found in want.items():
                own = next((i for i, (x, _) in enumerate(found) if x == q), 9)
                assert got[q][: own + 1] == found[: own + 1]
