import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caselight.llm.leakage import leaked
from caselight.llm.packing import packed, pieces, plan
from caselight.llm.reading import cut_points, isotonic, reading_levels
from caselight.llm.tokens import DEFAULT_VOCABULARY, counter
from caselight.llm.words import words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_holds_every_item_once(lengths):
    hist = np.bincount(np.array(lengths, dtype=int), minlength=65)
    used = np.zeros(65, dtype=int)
    for p in plan(hist, 64):
        assert sum(n * t for n, t in p.slots) <= 64
        assert p.repeats > 0
        for n, t in p.slots:
            used[n] += t * p.repeats
    assert (used == hist).all()


def test_packing(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.choice([5, 80, 200, 400])))) for i in range(300)] + [(300, "word " * 5000), (301, None), (302, ""), (302, "")]
    items = pieces(spark.createDataFrame([(*t, 1) for t in texts], "doc_id long, text string, offset int"))
    out = packed(items).toPandas()
    count = counter(DEFAULT_VOCABULARY)
    assert len(out) == items.count()
    total = out.groupby("doc_id").n_tokens.sum()
    assert all(total[i] == count(t) * (2 if i == 302 else 1) for i, t in texts)
    assert (out.groupby("container_id").n_tokens.sum() <= 2048).all()
    assert out[out.doc_id == 300].n_tokens.max() == 2048
    spans = out[out.n_tokens > 0].sort_values(["container_id", "offset"])
    ends = (spans.offset + spans.n_tokens).groupby(spans.container_id).shift(1).fillna(0)
    assert (ends <= spans.offset).all()
    n = out.n_tokens.sum()
    assert out.container_id.nunique() <= np.ceil(n / 2048) * 1.05 + 1
    assert packed(items.limit(0)).count() == 0


def _brute(docs, items, span=10):
    grams = {}
    for i, _, t in items:
        w = words(t or "")
        for j in range(len(w) - span + 1):
            grams.setdefault(tuple(w[j : j + span]), set()).add(i)
    return {(d, i) for d, t in docs for w in [words(t or "")] for j in range(len(w) - span + 1) for i in grams.get(tuple(w[j : j + span]), ())}


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, p, " ".join(text(rng.choice([0, 9, 10, 30])))) for i in range(30) for p in (0, 1)] + [(99, 0, None)]
    docs = []
    for d in range(120):
        body = text(rng.choice([0, 5, 60]))
        source = rng.choice(items)[2]
        if source:
            w = source.split()
            n = rng.choice([8, 9, 10, 11, 30])
            at = rng.randrange(max(1, len(w) - n + 1))
            body[len(body) // 2 : len(body) // 2] = [x.upper() if rng.random() < 0.3 else f"<b>{x}</b>," for x in w[at : at + n]]
        docs.append((d, " ".join(body)))
    docs += [(500, None), (501, ""), (0, docs[0][1])]
    got = leaked(spark.createDataFrame([(*x, 7) for x in docs], "id long, text string, item_id int"), spark.createDataFrame(items, "id long, part int, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == _brute(docs, items)


def test_isotonic():
    upper, value = isotonic(np.array([1.0, 2, 3, 4]), np.array([1.0, 3, 2, 4]))
    assert list(value) == [1, 2.5, 4]
    assert list(upper) == [1, 3, 4]
    assert cut_points(np.array([1.0, 2.0]), np.array([2.0, 2.0])) == [float("-inf"), float("inf"), float("inf")]


def test_reading_levels_on_held_out_documents(spark):
    """Accuracy on documents whose labels weren't used for fitting."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/reading_labels.parquet")
    fit, held = labels.filter("doc_id % 3 <> 0"), labels.filter("doc_id % 3 = 0")
    out = reading_levels(docs, fit)
    assert out.count() == docs.count()
    both = out.join(held.withColumnRenamed("reading_level", "given"), "doc_id").toPandas()
    assert (both.reading_level == both.given).mean() > 0.85


def test_reading_edges(spark):
    docs = spark.createDataFrame([(1, None, None, 5), (2, "", "XX", 5), (2, "", "XX", 5), (3, "Hello there.", "EN", 5)], "doc_id long, text string, lang string, reading_level int")
    none = spark.createDataFrame([], "doc_id long, rater int, reading_level int")
    assert [r.reading_level for r in reading_levels(docs, none).collect()] == [1, 1, 1, 1]
    one = spark.createDataFrame([(3, 1, 4), (3, 2, None)], "doc_id long, rater int, reading_level int")
    assert reading_levels(docs, one).count() == 4
    assert reading_levels(docs.limit(0), one).count() == 0
