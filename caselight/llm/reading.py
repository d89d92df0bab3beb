"""Reading level of each document: a linear pairwise ranker over syntax and vocabulary features, calibrated into levels by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Graded documents used for fitting at most (by a hash of their id), and pairs drawn from them.
TRAINING_DOCUMENTS, TRAINING_PAIRS = 6000, 60000
LEVELS = (1, 2, 3, 4)

# Frequent words that tell the four languages apart.
STOPWORDS = {
    "en": frozenset("the and of to is that for with was not this are we it be have from they you".split()),
    "de": frozenset("der die das und ist nicht wir mit ein eine zu den auf für dass sie wird im von es".split()),
    "fr": frozenset("le la les et est que des pour une dans pas nous sur au ce il elle du avec on".split()),
    "es": frozenset("el los las y es que de para una en no se con por del está lo su como más".split()),
}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?]+(?:\s|$)|\n\s*\n")
FEATURES = ("mean_length", "long_8", "long_11", "long_14", "upper_length", "words_per_sentence", "commas", "semicolons", "variety", "short_3", "questions", "median_length")


def features(text: str | None) -> list[float]:
    """The FEATURES of a text; zeros where it has no words."""
    words = _WORD.findall(text or "")
    if not words:
        return [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    n = len(words)
    sentences = max(1, len(_SENTENCE.findall(text)))
    counts = np.bincount(np.minimum(lengths, 30), minlength=31).cumsum() / n
    at = lambda q: float(np.searchsorted(counts, q))
    return [
        float(lengths.mean()), 1 - counts[7], 1 - counts[10], 1 - counts[13], at(0.9), float(np.log(n / sentences + 1)), text.count(",") / n, (text.count(";") + text.count(":")) / n,
        float(np.log(len(set(words)) + 1) / np.log(n + 1)), counts[3], text.count("?") / sentences, at(0.5),
    ]


def language(lang: str | None, text: str | None) -> str:
    """The stated language in lower case, or, where none of the four is stated, the one whose frequent words the text has most of."""
    stated = (lang or "").strip().lower()[:2]
    if stated in STOPWORDS:
        return stated
    counts = Counter(w.lower() for w in _WORD.findall(text or ""))
    return max(STOPWORDS, key=lambda k: (sum(counts[w] for w in STOPWORDS[k]), k))


def document_features(documents: DataFrame) -> DataFrame:
    """doc_id, lng and one column per feature; every row of ``documents`` (doc_id, text, lang), read whole."""
    schema = "doc_id long, lng string, " + ", ".join(f"{f} double" for f in FEATURES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, language(g, t), *features(t)) for i, t, g in zip(b.doc_id, b.text, b.lang, strict=True)]
            yield pd.DataFrame(rows, columns=["doc_id", "lng", *FEATURES])

    return documents.select("doc_id", "text", "lang").mapInPandas(run, schema)


def fit_ranker(x: np.ndarray, y: np.ndarray, group: np.ndarray, pairs: int = TRAINING_PAIRS, steps: int = 400) -> np.ndarray:
    """Weights of a linear ranker: logistic loss on the feature differences of pairs of one group with different grades."""
    rng = np.random.default_rng(7)
    i, j = rng.integers(0, len(y), pairs), rng.integers(0, len(y), pairs)
    ok = (group[i] == group[j]) & (y[i] != y[j])
    i, j = i[ok], j[ok]
    if not len(i):
        return np.zeros(x.shape[1])
    d = (x[i] - x[j]) * np.sign(y[i] - y[j])[:, None]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        g = -(d * p[:, None]).mean(axis=0) + 1e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Breakpoints of the non-decreasing least-squares fit of ``y`` on ``score`` (pool adjacent violators): upper scores and values of the pools."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []
    for s, g in zip(score[order], y[order], strict=True):
        pools.append([float(g), 1.0, float(s)])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], b[2]])
    return np.array([p[2] for p in pools]), np.array([p[0] for p in pools])


def cut_points(score: np.ndarray, y: np.ndarray) -> list[float]:
    """The scores at which the calibrated level passes 1.5, 2.5 and 3.5; a level that isn't reached has its cut at infinity."""
    upper, value = isotonic(score, y)
    cuts = []
    for at in (1.5, 2.5, 3.5):
        n = int(np.searchsorted(value, at))
        cuts.append(float("inf") if n == len(value) else float("-inf") if n == 0 else float(upper[n - 1] + (np.min(score[score > upper[n - 1]], initial=np.inf) - upper[n - 1]) / 2))
    return cuts


def reading_levels(documents: DataFrame, labels: DataFrame, training_documents: int = TRAINING_DOCUMENTS) -> DataFrame:
    """doc_id, reading_level (1 to 4), score of every row of ``documents`` (doc_id, text, lang).

    ``labels``: doc_id, reading_level (several raters are averaged; null grades are left out). Features are standardised within each language over all documents. Documents
    without words get the lowest score. Without any labels every document is on level 1. Equal texts get equal levels; repeated rows come out repeated.
    """
    from caselight.session import cut_lineage

    feats = cut_lineage(document_features(documents))
    stats = feats.groupBy("lng").agg(*[F.avg(f).alias(f"{f}_m") for f in FEATURES], *[F.stddev_pop(f).alias(f"{f}_s") for f in FEATURES])  # at most four rows
    table = stats.toPandas().set_index("lng")
    graded = labels.filter("doc_id IS NOT NULL AND reading_level BETWEEN 1 AND 4").groupBy("doc_id").agg(F.avg("reading_level").alias("grade"))
    chosen = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_documents)
    # The labelled documents are picked out before repeated rows are dropped, so the features of the corpus aren't shuffled.
    sample = feats.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").toPandas()
    if not len(sample):
        return feats.select("doc_id", F.lit(1).cast("long").alias("reading_level"), F.lit(0.0).alias("score"))

    def standardised(frame: pd.DataFrame) -> np.ndarray:
        own = table.loc[frame.lng]
        spread = own[[f"{f}_s" for f in FEATURES]].to_numpy(dtype=float)
        return (frame[list(FEATURES)].to_numpy(dtype=float) - own[[f"{f}_m" for f in FEATURES]].to_numpy(dtype=float)) / np.where(spread > 1e-9, spread, 1.0)

    x, y = standardised(sample), sample.grade.to_numpy(dtype=float)
    codes = sample.lng.astype("category").cat.codes.to_numpy()
    weights = fit_ranker(x, y, codes)
    cuts: dict[str, list[float]] = {}
    everywhere = cut_points(x @ weights, y)
    for lng, part in sample.groupby("lng"):
        rows = sample.index.get_indexer(part.index)
        cuts[str(lng)] = cut_points((x @ weights)[rows], y[rows]) if len(rows) >= 30 and len(np.unique(np.round(y[rows]))) == len(LEVELS) else everywhere
    score, level = None, None
    for lng in table.index:
        own = table.loc[lng]
        s = sum(
            ((F.col(f) - F.lit(float(own[f"{f}_m"]))) / F.lit(float(own[f"{f}_s"]) if own[f"{f}_s"] > 1e-9 else 1.0) * F.lit(float(w)) for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0)
        )
        c = cuts.get(lng, everywhere)
        v = sum((F.when(s > F.lit(cut), 1).otherwise(0) for cut in c), F.lit(1)).cast("long")
        here = F.col("lng") == lng
        score, level = (F.when(here, s), F.when(here, v)) if score is None else (score.when(here, s), level.when(here, v))
    return feats.select("doc_id", level.alias("reading_level"), F.round(score, 6).alias("score"))
