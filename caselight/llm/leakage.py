"""Passages of evaluation items in a corpus, found by winnowing.

Of each window of ``w`` consecutive k-gram hashes the least is kept as a fingerprint, on both sides; a span of ``w + k - 1`` words that both share lies
over a whole window of each, which keeps the same hash, so no such span is missed. Shared fingerprints are extended word by word to the spans' length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.words import gram_hashes, hashed

#: Words of a k-gram, and of the shortest span that is reported.
GRAM, SPAN = 5, 10
#: Slots of the filter through which the corpus's fingerprints go before they are shuffled; its size (64 KB) doesn't depend on any table.
FILTER_BITS = 19

_FINGERPRINTS = "id long, part int, fp long, near array<long>"


def _winnowed(h: np.ndarray, offsets: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (of k-grams) and hashes that winnowing keeps, over all texts of a batch. A text of fewer than ``w`` k-grams has no span to guarantee."""
    g = gram_hashes(h, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    best, at = g[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, w):
        nearer = g[j : j + n] <= best  # of equal ones the rightmost
        best[nearer], at[nearer] = g[j : j + n][nearer], j
    starts = np.arange(n)
    text = np.searchsorted(offsets, starts, side="right") - 1
    inside = starts + w + k - 1 <= offsets[text + 1]
    positions = np.unique((starts + at)[inside])
    return positions, g[positions]


def fingerprints(texts: DataFrame, k: int = GRAM, span: int = SPAN, slots: np.ndarray | None = None) -> DataFrame:
    """id, part, fp, near of every fingerprint of ``texts`` (id, part, text) that passes ``slots`` (all if None). ``near`` has the hashes of the words around the k-gram, as
    many on either side as a span of ``span`` words can reach, zero beyond the text's ends."""
    w, reach = span - k + 1, span - k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            h, offsets = hashed(b.text.tolist())
            at, fp = _winnowed(h, offsets, k, w)
            if slots is not None:
                keep = slots[(fp & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)]
                at, fp = at[keep], fp[keep]
            text = np.searchsorted(offsets, at, side="right") - 1
            index = at[:, None] + np.arange(-reach, k + reach)[None, :]
            valid = (index >= offsets[text][:, None]) & (index < offsets[text + 1][:, None])
            near = np.where(valid, h[np.clip(index, 0, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(0)).astype(np.int64)
            ids, parts = b.id.to_numpy()[text], b.part.to_numpy()[text]
            yield pd.DataFrame({"id": ids, "part": parts, "fp": fp.astype(np.int64), "near": list(near)}, columns=["id", "part", "fp", "near"])

    return texts.filter(F.col("id").isNotNull() & F.col("text").rlike(r"\S")).select("id", "part", "text").mapInPandas(run, _FINGERPRINTS)


def leaked(corpus: DataFrame, items: DataFrame, k: int = GRAM, span: int = SPAN) -> DataFrame:
    """doc_id, item_id: each document in which ``span`` or more consecutive words of a text of the item occur consecutively.

    ``corpus``: id, text; ``items``: id, part, text (the parts of an item are searched for each by itself). Null, blank and shorter texts hold no span. Repeated
    documents are cases of their own; a repeated item is one. Case, punctuation, markup and spacing are ignored; texts are read whole.

    The items' fingerprints fill a bit filter of fixed size, which goes to every task; the corpus's that pass it are joined with the items' by value. AQE splits a
    fingerprint that stands in very many documents; equal fingerprints of one document with the same words around are one row before the shuffle.
    """
    wanted = fingerprints(items, k, span).dropDuplicates(["id", "part", "fp", "near"])
    set_slots = [r.slot for r in wanted.select(F.col("fp").bitwiseAND((1 << FILTER_BITS) - 1).alias("slot")).distinct().collect()]  # at most 2 ** FILTER_BITS
    slots = np.zeros(1 << FILTER_BITS, dtype=bool)
    slots[set_slots] = True
    seen = fingerprints(corpus.select("id", F.lit(0).alias("part"), "text"), k, span, slots).select(F.col("id").alias("doc_id"), "fp", F.col("near").alias("doc_near"))
    met = seen.join(wanted.select(F.col("id").alias("item_id"), "fp", "near"), "fp")
    reach = span - k
    same = F.zip_with("doc_near", "near", lambda a, b: (a == b) & (a != 0))
    met = met.withColumn("same", same)
    longest = F.aggregate("same", F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), lambda acc, x: F.struct(F.when(x, acc["run"] + 1).otherwise(0).alias("run"), F.greatest(acc["best"], F.when(x, acc["run"] + 1).otherwise(0)).alias("best")))
    kgram = F.forall(F.slice("same", reach + 1, k), lambda x: x)
    return met.filter(kgram & (longest["best"] >= span)).select("doc_id", "item_id").distinct()
