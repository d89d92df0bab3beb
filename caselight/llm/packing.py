"""Items of varying length combined into containers of fixed capacity.

Shallow combinations of lengths that fill a container are enumerated, non-negative least squares against the histogram of lengths gives how often each is
repeated; the counts are rounded and what is left is packed greedily. All of it works on the histogram, whose size is the capacity's, never on items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.llm.tokens import DEFAULT_VOCABULARY, counter
from caselight.session import cut_lineage

CAPACITY = 2048
#: Combinations that enter the least squares at most (the fullest of the commonest lengths), steps of the solver, and unused space allowed in one.
COMBINATIONS, STEPS, SLACK = 6000, 400, 2
#: Parts into which the items of one length are split to be numbered.
SALTS = 64


@dataclass(frozen=True)
class Pattern:
    """A filling of one container: ``slots`` of (length, times), repeated ``repeats`` times."""

    slots: tuple[tuple[int, int], ...]
    repeats: int


def _combinations(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of up to three different lengths that leave at most SLACK unused, commonest lengths first."""
    present = [int(x) for x in np.argsort(-hist, kind="stable") if hist[x] > 0 and x > 0]
    common, there, found = present[:160], set(present), {}
    for a in common:
        for i in range(1, capacity // a + 1):
            rest = capacity - i * a
            if rest <= SLACK:
                found.setdefault(((a, i),), rest)
                continue
            for j in range(1, 9):
                for slack in range(SLACK + 1):
                    b, over = divmod(rest - slack, j)
                    if over == 0 and b > 0 and b != a and b in there:
                        found.setdefault(tuple(sorted(((a, i), (int(b), j)))), slack)
        if len(found) >= COMBINATIONS // 2:
            break
    for n, a in enumerate(common[:60]):
        for b in common[n + 1 : 60]:
            for i, j in ((1, 1), (2, 1), (1, 2), (2, 2)):
                rest = capacity - i * a - j * b
                for k in (1, 2, 3):
                    c, over = divmod(rest, k)
                    if rest > 0 and over == 0 and c in there and c not in (a, b):
                        found.setdefault(tuple(sorted(((a, i), (b, j), (int(c), k)))), 0)
        if len(found) >= COMBINATIONS:
            break
    return list(found)[:COMBINATIONS]


def _least_squares(combos: list[tuple[tuple[int, int], ...]], hist: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used nearest to the histogram: multiplicative steps, which keep x non-negative."""
    rows = np.array([length for c in combos for length, _ in c])
    cols = np.array([n for n, c in enumerate(combos) for _ in c])
    times = np.array([t for c in combos for _, t in c], dtype=float)
    wanted = np.zeros(len(combos))
    np.add.at(wanted, cols, times * hist[rows])
    x = np.full(len(combos), hist.sum() / max(1, len(combos)) / 4)
    for _ in range(STEPS):
        used = np.bincount(rows, weights=times * x[cols], minlength=len(hist))
        given = np.bincount(cols, weights=times * used[rows], minlength=len(combos))
        x *= wanted / np.maximum(given, 1e-9)
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that hold exactly the items of ``hist`` (items by length, 0 unused)."""
    left = hist.astype(np.int64).copy()
    out: list[Pattern] = []
    combos = _combinations(hist, capacity) if left.sum() > 0 else []
    if combos:
        x = np.floor(_least_squares(combos, hist.astype(float)) + 1e-9).astype(np.int64)
        for n in np.argsort(-x, kind="stable"):
            repeats = min([int(x[n]), *(int(left[length] // t) for length, t in combos[n])])
            if repeats > 0:
                out.append(Pattern(combos[n], repeats))
                for length, t in combos[n]:
                    left[length] -= repeats * t
    # What is left: the longest first, the gap filled with the longest that fit, as often as the scarcest length allows.
    while left.any():
        longest = int(np.flatnonzero(left)[-1])
        slots, gap = [], capacity
        length = longest
        while length > 0:
            t = min(gap // length, int(left[length])) if slots or capacity // length == 1 else min(capacity // length, int(left[length]))
            if t:
                slots.append((length, t))
                gap -= t * length
            fits = np.flatnonzero(left[: min(gap, length - 1) + 1])
            length = int(fits[-1]) if len(fits) else 0
        repeats = min(int(left[n] // t) for n, t in slots)
        out.append(Pattern(tuple(slots), repeats))
        for n, t in slots:
            left[n] -= repeats * t
    return out


def pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """doc_id, piece_no, token_start, n_tokens: a text of up to ``capacity`` tokens is one piece, a longer one full pieces and a rest. Null and empty texts are one piece of no tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(vocabulary)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                n = count(text)
                rows += [(doc_id, k, start, min(capacity, n - start)) for k, start in enumerate(range(0, max(n, 1), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece_no", "token_start", "n_tokens"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id long, piece_no int, token_start long, n_tokens int")


def packed(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``items`` (doc_id, piece_no, n_tokens and others) with container_id and offset, the place of their first token in the container.

    Every row gets a place, repeated rows each their own; rows of no tokens take none and stand in container 0. Containers are numbered from 0 without gaps; their tokens
    never exceed ``capacity``. Only counts by length (at most ``capacity`` of them) reach the driver; a length that very many items have is numbered in salted parts.
    """
    salt = F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(SALTS)).cast("int")
    items = cut_lineage(items.withColumn("_salt", salt))
    parts = items.groupBy("n_tokens", "_salt").agg(F.count("*").alias("_n")).toPandas()  # at most capacity * SALTS rows
    hist = np.zeros(capacity + 1, dtype=np.int64)
    np.add.at(hist, parts.n_tokens.to_numpy(dtype=np.int64), parts["_n"].to_numpy(dtype=np.int64))
    hist[0] = 0
    patterns = plan(hist, capacity)
    before = np.zeros((capacity + 1, SALTS), dtype=np.int64)
    before[parts.n_tokens, parts["_salt"]] = parts["_n"]
    before = np.cumsum(before, axis=1) - before
    # Of each length, the ranks that each pattern takes.
    segments: list[tuple[int, int, int, int, int]] = []
    used = np.zeros(capacity + 1, dtype=np.int64)
    base = 0
    for p in patterns:
        offset = 0
        for length, times in p.slots:
            segments.append((length, int(used[length]), times, base, offset))
            used[length] += p.repeats * times
            offset += length * times
        base += p.repeats
    segments.sort()
    lengths, starts, times, bases, offsets = (np.array(c, dtype=np.int64) for c in zip(*segments, strict=True)) if segments else (np.zeros(0, dtype=np.int64),) * 5
    wide = np.int64(1) << np.int64(44)

    @F.pandas_udf("struct<container_id:long,offset:int>")
    def place(n_tokens: pd.Series, salts: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n = n_tokens.to_numpy(dtype=np.int64)
        r = rank.to_numpy(dtype=np.int64) - 1 + before[n, salts.to_numpy(dtype=np.int64)]
        if not len(lengths):
            return pd.DataFrame({"container_id": np.zeros(len(n), dtype=np.int64), "offset": np.zeros(len(n), dtype=np.int32)})
        at = np.maximum(np.searchsorted(lengths * wide + starts, n * wide + r, side="right") - 1, 0)
        inside = r - starts[at]
        return pd.DataFrame({"container_id": np.where(n > 0, bases[at] + inside // times[at], 0), "offset": np.where(n > 0, offsets[at] + inside % times[at] * n, 0).astype(np.int32)})

    rank = F.row_number().over(W.partitionBy("n_tokens", "_salt").orderBy("doc_id", "piece_no"))
    ranked = items.withColumn("_rank", rank).withColumn("_p", place("n_tokens", "_salt", "_rank"))
    return ranked.select(*[c for c in items.columns if c != "_salt"], "_p.container_id", "_p.offset")
