"""Words of texts as 64-bit hashes, in batches."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import xxhash

_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|&(?:nbsp|amp|lt|gt|quot|#\d+);")
_JOINED = re.compile("[­​-‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")

#: Words whose hashes a worker keeps at most.
KEPT_WORDS = 500_000


def words(text: str) -> list[str]:
    """The words of ``text`` without case, punctuation, markup, spacing or ligature forms."""
    t = text
    if not t.isascii():
        t = unicodedata.normalize("NFKC", _JOINED.sub("", t))
    if "<" in t or "&" in t:
        t = _TAG.sub(lambda m: " " if m[0][0] == "&" else "", t)
    return _WORD.findall(t.lower())


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < KEPT_WORDS:
            self[word] = h
        return h


_HASHES = WordHashes()


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts behind each other, and the offset at which each text begins (one more at the end)."""
    of = _HASHES.__getitem__
    parts: list[int] = []
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            parts.extend(map(of, words(t)))
        offsets[i + 1] = len(parts)
    return np.array(parts, dtype=np.uint64), offsets


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words; runs over the end of a text are the caller's to leave out."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
        out ^= out >> np.uint64(31)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(27)
    return out
