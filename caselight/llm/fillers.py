"""Token-level classification of fillers in lines of speech.

Hesitation sounds and sound notes are fillers wherever they stand. Words that are fillers only sometimes (``like``, ``you know``) are decided by gradient-boosted trees over
their context, fitted on a bounded sample of lines in which the hesitation sounds are the positive and all other words the negative examples.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np

from caselight.llm.boosting import fit, score_row

#: Lines on which the token model is fitted at most, and lines with fillers below which nothing is fitted: then a comma behind the phrase decides.
TRAINING_LINES, LEAST_FILLERS = 4000, 40

# Hesitation sounds, however long they are drawn, and phrases that are fillers in some contexts.
SOUND = r"(?:u+h+m*|u+m+|e+r+m*|h+m+|a+h+|e+h+|m+h+m+|m{2,}|ä+h+m?|euh+)"
PHRASES = ("you know", "i mean", "like", "sort of", "kind of")

_SOUND = re.compile(SOUND, re.IGNORECASE)
_NOTE = r"\[\s*[A-Za-z][\w -]{1,30}\]|\({1,2}\s*[a-z][\w -]{1,30}\s*\){1,2}|<[a-z][\w -]{1,30}>|\*[a-z][\w -]{1,30}\*"
#: What may be a filler: a note, a sound, or a phrase.
CANDIDATE = re.compile(rf"(?P<note>{_NOTE})|(?<![\w'’-])(?:(?P<sound>{SOUND})|(?P<phrase>{'|'.join(p.replace(' ', r'\s+') for p in PHRASES)}))(?![\w'’]|-\w)", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_TWICE = re.compile(r"\b([^\W\d_]+)-\s+\1\b", re.IGNORECASE)
_LOOSE = re.compile(r"\s+([,.;:!?])")
_EDGES = re.compile(r"^[\s,\-–.…]+|[\s,\-–]+$")


def _context(text: str, start: int, end: int) -> list[float]:
    """Whether a comma follows, whether the clause begins here, whether it ends behind, and whether the next word has a capital, as after something put before a sentence."""
    before, after = text[max(0, start - 40) : start].rstrip(), text[end : end + 40].lstrip()
    begins = not before or before[-1] in ",.;:!?-–…"
    return [float(after[:1] == ","), float(begins), float(not after or after[0] in ".;:!?"), float(after.lstrip(" ,.-…")[:1].isupper())]


def _word_before(text: str, start: int) -> str:
    found = _WORD.findall(text[max(0, start - 40) : start])
    return found[-1].lower() if found else ""


@dataclass
class TokenModel:
    """``trees`` over the context and attachment; ``bound`` counts, for a word and the phrase after it, [all occurrences, those without a comma behind]."""

    trees: dict | None = None
    bound: dict[tuple[str, str], list[int]] = field(default_factory=dict)

    def attached(self, before: str, token: str, own: int = 0, bare: int = 0) -> float:
        """Share of the other occurrences behind this word that no comma follows: high for a verb or object of the clause, low for an insertion; 0.5 if unknown."""
        n, without = self.bound.get((before, token), (0, 0))
        return (without - bare + 1.0) / (n - own + 2.0)

    def is_filler(self, text: str, start: int, end: int) -> bool:
        around = _context(text, start, end)
        if self.trees is None:
            return around[0] == 1.0
        token = " ".join(text[start:end].lower().split())
        return score_row(self.trees, [*around, self.attached(_word_before(text, start), token)]) > 0


def fit_tokens(lines: list[str | None]) -> TokenModel:
    """A model from lines of speech. The target of a token is whether it is a hesitation sound; no feature is made from its letters."""
    model = TokenModel()
    seen: list[tuple[str, str, list[float], float]] = []
    for line in lines:
        text = re.sub(_NOTE, " ", line or "", flags=re.IGNORECASE)
        before = ""
        for m in _WORD.finditer(text):
            token = m[0].lower()
            sound = float(_SOUND.fullmatch(token) is not None)
            seen.append((before, token, _context(text, m.start(), m.end()), sound))
            before = token
        for m in CANDIDATE.finditer(text):
            if m["phrase"] and " " in m["phrase"]:
                pair = model.bound.setdefault((_word_before(text, m.start()), " ".join(m["phrase"].lower().split())), [0, 0])
                pair[0] += 1
                pair[1] += int(_context(text, m.start(), m.end())[0] == 0)
    for before, token, around, _ in seen:
        pair = model.bound.setdefault((before, token), [0, 0])
        pair[0] += 1
        pair[1] += int(around[0] == 0)
    sounds = sum(s[-1] for s in seen)
    if sounds < LEAST_FILLERS:
        return model
    x = np.array([(*around, model.attached(before, token, 1, int(around[0] == 0))) for before, token, around, _ in seen])
    y = np.array([s[-1] for s in seen])
    model.trees = fit(x, y, rounds=12)
    model.bound = {k: v for k, v in model.bound.items() if k[1] in PHRASES}
    return model


def cleaned(text: str, model: TokenModel) -> tuple[str, bool]:
    """``text`` without sounds, filler phrases, notes, and words said twice around a dash; and whether it says anything else."""
    out, at, gap = [], 0, False
    for m in CANDIDATE.finditer(text):
        if m["phrase"] and not model.is_filler(text, m.start(), m.end()):
            continue
        piece = text[at : m.start()]
        out.append(piece.lstrip(" \t,-.…") if gap else piece)
        if gap and out[-1]:
            out[-1] = " " + out[-1]
        at, gap = m.end(), True
    rest = text[at:]
    if gap:
        short = rest.lstrip(" \t,-.…")
        # A mark that ended the clause before the filler stays; those that only set the filler off go.
        rest = " " + short if short else ""
    out.append(rest)
    clean = " ".join("".join(out).split())
    if "-" in clean:
        clean = _TWICE.sub(r"\1", clean)
    clean = _EDGES.sub("", _LOOSE.sub(r"\1", clean))
    return clean, any(c.isalnum() for c in clean)
