"""Raw transcript lines made into clean, ordered speaker turns.

Lines are deduplicated, timed and labelled (speaker normalisation against the call's participants); tokens are classed as speech or filler (``fillers``); whether a line with an unsure label begins another speaker's turn is decided by gradient-boosted trees over the label, gaps and context, fitted on a bounded sample
of lines with sure labels into which slips are written.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.llm.boosting import fit, margin_column
from caselight.llm.fillers import TRAINING_LINES, TokenModel, cleaned, fit_tokens
from caselight.llm.names import NICKNAMES, folded
from caselight.session import cut_lineage

#: Pairs of adjacent lines (the first by a hash) on which the boundary model is fitted.
TRAINING_PAIRS = 4000
#: One label of so many is hidden from the model when it is fitted.
HIDDEN = 3
#: With fewer usable pairs, or one class of them only, nothing is fitted and the labels decide.
LEAST_PAIRS = 100
#: A block of a call: so many minutes of a timed call, so many lines of another. Long calls are worked on block by block.
BLOCK_MINUTES, BLOCK_LINES = 20, 500

_TIME = re.compile(r"^\s*[\[(]?(?:(\d{1,2}):)?(\d{1,2}):(\d{2})(?:[.,](\d{1,3}))?[\])]?(?:\s*-->\s*(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?)?(?=\s|$|[-–])\s*[-–]?\s*")
_LABEL = re.compile(r"^\s*(?:>>\s*)?([^\W\d_][^:\n]{0,58}?)\s*:(?=\s|$)\s*")
_NUMBERED = re.compile(r"^(?:spk|speaker|sprecher|participant|s)[\s_#-]*(\w+)$")
_REMARK = re.compile(r"\s*(?:\([^)]*\)|\[[^\]]*\]|\s[-–]\s+\w+)\s*$")

@lru_cache(maxsize=4096)
def _participants(speakers: str | None) -> tuple[tuple[str, str, str], ...]:
    """(spk_id, given, surname), folded."""
    out = []
    for s in json.loads(speakers) if speakers else []:
        words = folded(s.get("spk_name") or "").split()
        if s.get("spk_id") is not None:
            out.append((s["spk_id"], words[0] if words else "", " ".join(words[1:])))
    return tuple(out)


def _slips(a: str, b: str) -> int:
    """Edits, swaps counting one; 3 stands for more than two."""
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if last and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, last[j - 2] + 1)
            row.append(cost)
    return min(row[-1], 3)


@lru_cache(maxsize=65536)
def resolved(label: str, speakers: str | None) -> tuple[str | None, int]:
    """(spk_id, certainty 3 exact, 2 partial, 1 with slips) of a label; (None, 0) if it names no participant, or as well one as another."""
    people = _participants(speakers)
    text = label.strip().lstrip(">").strip().rstrip(":").strip()
    while (shorter := _REMARK.sub("", text)) != text and shorter:
        text = shorter
    plain = folded(text)
    if m := _NUMBERED.match(plain):
        for spk, _, _ in people:
            if folded(spk) in (m[1], plain):
                return spk, 3
    if "," in plain:
        surname, _, given = plain.partition(",")
        plain = f"{given.strip()} {surname.strip()}"
    words = [w.rstrip(".") for w in plain.split()]
    words = [w for i, w in enumerate(words) if w and not (len(w) == 1 and 0 < i < len(words) - 1)]
    if not words:
        return None, 0
    joined = " ".join(words)
    scores = sorted(((_written_as(words, joined, given, surname), spk) for spk, given, surname in people), reverse=True)
    if scores and scores[0][0] == 0:
        scores = sorted(((_written_with_slips(words, joined, given, surname), spk) for spk, given, surname in people), reverse=True)
    if not scores or scores[0][0] == 0 or (len(scores) > 1 and scores[0][0] == scores[1][0]):
        return None, 0
    return scores[0][1], 3 if scores[0][0] == 100 else 2 if scores[0][0] >= 75 else 1


def _formal(word: str) -> tuple[str, ...]:
    return (word, *NICKNAMES.get(word, "").split())


def _written_as(words: list[str], joined: str, given: str, surname: str) -> int:
    """How surely ``words`` are one of the ways of writing a name without slips; 0 if they aren't."""
    first = words[0]
    if len(words) == 1:
        return 80 if given in _formal(first) else 75 if first in (surname, f"{given}.{surname}", given[:1] + surname) else 0
    if joined in (f"{given} {surname}", f"{surname} {given}") or (given in _formal(first) and " ".join(words[1:]) == surname):
        return 100
    if len(words) == 2:
        last = words[1]
        if (len(first) == 1 and last == surname and given[:1] == first) or (len(last) == 1 and given in _formal(first) and surname[:1] == last):
            return 90
    return 0


def _written_with_slips(words: list[str], joined: str, given: str, surname: str) -> int:
    if len(words) == 1:
        return {1: 50, 2: 20}.get(_slips(joined, given) if len(joined) > 2 else 3, 0)
    return {0: 70, 1: 70, 2: 60}.get(min(_slips(joined, f"{given} {surname}"), _slips(joined, f"{surname} {given}")), 0)


def read_line(speaker: str | None, text: str | None, start_ms: float | None, speakers: str | None, model: TokenModel | None = None) -> tuple[float | None, str | None, int, bool, str, bool]:
    """(time, spk_id, certainty, labelled, clean text, says something) of a line."""
    return _read(speaker, text, start_ms, speakers, model or TokenModel())[:6]


def _read(speaker: str | None, text: str | None, start_ms: float | None, speakers: str | None, model: TokenModel) -> tuple[float | None, str | None, int, bool, str, bool, str | None]:
    """``read_line`` and the label as written."""
    rest = text or ""
    at = None if start_ms is None or start_ms != start_ms else float(start_ms)
    stated, rest = _time_at_head(rest)
    label = speaker if speaker and speaker.strip(" >:\t") else None
    if m := _LABEL.match(rest):
        spk, sure = resolved(m[1], speakers)
        if spk is not None and sure >= 1:
            behind, rest = _time_at_head(rest[m.end() :])
            stated = behind if stated is None else stated
            label = label or m[1]
    at = stated if at is None else at
    spk, sure = resolved(label, speakers) if label else (None, 0)
    clean, says = cleaned(rest, model)
    return at, spk, sure, label is not None, clean, says, label


def _time_at_head(text: str) -> tuple[float | None, str]:
    """The time a text begins with, in milliseconds, and the text behind it."""
    if not (m := _TIME.match(text)):
        return None, text
    return (int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])) * 1000.0 + float((m[4] or "0").ljust(3, "0")), text[m.end() :]


def _pair(speakers: str | None) -> list[str] | None:
    ids = sorted({spk for spk, _, _ in _participants(speakers)})
    return ids if len(ids) == 2 else None


def _people(calls: DataFrame) -> DataFrame:
    return calls.select("call_id", F.to_json(F.sort_array("speakers")).alias("_people")).dropDuplicates(["call_id"])


_LINE = "struct<at:double,spk:string,sure:int,labelled:boolean,clean:string,says:boolean,label:string,pair:array<string>>"


def token_model(turns: DataFrame, lines: int = TRAINING_LINES) -> TokenModel:
    """The filler model of ``turns``, fitted in the driver on at most ``lines`` distinct texts, the first by a hash."""
    texts = turns.filter(F.col("text").rlike(r"\w")).select("text", F.xxhash64("text").alias("h")).orderBy("h", "text").limit(lines)
    return fit_tokens(sorted({r.text for r in texts.collect()}))


def timed_lines(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per distinct line: call_id, line_no, at, spk, sure, labelled, clean, says, label, pair (the participants of a call of two, for a label that names none), timed, block."""
    model = token_model(turns)

    @F.pandas_udf(_LINE)
    def read(speaker: pd.Series, text: pd.Series, start: pd.Series, speakers: pd.Series) -> pd.DataFrame:
        rows = [_read(*x, model) for x in zip(speaker, text, start, speakers, strict=True)]
        pairs = [_pair(s) if r[3] and r[1] is None else None for r, s in zip(rows, speakers, strict=True)]
        return pd.DataFrame([(*r, x) for r, x in zip(rows, pairs, strict=True)], columns=["at", "spk", "sure", "labelled", "clean", "says", "label", "pair"])

    people = _people(calls)
    file_block = F.floor(F.coalesce("line_no", F.lit(0)) / BLOCK_LINES).cast("long").alias("_file_block")
    once = turns.filter("call_id IS NOT NULL").select("call_id", file_block, "line_no", "speaker", "text", F.col("start_ms").cast("double").alias("start_ms")).repartition("call_id", "_file_block")
    once = once.dropDuplicates(["call_id", "_file_block", "line_no", "speaker", "text", "start_ms"])
    lines = once.join(people, "call_id", "left").withColumn("r", read("speaker", "text", "start_ms", "_people")).select("call_id", "_file_block", "line_no", "r.*")
    lines = cut_lineage(lines)
    # A line of a timed call that states no time stands at the time of the line before it in the file.
    w_file = W.partitionBy("call_id").orderBy("_file_block")
    parts = lines.groupBy("call_id", "_file_block").agg(F.coalesce(F.max(F.col("at") > 0), F.lit(False)).alias("timed"), F.max_by("at", F.when(F.col("at").isNotNull(), F.struct("line_no", "at"))).alias("_last_at"))
    parts = parts.select("call_id", "_file_block", F.max("timed").over(W.partitionBy("call_id")).alias("timed"), F.last("_last_at", ignorenulls=True).over(w_file.rowsBetween(W.unboundedPreceding, -1)).alias("_at_before"))
    known = F.last("at", ignorenulls=True).over(W.partitionBy("call_id", "_file_block").orderBy("line_no", "at").rowsBetween(W.unboundedPreceding, 0))
    lines = lines.join(parts, ["call_id", "_file_block"]).withColumn("at", F.when(F.col("timed"), F.coalesce("at", known, "_at_before", F.lit(0.0)))).drop("_at_before", "_file_block")
    block = F.when(F.col("timed"), F.floor(F.col("at") / (BLOCK_MINUTES * 60_000))).otherwise(F.floor(F.coalesce("line_no", F.lit(0)) / BLOCK_LINES))
    return lines.withColumn("block", block.cast("long"))


def _carried(lines: DataFrame, value: Column, order: list, name: str) -> DataFrame:
    """``lines`` with ``name``: the last ``value`` that isn't null in the blocks before the line's own."""
    last = lines.filter(value.isNotNull()).groupBy("call_id", "block").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    blocks = lines.select("call_id", "block").distinct().join(last, ["call_id", "block"], "left")
    w = W.partitionBy("call_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return lines.join(blocks.select("call_id", "block", F.last("_last", ignorenulls=True).over(w).alias(name)), ["call_id", "block"])


def with_slips(label: str, seed: int) -> str:
    """``label`` with one or two letters swapped, dropped, doubled or replaced; the same for the same seed."""
    r, out = random.Random(seed), list(label)
    for _ in range(r.choice((1, 1, 2))):
        at = [i for i, c in enumerate(out) if c.isalpha()]
        if len(at) < 3:
            break
        i = r.choice(at)
        kind = r.randrange(4)
        if kind == 0 and i + 1 < len(out):
            out[i], out[i + 1] = out[i + 1], out[i]
        elif kind == 1:
            del out[i]
        elif kind == 2:
            out.insert(i, out[i])
        else:
            out[i] = r.choice("abcdefghijklmnopqrstuvwxyz")
    return "".join(out)


def training_rows(sample: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and targets from lines with sure labels (label, people, spk, prev, gap, size, before).

    Slips are written into each label and it is resolved again; only those that come out unsure or name nobody, as the lines the model is for, are kept. Slips seldom mislead,
    so every third label is hidden, for gap and context to be learned. The target is the change of speaker by the sure label, which no feature is made from.
    """
    x, y = [], []
    for n, r in enumerate(sample.itertuples(index=False)):
        slipped = with_slips(r.label, n)
        spk, sure = (None, 0) if n % HIDDEN == 0 else resolved(slipped, r.people)
        if sure < 2:
            x.append([0.0 if spk is None else -1.0 if spk == r.prev else 1.0, float(len(slipped.split())), r.gap, r.size, r.before])
            y.append(float(r.spk != r.prev))
    return np.array(x, dtype=float).reshape(-1, 5), np.array(y, dtype=float)


def attributed(turns: DataFrame, calls: DataFrame, training_pairs: int = TRAINING_PAIRS) -> DataFrame:
    """The lines with their speaker, those that say nothing dropped, and ``opens``: whether the line opens a turn.

    A line without label goes to the speaker of the line before it; at the start of a call to the next named one. So does a line with an unsure label, or one that names no
    participant, unless the model says that it begins another turn: that is the label's speaker or, where it names none, the other one of a call of two. As a turn is a maximal run of one participant, ``opens`` follows the speakers decided so.
    """
    lines = timed_lines(turns, calls)
    order = ["at", "line_no"]
    w_block = W.partitionBy("call_id", "block").orderBy(*order)
    so_far = w_block.rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("_known", F.last("spk", ignorenulls=True).over(so_far)).withColumn("_before", F.lag("_known").over(w_block)).withColumn("_gap", F.coalesce(F.col("at") - F.lag("at").over(w_block), F.lit(0.0)) / 1000)
    lines = lines.withColumn("_size", F.length("clean").cast("double")).withColumn("_size_before", F.coalesce(F.lag("_size").over(w_block), F.lit(0.0)))
    lines = cut_lineage(_carried(lines, F.col("spk"), order, "_carry")).withColumn("_prev", F.coalesce("_before", "_carry")).withColumn("_gap", F.least("_gap", F.lit(60.0)))
    sample = lines.filter("_prev IS NOT NULL AND sure >= 2").orderBy(F.xxhash64("call_id", "line_no"), "label", "clean").limit(training_pairs)
    sample = sample.join(_people(calls), "call_id").orderBy(F.xxhash64("call_id", "line_no"), "label", "clean")
    x, y = training_rows(sample.select("label", F.col("_people").alias("people"), "spk", F.col("_prev").alias("prev"), F.col("_gap").alias("gap"), F.col("_size").alias("size"), F.col("_size_before").alias("before")).toPandas())
    is_boundary = F.col("spk").isNotNull()
    if len(y) >= LEAST_PAIRS and y.min() != y.max():
        features = [F.when(F.col("spk").isNull(), 0.0).when(F.col("spk") == F.col("_prev"), -1.0).otherwise(1.0), F.size(F.split(F.trim("label"), r"\s+")).cast("double"), F.col("_gap"), F.col("_size"), F.col("_size_before")]
        is_boundary = margin_column(fit(x, y), features) > 0
    # A sure label decides who speaks; the model whether an unsure one is followed or the speaker of the line before goes on.
    other = F.when(F.col("_prev") == F.col("pair")[0], F.col("pair")[1]).otherwise(F.col("pair")[0])
    unsure = F.col("labelled") & (F.col("sure") < 2) & F.col("_prev").isNotNull()
    own = F.when(~unsure, F.col("spk")).when(is_boundary, F.coalesce("spk", other))
    lines = cut_lineage(lines.withColumn("_own", own).drop("_known", "_before", "_carry", "_prev", "_gap", "_size", "_size_before", "label", "pair"))
    lines = _carried(lines.withColumn("_last_own", F.last("_own", ignorenulls=True).over(so_far)), F.col("_own"), order, "_carry")
    lines = lines.withColumn("speaker", F.coalesce("_last_own", "_carry"))
    first = lines.filter("speaker IS NOT NULL").groupBy("call_id").agg(F.min_by("speaker", F.struct(*order)).alias("_first"))
    kept = lines.join(first, "call_id", "left").withColumn("speaker", F.coalesce("speaker", "_first")).filter("says AND speaker IS NOT NULL").select("call_id", "block", "line_no", "at", "timed", "speaker", "clean")
    kept = _carried(kept, F.col("speaker"), order, "_carry")
    prev = F.coalesce(F.lag("speaker").over(w_block), F.col("_carry"))
    return kept.withColumn("opens", (prev.isNull() | (prev != F.col("speaker"))).cast("int")).drop("_carry")


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``turn_no``, from 1 per call."""
    lines = cut_lineage(lines)
    counts = lines.groupBy("call_id", "block").agg(F.sum("opens").alias("_n"))
    w = W.partitionBy("call_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("call_id", "block", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_offset"))
    inside = F.sum("opens").over(W.partitionBy("call_id", "block").orderBy("at", "line_no").rowsBetween(W.unboundedPreceding, 0))
    return lines.join(offsets, ["call_id", "block"]).withColumn("turn_no", (F.col("_offset") + inside).cast("long")).drop("_offset")


def speaker_turns(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """call_id, turn_no, spk_id, start_ms, text of every clean turn.

    Null or empty texts say nothing; a repeated line counts once; calls without participants give no turns. Times that are missing in the whole call are 0. Ties of time go
    by line number; a line without time in a timed call stands behind the line before it in the file. A call of any length is worked on in blocks of bounded time; only the
    text of one turn, however long, is a single value.
    """
    lines = numbered(attributed(turns, calls))
    return lines.groupBy("call_id", "turn_no").agg(
        F.first("speaker").alias("spk_id"),
        F.coalesce(F.min("at"), F.lit(0.0)).cast("long").alias("start_ms"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line_no", "clean"))), lambda x: x["clean"]), " ").alias("text"),
    )
