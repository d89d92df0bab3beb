"""Text operators: line filters, sentences, chunkers, labels, file-name rules and facts. Native expressions where the algorithm allows, Arrow batches where it is sequential."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bullets that keep a short line, and the speaker label of a plain transcript.
BULLETS = "•-*–○▸·"
LABEL = r"^([A-Za-zÀ-ɏ][A-Za-z0-9À-ɏ _-]{0,40}):\s+(.+)$"


def alternatives(words: tuple[str, ...]) -> str:
    """A pattern for any of ``words`` (patterns themselves) as whole words."""
    return rf"\b(?:{'|'.join(words)})\b"


def word_count(c: Column) -> Column:
    """Words between white space; 0 for null and blank."""
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def noise_filtered(c: Column) -> Column:
    """The lines that carry text: blank ones, page numbers and short fragments go, headings that end in a colon and bullets stay; null gives ''."""
    lines = F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n?", "\n"), "\n"), lambda x: F.trim(x))
    is_page = lambda x: x.rlike(r"^(?:[-–—]+\s*\d+\s*[-–—]*|\d+\s*[-–—]+|(?i:page)\s+\d+(?:\s+(?i:of)\s+\d+)?)$")
    short = lambda x: (F.size(F.split(x, r"\s+")) < 4) & (F.length(x) < 40)
    keeps = lambda x: x.endswith(":") | F.substring(x, 1, 1).isin(*BULLETS)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~is_page(x) & (~short(x) | keeps(x))), "\n")


def sentences(c: Column) -> Column:
    """Pieces between sentence ends followed by white space, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z0-9]+"), 0)


def split_sentences(text: str | None) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text or "")) if s]


def sentence_chunks(text: str | None, size: int = 256, overlap: int = 64) -> list[str]:
    """Whole sentences up to ``size`` words (a longer sentence stands alone); each chunk starts at least ``overlap`` words before the end of the one before."""
    parts = split_sentences(text)
    lengths = [len(p.split()) for p in parts]
    out, start = [], 0
    while start < len(parts):
        end, total = start, 0
        while end < len(parts) and (end == start or total < size):
            total += lengths[end]
            end += 1
        out.append(" ".join(parts[start:end]))
        if end >= len(parts):
            break
        back, shared = end, 0
        while back > start + 1 and shared < overlap:
            back -= 1
            shared += lengths[back]
        start = max(start + 1, back)
    return out


def recursive_chunks(text: str | None, size: int, overlap: int, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most ``size`` characters, split at the coarsest separator that occurs, merged greedily with up to ``overlap`` characters repeated."""
    if not text or not text.strip():
        return []
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :] or ("",)
    out, window = [], []
    joined = lambda: sep.join(window).strip()
    for part in text.split(sep) if sep else list(text):
        if len(part) > size:
            if window and joined():
                out.append(joined())
            window = []
            out.extend(recursive_chunks(part, size, overlap, finer))
            continue
        if window and len(sep.join(window)) + len(sep) + len(part) > size:
            if joined():
                out.append(joined())
            while window and (len(sep.join(window)) > overlap or len(sep.join(window)) + len(sep) + len(part) > size):
                window.pop(0)
        window.append(part)
    if window and joined():
        out.append(joined())
    return out


def long_text_chunks(text: str | None, limit: int = 350, shared: int = 50, step: int = 300) -> list[str]:
    """A text of up to ``limit`` words unchanged; a longer one by sentences with up to ``shared`` words repeated, or, without sentence ends, in windows of words."""
    words = (text or "").split()
    if len(words) <= limit:
        return [text] if words else []
    parts = split_sentences(text)
    if len(parts) < 2:
        return [" ".join(words[i : i + limit]) for i in range(0, len(words), step) if i == 0 or i + limit - step < len(words)]
    out, window = [], []
    for p in parts:
        if window and sum(len(x.split()) for x in window) + len(p.split()) > limit:
            out.append(" ".join(window))
            kept: list[str] = []
            for x in reversed(window):
                if sum(len(y.split()) for y in kept) + len(x.split()) > shared:
                    break
                kept.insert(0, x)
            window = kept
        window.append(p)
    return [*out, " ".join(window)] if window else out


def exploded_chunks(df: DataFrame, key: str, text: str, chunker: Callable[[str | None], list[str]]) -> DataFrame:
    """key, chunk_index, chunk, n_words: one row per chunk, from a single pass without a shuffle."""
    dtype = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, c, len(c.split())) for k, t in zip(b[key], b[text], strict=True) for i, c in enumerate(chunker(t))]
            yield pd.DataFrame(rows, columns=[key, "chunk_index", "chunk", "n_words"])

    return df.select(key, text).mapInPandas(run, f"{key} {dtype}, chunk_index int, chunk string, n_words int")


def split_column(chunker: Callable[[str | None], list[str]]) -> Callable[[Column], Column]:
    """``chunker`` as a function of a column, in Arrow batches: an array of parts per text."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([chunker(t) for t in texts], dtype="object")

    return run


def merged_turns(turns: list[tuple[str, str]], limit: int = 120) -> list[tuple[str, str]]:
    """Consecutive turns of one speaker merged while their words stay within ``limit``; a first turn may exceed it."""
    out: list[list[str]] = []
    size = 0
    for speaker, text in turns:
        n = len(text.split())
        if out and out[-1][0] == speaker and size + n <= limit:
            out[-1][1] += f" {text}"
            size += n
        else:
            out.append([speaker, text])
            size = n
    return [(a, b) for a, b in out]


# Separators that end the head of a transcript, and the keys of its lines.
HEAD_ENDS = ("---", "—", "***", "===")
HEAD_KEYS = frozenset("date duration attendees participants location meeting subject time organizer host agenda title summary project call recorded transcribed".split())
# Cue times of VTT and SRT files, SRT counters, and the time lines of Zoom and Teams exports.
VTT_TIME, SRT_TIME = r"\d{2}:\d{2}:\d{2}\.\d{3}\s+-->\s+\d{2}:\d{2}:\d{2}\.\d{3}", r"\d{2}:\d{2}:\d{2},\d{3}\s+-->\s+\d{2}:\d{2}:\d{2},\d{3}"
SRT_COUNT, ZOOM_TIME, TEAMS_TIME = r"^\d+\s*$", r"^\d{1,2}:\d{2}:\d{2}\s*$", r"^\d{1,2}:\d{2}\s*[AaPp][Mm]\s*$"


def without_head(lines: list[str]) -> list[str]:
    """The lines behind the first separator; without one, those behind the leading lines whose label is a key of the head."""
    bare = [x.strip() for x in lines]
    if ends := [i for i, x in enumerate(bare) if x in HEAD_ENDS]:
        return lines[ends[0] + 1 :]
    first = 0
    for i, x in enumerate(bare):
        m = re.match(LABEL, x)
        if m and m[1].strip().lower() in HEAD_KEYS:
            first = i + 1
        elif x:
            break
    return lines[first:]


def plain_turns(text: str | None) -> list[tuple[str, str]]:
    """(speaker, utterance) of a plain transcript behind its head: a labelled line opens a turn, others continue it; text before the first label is said by ``Speaker``."""
    return _labelled(without_head((text or "").splitlines()))


def _labelled(lines: list[str]) -> list[tuple[str, str]]:
    out: list[list[str]] = []
    for line in lines:
        if m := re.match(LABEL, line.rstrip()):
            out.append([m[1].strip(), m[2].strip()])
        elif line.strip():
            if not out:
                out.append(["Speaker", ""])
            out[-1][1] = f"{out[-1][1]} {line.strip()}".strip()
    return [(a, b) for a, b in out if b]


def file_format(text: str | None) -> str:
    """``transcript_format`` of one text, in a batch."""
    lines = (text or "").splitlines()
    bare = [x.strip() for x in lines]
    if bare and bare[0].upper().startswith("WEBVTT"):
        return "vtt"
    if any(re.match(SRT_COUNT, a) and re.search(SRT_TIME, b) for a, b in zip(bare[:40], bare[1:41], strict=False)):
        return "srt"
    for name, pattern in (("zoom", ZOOM_TIME), ("teams", TEAMS_TIME)):
        if sum(re.match(pattern, x) is not None for x in bare[:20]) >= 2:
            return name
    return "plain"


def zoom_lines(lines: list[str]) -> list[str]:
    """Blocks of a time, a speaker and words made into labelled lines; a block ends at the next time or at a blank line behind its words. Other lines stay."""
    out: list[str] = []
    block: list[str] | None = None

    def close() -> None:
        if block and len(block) > 1:
            out.append(f"{block[0]}: {' '.join(block[1:])}")

    for line in (x.strip() for x in lines):
        if re.match(ZOOM_TIME, line):
            close()
            block = []
        elif block is None:
            if line:
                out.append(line)
        elif line:
            block.append(line)
        elif len(block) > 1:
            close()
            block = None
    close()
    return out


def teams_lines(lines: list[str]) -> list[str]:
    """Blocks of a speaker, a time and words made into labelled lines; a line is a speaker if the next one that isn't blank is a time. Lines outside blocks stay."""
    bare = [x.strip() for x in lines]
    following: list[str] = [""] * len(bare)
    seen = ""
    for i in range(len(bare) - 1, -1, -1):
        following[i] = seen
        seen = bare[i] or seen
    out: list[str] = []
    speaker, words = None, []
    for line, behind in zip(bare, following, strict=True):
        is_time = re.match(TEAMS_TIME, line) is not None
        if line and not is_time and re.match(TEAMS_TIME, behind):
            if speaker and words:
                out.append(f"{speaker}: {' '.join(words)}")
            speaker, words = line, []
        elif speaker and line and not is_time:
            words.append(line)
        elif speaker and not line and words:
            out.append(f"{speaker}: {' '.join(words)}")
            speaker, words = None, []
        elif line and not is_time:
            out.append(line)
    if speaker and words:
        out.append(f"{speaker}: {' '.join(words)}")
    return out


def transcript_turns(text: str | None) -> list[tuple[str, str, int]]:
    """(speaker, utterance, start_ms) of a transcript file of any format: a JSON export with segments, VTT, SRT, Zoom, Teams or plain text."""
    stripped = (text or "").lstrip()
    if stripped.startswith("{"):
        try:
            return segments(json.loads(stripped))
        except (ValueError, AttributeError):
            pass
    lines, kind = (text or "").splitlines(), file_format(text)
    if kind == "vtt":
        lines = [x for x in map(str.strip, lines) if x and not x.upper().startswith("WEBVTT") and not re.search(VTT_TIME, x) and not all(":" in t for t in x.split())]
    elif kind == "srt":
        lines = [re.sub(r"<[^>]+>", "", x).strip() for x in map(str.strip, lines) if x and not re.match(SRT_COUNT, x) and not re.search(SRT_TIME, x)]
    elif kind in ("zoom", "teams"):
        lines = zoom_lines(lines) if kind == "zoom" else teams_lines(lines)
    else:
        lines = without_head(lines)
    return [(a, b, 0) for a, b in _labelled(lines)]


def segments(export: dict) -> list[tuple[str, str, int]]:
    """The segments of a JSON export, with the names of its speakers; ``Speaker {id}`` where there is none, empty ones dropped."""
    names = {str(s.get("id", "")): s.get("name") or f"Speaker {s.get('id', '?')}" for s in export.get("speakers") or []}
    rows = [(str(x.get("spk_id", "")), (x.get("text") or "").strip(), int(x.get("start_offset") or 0)) for x in export.get("transcripts") or []]
    return [(names.get(i, f"Speaker {i}"), t, at) for i, t, at in rows if t]


def transcript_format(c: Column) -> Column:
    """vtt, srt, zoom, teams or plain by the first lines of a file; null is plain."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    head = F.slice(lines, 1, 20)
    numbered = F.exists(F.arrays_zip(F.slice(lines, 1, 40).alias("a"), F.slice(lines, 2, 40).alias("b")), lambda x: x["a"].rlike(SRT_COUNT) & F.coalesce(x["b"], F.lit("")).rlike(SRT_TIME))
    twice = lambda p: F.size(F.filter(head, lambda x: x.rlike(p))) >= 2
    return F.when(lines[0].rlike("(?i)^WEBVTT"), "vtt").when(numbered, "srt").when(twice(ZOOM_TIME), "zoom").when(twice(TEAMS_TIME), "teams").otherwise("plain")


def vtt_text(c: Column) -> Column:
    """A VTT text without header, cue times and cue settings."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    settings = lambda x: F.forall(F.split(x, r"\s+"), lambda t: F.contains(t, F.lit(":")))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.rlike("(?i)^WEBVTT") & ~x.rlike(VTT_TIME) & ~settings(x)), "\n")


def srt_text(c: Column) -> Column:
    """An SRT text without counters, cue times and tags."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: F.trim(x))
    kept = F.filter(lines, lambda x: (x != "") & ~x.rlike(SRT_COUNT) & ~x.rlike(SRT_TIME))
    return F.array_join(F.filter(F.transform(kept, lambda x: F.trim(F.regexp_replace(x, r"<[^>]+>", ""))), lambda x: x != ""), "\n")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(F.coalesce(c, F.lit("")), "/"), -1)


def filename_date(c: Column) -> Column:
    """The ISO date that a file name starts with (before an underscore), the first day of a ``YYYY-Qn`` quarter, or null."""
    name, iso, quarter = base_name(c), r"^(\d{4}-\d{2}-\d{2})_", r"^(\d{4})-Q([1-4])_"
    month = F.lpad((F.regexp_extract(name, quarter, 2).try_cast("int") * 3 - 2).cast("string"), 2, "0")
    return F.when(name.rlike(iso), F.regexp_extract(name, iso, 1)).when(name.rlike(quarter), F.concat(F.regexp_extract(name, quarter, 1), F.lit("-"), month, F.lit("-01")))


# Parts of a file name with the document type they show, in order of precedence, the types that endings stand for, and the shape of a valid name.
TYPE_KEYWORDS = (
    (("commitment", "commitments"), "commitment_tracker"),
    (("account-notes", "account_notes", "account-note", "crm-notes"), "account_notes"),
    (("qbr-deck", "qbr_deck", "slide", "deck", "presentation"), "qbr_deck"),
    (("qbr", "status-call", "status_call", "incident-review", "incident_review", "kickoff", "renewal", "transcript"), "transcript"),
    (("architecture", "solution", "design", "infra", "system"), "solution_architecture"),
    (("ticket", "inc-", "bug-", "case-"), "ticket"),
)
TYPE_ENDINGS = {".pdf": "qbr_deck", ".docx": "qbr_deck", ".html": "solution_architecture", ".txt": "transcript"}
VALID_NAME = r"^(\d{4}-\d{2}-\d{2}|\d{4}-Q[1-4])_([a-z][a-z0-9_-]*)_(.+)\.(txt|pdf|docx|html|csv|json)$"
# Meeting types as file names show them, in order of precedence.
MEETINGS = ("qbr", "status-call", "status_call", "incident-review", "incident_review", "kickoff", "renewal")


def extension(filename: Column) -> Column:
    """The ending with its dot, in lower case; '' where there is none."""
    return F.regexp_extract(F.lower(base_name(filename)), r"(\.[^.]*)$", 1)


def inferred_type(filename: Column) -> Column:
    """The type that a file name's words show, else that of its ending; null where neither tells."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    endings = F.create_map(*[F.lit(x) for kv in TYPE_ENDINGS.items() for x in kv])
    rules = [F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w)), kind) for words, kind in TYPE_KEYWORDS]
    return F.coalesce(*rules, F.try_element_at(endings, extension(filename)))


def meeting_type(filename: Column) -> Column:
    """The first of MEETINGS, in their order, that the name has; null without any."""
    name = F.lower(F.coalesce(filename, F.lit("")))
    return F.coalesce(*[F.when(F.contains(name, F.lit(m)), m.replace("_", "-")) for m in MEETINGS])


# The shapes of checkable facts: dates, amounts, percentages, quantities with units, versions, priorities, severities, ids, cloud regions, large counts.
FACTS = (
    r"\b\d{1,4}[-/]\d{1,2}[-/]\d{2,4}\b",
    r"\$[\d,]+\.?\d*[KkMm]?",
    r"\b\d+\.?\d*\s*%",
    r"\b\d+\.?\d*\s*(?:hours?|days?|weeks?|months?|years?|minutes?|seconds?|ms|GB|MB|TB|KB)\b",
    r"\bv?\d+\.\d+(?:\.\d+)*\b",
    r"\bP[0-4]\b",
    r"\b(?:Sev|SEV)[\s-]?[0-4]\b",
    r"\b[A-Z]{2,5}-\d{3,6}\b",
    r"\b(?:us|eu|ap|sa|ca|af|me)-(?:east|west|central|north|south|northeast|southeast|northwest|southwest)-[0-9]\b",
    r"\b\d{1,3}(?:,\d{3})+\s*(?:events|records|requests|users|transactions|seats|rows)\b",
)


def facts(c: Column) -> Column:
    """The distinct facts of a text, in lower case and order."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.array_sort(F.array_distinct(F.concat(*[F.regexp_extract_all(low, F.lit(f"(?i){p}"), 0) for p in FACTS])))


def json_strings(text: str | None, least: int = 10) -> list[str]:
    """The strings of a JSON text of at least ``least`` characters, depth first; [] for what is no JSON."""
    try:
        todo = [json.loads(text or "")]
    except ValueError:
        return []
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if len(x.strip()) >= least:
                out.append(x.strip())
        elif isinstance(x, (list, dict)):
            todo.extend(reversed(list(x.values()) if isinstance(x, dict) else x))
    return out


class _Sections(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.path, self.out, self.level, self.skip = ["", "", ""], [], 0, 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag in ("h1", "h2", "h3"):
            self.level = int(tag[1])
            self.path[self.level - 1 :] = [""] * (4 - self.level)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in ("h1", "h2", "h3"):
            self.level = 0

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        if self.skip or not text:
            return
        if self.level:
            self.path[self.level - 1] = f"{self.path[self.level - 1]} {text}".strip()
        elif self.out and self.out[-1][:3] == tuple(self.path):
            self.out[-1] = (*self.out[-1][:3], f"{self.out[-1][3]} {text}")
        else:
            self.out.append((*self.path, text))


def html_sections(html: str | None) -> list[tuple[str, str, str, str]]:
    """(h1, h2, h3, text) of an HTML page; scripts and styles are dropped."""
    p = _Sections()
    p.feed(html or "")
    return p.out
