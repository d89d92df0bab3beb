"""What happens to a file before it is searched: its type, date and metadata, its parts, and the typed fields of its rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.catalog import query
from caselight.operators import text as X
from caselight.operators.fields import COMMITMENT_DATES, TICKET_DATES, adf_text, normal_date, parsed_bool
from caselight.operators.nested import decoded
from caselight.operators.ranking import previous_in_blocks
from caselight.plans.frames import AS_OF, COMMITMENT_STATUS, DOC_TYPES, STATUS, TERMINAL_COMMITMENTS, TERMINAL_TICKETS, case_sql, mapped, quoted
from caselight.sources.files import commitment_rows_of_json, commitment_sheet, html_parts, shared_csv, ticket_sheet
from caselight.tables import table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


# --- file names -------------------------------------------------------------------------------------------------------

_EXT = "regexp_extract(lower(split_part(coalesce(filename, ''), '/', -1)), '(\\.[^.]*)$', 1)"
_TYPE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(filename, '')), '{w}')" for w in words) + f" THEN '{kind}'" for words, kind in X.TYPE_KEYWORDS)
_TYPE += " ELSE CASE " + _EXT + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TYPE_ENDINGS.items()) + " END END"


def _named(spark: SparkSession, d: str) -> DataFrame:
    """All file names: of documents, calls, and those typed as sources of commitments."""
    c = table(spark, d, "calls").select(F.lit("call").alias("src"), F.col("call_id").alias("id"), "filename")
    s = table(spark, d, "commitments").select(F.lit("commitment").alias("src"), F.col("commit_row_id").alias("id"), F.concat(F.col("source_doc"), F.lit(".json")).alias("filename"))
    return _docs(spark, d).select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), "filename").unionByName(c).unionByName(s)


_NAMED = "named AS (SELECT 'document' AS src, doc_id AS id, filename FROM documents UNION ALL SELECT 'call', call_id, filename FROM calls UNION ALL SELECT 'commitment', commit_row_id, source_doc || '.json' FROM commitments)"


@query("q_infer_doc_type", f"WITH {_NAMED} SELECT src, id, {_TYPE} AS inferred FROM named")
def infer_doc_type(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("src", "id", X.inferred_type(F.col("filename")).alias("inferred"))


_VALID = f"regexp_matches(split_part(coalesce(filename, ''), '/', -1), '(?i){X.VALID_NAME}')"


@query("q_validate_filename", f"WITH {_NAMED} SELECT src, id, CASE WHEN NOT {_VALID} THEN 'shape' WHEN ({_TYPE}) IS NULL THEN 'type' ELSE '' END AS problem FROM named")
def validate_filename(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with a name: its ``shape`` (date, keyword, descriptor, ending), its ``type`` (no known one), or nothing."""
    name = F.col("filename")
    problem = F.when(~X.base_name(name).rlike("(?i)" + X.VALID_NAME), "shape").when(X.inferred_type(name).isNull(), "type").otherwise("")
    return _named(spark, d).select("src", "id", problem.alias("problem"))


_FILE_DATE = r"CASE WHEN regexp_matches(split_part(coalesce(filename, ''), '/', -1), '^\d{4}-\d{2}-\d{2}_') THEN left(split_part(filename, '/', -1), 10) WHEN regexp_matches(split_part(coalesce(filename, ''), '/', -1), '^\d{4}-Q[1-4]_') THEN left(split_part(filename, '/', -1), 4) || '-' || lpad(CAST(CAST(substr(split_part(filename, '/', -1), 7, 1) AS INTEGER) * 3 - 2 AS VARCHAR), 2, '0') || '-01' END"


@query("q_filename_date", f"WITH {_NAMED} SELECT src, id, {_FILE_DATE} AS file_date FROM named")
def filename_date(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).select("src", "id", X.filename_date(F.col("filename")).alias("file_date"))


_MEETING = "CASE " + " ".join(f"WHEN contains(lower(coalesce(filename, '')), '{m}') THEN '{m.replace('_', '-')}'" for m in X.MEETINGS) + " END"
#: Fixed value: the meeting types of a transcript's chunks, of which the leftmost in the name counts.
CHUNK_MEETINGS = "(qbr|status[-_]call|status|incident[-_]review|incident|kickoff|renewal)"


@query("q_meeting_type", f"WITH {_NAMED} SELECT src, id, {_MEETING} AS by_order, replace(regexp_extract(lower(split_part(coalesce(filename, ''), '/', -1)), '{CHUNK_MEETINGS}', 1), '_', '-') AS by_place FROM named")
def meeting_type(spark: SparkSession, d: str) -> DataFrame:
    by_place = F.translate(F.regexp_extract(F.lower(X.base_name(F.col("filename"))), CHUNK_MEETINGS, 1), "_", "-")
    return _named(spark, d).select("src", "id", X.meeting_type(F.col("filename")).alias("by_order"), by_place.alias("by_place"))


# How a format is read: its strategy and whether its parts are split again into parents and children.
STRATEGIES = {".pdf": ("pdf", True), ".docx": ("docx", True), ".html": ("html", True), ".txt": ("transcript", False), ".json": ("ticket", False), ".csv": ("csv", False)}


def strategy(filename: Column) -> Column:
    """(name, resplit) of the strategy for a file; null for an ending that isn't supported."""
    by = F.create_map(*[x for k, (n, r) in STRATEGIES.items() for x in (F.lit(k), F.struct(F.lit(n).alias("name"), F.lit(r).alias("resplit")))])
    return F.try_element_at(by, X.extension(filename))


def required_strategy(filename: Column) -> Column:
    """``strategy``, with an error for an ending that isn't supported."""
    s = strategy(filename)
    return F.when(s.isNull(), F.raise_error(F.concat(F.lit("unsupported file: "), F.coalesce(filename, F.lit(""))))).otherwise(s)


_STRATEGY = "CASE " + _EXT + " " + " ".join(f"WHEN '{k}' THEN '{{0}}'".replace("{0}", n) for k, (n, _) in STRATEGIES.items()) + " END"
_RESPLIT = "CASE " + _EXT + " " + " ".join(f"WHEN '{k}' THEN {str(r).lower()}" for k, (_, r) in STRATEGIES.items()) + " END"


@query("q_ingest_strategy", f"WITH {_NAMED} SELECT src, id, {_STRATEGY} AS strategy, {_RESPLIT} AS resplit FROM named")
def ingest_strategy(spark: SparkSession, d: str) -> DataFrame:
    s = strategy(F.col("filename"))
    return _named(spark, d).select("src", "id", s["name"].alias("strategy"), s["resplit"].alias("resplit"))


# Other names of the document types.
TYPE_ALIASES = {"tickets": "ticket", "commitments": "commitment_tracker", "plain_text": "transcript", "notes": "transcript", "generic_json": "ticket"}


def normal_type(c: Column, strict: bool = False) -> Column:
    """A type under its canonical name; null, or with ``strict`` an error, for one that isn't known."""
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_ALIASES.items() for x in kv]), c), c)
    return F.when(known.isin(*DOC_TYPES), known).otherwise(F.raise_error(F.concat(F.lit("unknown type: "), F.coalesce(c, F.lit("null")))).cast("string") if strict else F.lit(None))


@query("q_normalize_doc_type", f"""SELECT kind, n, CASE WHEN k IN ({quoted(DOC_TYPES)}) THEN k END AS canonical FROM (SELECT kind, n, {case_sql('kind', TYPE_ALIASES)} AS k FROM (
  SELECT doc_type AS kind, count(*) AS n FROM documents GROUP BY 1 UNION ALL SELECT doc_type || 's', count(*) FROM documents GROUP BY 1 UNION ALL SELECT meeting_type, count(*) FROM calls GROUP BY 1 UNION ALL SELECT regexp_replace(doc_type, '^.*_', ''), count(*) FROM documents GROUP BY 1))""")
def normalize_doc_type(spark: SparkSession, d: str) -> DataFrame:
    """The types that occur, their plurals and short forms, and meeting types, which are none."""
    docs = _docs(spark, d)
    kinds = [docs.groupBy(F.col("doc_type").alias("kind")), docs.groupBy(F.concat("doc_type", F.lit("s")).alias("kind")), table(spark, d, "calls").groupBy(F.col("meeting_type").alias("kind")), docs.groupBy(F.regexp_replace("doc_type", "^.*_", "").alias("kind"))]
    out = None
    for k in kinds:
        part = k.agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out.select("kind", "n", normal_type(F.col("kind")).alias("canonical"))


# --- dates and metadata -----------------------------------------------------------------------------------------------

_DATE = r"\b(\d{4}-\d{2}-\d{2})\b"


@query("q_doc_date", rf"SELECT doc_id, coalesce(CASE WHEN doc_type IN ('transcript', 'plain_text', 'account_notes') THEN nullif(regexp_extract(left(text, 2048), '{_DATE}', 1), '') END, nullif(regexp_extract(filename, '^(\d{{4}}-\d{{2}}-\d{{2}})', 1), '')) AS doc_date, CASE WHEN doc_type IN ('transcript', 'plain_text', 'account_notes') AND regexp_matches(left(text, 2048), '{_DATE}') THEN 'content' WHEN regexp_matches(filename, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN 'filename' ELSE 'upload_fallback' END AS source FROM documents")
def doc_date(spark: SparkSession, d: str) -> DataFrame:
    """The date of a document: the first in the head of a transcript or note (a head is the feature: later dates are spoken of), else that of its name, else none."""
    head = F.when(F.col("doc_type").isin("transcript", "plain_text", "account_notes"), F.nullif(F.regexp_extract(F.substring("text", 1, 2048), _DATE, 1), F.lit("")))
    named = F.nullif(F.regexp_extract("filename", r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    return _docs(spark, d).select("doc_id", F.coalesce(head, named).alias("doc_date"), F.when(head.isNotNull(), "content").when(named.isNotNull(), "filename").otherwise("upload_fallback").alias("source"))


_STAMPS = ("updated_at", "created_at", "created", "date")
_JSON = "CASE WHEN json_valid(coalesce(payload, '')) THEN payload ELSE '{}' END"


def _readable() -> Column:
    """The payload where it is JSON as it stands, else an empty object."""
    return F.when(F.try_parse_json("payload").isNotNull(), F.col("payload")).otherwise("{}")


@query("q_doc_date_json", "SELECT raw_id, coalesce(" + ", ".join(f"CASE WHEN regexp_matches(json_extract_string(j, '$.{s}'), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN left(json_extract_string(j, '$.{s}'), 10) END" for s in _STAMPS) + f") AS doc_date FROM (SELECT raw_id, {_JSON} AS j FROM raw_tickets)")
def doc_date_json(spark: SparkSession, d: str) -> DataFrame:
    """The date of a ticket file: that of its last update, else of its creation."""
    j = _readable()
    stamp = lambda s: F.when(F.get_json_object(j, f"$.{s}").rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(F.get_json_object(j, f"$.{s}"), 1, 10))
    return table(spark, d, "raw_tickets").select("raw_id", F.coalesce(*map(stamp, _STAMPS)).alias("doc_date"))


_STEM = "regexp_replace(filename, '\\.[^.]*$', '')"


@query("q_doc_metadata", f"""SELECT doc_id, {_EXT} AS extension, CASE WHEN doc_type IN ('transcript', 'account_notes') THEN {_MEETING} END AS meeting_type,
  CASE WHEN doc_type IN ('transcript', 'account_notes') AND len(string_split({_STEM}, '_')) >= 3 THEN string_split({_STEM}, '_')[-1] END AS author,
  CASE WHEN doc_type = 'account_notes' THEN 'true' END AS is_internal, CASE WHEN doc_type = 'commitment_tracker' THEN 'true' END AS is_structured FROM documents""")
def doc_metadata(spark: SparkSession, d: str) -> DataFrame:
    spoken = F.col("doc_type").isin("transcript", "account_notes")
    parts = F.split(F.regexp_replace("filename", r"\.[^.]*$", ""), "_")
    return _docs(spark, d).select(
        "doc_id", X.extension(F.col("filename")).alias("extension"), F.when(spoken, X.meeting_type(F.col("filename"))).alias("meeting_type"),
        F.when(spoken & (F.size(parts) >= 3), F.element_at(parts, -1)).alias("author"), F.when(F.col("doc_type") == "account_notes", "true").alias("is_internal"), F.when(F.col("doc_type") == "commitment_tracker", "true").alias("is_structured"),
    )


@query("q_ticket_metadata", f"SELECT raw_id, nullif(json_extract_string(j, '$.reporter'), '') AS reporter, nullif(json_extract_string(j, '$.assignee'), '') AS assignee, nullif(json_extract_string(j, '$.updated_at'), '') AS updated_at FROM (SELECT raw_id, {_JSON} AS j FROM raw_tickets)")
def ticket_metadata(spark: SparkSession, d: str) -> DataFrame:
    j = _readable()
    return table(spark, d, "raw_tickets").select("raw_id", *[F.nullif(F.get_json_object(j, f"$.{c}"), F.lit("")).alias(c) for c in ("reporter", "assignee", "updated_at")])


# --- what a content shows ---------------------------------------------------------------------------------------------

# Keys that show commitments or tickets in a file, and words of notes.
COMMIT_KEYS, TICKET_KEYS = ("commitment_id", "promised_date", "current_target_date", "target_date", "is_slipped", "is_open"), ("ticket_id", "subject", "priority", "assignee", "reporter", "resolution")
ONE_TICKET, ONE_COMMIT, NOTE_WORDS = ("ticket_id", "subject", "description", "status", "priority"), ("commitment_id", "promised_date", "current_target_date"), ("account notes", "relationship", "account summary")
SPEAKER_LINE = r"(?m)^[A-Za-z][A-Za-z0-9 _\-]{1,40}:\s+\S"


def sniffed_json(c: Column) -> Column:
    """(kind, confidence) of a JSON text by its keys, read whole; (null, low) for what can't be read or shows nothing."""
    ok = F.try_parse_json(c).isNotNull()
    j = F.when(ok, c)
    is_list = F.ltrim(j).startswith("[")
    listed = F.coalesce(F.when(is_list, j), F.get_json_object(j, "$.commitments"))
    keys = lambda x: F.coalesce(F.transform(F.json_object_keys(x), lambda k: F.lower(k)), F.array().cast("array<string>"))
    first, root = keys(F.get_json_object(listed, "$[0]")), F.when(is_list, F.array().cast("array<string>")).otherwise(keys(j))
    any_of = lambda a, names: F.arrays_overlap(a, F.array(*map(F.lit, names)))
    count = lambda a, names: F.size(F.array_intersect(a, F.array(*map(F.lit, names))))
    kind = F.when(any_of(first, COMMIT_KEYS), "commitment_tracker").when(any_of(first, TICKET_KEYS), "ticket").when(F.array_contains(root, "fields"), "ticket").when(count(root, ONE_TICKET) >= 3, "ticket").when(any_of(root, ONE_COMMIT), "commitment_tracker")
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), "high").otherwise("low").alias("confidence"))


def sniffed_text(c: Column) -> Column:
    """(kind, confidence) of a plain text, read whole: speaker labels, an export's marks, words of notes, else a transcript with little confidence."""
    t = F.coalesce(c, F.lit(""))
    labels, low = F.regexp_count(t, F.lit(SPEAKER_LINE)), F.lower(t)
    export = F.contains(t, F.lit('"speaker"')) & F.contains(t, F.lit('"words"'))
    notes = F.exists(F.array(*map(F.lit, NOTE_WORDS)), lambda w: F.contains(low, w))
    as_ = lambda k, v: F.struct(F.lit(k).alias("kind"), F.lit(v).alias("confidence"))
    return F.when(labels >= 2, as_("transcript", "high")).when(export, as_("transcript", "medium")).when(notes, as_("account_notes", "medium")).otherwise(as_("transcript", "low"))


def sniffed_columns(headers: list[str]) -> tuple[str | None, str]:
    """(kind, confidence) of a sheet by its headings."""
    h = {x.strip().lower() for x in headers}
    if h & {"commitment_id", "promised_date", "current_target_date", "target_date"}:
        return "commitment_tracker", "high"
    if h & {"ticket_id", "issue_key", "summary"}:
        return "ticket", "high"
    return ("ticket", "medium") if {"status", "priority"} <= h else (None, "low")


def sniffed(filename: Column, content: Column) -> Column:
    """(kind, confidence) of a file by its ending and content."""
    ext = X.extension(filename)
    as_ = lambda k, v: F.struct(F.lit(k).cast("string").alias("kind"), F.lit(v).alias("confidence"))
    return F.when(ext == ".json", sniffed_json(content)).when(ext.isin(".vtt", ".srt"), as_("transcript", "high")).when(ext == ".txt", sniffed_text(content)).when(ext.isin(".pdf", ".docx"), as_("account_notes", "low")).when(ext == ".html", as_("solution_architecture", "low")).otherwise(as_(None, "low"))


def _overlap(a: str, names: tuple[str, ...]) -> str:
    return f"len(list_intersect({a}, [{quoted(names)}]))"


_SNIFF_JSON = f"""CASE WHEN {_overlap('fk', COMMIT_KEYS)} > 0 THEN 'commitment_tracker' WHEN {_overlap('fk', TICKET_KEYS)} > 0 THEN 'ticket' WHEN list_contains(rk, 'fields') OR {_overlap('rk', ONE_TICKET)} >= 3 THEN 'ticket' WHEN {_overlap('rk', ONE_COMMIT)} > 0 THEN 'commitment_tracker' END"""
_SNIFF_TEXT = f"""CASE WHEN len(regexp_extract_all(coalesce(content, ''), '{SPEAKER_LINE}')) >= 2 THEN 'transcript high' WHEN contains(content, '"speaker"') AND contains(content, '"words"') THEN 'transcript medium' WHEN {' OR '.join(f"contains(lower(content), '{w}')" for w in NOTE_WORDS)} THEN 'account_notes medium' ELSE 'transcript low' END"""


@query("q_sniff", f"""WITH f AS (SELECT 'document' AS src, doc_id AS id, {_EXT} AS ext, text AS content FROM documents),
  t AS (SELECT src, id, CASE ext WHEN '.txt' THEN {_SNIFF_TEXT} WHEN '.pdf' THEN 'account_notes low' WHEN '.html' THEN 'solution_architecture low' ELSE ' low' END AS k FROM f),
  j AS (SELECT raw_id AS id, CASE WHEN json_valid(coalesce(payload, '')) THEN payload END AS p FROM raw_tickets),
  l AS (SELECT id, p, CASE WHEN ltrim(p, ' ' || chr(10)) LIKE '[%' THEN true ELSE false END AS listed FROM j),
  k AS (SELECT id, CASE WHEN listed THEN json_extract(p, '$[0]') ELSE json_extract(p, '$.commitments[0]') END AS f, CASE WHEN NOT listed THEN CAST(p AS JSON) END AS r FROM l),
  m AS (SELECT id, CASE WHEN json_type(f) = 'OBJECT' THEN list_transform(json_keys(f), lambda x: lower(x)) ELSE [] END AS fk, CASE WHEN json_type(r) = 'OBJECT' THEN list_transform(json_keys(r), lambda x: lower(x)) ELSE [] END AS rk FROM k)
  SELECT src, id, nullif(split_part(k, ' ', 1), '') AS kind, split_part(k, ' ', 2) AS confidence FROM t UNION ALL SELECT 'raw', id, {_SNIFF_JSON}, CASE WHEN {_SNIFF_JSON} IS NULL THEN 'low' ELSE 'high' END FROM m""")
def sniff(spark: SparkSession, d: str) -> DataFrame:
    """The type that a file's content shows: documents as they are named, raw tickets as JSON files."""
    files = _docs(spark, d).select(F.lit("document").alias("src"), F.col("doc_id").alias("id"), "filename", F.col("text").alias("content"))
    raw = table(spark, d, "raw_tickets").select(F.lit("raw").alias("src"), F.col("raw_id").alias("id"), F.lit("t.json").alias("filename"), F.col("payload").alias("content"))
    return files.unionByName(raw).select("src", "id", sniffed(F.col("filename"), F.col("content")).alias("s")).select("src", "id", "s.kind", "s.confidence")


# Groups of words, of which a tracker or a ticket shows at least two groups, and those of a transcript.
TRACKER_SIGNALS = (("commitment", "promised", "due_date", "target_date"), ("status",), ("owner", "assignee", "responsible"), ("delivered", "slipped", "deferred", "active"))
TICKET_SIGNALS = (("ticket", "issue", "bug", "case", "incident", "id"), ("status", "priority", "severity"), ("assignee", "reporter", "created_at", "description"))
SPEECH_WORDS = ("speaker", "interviewer", "moderator", "host")
LABEL_LINE = r"(?m)^[A-Za-z][A-Za-z0-9 _-]{1,40}:\s+\S"


def inconsistency(kind: Column, content: Column) -> Column:
    """Why a content doesn't look like its type; null if it does or the type has no signs."""
    t = F.coalesce(content, F.lit(""))
    low = F.lower(t)
    says = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    signals = lambda groups: sum((says(g).cast("int") for g in groups), F.lit(0))
    return F.when((kind == "transcript") & ~t.rlike(LABEL_LINE) & ~says(SPEECH_WORDS), "no speaker labels").when((kind == "commitment_tracker") & (signals(TRACKER_SIGNALS) < 2), "no commitment records").when((kind == "ticket") & (signals(TICKET_SIGNALS) < 2), "no ticket fields")


def _says(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in words) + ")"


@query("q_consistency", f"""SELECT doc_id, CASE WHEN doc_type = 'transcript' AND NOT regexp_matches(coalesce(text, ''), '{LABEL_LINE}') AND NOT {_says(SPEECH_WORDS)} THEN 'no speaker labels' WHEN doc_type = 'commitment_tracker' AND {' + '.join(f'CAST({_says(g)} AS INTEGER)' for g in TRACKER_SIGNALS)} < 2 THEN 'no commitment records'
  WHEN doc_type = 'ticket' AND {' + '.join(f'CAST({_says(g)} AS INTEGER)' for g in TICKET_SIGNALS)} < 2 THEN 'no ticket fields' END AS warning FROM documents""")
def consistency(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", inconsistency(F.col("doc_type"), F.col("text")).alias("warning"))


# --- transcripts ------------------------------------------------------------------------------------------------------

_FILE_LINES = "list_transform(regexp_split_to_array(coalesce(text, ''), '\\r?\\n'), lambda x: trim(x))"


@query("q_detect_format", f"""SELECT doc_id, CASE WHEN regexp_matches(l[1], '(?i)^WEBVTT') THEN 'vtt' WHEN len(list_filter(range(1, 41), lambda i: coalesce(regexp_matches(l[i], '{X.SRT_COUNT}') AND regexp_matches(l[i + 1], '{X.SRT_TIME}'), false))) > 0 THEN 'srt'
  WHEN len(list_filter(l[1:20], lambda x: regexp_matches(x, '{X.ZOOM_TIME}'))) >= 2 THEN 'zoom' WHEN len(list_filter(l[1:20], lambda x: regexp_matches(x, '{X.TEAMS_TIME}'))) >= 2 THEN 'teams' ELSE 'plain' END AS format FROM (SELECT doc_id, {_FILE_LINES} AS l FROM documents)""")
def detect_format(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.transcript_format(F.col("text")).alias("format"))


_OF_CALLS = "turns t JOIN calls c ON c.call_id = t.call_id WHERE c.export_kind = '{0}'"


def _lines_of(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "turns").join(table(spark, d, "calls").filter(F.col("export_kind") == kind).select("call_id"), "call_id", "left_semi")


@query("q_norm_vtt", f"SELECT turn_row_id, array_to_string(list_filter({_FILE_LINES}, lambda x: x <> '' AND NOT regexp_matches(x, '(?i)^WEBVTT') AND NOT regexp_matches(x, '{X.VTT_TIME}') AND len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: NOT contains(w, ':'))) > 0), chr(10)) AS text FROM {_OF_CALLS.format('vtt')}")
def norm_vtt(spark: SparkSession, d: str) -> DataFrame:
    return _lines_of(spark, d, "vtt").select("turn_row_id", X.vtt_text(F.col("text")).alias("text"))


@query("q_norm_srt", f"SELECT turn_row_id, array_to_string(list_filter(list_transform(list_filter({_FILE_LINES}, lambda x: x <> '' AND NOT regexp_matches(x, '{X.SRT_COUNT}') AND NOT regexp_matches(x, '{X.SRT_TIME}')), lambda x: trim(regexp_replace(x, '<[^>]+>', '', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM {_OF_CALLS.format('srt')}")
def norm_srt(spark: SparkSession, d: str) -> DataFrame:
    return _lines_of(spark, d, "srt").select("turn_row_id", X.srt_text(F.col("text")).alias("text"))


def _block_lines(kind: str):  # noqa: ANN202
    reader, time_first = (X.zoom_lines, True) if kind == "zoom" else (X.teams_lines, False)

    @F.pandas_udf("string")
    def run(speaker: pd.Series, text: pd.Series, at: pd.Series) -> pd.Series:
        out = []
        for s, t, a in zip(speaker, text, at, strict=True):
            head = [a, s] if time_first else [s, a]
            out.append("\n".join(reader([*head, *(t or "").splitlines()])))
        return pd.Series(out, dtype="object")

    return run


def _norm_blocks(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Each line as its export's block (time, speaker, words), made into a labelled line."""
    lines = _lines_of(spark, d, kind)
    speaker = F.coalesce(F.nullif(F.trim("speaker"), F.lit("")), F.lit("Speaker"))
    return lines.select("turn_row_id", _block_lines(kind)(speaker, F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s*\n\s*", "\n")), F.lit("00:01:23" if kind == "zoom" else "10:05 AM")).alias("line"))


_BLOCK = "SELECT turn_row_id, CASE WHEN trim(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', chr(10), 'g')) = '' THEN '' ELSE coalesce(nullif(trim(speaker), ''), 'Speaker') || ': ' || array_to_string(list_transform(string_split(trim(regexp_replace(coalesce(text, ''), '\\s*\\n\\s*', chr(10), 'g')), chr(10)), lambda x: trim(x)), ' ') END AS line FROM "


@query("q_norm_zoom", _BLOCK + _OF_CALLS.format("zoom"))
def norm_zoom(spark: SparkSession, d: str) -> DataFrame:
    return _norm_blocks(spark, d, "zoom")


@query("q_norm_teams", _BLOCK + _OF_CALLS.format("teams"))
def norm_teams(spark: SparkSession, d: str) -> DataFrame:
    return _norm_blocks(spark, d, "teams")


_SPK = r"^(?:spk|speaker)[ _]?(\w+)$"


@query("q_otter", f"""WITH s AS (SELECT call_id, u.s.spk_id AS spk_id, nullif(trim(u.s.spk_name), '') AS spk_name FROM calls, unnest(speakers) AS u(s) WHERE export_kind = 'otter'),
  l AS (SELECT t.turn_row_id, t.call_id, nullif(regexp_extract(lower(trim(coalesce(t.speaker, ''))), '{_SPK}', 1), '') AS spk, t.text, t.start_ms FROM {_OF_CALLS.format('otter')})
  SELECT l.turn_row_id, coalesce(s.spk_name, 'Speaker ' || l.spk) AS speaker, trim(l.text) AS text, coalesce(l.start_ms, 0) AS start_ms FROM l LEFT JOIN s ON s.call_id = l.call_id AND s.spk_id = l.spk WHERE l.spk IS NOT NULL AND trim(coalesce(l.text, '')) <> ''""")
def otter(spark: SparkSession, d: str) -> DataFrame:
    """The segments of JSON exports that name a speaker's number: the name in the export's speaker map, or ``Speaker {id}``; empty ones go and a missing offset is 0."""
    names = F.map_from_entries(F.transform(F.array_distinct(F.transform("speakers", lambda s: s["spk_id"])), lambda i: F.struct(i, F.get(F.filter("speakers", lambda s: s["spk_id"] == i), F.lit(0))["spk_name"])))
    calls = table(spark, d, "calls").filter("export_kind = 'otter'").select("call_id", names.alias("names"))
    spk = F.nullif(F.regexp_extract(F.lower(F.trim(F.coalesce("speaker", F.lit("")))), _SPK, 1), F.lit(""))
    lines = table(spark, d, "turns").join(calls, "call_id").withColumn("spk", spk).filter("spk IS NOT NULL AND trim(coalesce(text, '')) <> ''")
    return lines.select("turn_row_id", F.coalesce(F.nullif(F.trim(F.try_element_at("names", F.col("spk"))), F.lit("")), F.concat(F.lit("Speaker "), "spk")).alias("speaker"), F.trim("text").alias("text"), F.coalesce("start_ms", F.lit(0)).alias("start_ms"))


_PRIOR = "'[Prior: ' || p || ': ' || left(x, 100) || CASE WHEN length(x) > 100 THEN '...' ELSE '' END || ']'"


@query("q_prior_turn", f"SELECT turn_row_id, {_PRIOR} AS prior FROM (SELECT turn_row_id, lag(coalesce(speaker, 'Speaker')) OVER w AS p, lag(coalesce(text, '')) OVER w AS x FROM turns WINDOW w AS (PARTITION BY call_id ORDER BY coalesce(line_no, 0), turn_row_id))")
def prior_turn(spark: SparkSession, d: str) -> DataFrame:
    """What was said before each line, whatever numbers are missing between them; null for the first line of a call. A call of any length is worked on in blocks."""
    t = table(spark, d, "turns").select("turn_row_id", "call_id", F.coalesce("line_no", F.lit(0)).alias("line_no"), F.struct(F.coalesce("speaker", F.lit("Speaker")).alias("p"), F.coalesce("text", F.lit("")).alias("x")).alias("said"))
    b = previous_in_blocks(t, "call_id", F.floor(F.col("line_no") / 500), ["line_no", "turn_row_id"], "said", "before")
    long = F.when(F.length("before.x") > 100, "...").otherwise("")
    return b.select("turn_row_id", F.concat(F.lit("[Prior: "), "before.p", F.lit(": "), F.substring("before.x", 1, 100), long, F.lit("]")).alias("prior"))


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).filter("doc_type = 'transcript'").select("doc_id", "text")


@query("q_turns_plain")
def turns_plain(spark: SparkSession, d: str) -> DataFrame:
    """The turns of every transcript, of whatever format, behind its head."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = [(i, n, s, t) for i, text in zip(b.doc_id, b.text, strict=True) for n, (s, t, _) in enumerate(X.transcript_turns(text))]
            yield pd.DataFrame(rows, columns=["doc_id", "turn_ix", "speaker", "text"])

    return _transcripts(spark, d).mapInPandas(run, "doc_id long, turn_ix int, speaker string, text string")


@query("q_merge_turns")
def merge_turns(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive turns of one speaker merged up to 120 words."""
    return transcript_chunks(spark, d).select("doc_id", "chunk_index", "speaker", F.col("n_words"), F.md5("said").alias("said"))


@query("q_transcript_chunks")
def transcript_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The merged turns as chunks, each headed by the one before; with all speakers of the file. A file with at most one turn is read as plain text instead (``q_plain_text_chunks``)."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            rows = []
            for i, text in zip(b.doc_id, b.text, strict=True):
                turns = X.merged_turns([(s, t) for s, t, _ in X.transcript_turns(text)])
                everyone = ", ".join(sorted({s for s, _ in turns}))
                for n, (s, t) in enumerate(turns if len(turns) > 1 else []):
                    before = turns[n - 1][1] if n else ""
                    prior = f"[Prior: {turns[n - 1][0]}: {before[:100]}{'...' if len(before) > 100 else ''}]\n\n" if n else ""
                    rows.append((i, n, s, everyone, f"{prior}{s}: {t}", t, len(t.split())))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "speaker", "all_speakers", "content", "said", "n_words"])

    return _transcripts(spark, d).mapInPandas(run, "doc_id long, chunk_index int, speaker string, all_speakers string, content string, said string, n_words int")


@query("q_plain_text_chunks")
def plain_text_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Texts without speakers: noise lines out, then chunks of whole sentences."""
    docs = _docs(spark, d).filter("doc_type <> 'transcript'").select("doc_id", X.noise_filtered(F.col("text")).alias("text"))
    return X.exploded_chunks(docs, "doc_id", "text", X.sentence_chunks)


@query("q_html_sections", "SELECT ticket_row_id, CAST(0 AS INTEGER) AS section, regexp_replace(trim(coalesce(subject, '')), '\\s+', ' ', 'g') AS h1, '' AS h2, '' AS h3, regexp_replace(trim(description), '\\s+', ' ', 'g') AS text FROM tickets WHERE trim(regexp_replace(coalesce(description, ''), '\\s+', ' ', 'g')) <> ''")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Pages made of tickets (heading, script, body), cut into sections by their headings."""
    esc = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = table(spark, d, "tickets").select("ticket_row_id", F.concat(F.lit("<html><script>var x = 1;</script><h1>"), esc("subject"), F.lit("</h1><p>"), esc("description"), F.lit("</p></html>")).alias("html"))
    return html_parts(pages, "ticket_row_id", "html")


@query("q_contextual_prefix", "SELECT doc_id, md5(CASE WHEN coalesce(doc_type, '') = '' THEN text ELSE '[Context: ' || doc_type || ' of ' || customer_slug || ']' || chr(10) || chr(10) || text END) AS content, coalesce(doc_type, '') <> '' AS has_context_prefix FROM documents")
def q_contextual_prefix(spark: SparkSession, d: str) -> DataFrame:
    with_context = contextual_prefix(_docs(spark, d), F.concat(F.nullif("doc_type", F.lit("")), F.lit(" of "), F.col("customer_slug")), "text")
    return with_context.select("doc_id", F.md5("text").alias("content"), "has_context_prefix")


def contextual_prefix(chunks: DataFrame, context: Column, text: str) -> DataFrame:
    """``chunks`` with each ``text`` headed by its context, and ``has_context_prefix``. ``context`` is a column, so that any function or joined answers of a model can give it; where it is null or empty the chunk stays as it is."""
    c = F.nullif(F.trim(context), F.lit(""))
    return chunks.withColumn("has_context_prefix", c.isNotNull()).withColumn(text, F.when(c.isNotNull(), F.concat(F.lit("[Context: "), c, F.lit("]\n\n"), F.col(text))).otherwise(F.col(text)))


@query("q_adf_text")
def q_adf_text(spark: SparkSession, d: str) -> DataFrame:
    """The plain text of every rich-text tree that stands as a description."""

    @F.pandas_udf("string")
    def read(payloads: pd.Series) -> pd.Series:
        return pd.Series([_description(p) for p in payloads], dtype="object")

    return table(spark, d, "raw_tickets").select("raw_id", read("payload").alias("text")).filter("text IS NOT NULL")


def _description(payload: str | None) -> str | None:
    root = decoded(payload)
    fields = root.get("fields") if isinstance(root, dict) else None
    tree = fields.get("description") if isinstance(fields, dict) else None
    return adf_text(tree).strip() if isinstance(tree, dict) else None


# --- typed fields -----------------------------------------------------------------------------------------------------

_STATUS_BOTH = f"SELECT 'ticket' AS src, ticket_row_id AS id, {case_sql('lower(trim(status))', STATUS)} AS status FROM tickets UNION ALL SELECT 'commitment', commit_row_id, {case_sql('lower(trim(status))', COMMITMENT_STATUS)} FROM commitments"


@query("q_status_norm", _STATUS_BOTH)
def status_norm(spark: SparkSession, d: str) -> DataFrame:
    s = F.lower(F.trim("status"))
    t = table(spark, d, "tickets").select(F.lit("ticket").alias("src"), F.col("ticket_row_id").alias("id"), mapped(s, STATUS).alias("status"))
    return t.unionByName(table(spark, d, "commitments").select(F.lit("commitment").alias("src"), F.col("commit_row_id").alias("id"), mapped(s, COMMITMENT_STATUS).alias("status")))


def _date_sql(c: str, formats: tuple) -> str:
    tries = ", ".join(f"CASE WHEN regexp_matches({c}, '{p}') THEN strftime(try_strptime({c}, '{duck}'), '%Y-%m-%d') END" for p, _, duck in formats)
    return f"coalesce({tries}, CASE WHEN regexp_matches(left({c}, 10), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') THEN strftime(try_strptime(left({c}, 10), '%Y-%m-%d'), '%Y-%m-%d') END)"


@query("q_date_norm", f"SELECT 'ticket' AS src, ticket_row_id AS id, {_date_sql('trim(created_at)', TICKET_DATES)} AS day FROM tickets UNION ALL SELECT 'commitment', commit_row_id, {_date_sql('trim(current_target_date)', COMMITMENT_DATES)} FROM commitments")
def date_norm(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tickets").select(F.lit("ticket").alias("src"), F.col("ticket_row_id").alias("id"), normal_date(F.col("created_at"), TICKET_DATES).alias("day"))
    return t.unionByName(table(spark, d, "commitments").select(F.lit("commitment").alias("src"), F.col("commit_row_id").alias("id"), normal_date(F.col("current_target_date"), COMMITMENT_DATES).alias("day")))


_TARGET = _date_sql("trim(current_target_date)", COMMITMENT_DATES)


@query("q_slipped", f"SELECT commit_row_id, coalesce(is_slipped, coalesce(current_target_date, '') <> '' AND coalesce(promised_date, '') <> '' AND current_target_date > promised_date) AS slipped, coalesce(coalesce({_TARGET}, promised_date) > promised_date, false) AS slipped_in_sheet FROM commitments")
def slipped(spark: SparkSession, d: str) -> DataFrame:
    """Whether a commitment slipped: as stated, else by comparing its dates as text; and as a sheet has it, by parsed dates."""
    given = lambda c: F.coalesce(F.col(c), F.lit(""))
    stated = F.coalesce("is_slipped", (given("current_target_date") != "") & (given("promised_date") != "") & (given("current_target_date") > given("promised_date")))
    target = F.coalesce(normal_date(F.col("current_target_date"), COMMITMENT_DATES), "promised_date")
    return table(spark, d, "commitments").select("commit_row_id", stated.alias("slipped"), F.coalesce(target > F.col("promised_date"), F.lit(False)).alias("slipped_in_sheet"))


_TRUE = "lower(trim({0})) IN ('true', 'yes', '1', '{1}')"


@query("q_bool_parse", f"SELECT 'aware' AS src, commit_row_id AS id, coalesce({_TRUE.format('CAST(customer_aware AS VARCHAR)', 'y')}, false) AS parsed, coalesce({_TRUE.format('CAST(customer_aware AS VARCHAR)', 'x')}, false) AS parsed_in_sheet FROM commitments UNION ALL SELECT 'number', comment_row_id, coalesce({_TRUE.format('CAST(comment_no AS VARCHAR)', 'y')}, false), coalesce({_TRUE.format('CAST(comment_no AS VARCHAR)', 'x')}, false) FROM ticket_comments")
def bool_parse(spark: SparkSession, d: str) -> DataFrame:
    both = lambda df, src, i, c: df.select(F.lit(src).alias("src"), F.col(i).alias("id"), parsed_bool(F.col(c)).alias("parsed"), parsed_bool(F.col(c), sheet=True).alias("parsed_in_sheet"))
    return both(table(spark, d, "commitments"), "aware", "commit_row_id", "customer_aware").unionByName(both(table(spark, d, "ticket_comments"), "number", "comment_row_id", "comment_no"))


_ALIASES = {"ticket_id": ("ticket_id", "key", "id"), "subject": ("subject", "fields.summary", "summary"), "created": ("created_at", "fields.created", "timestamp"), "status": ("status.name", "fields.status.name", "status")}


@query("q_alias_cols", "SELECT raw_id, " + ", ".join("coalesce(" + ", ".join(f"nullif(json_extract_string(j, '$.{p}'), '')" for p in paths) + f") AS {c}" for c, paths in _ALIASES.items()) + f" FROM (SELECT raw_id, {_JSON} AS j FROM raw_tickets)")
def alias_cols(spark: SparkSession, d: str) -> DataFrame:
    """A ticket's fields under one name each: the canonical key first, then its other names."""
    j = _readable()
    return table(spark, d, "raw_tickets").select("raw_id", *[F.coalesce(*[F.nullif(F.get_json_object(j, f"$.{p}"), F.lit("")) for p in paths]).alias(c) for c, paths in _ALIASES.items()])


_REQUIRED = ("ticket_id", "subject", "status")


@query("q_required_cols", f"WITH k AS (SELECT raw_id, CASE WHEN json_valid(coalesce(payload, '')) AND json_type(payload) = 'OBJECT' THEN json_keys(payload) ELSE [] END AS k FROM raw_tickets) SELECT raw_id, array_to_string(list_filter([{quoted(_REQUIRED)}], lambda x: NOT list_contains(k, x)), ';') AS missing FROM k")
def required_cols(spark: SparkSession, d: str) -> DataFrame:
    """The required fields that a payload's root doesn't have."""
    keys = F.coalesce(F.json_object_keys(_readable()), F.array().cast("array<string>"))
    return table(spark, d, "raw_tickets").select("raw_id", F.array_join(F.array_except(F.array(*map(F.lit, _REQUIRED)), keys), ";").alias("missing"))


_SIGNALS = ("ticket_id", "subject", "priority", "assignee", "reporter", "resolution", "key", "fields")


@query("q_key_signals", f"WITH k AS (SELECT raw_id, CASE WHEN json_valid(coalesce(payload, '')) AND json_type(payload) = 'OBJECT' THEN json_keys(payload) ELSE [] END AS k FROM raw_tickets) SELECT raw_id, array_to_string(list_filter([{quoted(_SIGNALS)}], lambda x: list_contains(k, x)), ';') AS signals FROM k")
def key_signals(spark: SparkSession, d: str) -> DataFrame:
    keys = F.coalesce(F.json_object_keys(_readable()), F.array().cast("array<string>"))
    return table(spark, d, "raw_tickets").select("raw_id", F.array_join(F.array_intersect(F.array(*map(F.lit, _SIGNALS)), keys), ";").alias("signals"))


@query("q_strip_json", r"SELECT raw_id, md5(CASE WHEN p IS NULL THEN NULL ELSE trim(p, ' ' || chr(10)) END) AS body FROM (SELECT raw_id, payload AS p FROM raw_tickets)")
def strip_json_fences(spark: SparkSession, d: str) -> DataFrame:
    """Payloads put between the fences of a model's answer, and taken out again."""
    fenced = F.concat(F.lit("Here it is:\n```json\n"), "payload", F.lit("\n```\nDone."))
    return table(spark, d, "raw_tickets").select("raw_id", F.md5(strip_json(fenced)).alias("body"))


def strip_json(c: Column) -> Column:
    """What stands between the first pair of code fences, without outer blanks; the text itself where there is none."""
    fence = r"(?s)```(?:json)?\s*(.*?)```"
    bare = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(c.rlike(fence), bare(F.regexp_extract(c, fence, 1))).otherwise(bare(c))


@query("q_workspace_id", "SELECT account_id, left(sha256(lower(trim(customer_slug)) || ':' || trim(fde_user_id)), 32) AS workspace_id FROM accounts")
def workspace_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "accounts").select("account_id", F.substring(F.sha2(F.concat(F.lower(F.trim("customer_slug")), F.lit(":"), F.trim("fde_user_id")), 256), 1, 32).alias("workspace_id"))


# --- sheets and trackers as files -------------------------------------------------------------------------------------

_SHEET_T = f"""ts AS (SELECT ticket_id, coalesce(trim(subject), '') AS summary, coalesce(nullif(lower(trim(status)), ''), 'open') AS status, coalesce(nullif(trim(priority), ''), 'normal') AS priority, {_date_sql('trim(created_at)', TICKET_DATES)} AS created_date, coalesce(trim(description), '') AS description, nullif(trim(resolution), '') AS resolution FROM tickets WHERE trim(coalesce(ticket_id, '')) <> '')"""


def _ticket_csv(spark: SparkSession, d: str) -> DataFrame:
    """The tickets written as a sheet with other headings, and read back from the shared folder."""
    sheet = table(spark, d, "tickets").select(F.col("ticket_id").alias("Issue Key"), F.col("subject").alias("Title"), F.col("status").alias("State"), "priority", F.col("created_at").alias("Created"), "assignee", "reporter", F.col("description").alias("Desc"), "resolution")
    return ticket_sheet(spark, shared_csv(sheet))


@query("q_ticket_sheet", f"WITH {_SHEET_T} SELECT ticket_id, summary, status, priority, created_date, md5(description) AS description FROM ts")
def q_ticket_sheet(spark: SparkSession, d: str) -> DataFrame:
    return _ticket_csv(spark, d).select("ticket_id", F.coalesce("summary", F.lit("")).alias("summary"), "status", "priority", "created_date", F.md5(F.coalesce("description", F.lit(""))).alias("description"))


def csv_ticket_chunks(sheet: DataFrame) -> DataFrame:
    """ticket_id, section, part, content, is_open, doc_date of a ticket sheet: a description in parts of at most 350 words, and the resolution if there is one."""
    head = F.concat(F.lit("Ticket: "), "ticket_id", F.lit("\nTitle: "), F.coalesce("summary", F.lit("")), F.lit("\nStatus: "), "status", F.lit("\nPriority: "), "priority")
    is_open = ~F.lower("status").isin(*TERMINAL_TICKETS)
    parts = X.split_column(X.long_text_chunks)
    described = sheet.select("ticket_id", F.lit("description").alias("section"), F.posexplode_outer(parts(F.col("description"))).alias("part", "text"), head.alias("head"), is_open.alias("is_open"), F.col("created_date").alias("doc_date"))
    described = described.withColumn("content", F.when(F.col("text").isNull(), F.col("head")).otherwise(F.concat("head", F.lit("\nDescription: "), "text")))
    short = F.concat(F.lit("Ticket: "), "ticket_id", F.lit(" Title: "), F.coalesce("summary", F.lit("")), F.lit("\nResolution: "))
    resolved = sheet.filter("resolution IS NOT NULL").select("ticket_id", F.lit("resolution").alias("section"), F.posexplode(parts(F.col("resolution"))).alias("part", "text"), short.alias("head"), is_open.alias("is_open"), F.col("created_date").alias("doc_date")).withColumn("content", F.concat("head", "text"))
    columns = ["ticket_id", "section", F.coalesce("part", F.lit(0)).alias("part"), "content", "is_open", "doc_date"]
    return described.select(*columns).unionByName(resolved.select(*columns))


@query("q_csv_ticket_chunks", f"""WITH {_SHEET_T} SELECT ticket_id, 'description' AS section, CAST(0 AS INTEGER) AS part, md5('Ticket: ' || ticket_id || chr(10) || 'Title: ' || summary || chr(10) || 'Status: ' || status || chr(10) || 'Priority: ' || priority || CASE WHEN description = '' THEN '' ELSE chr(10) || 'Description: ' || description END) AS content, status NOT IN ({quoted(TERMINAL_TICKETS)}) AS is_open, created_date AS doc_date FROM ts
  UNION ALL SELECT ticket_id, 'resolution', 0, md5('Ticket: ' || ticket_id || ' Title: ' || summary || chr(10) || 'Resolution: ' || resolution), status NOT IN ({quoted(TERMINAL_TICKETS)}), created_date FROM ts WHERE resolution IS NOT NULL""")
def q_csv_ticket_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The SQL knows no texts of more than 350 words, which the tables of the comparison don't hold; tests cover them."""
    return csv_ticket_chunks(_ticket_csv(spark, d)).withColumn("content", F.md5("content"))


_SHEET_C = f"""cs AS (SELECT commit_row_id, commitment_id, trim(description) AS description, {case_sql("coalesce(nullif(lower(trim(status)), ''), 'open')", COMMITMENT_STATUS)} AS status, {_date_sql('trim(promised_date)', COMMITMENT_DATES)} AS promised, {_date_sql('trim(current_target_date)', COMMITMENT_DATES)} AS stated, nullif(trim(owner), '') AS owner, coalesce(customer_aware, false) AS aware FROM commitments WHERE trim(coalesce(description, '')) <> '')"""


def _commitment_csv(spark: SparkSession, d: str) -> DataFrame:
    sheet = table(spark, d, "commitments").select(F.col("commitment_id").alias("ID"), F.col("description").alias("Promise"), F.col("promised_date").alias("Due Date"), F.col("current_target_date").alias("Revised Date"), "status", F.col("owner").alias("Responsible"), F.col("customer_aware").alias("Customer Visible"))
    return commitment_sheet(spark, shared_csv(sheet))


@query("q_commitment_sheet", f"WITH {_SHEET_C} SELECT commitment_id, description AS commitment, status, promised AS promised_date, coalesce(stated, promised) AS current_target_date, owner, aware AS customer_aware, coalesce(coalesce(stated, promised) > promised, false) AS is_slipped, status NOT IN ({quoted(TERMINAL_COMMITMENTS)}) AS is_open FROM cs")
def q_commitment_sheet(spark: SparkSession, d: str) -> DataFrame:
    return _commitment_csv(spark, d).select("commitment_id", "commitment", "status", "promised_date", "current_target_date", "owner", "customer_aware", "is_slipped", "is_open")


def csv_commitment_chunks(sheet: DataFrame, as_of: str) -> DataFrame:
    """commitment_id, content, is_overdue, days_overdue, doc_date of a commitment sheet."""
    overdue = F.coalesce(F.col("is_open") & (F.col("current_target_date") < as_of), F.lit(False))
    days = F.when(overdue, F.datediff(F.lit(as_of).cast("date"), F.to_date("current_target_date"))).otherwise(0)
    late = F.when(overdue, F.concat(F.lit("\nOVERDUE by "), days.cast("string"), F.lit(" days (target was "), F.col("current_target_date"), F.lit(")"))).otherwise("")
    line = lambda label, c: F.concat(F.lit(f"{label}: "), F.col(c))
    content = F.concat_ws("\n", F.concat(F.lit("Commitment: "), "commitment", late), line("Status", "status"), line("Promised", "promised_date"), line("Target", "current_target_date"), line("Owner", "owner"))
    return sheet.select("commitment_id", content.alias("content"), overdue.alias("is_overdue"), days.alias("days_overdue"), F.coalesce("current_target_date", "promised_date", F.lit("")).alias("doc_date"))


@query("q_csv_commit_chunks", f"""WITH {_SHEET_C}, o AS (SELECT *, coalesce(stated, promised) AS target, coalesce(status NOT IN ({quoted(TERMINAL_COMMITMENTS)}) AND coalesce(stated, promised) < '{AS_OF}', false) AS late FROM cs), n AS (SELECT *, CASE WHEN late THEN datediff('day', CAST(target AS DATE), DATE '{AS_OF}') ELSE 0 END AS days FROM o)
  SELECT commitment_id, md5(concat_ws(chr(10), 'Commitment: ' || description || CASE WHEN late THEN chr(10) || 'OVERDUE by ' || days || ' days (target was ' || target || ')' ELSE '' END, 'Status: ' || status, 'Promised: ' || promised, 'Target: ' || target, 'Owner: ' || owner)) AS content, late AS is_overdue, CAST(days AS INTEGER) AS days_overdue, coalesce(target, promised, '') AS doc_date FROM n""")
def q_csv_commit_chunks(spark: SparkSession, d: str) -> DataFrame:
    return csv_commitment_chunks(_commitment_csv(spark, d), AS_OF).withColumn("content", F.md5("content"))


@query("q_commitment_json", "SELECT commitment_id, coalesce(description, '') AS description, coalesce(promised_date, '') AS promised_date, coalesce(current_target_date, '') AS current_target_date, coalesce(is_slipped, coalesce(current_target_date, '') <> '' AND coalesce(promised_date, '') <> '' AND current_target_date > promised_date) AS is_slipped, " + case_sql("coalesce(lower(trim(status)), 'active')", COMMITMENT_STATUS) + " AS status FROM commitments")
def q_commitment_json(spark: SparkSession, d: str) -> DataFrame:
    """Trackers as JSON files, as a list or under ``commitments``, read back. A null is empty, and a missing status active."""
    c = table(spark, d, "commitments")
    row = F.struct(F.col("commitment_id").alias("ID"), F.col("description").alias("item"), F.col("promised_date").alias("due_date"), "current_target_date", "is_slipped", "status")
    listed, wrapped = F.to_json(F.array(row)), F.to_json(F.struct(F.array(row).alias("commitments")))
    files = c.select(F.when(F.col("customer_aware"), listed).otherwise(wrapped).alias("payload"))
    return commitment_rows_of_json(files, "payload").select("commitment_id", "description", "promised_date", "current_target_date", "is_slipped", "status")
