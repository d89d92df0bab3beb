import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from caselight.operators import text as X


def test_noise_filter(spark):
    df = spark.createDataFrame([("Risks:\r\nPage 3\n— 12 —\n• Cost overrun\n- Data loss\n\nshort\nA full line with more than four words here",), (None,)], "t string")
    kept, none = (r[0] for r in df.select(X.noise_filtered(F.col("t"))).collect())
    assert kept.split("\n") == ["Risks:", "• Cost overrun", "- Data loss", "A full line with more than four words here"]
    assert none == ""


def test_sentence_chunks():
    text = " ".join(f"This is sentence number {i} with a few more words." for i in range(60))
    chunks = X.sentence_chunks(text, 256, 64)
    assert len(chunks) >= 2
    assert all(len(c.split()) <= 320 and c.endswith(".") for c in chunks)
    assert X.sentence_chunks(None) == X.sentence_chunks("  ") == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=400), st.integers(10, 60))
def test_recursive_chunks_are_bounded_and_lose_nothing(text, size):
    chunks = X.recursive_chunks(text, size, 5)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(text.split())) <= set("".join(chunks)) | set(" \n")


def test_turns_and_merging():
    turns = X.plain_turns("Intro\nAna: one two\nmore\nBob: x\nBob: y\nSarah (FDE): z")
    assert turns == [("Speaker", "Intro"), ("Ana", "one two more"), ("Bob", "x"), ("Bob", "y Sarah (FDE): z")]
    assert X.merged_turns(turns[1:]) == [("Ana", "one two more"), ("Bob", "x y Sarah (FDE): z")]


@pytest.mark.parametrize(("name", "want"), [("2024-Q3_qbr_deck.pdf", "2024-07-01"), ("2024-10-01_x.csv", "2024-10-01"), ("notes.txt", None), ("a/2024-10-01_x.csv", "2024-10-01"), ("2024-10-01.csv", None), (None, None)])
def test_filename_date(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(X.filename_date(F.col("n"))).first()[0] == want


def test_json_and_html():
    assert X.json_strings('{"a": "long enough text", "b": ["short", {"c": "another long one"}], "n": 1}') == ["long enough text", "another long one"]
    assert X.json_strings("no json") == []
    assert X.html_sections("<h1>A</h1><p>x</p><h2>B</h2><p>y z</p><script>no</script>") == [("A", "", "", "x"), ("A", "B", "", "y z")]


def test_facts_of_the_reference(spark):
    text = "On 9/25/2024 us-east-2 held 12 GB and 3 years of logs for $4.5M under v3.2; SEV-1, TICK-4521, P0, 99.9%, 50,000 records."
    got = spark.createDataFrame([(text,)], "t string").select(X.facts(F.col("t"))).first()[0]
    assert {"9/25/2024", "us-east-2", "12 gb", "3 years", "$4.5m", "v3.2", "sev-1", "tick-4521", "p0", "99.9%", "50,000 records"} <= set(got)


def test_person_tiers(spark, tmp_path):
    from caselight.plans.sections import person_filter

    people = [("1", "Lee Park"), ("2", "Ana Gräf"), ("3", "Max Ode")]
    spark.createDataFrame([(1, people)], "call_id long, speakers array<struct<spk_id:string,spk_name:string>>").write.parquet(f"{tmp_path}/calls.parquet")
    lines = ["I believe so", "Park, Lee is here", "lee said", "Ana Gräf spoke", "ana again", "Max alone"]
    spark.createDataFrame([(i, 1, x) for i, x in enumerate(lines)], "turn_row_id long, call_id long, text string").write.parquet(f"{tmp_path}/turns.parquet")
    got = sorted(map(tuple, person_filter(spark, str(tmp_path)).collect()))
    assert got == [(1, 1, "lee park", 2), (3, 1, "ana gräf", 1), (5, 1, "max ode", 3)]


def test_hallucination_asks_the_documents(spark, tmp_path):
    from caselight.plans.retrieval import detect_hallucination

    d = str(tmp_path)
    spark.createDataFrame([(1, "The relay costs $5.", "c", "2025-01-01"), (2, "other", "c", None)], "doc_id long, text string, customer_slug string, doc_date string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([(1, "What costs the relay, $7?", "$5 and not $7")], "item_id long, question string, reference_answer string").write.parquet(f"{d}/eval_items.parquet")
    assert detect_hallucination(spark, d).first().unsupported == "$7"


@pytest.mark.parametrize(
    ("text", "kind", "turns"),
    [
        ("WEBVTT\n\n00:00:05.000 --> 00:00:10.000\nalign:middle line:0%\nAna: hello\nthis was discussed", "vtt", [("Ana", "hello this was discussed")]),
        ("1\n00:00:05,000 --> 00:00:10,000\n<i>Ana: hi</i>\n\n2\n00:00:11,000 --> 00:00:12,000\nBob: yes", "srt", [("Ana", "hi"), ("Bob", "yes")]),
        ("00:01:23\nAlice Jones\nSome words\nmore\n\n00:01:45\nBob Smith\nHis reply.", "zoom", [("Alice Jones", "Some words more"), ("Bob Smith", "His reply.")]),
        ("Alice Jones\n10:05 AM\nHello all.\n\nBob Smith\n10:06 AM\nHi.\nStill me.", "teams", [("Alice Jones", "Hello all."), ("Bob Smith", "Hi. Still me.")]),
        ("Date: today\nAttendees: all\nAna: hi", "plain", [("Ana", "hi")]),
        ("Title: x\nAna: before\n---\nBob: after", "plain", [("Bob", "after")]),
        ("", "plain", []),
        (None, "plain", []),
    ],
)
def test_transcript_formats(spark, text, kind, turns):
    assert spark.createDataFrame([(text,)], "t string").select(X.transcript_format(F.col("t"))).first()[0] == kind == X.file_format(text)
    assert [(a, b) for a, b, _ in X.transcript_turns(text)] == turns


def test_json_export():
    text = '{"speakers": [{"id": 1, "name": "Ana"}], "transcripts": [{"spk_id": 1, "text": " hi ", "start_offset": 5}, {"spk_id": 2, "text": "yo"}, {"spk_id": 1, "text": " "}]}'
    assert X.transcript_turns(text) == [("Ana", "hi", 5), ("Speaker 2", "yo", 0)]


@pytest.mark.parametrize(
    ("name", "kind", "meeting"),
    [("2024-01-01_status-call_x.txt", "transcript", "status-call"), ("2024_qbr-deck.pdf", "qbr_deck", "qbr"), ("x/commitments-q1.csv", "commitment_tracker", None), ("crm-notes.docx", "account_notes", None), ("a.json", None, None), ("plain.pdf", "qbr_deck", None), ("INC-12.json", "ticket", None), ("kickoff_renewal.txt", "transcript", "kickoff"), (None, None, None)],
)
def test_types_by_name(spark, name, kind, meeting):
    assert tuple(spark.createDataFrame([(name,)], "n string").select(X.inferred_type(F.col("n")), X.meeting_type(F.col("n"))).first()) == (kind, meeting)
