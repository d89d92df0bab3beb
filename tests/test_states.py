"""State machines, answers and sections on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from caselight.operators.people import person_tiers
from caselight.operators.ranking import cumulated, nearest_ranks, numbered_in_blocks, previous_in_blocks
from caselight.plans.claims import checked_claims, citations, judge_verdicts, urgency, valid_verb, with_fallback
from caselight.plans.questions import intent_of, missing_hints, predicates, require_tenant, sub_queries
from caselight.streaming.events import Breaker, circuit_breaker, drained, ttl_cache


def test_breaker():
    b = Breaker(threshold=3, recovery=30)
    for t in range(3):
        assert not b.refuses(t)
        b.report(True, t)
    assert b.refuses(10) and not b.refuses(32) and b.state == "half_open"
    b.report(True, 33)
    assert b.state == "open" and not b.refuses(63)
    b.report(False, 63)
    assert (b.state, b.failures) == ("closed", 0)


@pytest.fixture
def stream(spark, tmp_path):
    """Events in two files, so in two micro-batches."""
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=20 * i), rng.randrange(3), rng.choice(["error", "error", "view", "click", "purchase"])) for i in range(300)]
    schema = "event_id long, ts timestamp, user_id long, event_type string"
    for part in (rows[:150], rows[150:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    return rows, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/e")


def test_streamed_states_equal_a_fold_by_hand(stream):
    rows, events = stream
    breakers, want = {}, {}
    for i, ts, user, kind in rows:
        b = breakers.setdefault(user, Breaker(2, 100))
        now = ts.replace(tzinfo=dt.UTC).timestamp()
        refused = b.refuses(now)
        if not refused:
            b.report(kind == "error", now)
        want[i] = (b.state, refused)
    got = {r.event_id: (r.state, r.refused) for r in drained(circuit_breaker(events, threshold=2, recovery=100)).collect()}
    assert got == want
    held, hits = {}, {}
    for i, ts, user, kind in rows:
        own = held.setdefault(user, {})
        if kind == "purchase":
            own.clear()
            continue
        hits[i] = kind in own and (ts - own[kind]).total_seconds() <= 200
        if not hits[i]:
            own[kind] = ts
    assert {r.event_id: r.hit for r in drained(ttl_cache(events, seconds=200)).collect()} == hits


def test_ranks_and_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), rng.randrange(40) / 4, i) for i in range(200)] + [("c", None, 200)]
    df = spark.createDataFrame(rows, "g string, v double, i long")
    got = {r.g: r for r in nearest_ranks(df, "g", "v", {50: 0.5, 99: 0.99}).collect()}
    for g in "ab":
        s = sorted(v for x, v, _ in rows if x == g)
        assert (got[g].p50, got[g].p99, got[g].n) == (s[int(len(s) * 0.5)], s[min(int(len(s) * 0.99), len(s) - 1)], len(s))
    assert "c" not in got and cumulated(df.limit(0), "g", "v").count() == 0
    before = {r.i: r.before for r in previous_in_blocks(df, "g", F.floor(F.col("i") / 7), ["i"], "v", "before").collect()}
    numbers = {r.i: r.n for r in numbered_in_blocks(df.withColumn("b", F.floor(F.col("i") / 7)), "g", ["b"], ["i"], "n").collect()}
    for g in "abc":
        own = [(i, v) for x, v, i in rows if x == g]
        assert [before[i] for i, _ in own] == [None, *[v for _, v in own[:-1]]]
        assert [numbers[i] for i, _ in own] == list(range(1, len(own) + 1))


def test_claims(spark):
    claims = spark.createDataFrame([(1, 0, "It took 5 days and $7 only, they said so"), (1, 1, "It took 5 days in all"), (1, 2, "Nothing to check here"), (1, 3, "Ana said 5 days were fine"), (2, 0, "It took 5 days")], "k long, no int, claim string")
    context = spark.createDataFrame([(1, "it was 5 days"), (1, "and more"), (3, "$7")], "k long, low string")
    got = {(r.k, r.no): (r.bucket, r.unsupported) for r in checked_claims(claims, context, "k").collect()}
    assert got == {(1, 0): ("flagged", "$7"), (1, 1): ("verified", ""), (1, 2): ("needs_judge", ""), (1, 3): ("needs_judge", ""), (2, 0): ("flagged", "5 days")}


def test_verdicts(spark):
    answers = ['{"verdicts": [{"index": 1, "verdict": "Unsupported"}, {"index": 9, "verdict": "unsupported"}, {"verdict": "unsupported"}], "conflicts": [{"topic": "t", "source_a": "a", "source_b": "b"}, {"topic": "t"}]}', '[{"index": 2, "verdict": "unsupported"}]', "no json", None]
    df = spark.createDataFrame([(a, ["x", "y"]) for a in answers], "a string, c array<string>").select(judge_verdicts(F.col("a"), F.col("c")).alias("v"))
    got = [(r.v.status, r.v.unsupported, None if r.v.conflicts is None else len(r.v.conflicts)) for r in df.collect()]
    assert got == [("ok", ["x"], 1), ("ok", ["y"], 0), ("parse_error", None, None), ("parse_error", None, None)]


def test_citations_fall_back(spark):
    retrieved = spark.createDataFrame([(a, f"C{i}", f"f{i % 2}", "2025-01-01") for a in (1, 2) for i in range(6)], "answer_id long, chunk_id string, document string, doc_date string")
    cited = spark.createDataFrame([(1, 0, "X9"), (1, 1, "C3"), (1, 2, "C1"), (1, 3, "C2")], "answer_id long, ix int, chunk_id string")
    answers = spark.createDataFrame([(1,), (2,), (3,)], "answer_id long")
    got = sorted((r.answer_id, r.position, r.document) for r in with_fallback(citations(cited, retrieved), answers, retrieved).collect())
    assert got == [(1, 1, "f1"), (1, 2, "f0"), (2, 1, "f0"), (2, 2, "f1")]


def test_questions(spark):
    df = spark.createDataFrame([("Which commitments are overdue in Q4 2024 after May 2024?",), ("open P1 tickets about the P0 bug",), (None,)], "q string")
    rows = df.select(intent_of(F.col("q")).alias("i"), predicates(F.col("q")).alias("p"), sub_queries(F.col("q")).alias("s"), missing_hints(F.col("q"), F.array(F.lit("ticket"))).alias("m")).collect()
    assert [r.i for r in rows] == ["commitment", "ticket", "semantic"]
    assert (rows[0].p.overdue, rows[0].p.due_from, rows[0].p.due_before, rows[1].p.priority, rows[1].p.ticket_open) == (True, "2024-10-01", "2025-01-01", "P0", True)
    assert len(rows[0].s) == 2 and rows[2].s == [""]
    assert rows[0].m == ["commitment_tracker"] and rows[1].m == []
    for bad in (None, " "):
        with pytest.raises(ValueError):
            require_tenant(bad)


def test_verbs(spark):
    df = spark.createDataFrame([(" lead ",), ("PUSH",), ("shout",), (None,)], "v string").select(valid_verb(F.col("v")).alias("v"), urgency(F.col("v")).alias("u"))
    assert [tuple(r) for r in df.collect()] == [("Lead", "medium"), ("Push", "medium"), (None, "medium"), (None, "medium")]


def test_person_tiers(spark):
    people = spark.createDataFrame([("t", "lee park"), ("t", "ana gräf"), ("t", "max ode"), ("t", "cher"), ("u", "lee park"), ("t", None)], "tenant string, person string")
    texts = [(1, "note", "I believe so"), (2, "note", "Park, Lee is here"), (3, "transcript", "lee said"), (4, "note", "Ana Gräf spoke"), (5, "transcript", "ana again"), (6, "note", "Max alone"), (7, "transcript", "MAX again"), (8, "note", "Cher!"), (9, "note", None)]
    chunks = spark.createDataFrame([("t", *x) for x in texts], "tenant string, chunk_id long, kind string, text string")
    got = sorted((r.person, r.chunk_id, r.tier) for r in person_tiers(chunks, people, []).collect())
    assert got == [("ana gräf", 4, 1), ("cher", 8, 1), ("lee park", 2, 2), ("max ode", 7, 3)]
