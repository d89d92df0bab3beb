import pytest

from caselight.llm.canonical import THRESHOLD, UNMATCHED, grams, listed_aliases, map_values, mapped_rows, normalised, surface_forms

REF = [("ticket_status", c) for c in ("open", "in_progress", "pending", "closed", "escalated")] + [("ticket_priority", c) for c in ("P0", "P1", "P2", "P3")]


@pytest.fixture
def entries(spark):
    return spark.createDataFrame([(*r, "g") for r in REF], "field_group string, canonical string, value string")


def test_values(spark, entries):
    want = {
        ("ticket_status", "clsoed"): "closed", ("ticket_status", "  OPEN ?"): "open", ("ticket_status", "-> in_porgress"): "in_progress", ("ticket_status", "Wartet auf Kunde (per call)"): "pending",
        ("ticket_status", "see notes"): UNMATCHED, ("ticket_status", "??"): UNMATCHED, ("ticket_status", "x" * 50_000): UNMATCHED, ("ticket_priority", "🔴 Sev-0"): "P0", ("ticket_priority", "P1/P2"): UNMATCHED,
        ("ticket_priority", "P7"): UNMATCHED, ("ticket_priority", "crítico"): "P0", ("ticket_priority", "2 - nomral"): "P2", ("nowhere", "open"): UNMATCHED,
    }
    got = {(r.grp, r.value): r.canonical for r in map_values(spark.createDataFrame(list(want), "grp string, value string"), entries, aliases=listed_aliases(spark)).collect()}
    assert {k: got.get(k, UNMATCHED) for k in want} == want


def test_rows(spark, entries):
    rows = spark.createDataFrame([(1, "ticket_status", "open"), (2, "ticket_status", "Open"), (3, "ticket_status", "Open"), (4, "ticket_status", None), (5, "ticket_status", "  ")], "id long, grp string, value string")
    assert sorted((r.id, r.canonical) for r in mapped_rows(rows, entries).collect()) == [(2, "open"), (3, "open")]
    assert mapped_rows(rows.limit(0), entries).count() == 0


def test_glosses_are_forms(spark):
    entries = spark.createDataFrame([("p", "P0", "critical, severity 0"), ("p", "P2", "normal or medium, severity 2"), ("p", None, "x")], "field_group string, canonical string, gloss string")
    got = {r.value: r.canonical for r in map_values(spark.createDataFrame([("p", v) for v in ("Critcal", "medium!", "Severity-2", "p0", "other")], "grp string, value string"), entries).collect()}
    assert got == {"Critcal": "P0", "medium!": "P2", "Severity-2": "P2", "p0": "P0", "other": UNMATCHED}


def test_a_long_list_against_brute_force(spark):
    import math
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeorst") for _ in range(rng.randrange(4, 9))) for _ in range(30)]
    cities = sorted({f"{rng.choice(words)} {rng.choice(words)}" for _ in range(60)})
    slip = lambda c: c[: (i := rng.randrange(1, len(c) - 1))] + c[i + 1 :]
    values = [slip(c) for c in cities] + words[:20]
    entries = spark.createDataFrame([("city", c) for c in cities], "field_group string, canonical string")
    of = lambda texts: {r.v: set(r.g) for r in spark.createDataFrame([(t,) for t in texts], "v string").select("v", grams(normalised(F.col("v"))).alias("g")).collect()}
    forms, asked = of(cities), of(values)
    df = {g: sum(g in x for x in forms.values()) for g in set().union(*forms.values())}
    w = lambda g: math.log(1 + len(forms) / df[g]) if g in df else math.log(1 + len(forms))
    norm = lambda gs: math.sqrt(sum(w(g) ** 2 for g in gs))
    got = {r.value: r for r in map_values(spark.createDataFrame([("city", v) for v in values], "grp string, value string"), entries).collect()}
    for v in values:
        scores = sorted(((sum(w(g) ** 2 for g in asked[v] & fg) / norm(asked[v]) / norm(fg), c) for c, fg in forms.items()), reverse=True)
        ok = scores[0][0] >= THRESHOLD and scores[0][0] - scores[1][0] >= 0.06
        if abs(scores[0][0] - THRESHOLD) > 1e-6 and abs(scores[0][0] - scores[1][0] - 0.06) > 1e-6:
            assert got[v].canonical == (scores[0][1] if ok else UNMATCHED), v
    assert surface_forms(entries).count() == len(cities)
