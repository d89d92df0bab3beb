import datetime as dt
import random

from caselight.operators.history import version_history

SCHEMA = "id long, e string, a string, b string, as_of string, loaded_at timestamp"


def brute(rows, attributes=("a", "b")):
    def plain(v):
        v = (v or "").strip().lower()
        return v[:10] if len(v) == 19 and v.endswith("t00:00:00") else v

    best = {}
    for r in rows:
        if r[1] is None:
            continue
        day = r[4][:10] if r[4] else (r[5].date().isoformat() if r[5] else None)
        if day is None:
            continue
        key = (r[1], day)
        rank = (r[5] or dt.datetime.min, r[0])
        if key not in best or best[key][0] < rank:
            best[key] = (rank, (plain(r[2]), plain(r[3])))
    out = []
    for e in {k[0] for k in best}:
        days = sorted(k[1] for k in best if k[0] == e)
        runs = [d for i, d in enumerate(days) if i == 0 or best[e, d][1] != best[e, days[i - 1]][1]]
        out += [(e, i + 1, d, runs[i + 1] if i + 1 < len(runs) else "9999-12-31") for i, d in enumerate(runs)]
    return sorted(out)


def got(df):
    return sorted((r.e, r.version_no, r.valid_from, r.valid_to) for r in version_history(df, "e", ["a", "b"], "as_of", "loaded_at", "id").collect())


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        day = dt.date(2023, 1, 1) + dt.timedelta(days=rng.choice([rng.randrange(900), rng.randrange(20)]))
        load = dt.datetime.combine(day, dt.time(rng.randrange(24))) + dt.timedelta(days=rng.choice([0, 0, 0, 30]))
        rows.append((i, rng.choice(["x", "x", "y", "z", None]), rng.choice(["p", " P ", "q", None, ""]), rng.choice(["2024-01-01", "2024-01-01T00:00:00", None]), rng.choice([day.isoformat(), None]), load))
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty) == []
    t = dt.datetime(2024, 1, 5, 8)
    rows = [(1, "x", "a", None, "2024-01-01", t), (2, "x", "A", "", "2024-01-02", t), (3, "x", "b", None, "2024-01-02", t), (4, "y", None, None, "", None), (5, "y", None, None, "no date", t)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == [("x", 1, "2024-01-01", "2024-01-02"), ("x", 2, "2024-01-02", "9999-12-31"), ("y", 1, "2024-01-05", "9999-12-31")]


def test_dates_of_any_year_form_one_history(spark):
    days = ["0001-01-01", "1969-12-31", "1970-01-01", "1990-05-05", "2149-06-06", "2149-06-07", "2200-01-01", "9999-12-30"]
    rows = [(i, "x", f"v{i}", None, d, dt.datetime(2024, 1, 1)) for i, d in enumerate(days)]
    want = [("x", i + 1, d, [*days[1:], "9999-12-31"][i]) for i, d in enumerate(days)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == want
