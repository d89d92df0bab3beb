import pytest

from caselight.operators.timestamps import normal_form, normalise_timestamps


@pytest.mark.parametrize(
    ("value", "tz", "order", "want"),
    [
        ("2024-10-27 01:30", "Europe/London", "dmy", "2024-10-27T00:30:00.000Z"),  # occurs twice: the earlier
        ("2024-03-31 01:30", "Europe/London", "dmy", "2024-03-31T01:30:00.000Z"),  # skipped: moved forward
        ("03/04/2024", "America/New_York", "mdy", "2024-03-04"),
        ("03/04/2024", "Europe/London", "dmy", "2024-04-03"),
        ("31/31/2024", "Europe/London", "dmy", None),
        ("2024-02-30", "UTC", "ymd", None),
        ("26. März 2023, 02:43 Uhr", "Europe/Berlin", "dmy", "2023-03-26T01:43:00.000Z"),
        ("Oct 28, 2024 5:07 PM", "America/New_York", "mdy", "2024-10-28T21:07:00.000Z"),
        ("12/01/24 12:17am", "America/New_York", "mdy", "2024-12-01T05:17:00.000Z"),
        ("2023-05-10T08:30:05+02:00[Europe/Berlin]", None, None, "2023-05-10T06:30:05.000Z"),
        ("2024-12-06T06:57:52.866188+0000", None, None, "2024-12-06T06:57:52.866Z"),
        ("2025-10-17 01:08:20 CEST", None, None, "2025-10-16T23:08:20.000Z"),
        ("Tue, 09 Jan 2024 14:56:14 +0530", None, None, "2024-01-09T09:26:14.000Z"),
        ("1703598007000000", None, None, "2023-12-26T13:40:07.000Z"),
        ("20250820T215422Z", None, None, "2025-08-20T21:54:22.000Z"),
        ("23-Jun-2024", None, None, "2024-06-23"),
        ("2024-01-01 10:00", None, "dmy", None),
        ("2024-01-01 25:00", "UTC", "dmy", None),
        ("TBD", "UTC", "dmy", None),
        ("", "UTC", "dmy", None),
        (None, "UTC", "dmy", None),
        ("x" * 100_000, "UTC", "dmy", None),
    ],
)
def test_normal_form(value, tz, order, want):
    assert normal_form(value, tz, order) == want


def test_rows(spark):
    rows = spark.createDataFrame([(1, "lon", "01/02/2024", None, "n"), (1, "lon", "01/02/2024", "", "n"), (2, None, "2024-01-01T00:00", "2024-05-05", "n")], "id long, site_code string, a string, b string, tz_name string")
    sites = spark.createDataFrame([("lon", "Europe/London", "dmy"), ("lon", "Europe/London", "dmy"), (None, "UTC", "ymd")], "site_code string, tz_name string, date_order string")
    out = normalise_timestamps(rows, sites, ["a", "b"], "id", "t")
    assert sorted((r.row_id, r.field_name, r.normal_form) for r in out.collect()) == [(1, "a", "2024-02-01"), (1, "a", "2024-02-01"), (2, "b", "2024-05-05")]
    assert normalise_timestamps(rows.limit(0), sites, ["a"], "id", "t").count() == 0
