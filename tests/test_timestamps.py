from datetime import datetime, timezone

import pytest

from heliovox.operators import timestamps as T


def us(text):
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000 + 0.5)


CASES = [
    # text, received, zone, winter clock, instant, status
    ("2024-06-01 12:00:00+02:00", "2024-06-01 11:00:00", "Europe/Rome", False, "2024-06-01 10:00:00", "exact"),
    ("2024-06-01T12:00:00.1234567Z", "2024-06-01 13:00:00", None, False, "2024-06-01 12:00:00.123456", "exact"),
    ("2024-06-01 12:00:00", "2024-06-01 13:00:00", "Europe/Rome", False, "2024-06-01 10:00:00", "exact"),
    ("2024-06-01 12:00:00", "2024-06-01 13:00:00", "Europe/Rome", True, "2024-06-01 11:00:00", "exact"),
    ("20240601T120000Z", "2024-06-01 13:00:00", None, False, "2024-06-01 12:00:00", "exact"),
    ("03/04/2024 10:15", "2024-04-03 20:00:00", "Europe/Rome", False, "2024-04-03 08:15:00", "exact"),
    ("03/04/2024 10:15", "2024-03-05 20:00:00", "Europe/Rome", False, "2024-03-04 09:15:00", "exact"),
    ("03/04/2024 12:15:30 AM", "2024-04-03 20:00:00", "Europe/Rome", False, "2024-04-02 22:15:30", "exact"),
    ("11/01/24 01:23", "2024-01-11 09:00:00", "Europe/Rome", False, "2024-01-11 00:23:00", "exact"),
    ("28/05/2024 06", "2024-05-28 09:00:00", "Europe/Rome", False, "2024-05-28 04:00:00", "exact"),
    ("15.03.2024 22:28:28 CET", "2024-03-16 00:00:00", None, False, "2024-03-15 21:28:28", "exact"),
    ("23/08/2024 08:56 UTC+1", "2024-08-23 10:00:00", None, False, "2024-08-23 07:56:00", "exact"),
    ("Sun, 10 Mar 2024 04:10:44 +0200", "2024-03-10 10:00:00", None, False, "2024-03-10 02:10:44", "exact"),
    ("8 ott 2025 12:40:43", "2025-10-08 12:00:00", "Europe/Rome", False, "2025-10-08 10:40:43", "exact"),
    ("1704949987", "2024-01-11 06:00:00", None, False, "2024-01-11 05:13:07", "exact"),
    ("1704949987123", "2024-01-11 06:00:00", None, False, "2024-01-11 05:13:07.123", "exact"),
    ("1704949987123456789", "2024-01-11 06:00:00", None, False, "2024-01-11 05:13:07.123456", "exact"),
    ("1704949987.5", "2024-01-11 06:00:00", None, False, "2024-01-11 05:13:07.5", "exact"),
    ("2024-10-27 02:30:00", "2024-10-27 06:00:00", "Europe/Rome", False, "2024-10-27 01:30:00", "ambiguous"),
    ("2024-10-27 02:30:00", "2024-10-27 01:00:00", "Europe/Rome", False, "2024-10-27 00:30:00", "ambiguous"),
    ("2024-03-31 02:30:00", "2024-03-31 06:00:00", "Europe/Rome", False, None, "nonexistent"),
    ("2024-06-01 12:00:00Z", "2024-08-01 13:00:00", None, False, None, "out_of_window"),
    ("2024-06-01 12:00:00Z", "2024-06-01 11:59:59", None, False, None, "out_of_window"),
    ("2024-06-01 12:00:00", "2024-06-01 13:00:00", None, False, None, "nonexistent"),
    ("2024-06-01 12:00:00", "2024-06-01 13:00:00", "Mars/Base", False, None, "nonexistent"),
    ("31/02/2026 10:00", "2026-03-01 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("2026-13-04 25:61:00", "2026-03-01 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("0000-00-00 00:00:00", "2026-03-01 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("", "2026-03-01 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("n/d", "2026-03-01 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("x" * 100_000, "2026-03-01 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("9" * 50_000, "2026-03-01 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("15.03.2024 22:28:28 XYZ", "2024-03-16 00:00:00", "Europe/Rome", False, None, "unreadable"),
    ("2024-06-01 12:00:00Z", None, "Europe/Rome", False, None, "out_of_window"),
]


@pytest.fixture(scope="module")
def zones(spark):
    return T.zone_intervals(spark.createDataFrame([("Europe/Rome",), (None,), ("Mars/Base",), ("Europe/Rome",)], "zone string")).cache()


def test_cases(spark, zones):
    rows = [(n, t, datetime.fromisoformat(r) if r else None, z, w) for n, (t, r, z, w, _, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, text string, got timestamp, tz string, winter boolean").selectExpr("*", "1 as zone", "2 as year", "3 as spans", "4 as standard")
    out = T.normalise(df, zones, text="text", received="got", zone="tz", standard=df["winter"])
    got = {r["n"]: (r["utc_us"], r["time_status"]) for r in out.collect()}
    assert len(got) == len(CASES)
    for n, (text, _, _, _, instant, status) in enumerate(CASES):
        assert got[n] == (us(instant) if instant else -1, status), text[:40]
    assert {"zone", "year", "spans", "standard"} < set(out.columns)


def test_null_text_and_empty_table(spark, zones):
    df = spark.createDataFrame([(None, datetime(2024, 1, 1), "Europe/Rome")], "text string, got timestamp, tz string")
    args = dict(text="text", received="got", zone="tz")
    assert T.normalise(df, zones, **args).first()["utc_us"] is None
    assert T.normalise(df.limit(0), zones, **args).count() == 0


def test_intervals_agree_with_the_zone(zones):
    from zoneinfo import ZoneInfo

    rows = [r for r in zones.where("not standard and year in (1977, 2024, 2050)").collect()]
    assert rows
    for r in rows:
        for s in r["spans"]:
            for edge in (s["lo"], s["hi"] - 1_000_000):
                at = datetime.fromtimestamp(edge / 1e6 - s["off"], timezone.utc)
                assert at.astimezone(ZoneInfo("Europe/Rome")).utcoffset().total_seconds() == s["off"]


def test_usual_form_with_impossible_parts(spark, zones):
    texts = ["2024-02-30 12:00:00+01:00", "2024-02-28 24:00:00+01:00", "2024-02-28 12:00:61+01:00", "2024-02-28 12:00:00-09:30"]
    df = spark.createDataFrame([(t, datetime(2024, 3, 1), None) for t in texts], "text string, got timestamp, tz string")
    assert [r["utc_us"] for r in T.normalise(df, zones, text="text", received="got", zone="tz").collect()] == [-1, -1, -1, us("2024-02-28 21:30:00")]


def test_windows_beyond_the_year(spark, zones):
    df = spark.createDataFrame([("2024-11-20 12:00:00", datetime(2025, 1, 10), "Europe/Rome"), ("2024-11-20 12:00:00", datetime(2024, 11, 25), "Europe/Rome")], "text string, got timestamp, tz string")
    args = dict(text="text", received="got", zone="tz")
    wide = T.zone_intervals(spark.createDataFrame([("Europe/Rome",)], "zone string"), 60)
    assert [(r["utc_us"], r["time_status"]) for r in T.normalise(df, wide, **args, window_days=60).collect()] == [(us("2024-11-20 11:00:00"), "exact")] * 2
    assert [r["time_status"] for r in T.normalise(df, zones, **args).collect()] == ["out_of_window", "exact"]
    with pytest.raises(Exception, match="laid out"):
        T.normalise(df, zones, **args, window_days=60).collect()
