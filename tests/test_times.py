import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberlog.functions import times


@pytest.mark.parametrize("text", ["2025-01-02", "2025-01-02 03:04", "2025-01-02T03:04:05", " 2025-01-02 03:04:05.678 ", "2025/01/02x03-04"])
def test_ui_datetime_accepts(text):
    assert times.parse_ui_datetime(text) is not None


@pytest.mark.parametrize("text", ["2025-13-45", "2025-02-30", "2025-02-29", "2025-01-01 24:00", "2025-01-01 12:60", "2025-01-01 12:00:60", "2025-01-01x", "2025-1-1", "abcd-01-01"])
def test_ui_datetime_rejects(spark, text):
    with pytest.raises(ValueError):
        times.parse_ui_datetime(text)
    assert spark.createDataFrame([(text,)], "t string").select(times.ui_millis(F.col("t"))).first()[0] is None


def test_ui_datetime_nothing():
    assert times.parse_ui_datetime(None) is None
    assert times.parse_ui_datetime("  ") is None
    assert times.parse_ui_datetime("2024-02-29") == 1709164800000


@given(st.datetimes(min_value=dt.datetime(1, 1, 1), max_value=dt.datetime(9999, 12, 31)))
def test_iso_round_trip(t):
    ms = times.millis_of(t.year, t.month, t.day, t.hour, t.minute, t.second, t.microsecond // 1000)
    assert times.parse_ui_datetime(times.iso(ms)) == ms


def test_columns_agree_with_driver(spark):
    values = [0, 1, -1, 999, 1709164799999, -62135596800000, 253402300799999, 1700000000123]
    df = spark.createDataFrame([(v, times.iso(v)) for v in values], "ms long, t string")
    for r in df.select("ms", "t", times.format_iso(F.col("ms")).alias("iso"), times.ui_millis(F.col("t")).alias("back")).collect():
        assert (r.iso, r.back) == (r.t, r.ms)


def test_calendar_is_not_checked_for_logs(spark):
    rows = [("2025-13-45 00:00:00.000", "2026-02-14"), ("2026-02-31 00:00:00.000", "2026-03-03"), ("2026-00-10 00:00:00.000", "2025-12-10"), ("2026-01-01 99:00:00.000", "2026-01-05")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", times.format_iso(times.log_millis(F.col("t"))).alias("iso")).collect()
    assert all(r.iso.startswith(r.want) for r in got)


def test_month_names(spark):
    rows = [("15-Jun-2026 00:19:11.705", "2026-06-15T00:19:11.705"), ("15-JUN-2026 00:19:11.705", "2026-06-15T00:19:11.705"), ("15-Jux-2026 00:19:11.705", None), ("01-nFe-2026 00:00:00.000", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("want", times.format_iso(times.month_day_millis(F.col("t"))).alias("iso")).collect()
    assert all(r.iso == r.want for r in got)


def test_ranges():
    assert times.first_hours(1000, 10**9, 1) == (1000, 3601000)
    assert times.last_hours(10**9 - 5, 10**9, 24) == (10**9 - 5, 10**9)
    assert times.around(61_999, 1) == (1000, 121_000)
    assert times.minute_range("2025-01-01", None, "2025-01-02", "10:30") == ("2025-01-01 00:00:00.000", "2025-01-02 10:30:59.999")
