"""Calendar and scalar functions: boundary values of seasons, night, holidays, rush hours, cyclic."""

import math

import pytest
from pyspark.sql import functions as F

from tests.conftest import ts
from velora.functions import calendar as cal
from velora.functions import scalar as sc
from velora.operators.quality import coerce_counts, standardize_columns


def _one(spark, expr, stamp):
    return spark.createDataFrame([(ts(stamp),)], "ts timestamp_ntz").select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "stamp,expected",
    [
        ("2025-03-19 23:00:00", "winter"),
        ("2025-03-20 00:00:00", "spring"),
        ("2025-06-20 23:00:00", "spring"),
        ("2025-06-21 00:00:00", "summer"),
        ("2025-09-21 12:00:00", "summer"),
        ("2025-09-22 00:00:00", "autumn"),
        ("2025-12-20 23:00:00", "autumn"),
        ("2025-12-21 00:00:00", "winter"),
        ("2025-12-22 08:00:00", "winter"),
        ("2025-01-05 08:00:00", "winter"),
    ],
)
def test_season_boundaries(spark, stamp, expected):
    assert _one(spark, cal.season(F.col("ts")), stamp) == expected


@pytest.mark.parametrize(
    "stamp,expected",
    [
        ("2025-01-10 17:00:00", True),   # winter start 17
        ("2025-01-10 16:00:00", False),
        ("2025-01-10 07:00:00", True),   # winter end 8
        ("2025-01-10 08:00:00", False),
        ("2025-04-10 20:00:00", False),  # spring start 20.5
        ("2025-04-10 20:30:00", True),
        ("2025-04-10 21:00:00", True),
        ("2025-04-10 05:59:00", True),
        ("2025-07-10 22:00:00", True),   # summer 22 / 5
        ("2025-07-10 05:00:00", False),
        ("2025-10-10 19:00:00", True),   # autumn 19 / 7
        ("2025-10-10 07:00:00", False),
    ],
)
def test_night_bounds(spark, stamp, expected):
    assert _one(spark, cal.is_night(F.col("ts")), stamp) is expected


def test_night_unknown_season_is_false(spark):
    df = spark.createDataFrame([(ts("2025-01-10 23:00:00"), "monsoon"), (ts("2025-01-10 23:00:00"), "Winter")], "ts timestamp_ntz, s string")
    got = [r.v for r in df.select(cal.is_night(F.col("ts"), F.col("s")).alias("v")).collect()]
    assert got == [False, True]


@pytest.mark.parametrize(
    "stamp,expected",
    [
        ("2024-10-19 00:00:00", True),   # start included
        ("2024-10-18 23:00:00", False),
        ("2024-11-04 23:00:00", True),
        ("2024-11-05 00:00:00", False),  # end excluded
        ("2025-05-31 12:00:00", True),
        ("2025-06-01 00:00:00", False),
        ("2025-09-01 23:00:00", True),
        ("2025-09-02 00:00:00", False),
    ],
)
def test_holiday_intervals(spark, stamp, expected):
    assert _one(spark, cal.holiday_flag(F.col("ts")), stamp) is expected


def test_holiday_join_equals_expression(spark):
    import datetime as dt

    hours = spark.range(0, 24 * 400).select((F.lit(dt.datetime(2024, 10, 1)) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"))
    intervals = spark.createDataFrame(
        [(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in cal.HOLIDAY_PERIODS], "start_date date, end_date date"
    )
    joined = cal.interval_flag_join(hours, "ts", intervals, "j").withColumn("e", cal.holiday_flag("ts"))
    assert joined.filter(F.col("j") != F.col("e")).count() == 0
    assert joined.count() == 24 * 400


@pytest.mark.parametrize("hour,expected", [(6, False), (7, True), (9, True), (10, False), (16, False), (17, True), (19, True), (20, False)])
def test_rush_hour(spark, hour, expected):
    assert _one(spark, cal.is_rush_hour(F.col("ts")), f"2025-03-03 {hour:02d}:00:00") is expected


def test_cyclic_range_and_noon(spark):
    df = spark.range(0, 24 * 14).select(
        (F.lit(ts("2025-03-03 00:00:00")) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts")
    )
    out = cal.add_cyclic_features(df, "ts")
    for c in ("dow_sin", "dow_cos", "month_sin", "month_cos", "hour_sin", "hour_cos", "season_sin", "season_cos"):
        lo, hi = out.agg(F.min(c), F.max(c)).first()
        assert -1.0 <= lo <= hi <= 1.0
    noon = out.filter(F.hour("ts") == 12).select("hour_cos").first()[0]
    assert math.isclose(noon, -1.0)


def test_floor_hour_and_weekday(spark):
    df = spark.createDataFrame([(ts("2025-03-03 08:45:31"),), (ts("2025-03-09 00:00:00"),)], "ts timestamp_ntz")
    rows = df.select(cal.floor_hour("ts").alias("h"), cal.weekday0("ts").alias("w"), cal.iso_dow("ts").alias("i"), cal.day_name_fr("ts").alias("n")).collect()
    assert rows[0].h == ts("2025-03-03 08:00:00") and rows[0].w == 0 and rows[0].i == 1 and rows[0].n == "Lundi"
    assert rows[1].w == 6 and rows[1].i == 7 and rows[1].n == "Dimanche"


def test_hour_grid_is_half_open(spark):
    g = cal.hour_grid(spark, "2025-01-01 00:00:00", "2025-01-01 03:00:00").collect()
    assert [r.ts for r in g] == [ts("2025-01-01 01:00:00"), ts("2025-01-01 02:00:00"), ts("2025-01-01 03:00:00")]


def test_standardize_and_coerce(spark):
    df = spark.createDataFrame([(" Site ID ", "x")], "`A B ` string, c string")
    assert standardize_columns(df).columns == ["a_b", "c"]
    raw = spark.createDataFrame(
        [("42.0", "7", "2025-01-01 08:45:00+01:00"), ("abc", "n/a", "not a date"), ("43", "5", "2025-10-26 02:30:00+02:00")],
        "site_id string, hourly_count string, ts string",
    )
    rows = coerce_counts(raw).collect()
    assert rows[0].site_id == 42 and rows[0].hourly_count == 7 and rows[0].ts == ts("2025-01-01 08:45:00")
    assert rows[1].site_id is None and rows[1].hourly_count is None and rows[1].ts is None
    assert rows[2].ts == ts("2025-10-26 02:30:00")  # zone dropped, clock time kept


def test_coordinates_and_labels(spark):
    df = spark.createDataFrame([("48.85, 2.35", "A", 1), ("", None, 2), ("48.8", "C", 3)], "c string, n string, i long")
    rows = df.select(
        sc.coord_part("c", 1).alias("lat"), sc.coord_part("c", 2).alias("lon"), sc.site_label("n", "i").alias("l")
    ).collect()
    assert (rows[0].lat, rows[0].lon, rows[0].l) == (48.85, 2.35, "A (ID 1)")
    assert rows[1].lat is None and rows[1].lon is None and rows[1].l is None
    assert rows[2].lat == 48.8 and rows[2].lon is None


def test_weather_flags_and_levels(spark):
    df = spark.createDataFrame([(0.0, None, 15.0, 5.0), (None, 0.2, 15.1, 25.0)], "r double, s double, w double, v double")
    rows = df.select(
        sc.rainy("r").alias("rain"), sc.snowy("s").alias("snow"), sc.windy("w").alias("wind"), sc.load_level("v", 10, 20).alias("lvl"),
        sc.load_level("v", 10, 5).alias("lvl2"), sc.round1(F.lit(2.25)).alias("r1"),
    ).collect()
    assert (rows[0].rain, rows[0].snow, rows[0].wind, rows[0].lvl, rows[0].lvl2) == (False, False, False, "calm", "calm")
    assert (rows[1].rain, rows[1].snow, rows[1].wind, rows[1].lvl, rows[1].lvl2) == (False, True, True, "busy", "busy")
    assert float(rows[0].r1) == 2.2


def test_holiday_table_join_equals_the_fixed_calendar(spark):
    import datetime as dt

    hours = spark.range(0, 24 * 60).select((F.lit(dt.datetime(2024, 12, 1)) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"))
    intervals = spark.createDataFrame(
        [(dt.date.fromisoformat(a), dt.date.fromisoformat(b)) for a, b in cal.HOLIDAY_PERIODS], "start_date date, end_date date"
    )
    joined = cal.interval_flag_join(hours, "ts", intervals, "j")
    assert joined.filter(F.col("j") != cal.holiday_flag("ts")).count() == 0 and joined.count() == 24 * 60
