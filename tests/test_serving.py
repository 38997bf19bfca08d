"""Serving queries."""

import datetime as dt

from pyspark.sql import functions as F

from velora.operators.quality import map_ready
from velora.plans import serving as sv
from velora.plans.sites import forecast_geo, located_forecast, site_dimension

H = dt.datetime(2025, 1, 2, 8)


def _forecast(spark):
    rows = [(1, H, 5.0), (2, H, 9.0), (3, H, 9.0), (1, H + dt.timedelta(hours=1), 1.0), (4, H, 2.0)]
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count double")


def _sites(spark):
    raw = spark.createDataFrame(
        [(1, "B st", "48.1,2.1", H), (2, "A st", "48.2, 2.2", H), (3, "C st", "", H), (4, "D st", None, H), (2, "A2 st", "48.3,2.3", H - dt.timedelta(days=1))],
        "site_id long, site_name string, coordinates string, ts timestamp_ntz",
    )
    return site_dimension(raw)


def test_site_dimension_and_geo(spark):
    sites = {r.site_id: r for r in _sites(spark).collect()}
    assert set(sites) == {1, 2, 3}  # NULL coordinates -> not in the dimension
    assert sites[2].site_name == "A st" and sites[2].longitude == 2.2  # latest row wins, trimmed
    assert sites[3].latitude is None  # blank coordinates -> NULL lat/lon
    geo = forecast_geo(_forecast(spark), _sites(spark))
    assert geo.count() == 5
    assert geo.filter("site_id = 4").first().site_name is None  # left join keeps unknown sites
    assert {r.site_id for r in located_forecast(_forecast(spark), _sites(spark)).collect()} == {1, 2}
    assert map_ready(geo).count() == 3


def test_predict_top_and_default(spark):
    geo = forecast_geo(_forecast(spark), _sites(spark))
    rows = sv.predict_at(geo, "2025-01-02 08:45:00").collect()  # floored to the hour
    assert [r.site_id for r in rows] == [2, 3, 1, 4]  # busiest first, ties by id
    top = sv.top_sites(geo, H, n=2).collect()
    assert [r.station for r in top] == ["A st (ID 2)", "C st (ID 3)"]
    quiet = sv.top_sites(geo, H, n=1, busiest=False).collect()
    assert quiet[0].site_id == 4 and quiet[0].station is None
    assert sv.default_site(geo, H).first().site_id == 2
    assert sv.predict_at(geo, "2030-01-01 00:00:00").count() == 0


def test_range_series_trends_levels(spark):
    geo = forecast_geo(_forecast(spark), _sites(spark))
    rng = sv.forecast_range(geo, H, H + dt.timedelta(hours=1)).collect()
    assert [(r.site_name, r.ts) for r in rng][:3] == [("A st", H), ("B st", H), ("B st", H + dt.timedelta(hours=1))]
    assert [r.hourly_count for r in sv.site_series(geo, 1).collect()] == [5.0, 1.0]
    hist = spark.createDataFrame([(1, H - dt.timedelta(hours=1), 7)], "site_id long, ts timestamp_ntz, hourly_count long")
    tr = sv.trends(hist, _forecast(spark), 1, H - dt.timedelta(hours=2), H + dt.timedelta(hours=2)).collect()
    assert [(r.series, r.hourly_count) for r in tr] == [("forecast", 5.0), ("forecast", 1.0), ("history", 7.0)]
    lv = {r.site_id: r.load_level for r in sv.with_load_level(geo.filter(F.col("ts") == H), 3, 6).collect()}
    assert lv == {1: "moderate", 2: "busy", 3: "busy", 4: "calm"}
    opts = sv.site_options(geo).collect()
    assert [r.site_label for r in opts][:2] == ["A st (ID 2)", "B st (ID 1)"] and opts[-1].site_label is None


def test_compare_with_reference(spark):
    ref = spark.createDataFrame([(1, H, "lbl", 4.0)], "site_id long, ts timestamp_ntz, label string, reference double")
    out = {(r.site_id, r.ts): r for r in sv.compare_with_reference(_forecast(spark), ref).collect()}
    assert out[(1, H)].delta == 1.0 and out[(2, H)].reference is None and out[(2, H)].delta is None


def test_one_row_per_site_hour(spark):
    dup = _forecast(spark).unionByName(_forecast(spark)).withColumn("site_name", F.lit("x"))
    assert sv.one_row_per_site_hour(dup).count() == 5
