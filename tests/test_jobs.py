"""End-to-end jobs on stored tables built from the sf0.001 driver tables."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from velora.plans import jobs
from velora.sources import tables as tb


def test_feature_and_forecast_jobs(spark):
    root = tempfile.mkdtemp(prefix="velora-jobs-")
    counts = tb.counts(spark, SF001)
    raw_p, w_p, wfc_p = (os.path.join(root, n) for n in ("raw", "weather", "wfc"))
    counts.write.parquet(raw_p)
    tb.weather(counts).write.parquet(w_p)
    jobs.weather_forecast_job(spark, raw_p, tb.weather_forecast(counts), wfc_p)
    stats_p, feat_p, fc_p = (os.path.join(root, n) for n in ("stats", "features", "forecast"))
    jobs.site_features_job(spark, raw_p, stats_p)
    jobs.feature_table_job(spark, raw_p, w_p, feat_p, stats_p)
    feats = spark.read.parquet(feat_p)
    assert "month" in feats.columns and feats.count() > 0
    v1 = jobs.forecast_job(spark, raw_p, feat_p, wfc_p, fc_p, dt.datetime(2025, 1, 1), stats_path=stats_p)
    fc = spark.read.parquet(v1)
    n_sites = feats.select("site_id").distinct().count()
    assert fc.count() == 48 * n_sites
    assert fc.filter(F.col("hourly_count") < 0).count() == 0
    assert set(fc.columns) >= {"site_id", "ts", "hourly_count", "generated_at", "model_uri"}


def test_forecast_job_refuses_misaligned_tables(spark):
    root = tempfile.mkdtemp(prefix="velora-jobs-")
    counts = tb.counts(spark, SF001)
    raw_p, w_p, feat_p, wfc_p = (os.path.join(root, n) for n in ("raw", "weather", "features", "wfc"))
    counts.write.parquet(raw_p)
    tb.weather(counts).write.parquet(w_p)
    jobs.weather_forecast_job(spark, raw_p, tb.weather_forecast(counts), wfc_p)
    jobs.feature_table_job(spark, raw_p, w_p, feat_p)
    later = counts.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    raw2 = os.path.join(root, "raw2")
    later.write.parquet(raw2)
    with pytest.raises(RuntimeError, match="not aligned"):
        jobs.forecast_job(spark, raw2, feat_p, wfc_p, os.path.join(root, "fc"), dt.datetime(2025, 1, 1))


def test_second_forecast_run_builds_on_the_first(spark):
    from velora.sinks import tables as sk

    root = tempfile.mkdtemp(prefix="velora-jobs-")
    counts = tb.counts(spark, SF001)
    raw_p, w_p, wfc_p, feat_p, runs, ptr = (os.path.join(root, n) for n in ("raw", "weather", "wfc", "features", "runs", "ptr"))
    counts.write.parquet(raw_p)
    tb.weather(counts).write.parquet(w_p)
    jobs.weather_forecast_job(spark, raw_p, tb.weather_forecast(counts), wfc_p)
    jobs.feature_table_job(spark, raw_p, w_p, feat_p)
    out = os.path.join(root, "forecast")
    jobs.forecast_job(spark, raw_p, feat_p, wfc_p, out, dt.datetime(2025, 1, 1), horizon=6)
    n = spark.read.parquet(sk.current_version(spark, out)).count()
    jobs.training_job(spark, feat_p, os.path.join(root, "m"), runs, ptr, "p", "r1", dt.datetime(2025, 1, 1), "gbt", rounds=4, max_depth=3)
    chosen = jobs.choose_model(spark, runs, ptr, "p")
    v2 = jobs.forecast_job(spark, raw_p, feat_p, wfc_p, out, dt.datetime(2025, 1, 2), horizon=3, model_path=chosen)
    assert sk.current_version(spark, out) == v2
    t = spark.read.parquet(v2)
    assert t.count() == n and t.filter(F.col("model_uri") == chosen).count() == n // 2
    assert t.filter(F.col("hourly_count").isNull() | (F.col("hourly_count") < 0)).count() == 0


def test_update_job(spark):
    from velora.sinks import tables as sk
    from velora.plans.sites import site_dimension

    root = tempfile.mkdtemp(prefix="velora-update-")
    at = {n: os.path.join(root, n) for n in ("pages1", "pages2", "raw", "weather", "wfc", "sites")}
    rec = "struct(id, name, sum_counts, date, struct(lat, lon) as coordinates)"

    def land(rows, folder):
        df = spark.createDataFrame(rows, "id string, name string, sum_counts string, date string, lat double, lon double")
        df.select(F.expr(rec).alias("r")).agg(F.count("*").alias("total_count"), F.collect_list("r").alias("results")).write.json(folder)

    land([("1", "A", "5", "2025-01-01T08:00:00", 48.1, 2.1), ("2", "B", "6", "2025-01-02T09:00:00", 48.2, 2.2)], at["pages1"])
    land([("1", "A2", "7", "2025-01-03T08:00:00", 48.3, 2.3)], at["pages2"])
    w = spark.range(24 * 20).select(
        (F.lit("2025-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("time"),
        F.lit(0.0).alias("rain"), F.lit(0.0).alias("snowfall"), F.lit(1.0).alias("wind_speed_10m"), F.lit(3.0).alias("apparent_temperature"), F.lit(0).alias("ingest_seq"),
    )
    args = (w, w, at["raw"], at["weather"], at["wfc"], at["sites"])
    assert jobs.update_job(spark, at["pages1"], *args) == {"counts": 2, "weather": 48}
    assert jobs.update_job(spark, at["pages2"], *args) == {"counts": 1, "weather": 24}
    assert jobs.update_job(spark, at["pages2"], *args) == {"counts": 0, "weather": 0}
    # a site that has left raw stays in the dimension
    jobs.site_dimension_job(spark, spark.read.parquet(at["raw"]).filter("site_id = 2"), at["sites"])
    sites = {r.site_id: r.site_name for r in spark.read.parquet(sk.current_version(spark, at["sites"])).collect()}
    assert sites == {1: "A2", 2: "B"} and site_dimension(spark.read.parquet(at["raw"])).count() == 2
    with pytest.raises(ValueError, match="readable"):
        jobs.weather_gap_load(spark, spark.read.parquet(at["raw"]), w.withColumn("time", F.lit(None).cast("timestamp_ntz")), at["weather"])
