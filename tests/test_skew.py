"""A site holding most of the rows is still spread over several tasks by the lag operator."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from velora.operators.lags import row_lags


def test_hot_site_is_split_across_tasks_and_exact(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [(1, base + dt.timedelta(hours=i), i % 17) for i in range(3000)]  # the hot site
    rows += [(2, base + dt.timedelta(hours=i), i % 5) for i in range(30)]
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count long")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = row_lags(df, "site_id", ["ts"], "hourly_count", chunk_rows=200).withColumn("pid", F.spark_partition_id())
        pdf = out.toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    hot = pdf[pdf.site_id == 1]
    assert hot.pid.nunique() > 1  # the hot site's rows were processed by several tasks
    g = hot.sort_values("ts")
    y = g.hourly_count.astype(float)
    pd.testing.assert_series_equal(g.lag_1.reset_index(drop=True), y.shift(1).reset_index(drop=True), check_names=False)
    pd.testing.assert_series_equal(g.lag_24.reset_index(drop=True), y.shift(24).reset_index(drop=True), check_names=False)
    exp_roll = y.shift(1).rolling(24).mean().reset_index(drop=True)
    pd.testing.assert_series_equal(g.rolling_mean_24.reset_index(drop=True).astype(float), exp_roll, check_names=False, rtol=1e-12)
