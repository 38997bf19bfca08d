"""Row lags (W1-W4): the chunked plan equals a single window and a pandas brute force."""

import datetime as dt
import random

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from velora.operators.lags import drop_warmup, row_lags


def row_lags_single_window(df, key, order, value, lags=(1, 24), rolling=24):
    """The same result with one window per key: the brute-force form."""
    w = Window.partitionBy(key).orderBy(*order)
    cols = {f"lag_{k}": F.lag(F.col(value), k).over(w).cast("double") for k in lags}
    wr = w.rowsBetween(-rolling, -1)
    cols[f"rolling_mean_{rolling}"] = F.when(F.count(F.col(value)).over(wr) == F.lit(rolling), F.avg(F.col(value)).over(wr))
    return df.withColumns(cols)


def _series(spark, seed=7):
    rnd = random.Random(seed)
    rows = []
    base = dt.datetime(2025, 1, 1)
    for site, n in ((1, 24), (2, 25), (3, 400), (4, 1), (5, 130)):
        h = 0
        for _ in range(n):
            h += rnd.choice([1, 1, 1, 2, 5, 30])  # sparse: gaps of hours and days
            rows.append((site, base + dt.timedelta(hours=h), rnd.randint(0, 50)))
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count long")


def _brute(pdf):
    out = []
    for _, g in pdf.sort_values(["site_id", "ts"]).groupby("site_id"):
        g = g.copy()
        g["lag_1"] = g["hourly_count"].shift(1)
        g["lag_24"] = g["hourly_count"].shift(24)
        g["rolling_mean_24"] = g["hourly_count"].shift(1).rolling(24).mean()
        out.append(g)
    return pd.concat(out)


def _cmp(a, b):
    a = a.sort_values(["site_id", "ts"]).reset_index(drop=True)
    b = b.sort_values(["site_id", "ts"]).reset_index(drop=True)
    assert len(a) == len(b)
    for c in ("lag_1", "lag_24", "rolling_mean_24"):
        pd.testing.assert_series_equal(a[c].astype(float), b[c].astype(float), check_names=False, rtol=1e-9)


def test_chunked_equals_brute_force_with_small_chunks(spark):
    df = _series(spark)
    brute = _brute(df.toPandas())
    for chunk in (24, 37, 100, 65_536):
        got = row_lags(df, "site_id", ["ts", "hourly_count"], "hourly_count", chunk_rows=chunk, bucket_days=3).toPandas()
        _cmp(got, brute)


def test_single_window_reference(spark):
    df = _series(spark, 3)
    a = row_lags(df, "site_id", ["ts", "hourly_count"], "hourly_count", chunk_rows=50).toPandas()
    b = row_lags_single_window(df, "site_id", ["ts", "hourly_count"], "hourly_count").toPandas()
    _cmp(a, b)


def test_warmup_drop_keeps_rows_after_24(spark):
    df = _series(spark)
    kept = drop_warmup(row_lags(df, "site_id", ["ts", "hourly_count"], "hourly_count", chunk_rows=40))
    per_site = {r.site_id: r.n for r in kept.groupBy("site_id").agg(F.count("*").alias("n")).collect()}
    assert per_site.get(1, 0) == 0      # 24 rows -> nothing left
    assert per_site[2] == 1             # 25 rows -> one
    assert per_site[3] == 400 - 24
    assert 4 not in per_site            # one-row site vanishes


def test_chunk_too_small_rejected(spark):
    import pytest

    with pytest.raises(ValueError):
        row_lags(_series(spark), "site_id", ["ts"], "hourly_count", chunk_rows=10)
