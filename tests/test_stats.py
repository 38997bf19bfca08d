"""Aggregations and statistics."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from velora.operators import analytics as an
from velora.operators import stats as st
from velora.operators.quality import varying_columns


def test_site_stats_values(spark):
    df = spark.createDataFrame([(1, 10.0), (1, 20.0), (1, 30.0), (2, 5.0), (2, None)], "site_id long, hourly_count double")
    got = {r.site_id: r for r in st.site_stats(df, with_n=True).collect()}
    assert got[1].site_mean == 20.0 and got[1].site_max == 30.0 and got[1].site_min == 10.0 and got[1].n == 3
    assert got[2].site_std is None and got[2].site_min == 5.0 and got[2].n == 1  # one value -> NULL deviation
    assert len(got) == 2


def test_months_and_shape(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 11, 3),), (dt.datetime(2025, 2, 1),)], "ts timestamp_ntz")
    assert st.months_spanned(df).first()[0] == 4
    assert st.table_shape(df, "t").first().asDict() == {"table_name": "t", "n_rows": 2, "n_cols": 1}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 5.0)], "y double, prediction double")
    r = st.regression_metrics(df).first()
    assert math.isclose(r.mae, 1.0)
    assert math.isclose(r.rmse, math.sqrt(5 / 3))
    assert math.isclose(r.r2, 1 - 5 / 2)
    assert r.n_rows == 3


def test_mean_impute(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "t double")
    assert sorted(r.t for r in st.mean_impute(df, "t").collect()) == [1.0, 2.0, 3.0]


def test_constant_columns_dropped(spark):
    df = spark.createDataFrame([(1.0, 0.0, 5.0), (2.0, 0.0, 7.0)], "a double, b double, c double")
    assert varying_columns(df, ["a", "b", "c"]) == ["a", "c"]
    with pytest.raises(ValueError):
        varying_columns(df.select("b"), ["b"])


def _features(spark):
    rows = []
    base = dt.datetime(2025, 1, 6)
    for i in range(200):
        t = base + dt.timedelta(hours=i)
        night = t.hour >= 17 or t.hour < 8
        rush = 7 <= t.hour < 10 or 17 <= t.hour < 20
        y = 5 + (0 if night else 20) + (10 if rush else 0) + (i % 7)
        rows.append((1, t, y, night, i % 50 == 0, rush, i % 5 == 0, False, i % 3 == 0, float(i % 30) - 5.0))
    return spark.createDataFrame(
        rows,
        "site_id long, ts timestamp_ntz, hourly_count long, is_night boolean, is_holiday boolean, is_rush_hour boolean, "
        "is_rainy boolean, is_snowy boolean, is_windy boolean, apparent_temperature double",
    )


def test_correlation_matrix_drops_constant_and_is_symmetric(spark):
    m = {(r.col_a, r.col_b): r.r for r in an.correlation_matrix(_features(spark)).collect()}
    assert ("is_snowy", "hourly_count") not in m  # constant column dropped
    assert m[("hourly_count", "hourly_count")] == 1.0
    assert math.isclose(m[("hourly_count", "is_night")], m[("is_night", "hourly_count")])
    assert m[("hourly_count", "is_night")] < 0


def test_pearson_and_pvalues(spark):
    import numpy as np

    f = _features(spark)
    rows = {r.variable: r for r in an.pearson_with_p(f).collect()}
    pdf = f.toPandas()
    r = np.corrcoef(pdf.hourly_count, pdf.apparent_temperature)[0, 1]
    assert math.isclose(rows["apparent_temperature"].r, r, rel_tol=1e-9)
    t = r * math.sqrt(198 / (1 - r * r))
    assert math.isclose(rows["apparent_temperature"].t, t, rel_tol=1e-9)
    assert 0.0 <= rows["apparent_temperature"].p_value <= 1.0
    assert "is_snowy" in rows and rows["is_snowy"].r is None or math.isnan(rows["is_snowy"].r or float("nan"))


def test_two_sample_t(spark):
    import numpy as np

    f = _features(spark)
    got = {r.flag: r for r in an.two_sample_with_p(f).collect()}
    pdf = f.toPandas()
    a = pdf[~pdf.is_night].hourly_count.to_numpy(float)
    b = pdf[pdf.is_night].hourly_count.to_numpy(float)
    sp2 = ((len(a) - 1) * a.var(ddof=1) + (len(b) - 1) * b.var(ddof=1)) / (len(a) + len(b) - 2)
    t = (a.mean() - b.mean()) / math.sqrt(sp2 * (1 / len(a) + 1 / len(b)))
    assert math.isclose(got["is_night"].t, t, rel_tol=1e-9)
    assert got["is_night"].p_value < 1e-6
    one_group = spark.createDataFrame([(1, True), (2, True)], "hourly_count long, is_night boolean")
    assert an.two_sample_tests(one_group, flags=["is_night"]).count() == 0


def test_chi_square_yates(spark):
    # table [[10, 20], [30, 40]]: Yates chi2 = 0.44642857..., p = 0.50403...
    rows = [(False, False)] * 10 + [(False, True)] * 20 + [(True, False)] * 30 + [(True, True)] * 40
    df = spark.createDataFrame(rows, "is_night boolean, is_holiday boolean")
    r = an.chi_square_with_p(df, pairs=[("is_night", "is_holiday")]).first()
    n, e = 100.0, {(0, 0): 30 * 40 / 100, (0, 1): 30 * 60 / 100, (1, 0): 70 * 40 / 100, (1, 1): 70 * 60 / 100}
    o = {(0, 0): 10, (0, 1): 20, (1, 0): 30, (1, 1): 40}
    exp = sum(max(abs(o[k] - e[k]) - 0.5, 0) ** 2 / e[k] for k in o)
    assert math.isclose(r.chi2, exp, rel_tol=1e-12)
    assert math.isclose(r.p_value, math.erfc(math.sqrt(exp / 2)), rel_tol=1e-12)
    single = spark.createDataFrame([(True, False), (True, True)], "is_night boolean, is_holiday boolean")
    assert an.chi_square_tests(single, pairs=[("is_night", "is_holiday")]).count() == 0


def test_t_distribution_tail_values():
    from velora.functions.distributions import chi2_1df_sf, t_two_sided_p

    assert abs(t_two_sided_p(2.228, 10) - 0.05) < 2e-4
    assert abs(t_two_sided_p(12.706, 1) - 0.05) < 2e-4
    assert abs(t_two_sided_p(1.96, 1e7) - 0.05) < 1e-4
    assert abs(chi2_1df_sf(3.8415) - 0.05) < 1e-4


def test_breakdowns(spark):
    f = _features(spark)
    hours = an.mean_by_hour(f).collect()
    assert len(hours) == 24
    dims = {(r.dimension, r.value) for r in an.mean_by_weather(f).collect()}
    assert ("is_rainy", "true") in dims and ("is_snowy", "false") in dims and ("is_snowy", "true") not in dims
    cal = {r.dimension for r in an.mean_by_calendar(f).collect()}
    assert cal == {"season", "month", "is_holiday", "is_rush_hour"}
    assert an.temperature_bins(f).agg(F.sum("n")).first()[0] == 200


def test_stats_merged_from_buckets_equal_direct(spark):
    import random

    from velora.operators.lags import bucket_of

    rnd = random.Random(5)
    base = dt.datetime(2025, 1, 1)
    rows = [(s, base + dt.timedelta(hours=rnd.randint(0, 24 * 200)), rnd.choice([None, 0, 3, 8, 40])) for s in (1, 2) for _ in range(500)]
    rows += [(3, base, 7)]  # a one-row site
    df = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count long")
    direct = {r.site_id: r for r in st.site_stats(df, with_n=True).collect()}
    merged = {r.site_id: r for r in st.site_stats_from_buckets(st.bucket_moments(df, bucket_of("ts")), with_n=True).collect()}
    assert set(direct) == set(merged)
    for k, d in direct.items():
        m = merged[k]
        assert d.n == m.n and d.site_min == m.site_min and d.site_max == m.site_max
        assert math.isclose(d.site_mean, m.site_mean, rel_tol=1e-12)
        assert (d.site_std is None and m.site_std is None) or math.isclose(d.site_std, m.site_std, rel_tol=1e-9)


def test_with_one_row_refuses_other_counts(spark):
    from velora.operators.one_row import with_one_row

    df = spark.range(3)
    assert with_one_row(df, df.agg(F.max("id").alias("m"))).count() == 3
    for other in (spark.range(2).toDF("m"), spark.range(0).toDF("m")):
        with pytest.raises(Exception, match="exactly one row"):
            with_one_row(df, other).collect()
