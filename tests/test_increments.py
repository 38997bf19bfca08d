"""State that follows landings: equal to a full recomputation, and untouched months are neither read nor written."""

import datetime as dt
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from velora.functions.calendar import interval_flag_join
from velora.operators import moments as mo
from velora.operators.stats import site_stats
from velora.plans import increments as inc
from velora.plans import jobs
from velora.plans.features import build_features
from velora.sinks import tables as sk

T0 = dt.datetime(2024, 1, 1)
TYPE = "site_id bigint, ts timestamp_ntz, hourly_count bigint"


@pytest.fixture()
def at():
    root = tempfile.mkdtemp(prefix="velora-inc-")
    return {n: os.path.join(root, n) for n in ("raw", "moments", "changes", "features", "weather")}


def _weather(spark, hours):
    return spark.range(hours).select(
        (F.lit(T0).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).alias("time"),
        (F.col("id") % 5 - 3).cast("double").alias("rain"), F.lit(0.0).alias("snowfall"), (F.col("id") % 30).cast("double").alias("wind_speed_10m"),
        (F.col("id") % 20).cast("double").alias("apparent_temperature"), F.lit(0).alias("ingest_seq"),
    )


def _rows(seed, hours=24 * 240):
    """Sites with many, few, exactly 24 and 25 rows, long gaps, NULL counts and a constant series."""
    r = random.Random(seed)
    rows = []
    for site, n in ((1, 400), (2, 60), (3, 24), (4, 25), (5, 1), (6, 90)):
        for h in sorted(r.sample(range(hours), n)):
            v = 7 if site == 6 else None if r.random() < 0.1 and site == 2 else r.randint(0, 10**6)
            rows.append((site, T0 + dt.timedelta(hours=h), v))
    return rows


def _same(got, want, cols):
    a, b = (sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) for df in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q if not isinstance(q, float) else p == pytest.approx(q, rel=1e-9, abs=1e-6) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("seed", [1])
def test_three_landings_equal_one_full_build(spark, at, seed):
    rows = _rows(seed)
    random.Random(seed + 9).shuffle(rows)  # every landing holds late rows
    frame = spark.createDataFrame(rows, TYPE)
    weather = _weather(spark, 24 * 240)
    weather.write.parquet(at["weather"])
    third = len(rows) // 3
    for k in range(3):
        part = spark.createDataFrame(rows[k * third : (k + 1) * third if k < 2 else None], TYPE)
        again = part.unionByName(part.limit(5))  # stored and repeated keys change nothing
        inc.land_counts(spark, again, at["raw"], at["moments"], at["changes"])
        assert inc.land_counts(spark, part.limit(7), at["raw"], at["moments"], at["changes"]) == 0
        inc.update_features(spark, at["raw"], at["weather"], at["moments"], at["changes"], at["features"])
    state = spark.read.parquet(at["moments"])
    _same(mo.site_stats_from_moments(state, with_n=True), site_stats(frame, with_n=True), ["site_id", "n", "site_mean", "site_std", "site_min", "site_max"])
    full = build_features(frame, weather)
    _same(inc.feature_view(spark, at["features"], at["moments"]), full, full.columns)


def test_only_touched_months_are_read_and_written(spark, at):
    rows = [(s, T0 + dt.timedelta(hours=6 * h), h) for s in (1, 2) for h in range(4 * 200)]
    _weather(spark, 24 * 220).write.parquet(at["weather"])
    inc.land_counts(spark, spark.createDataFrame(rows, TYPE), at["raw"], at["moments"], at["changes"])
    inc.update_features(spark, at["raw"], at["weather"], at["moments"], at["changes"], at["features"])

    def files(name):
        return {os.path.join(d, f) for d, _, fs in os.walk(at[name]) for f in fs if f.endswith(".parquet")}

    before = {n: files(n) for n in ("moments", "features")}
    late = spark.createDataFrame([(1, dt.datetime(2024, 3, 5, 1), 99)], TYPE)
    assert inc.land_counts(spark, late, at["raw"], at["moments"], at["changes"]) == 1
    assert inc.update_features(spark, at["raw"], at["weather"], at["moments"], at["changes"], at["features"]) == ["2024-03", "2024-04"]
    for n, months in (("moments", ["2024-03"]), ("features", ["2024-03", "2024-04"])):
        assert {f.split("month=")[1][:7] for f in before[n] - files(n)} == set(months)
    assert inc.update_features(spark, at["raw"], at["weather"], at["moments"], at["changes"], at["features"]) == []
    # the end of a month reaches into the next one; the months before are looked at, not rebuilt
    inc.land_counts(spark, spark.createDataFrame([(2, dt.datetime(2024, 4, 30, 1), 5)], TYPE), at["raw"], at["moments"], at["changes"])
    touched = spark.createDataFrame([(2, dt.datetime(2024, 4, 1))], "site_id bigint, month_start timestamp_ntz")
    plan = inc.changed_months(spark.read.parquet(at["moments"]), touched).collect()
    assert sorted((r.site_id, r.month_start.month, r.rebuild) for r in plan) == [(2, 3, False), (2, 4, True), (2, 5, True)]
    raw = inc._of_months(spark.read.parquet(at["raw"]), ["2024-03", "2024-04"])
    assert "PartitionFilters: [month" in raw._jdf.queryExecution().executedPlan().toString()


def test_a_lost_merge_is_noticed(spark, at):
    rows = _rows(3)
    first, second = (spark.createDataFrame(x, TYPE) for x in (rows[:300], rows[300:]))
    inc.land_counts(spark, first, at["raw"], at["moments"], at["changes"])
    sk.append_new(spark, at["raw"], second)  # the merge never ran
    last = spark.createDataFrame([(s, T0 + dt.timedelta(days=d), 1, ) for s in (1,) for d in range(0, 240, 15)], TYPE)
    inc.land_counts(spark, last, at["raw"], at["moments"], at["changes"])
    cols = ["site_id", "n", "site_mean", "site_std", "site_min", "site_max"]
    _same(mo.site_stats_from_moments(spark.read.parquet(at["moments"]), with_n=True), site_stats(spark.read.parquet(at["raw"]), with_n=True), cols)


def test_late_weather_rebuilds_its_months(spark, at):
    rows = [(s, T0 + dt.timedelta(hours=3 * h), h % 50) for s in (1, 2) for h in range(8 * 100)]
    frame, weather = spark.createDataFrame(rows, TYPE), _weather(spark, 24 * 100)
    weather.filter("time < '2024-02-10'").write.parquet(at["weather"])
    inc.land_counts(spark, frame, at["raw"], at["moments"], at["changes"])
    inc.update_features(spark, at["raw"], at["weather"], at["moments"], at["changes"], at["features"])
    rest = weather.filter("time >= '2024-02-10'")
    rest.write.mode("append").parquet(at["weather"])
    inc.update_features(spark, at["raw"], at["weather"], at["moments"], at["changes"], at["features"], weather_changes=rest.select("time"))
    full = build_features(frame, weather)
    _same(inc.feature_view(spark, at["features"], at["moments"]), full, full.columns)


def test_replacement_of_months_survives_a_lost_write(spark, at, monkeypatch):
    a = spark.createDataFrame([(1, dt.datetime(2024, m, 1), m) for m in range(1, 5)], TYPE)
    sk.write_by_month(a, at["raw"])
    new = spark.createDataFrame([(1, dt.datetime(2024, m, 1), 10 * m) for m in (2, 3)], TYPE)
    overwrite = sk._overwrite_months

    def lost(spark, path, staged):
        import shutil

        shutil.rmtree(f"{path}/month=2024-02")  # the old month is gone, the new one not there yet
        raise RuntimeError("driver lost")

    monkeypatch.setattr(sk, "_overwrite_months", lost)
    with pytest.raises(RuntimeError):
        sk.upsert_months(spark, at["raw"], new, ["site_id", "ts"])
    monkeypatch.setattr(sk, "_overwrite_months", overwrite)
    assert sk.recover_months(spark, at["raw"]) and not sk.recover_months(spark, at["raw"])
    assert sorted(r.hourly_count for r in spark.read.parquet(at["raw"]).collect()) == [1, 4, 20, 30]
    left = os.listdir(os.path.dirname(at["raw"]))
    assert not [x for x in left if "redo" in x or "staging" in x]
    # a write that fails while it is staged leaves the table as it was
    broken = new.withColumn("hourly_count", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception):
        sk.upsert_months(spark, at["raw"], broken, ["site_id", "ts"])
    assert sorted(r.hourly_count for r in spark.read.parquet(at["raw"]).collect()) == [1, 4, 20, 30]


def test_empty_interval_flags_nothing(spark):
    days = [(dt.date(2025, 3, 10), dt.date(2025, 3, 10)), (dt.date(2025, 3, 20), dt.date(2025, 3, 19)), (None, dt.date(2025, 3, 2)), (dt.date(2025, 3, 25), dt.date(2025, 3, 26))]
    intervals = spark.createDataFrame(days, "start_date date, end_date date")
    hours = spark.createDataFrame([(dt.datetime(2025, 3, d, 5),) for d in range(1, 31)], "ts timestamp_ntz")
    got = interval_flag_join(hours, "ts", intervals)
    assert [r.ts.day for r in got.filter("is_holiday").collect()] == [25] and got.count() == 30


def test_unreadable_weather_times_warn(spark, at):
    raw = spark.createDataFrame([(1, T0 + dt.timedelta(hours=h), 1) for h in range(48)], TYPE)
    w = _weather(spark, 48)
    bad = w.limit(3).withColumn("time", F.lit(None).cast("timestamp_ntz"))
    with pytest.warns(UserWarning, match="3 weather rows"):
        assert jobs.weather_gap_load(spark, raw, w.unionByName(bad), at["weather"]) == 48
