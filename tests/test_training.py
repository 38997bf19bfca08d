"""Chronological split, target encoding, scaling, model fit/save/load and run selection."""

import datetime as dt
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from velora.plans import training as trn


def _frame(spark, n_hours=20, sites=(1, 2, 3)):
    base = dt.datetime(2025, 1, 1)
    rows = [(s, base + dt.timedelta(hours=h), float(s * 10 + h % 5)) for h in range(n_hours) for s in sites]
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count double")


@pytest.mark.parametrize("ratio,expected", [(0.1, 6), (0.25, 15), (0.0, 0), (0.01, 0)])
def test_chrono_split_sizes_and_order(spark, ratio, expected):
    df = _frame(spark)
    out = trn.chrono_split(df, ratio)
    assert out.count() == 60
    test = out.filter("is_test").orderBy("ts", "site_id").collect()
    assert len(test) == expected
    if expected:
        allrows = sorted((r.ts, r.site_id) for r in out.collect())
        assert [(r.ts, r.site_id) for r in test] == allrows[-expected:]


def test_target_encoding_formula(spark):
    rows = [(1, float(v)) for v in range(30)] + [(2, 100.0)]
    train = spark.createDataFrame(rows, "site_id long, hourly_count double")
    enc = {r.site_id: r for r in trn.fit_target_encoding(train).collect()}
    prior = sum(v for _, v in rows) / len(rows)
    lam = 1 / (1 + math.exp(-(30 - 20) / 10))
    assert math.isclose(enc[1].te_value, prior * (1 - lam) + 14.5 * lam)
    assert math.isclose(enc[2].te_value, prior)  # seen once -> prior
    other = spark.createDataFrame([(3,), (None,)], "site_id long")
    applied = trn.apply_target_encoding(other, trn.fit_target_encoding(train)).collect()
    assert all(math.isclose(r.site_id_te, prior) for r in applied)  # unseen / NULL -> prior


def test_scaler_population_and_constant(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    sc = trn.fit_scaler(df, ["a", "b"])
    got = {r.column: (r.mean, r.std) for r in sc.collect()}
    assert got == {"a": (2.0, 1.0), "b": (3.0, 0.0)}
    out = trn.apply_scaler(df, sc, ["a", "b"]).orderBy("a").collect()
    assert [r.a for r in out] == [-1.0, 1.0] and [r.b for r in out] == [0.0, 0.0]


def _train_frame(spark):
    import random

    rnd = random.Random(42)
    base = dt.datetime(2025, 1, 1)
    rows = []
    for i in range(200):
        t = base + dt.timedelta(hours=i // 2)
        x = rnd.random()
        rows.append((1 + i % 2, t, x > 0.5, rnd.random(), 3 * x + rnd.random() * 0.1))
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, is_night boolean, lag_1 double, hourly_count double")


def test_train_save_and_load_linear_and_gbt(spark):
    from velora.plans.forecaster import fit_forecaster, load_forecaster, save_forecaster

    f = _train_frame(spark)
    linear, metrics = fit_forecaster(f, "linear")
    m = metrics.first()
    assert m.n_rows == 20 and all(math.isfinite(v) for v in (m.mae, m.rmse))
    assert linear.cols[0] == "site_te" and "is_night" in linear.cols and "ts" not in linear.cols
    assert [r.importance >= 0 for r in linear.importances(top_n=2).collect()] == [True, True]
    gbt, gm = fit_forecaster(f, "gbt", rounds=5, max_depth=3)
    imp = gbt.importances(top_n=2).collect()
    assert len(imp) == 2 and imp[0].importance >= imp[1].importance
    for one in (linear, gbt):
        path = os.path.join(tempfile.mkdtemp(prefix="velora-model-"), "m")
        save_forecaster(one, path)
        again = load_forecaster(spark, path)
        a = {(r.site_id, r.ts, r.lag_1): r.prediction for r in one.score(f).collect()}
        b = {(r.site_id, r.ts, r.lag_1): r.prediction for r in again.score(f).collect()}
        assert a == b and len(a) == 200
        # unseen and NULL sites get the prior, columns of the table stay
        odd = again.score(f.limit(2).withColumn("site_id", F.lit(None).cast("long")))
        assert odd.columns == [*f.columns, "prediction"] and odd.filter("prediction is null").count() == 0
    with pytest.raises(RuntimeError, match="lacks"):
        linear.score(f.drop("lag_1"))


def test_run_selection(spark):
    runs = spark.createDataFrame(
        [("p", "a", dt.datetime(2025, 1, 1), 3.0), ("p", "b", dt.datetime(2025, 1, 2), 5.0), ("q", "c", dt.datetime(2025, 1, 3), 1.0)],
        "name string, run_id string, started_at timestamp_ntz, rmse double",
    )
    assert {r.name: r.run_id for r in trn.latest_run(runs).collect()} == {"p": "b", "q": "c"}
    assert {r.name: r.run_id for r in trn.best_run(runs).collect()} == {"p": "a", "q": "c"}
    assert trn.current_pointer(runs, "zzz").count() == 0


def test_training_job_logs_points_and_is_chosen(spark):
    from velora.plans import jobs

    root = tempfile.mkdtemp(prefix="velora-train-")
    at = {n: os.path.join(root, n) for n in ("features", "a", "b", "runs", "pointer")}
    f = _train_frame(spark)
    f.write.parquet(at["features"])
    jobs.training_job(spark, at["features"], at["a"], at["runs"], at["pointer"], "p", "run-a", dt.datetime(2025, 1, 1), "linear")
    jobs.training_job(spark, at["features"], at["b"], at["runs"], at["pointer"], "p", "run-b", dt.datetime(2025, 1, 2), "linear", cols=["lag_1"])
    runs = spark.read.parquet(at["runs"])
    assert runs.count() == 2
    best = min(runs.collect(), key=lambda r: r.rmse).model_uri
    assert jobs.choose_model(spark, at["runs"], at["pointer"], "p") == at["b"]
    assert jobs.choose_model(spark, at["runs"], at["pointer"], "p", by="latest") == at["b"]
    assert jobs.choose_model(spark, at["runs"], at["pointer"], "p", by="best") == best
    for by in ("pointer", "best"):
        with pytest.raises(KeyError):
            jobs.choose_model(spark, at["runs"], at["pointer"], "missing", by=by)
    test = trn.chrono_split(f).filter("is_test").drop("is_test")
    again = jobs.evaluate_model(spark, at["a"], test).first()
    logged = runs.filter("run_id = 'run-a'").first()
    assert math.isclose(again.rmse, logged.rmse, rel_tol=1e-9) and again.n_rows == 20
