import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor

from velora.operators import boosting as bo

COLS = ["a", "b", "flag", "few", "constant"]


def _rows(spark, n=600):
    rnd = random.Random(7)
    rows = []
    for _ in range(n):
        a, b, flag, few = rnd.random(), rnd.gauss(0, 1), float(rnd.random() < 0.3), float(rnd.randrange(5))
        rows.append((a, b, flag, few, 1.0, float(round(3 * a + b * few + flag + rnd.random(), 3))))
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*COLS, "y"])).checkpoint()


def _estimator(rounds, depth):
    return GBTRegressor(labelCol="y", featuresCol="features", maxIter=rounds, stepSize=0.1, maxDepth=depth, seed=42)


@pytest.mark.parametrize("task_rows, block_rows, checkpoint", [(20_000, 1 << 19, 25), (100, 40, 3)])
def test_trees_are_those_of_mllib(spark, monkeypatch, task_rows, block_rows, checkpoint):
    """One block in one task, and many blocks in several tasks with stored states between."""
    monkeypatch.setattr(bo, "TASK_ROWS", task_rows)
    monkeypatch.setattr(bo, "CHECKPOINT_ROUNDS", checkpoint)
    monkeypatch.setattr(bo, "BLOCK_ROWS", block_rows)
    df, est = _rows(spark), _estimator(8, 4)
    x = VectorAssembler(inputCols=COLS, outputCol="features").transform(df)
    want, got = est.fit(x), bo.fit_boosted(df, COLS, est)
    assert got.getNumTrees == 8 and list(got.treeWeights) == list(want.treeWeights) and got.getMaxIter() == 8
    assert got.totalNumNodes == want.totalNumNodes
    p, q = (m.transform(x).orderBy("a", "b").toPandas()["prediction"].to_numpy() for m in (want, got))
    assert np.allclose(p, q, rtol=1e-9)
    assert np.allclose(want.featureImportances.toArray(), got.featureImportances.toArray(), rtol=1e-6)


def test_a_job_per_level_counts_the_smaller_children_only(spark, monkeypatch):
    """Rows counted per tree: all at the root, at most half of them on every level below."""
    df = _rows(spark)
    layout = bo.Layout([bo.split_points(df.toPandas()[c].to_numpy()) for c in COLS])
    packed = df.select("y", *COLS).coalesce(1).mapInArrow(layout.pack, "codes binary, label binary")
    state = packed.rdd.mapPartitions(layout.blocks).cache()
    seen = []
    level = bo._level
    monkeypatch.setattr(bo, "_level", lambda lay, splits, wanted, *a: seen.append((splits, wanted)) or level(lay, splits, wanted, *a))
    nodes, splits = bo._tree(state, layout, 3, True)
    blocks = state.collect()
    counted = [sum(len(codes[0]) if (r := layout.places(codes, s)[w]) is None else len(r) for codes, _, _ in blocks for w in ws) for s, ws in seen]
    assert len(counted) == 4 and counted[0] == 600 and max(counted[1:]) <= 300
    leaves = [m for m in nodes if not m["kids"]]
    assert sum(m["sums"][-3] for m in leaves) == 600 and len(splits) == len(nodes) - len(leaves)


def test_bins_and_bundles():
    assert bo.split_points(np.array([2.0, 1.0, 1.0, 4.0])).tolist() == [1.5, 3.0]
    assert bo.split_points(np.array([5.0, 5.0])).tolist() == []
    assert len(bo.split_points(np.arange(10_000.0))) == 31
    sizes = [32, 2, 32, 1, 5, 32]
    found = bo.bundles(sizes)
    assert sorted(f for b in found for f in b) == [0, 1, 2, 4, 5]  # the constant is in none
    assert all(np.prod([sizes[f] for f in b]) <= bo.CELLS for b in found)


def test_one_value_and_no_rows(spark):
    est = _estimator(3, 2)
    flat = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, y double")
    m = bo.fit_boosted(flat, ["a"], est)
    assert m.getNumTrees == 3 and m.totalNumNodes == 3 and m.predict(Vectors.dense([9.0])) == pytest.approx(2.0)
    with pytest.raises(ValueError, match="no rows"):
        bo.fit_boosted(flat.limit(0), ["a"], est)


def test_many_rows_are_fitted_from_packed_blocks(spark, monkeypatch):
    """The forecaster above ``MLLIB_ROWS`` rows: the same model, without MLlib's fit of all rows."""
    import datetime as dt

    from velora.plans import forecaster as fr

    rnd = random.Random(3)
    rows = [(s, dt.datetime(2025, 1, 1) + dt.timedelta(hours=h), rnd.random(), s * 3 + h % 7 + rnd.random()) for s in (1, 2, 3) for h in range(100)]
    feats = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, lag_1 double, hourly_count double")
    want = fr.fit_forecaster(feats, "gbt", rounds=5, max_depth=3)[1].first()
    called = []
    monkeypatch.setattr(fr, "MLLIB_ROWS", 10)
    monkeypatch.setattr(fr, "fit_boosted", lambda *a: called.append(1) or bo.fit_boosted(*a))
    got = fr.fit_forecaster(feats, "gbt", rounds=5, max_depth=3)[1].first()
    assert called and got.n_rows == want.n_rows == 30
    assert np.allclose([got.mae, got.rmse, got.r2], [want.mae, want.rmse, want.r2], rtol=1e-9)
