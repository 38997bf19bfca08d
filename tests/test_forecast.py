"""History (W8), recursive forecast (M8 a/b) and future features."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from velora.operators.history import last_values
from velora.operators.recursive import FIXED_SCORER, LinearScorer, linear_fold
from velora.operators.trees import NODE_COLUMNS, ensemble, tree_forecast


def _hist_input(spark):
    base = dt.datetime(2025, 1, 1)
    rows = [(1, base + dt.timedelta(hours=i), float(i)) for i in range(30)]
    rows += [(2, base + dt.timedelta(hours=i * 5), v) for i, v in enumerate([10.0, 11.0, 13.0])]  # short site
    rows += [(3, base + dt.timedelta(hours=i), 2.5) for i in range(2)]  # mean 2.5 -> half-even 2
    return spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count double")


def test_history_last_24_newest_last_and_padding(spark):
    got = {r.site_id: r.history for r in last_values(_hist_input(spark)).collect()}
    assert got[1] == [float(i) for i in range(6, 30)]
    assert got[2] == [11.0] * 21 + [10.0, 11.0, 13.0]  # mean 11.33 -> 11
    assert got[3] == [2.0] * 22 + [2.5, 2.5]
    assert all(len(v) == 24 for v in got.values())


def _brute_fold(history, hours, scorer):
    hist = list(history)
    out = []
    for h in hours:
        lag1, lag24, mean = hist[-1], hist[0], float(np.mean(hist))
        x = scorer.intercept
        for f, c in scorer.coefs.items():
            x += c * {"lag_1": lag1, "lag_24": lag24, "rolling_mean_24": mean}.get(f, h.get(f, 0.0))
        p = max(x, 0.0)
        out.append(p)
        hist = (hist + [p])[-24:]
    return out


def test_linear_fold_matches_loop_and_isolates_sites(spark):
    base = dt.datetime(2025, 2, 1)
    hours = [{"ts": base + dt.timedelta(hours=i), "is_rush_hour": float(i % 3 == 0), "hour_cos": math.cos(i)} for i in range(1, 49)]
    histories = {1: [float(i) for i in range(24)], 2: [100.0] * 24, 3: None}
    rows = [(k, v) for k, v in histories.items()]
    sites = spark.createDataFrame(rows, "site_id long, history array<double>")
    harr = F.array(*[F.struct(F.lit(h["ts"]).alias("ts"), F.lit(h["is_rush_hour"]).alias("is_rush_hour"), F.lit(h["hour_cos"]).alias("hour_cos")) for h in hours])
    scorer = LinearScorer(-3.0, {"lag_1": 0.6, "lag_24": 0.2, "rolling_mean_24": 0.1, "is_rush_hour": 2.0, "hour_cos": -1.0})
    got = linear_fold(sites.withColumn("hours", harr), "hours", scorer, ["is_rush_hour", "hour_cos"]).collect()
    for r in got:
        exp = _brute_fold(histories[r.site_id] or [0.0] * 24, hours, scorer)
        assert [x.pred for x in r.forecast] == exp or np.allclose([x.pred for x in r.forecast], exp, rtol=1e-12)
        assert all(x.pred >= 0 for x in r.forecast)  # clipped
        assert [x.ts for x in r.forecast] == [h["ts"] for h in hours]


def _walk(nodes, x):
    total = 0.0
    for tree in {n[0] for n in nodes}:
        by = {n[1]: n for n in nodes if n[0] == tree}
        at = by[0]
        while at[2] >= 0:
            at = by[at[4] if x[at[2]] <= at[3] else at[5]]
        total += at[6] * at[7]
    return total


def test_tree_forecast_equals_a_loop(spark):
    names = ["lag_1", "hour_cos", "site_mean", "rolling_mean_24", "lag_24"]
    nodes = [
        (0, 0, 0, 8.0, 1, 2, 0.0, 1.0), (0, 1, -1, None, -1, -1, 4.0, 1.0), (0, 2, 3, 10.0, 3, 4, 0.0, 1.0),
        (0, 3, -1, None, -1, -1, 9.0, 1.0), (0, 4, -1, None, -1, -1, 20.0, 1.0),
        (1, 0, 1, 0.0, 1, 2, 0.0, 0.5), (1, 1, -1, None, -1, -1, -6.0, 0.5), (1, 2, 2, 4.0, 3, 4, 0.0, 0.5),
        (1, 3, -1, None, -1, -1, 1.0, 0.5), (1, 4, 4, 3.0, 5, 6, 0.0, 0.5), (1, 5, -1, None, -1, -1, 2.0, 0.5), (1, 6, -1, None, -1, -1, 7.0, 0.5),
    ]
    model = ensemble(spark.createDataFrame(nodes, NODE_COLUMNS), names)
    base = dt.datetime(2025, 2, 1)
    hours = spark.createDataFrame([(base + dt.timedelta(hours=i), math.cos(i)) for i in range(1, 31)], "ts timestamp_ntz, hour_cos double")
    rows = [(1, [float(i) for i in range(24)], 5.0), (2, [3.0] * 24, 3.0), (3, None, None)]
    sites = spark.createDataFrame(rows, "site_id long, history array<double>, site_mean double")
    for scale in (None, {"lag_1": (2.0, 4.0), "site_mean": (1.0, 0.0)}):
        got = {(r.site_id, r.ts): r.pred for r in tree_forecast(sites, hours, model, scale).collect()}
        assert len(got) == 90
        z = lambda name, v: 0.0 if v is None else (v - (scale or {}).get(name, (0, 1))[0]) / ((scale or {}).get(name, (0, 1))[1] or 1)  # noqa: E731, B023
        for sid, hist, mean in rows:
            fifo = list(hist or [0.0] * 24)
            for i in range(1, 31):
                raw = {"lag_1": fifo[-1], "hour_cos": math.cos(i), "site_mean": mean, "rolling_mean_24": float(np.mean(fifo)), "lag_24": fifo[0]}
                p = max(_walk(nodes, [z(n, raw[n]) for n in names]), 0.0)
                assert abs(got[sid, base + dt.timedelta(hours=i)] - p) < 1e-9
                fifo = fifo[1:] + [p]


def test_ensemble_of_a_saved_model_predicts_like_it(spark):
    import os
    import random
    import tempfile

    from velora.plans.forecaster import fit_forecaster, load_forecaster, save_forecaster

    rnd = random.Random(1)
    rows = [(s, dt.datetime(2025, 1, 1) + dt.timedelta(hours=h), rnd.random(), float(s * 3 + h % 7 + rnd.random())) for s in (1, 2, 3) for h in range(100)]
    feats = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, lag_1 double, hourly_count double")
    f, _ = fit_forecaster(feats, "gbt", rounds=6, max_depth=4)
    f = save_forecaster(f, os.path.join(tempfile.mkdtemp(prefix="velora-trees-"), "f"))
    trees = load_forecaster(spark, f.path).trees()
    got = f.model.transform(f.prepared(feats)).toPandas()
    mine = trees.predict(got[[f"__x_{c}" for c in f.cols]].to_numpy())
    assert np.allclose(mine, got["prediction"], rtol=1e-9)


def test_future_features_horizon_and_weather_defaults(spark):
    from velora.plans.forecast import HOUR_FEATURES, future_features

    start = spark.createDataFrame([(dt.datetime(2025, 1, 1, 23),)], "start timestamp_ntz")
    w = spark.createDataFrame(
        [(dt.datetime(2025, 1, 2, 0), None, 0.0, 20.0, 3.0), (dt.datetime(2025, 1, 2, 0), 1.0, 0.0, 20.0, 4.0), (dt.datetime(2025, 1, 1, 23), 5.0, 0.0, 0.0, 9.0)],
        "time timestamp_ntz, rain double, snowfall double, wind_speed_10m double, apparent_temperature double",
    ).withColumn("ingest_seq", F.monotonically_increasing_id())
    ff = future_features(start, w, 3).orderBy("ts").collect()
    assert [r.ts for r in ff] == [dt.datetime(2025, 1, 2, 0), dt.datetime(2025, 1, 2, 1), dt.datetime(2025, 1, 2, 2)]
    assert ff[0].is_rainy is True and ff[0].is_windy is True and ff[0].apparent_temperature == 4.0  # last copy wins
    assert ff[1].is_rainy is False and ff[1].apparent_temperature is None  # missing hour -> no rain, temp NULL
    filled = future_features(start, w, 3, fill_temperature=True).orderBy("ts").collect()
    assert filled[1].apparent_temperature == 4.0
    assert set(HOUR_FEATURES) <= set(ff[0].asDict())


def test_trained_linear_fold_equals_a_loop(spark):
    """A fitted linear forecaster as a fold gives what its own score gives hour by hour."""
    from tests.conftest import SF001
    from velora.operators import stats as st
    from velora.plans import forecast as fc
    from velora.plans.features import build_features
    from velora.plans.forecaster import fit_forecaster
    from velora.sources import tables as tb

    c = tb.counts(spark, SF001)
    feats = build_features(c, tb.weather(c)).checkpoint()
    f, _ = fit_forecaster(feats, "linear")
    stats, wfc = st.site_stats(c), tb.weather_forecast(c)
    got = {(r.site_id, r.ts): r.hourly_count for r in fc.recursive_forecast_linear(feats, c, wfc, stats, f.linear_scorer(), 4, 30, encode=f.encode).collect()}
    start = fc.forecast_start_value(c)
    hist = last_values(fc.history_window(feats, start, 30)).join(stats, "site_id", "left")
    fifo = {r.site_id: (list(r.history), r) for r in hist.collect()}
    hours = fc.future_features(start, wfc, 4).orderBy("ts").collect()
    for h in hours:
        rows = []
        for sid, (v, r) in fifo.items():
            rows.append({**h.asDict(), **{k: r[k] for k in ("site_mean", "site_std", "site_min", "site_max")}, "site_id": sid,
                         "lag_1": v[-1], "lag_24": v[0], "rolling_mean_24": float(np.mean(v)), "hourly_count": 0})
        frame = spark.createDataFrame(rows, feats.schema)
        for r in f.score(frame.select(*feats.columns)).collect():
            p = max(r.prediction, 0.0)
            assert abs(got[r.site_id, h.ts] - p) < 1e-6
            fifo[r.site_id][0].append(p)
            del fifo[r.site_id][0][0]
    assert len(got) == 4 * len(fifo) > 0
