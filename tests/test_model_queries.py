"""Small models against brute force: the first round's tree on flags (NULL flags, ties) and a plane through two lags."""

import datetime as dt
import random

import pytest

from velora.plans import forecaster as fr

FLAGS = ["is_night", "is_rainy", "is_windy"]


def frame(spark, n=400):
    r = random.Random(4)
    rows = []
    for i in range(n):
        night, rain = r.random() < 0.3, r.choice([True, False, False, None])
        y = 10.0 - 6.0 * night - 2.0 * bool(rain) * (not night) + r.random()
        # is_windy repeats is_night: of equal gains the first feature is split
        rows.append((i % 5, dt.datetime(2025, 1, 1) + dt.timedelta(hours=i), y, night, rain, night, float(r.randrange(9)), float(r.randrange(9))))
    return spark.createDataFrame(
        rows, "site_id long, ts timestamp_ntz, hourly_count double, is_night boolean, is_rainy boolean, is_windy boolean, lag_1 double, lag_24 double"
    ), rows


def best_split(rows):
    """(gain, flag, rows off, rows on) of the split that lowers the squared error most; rows are (flags, y)."""
    found = None
    for k in range(len(FLAGS)):
        off, on = ([r for r in rows if r[0][k] == v] for v in (0, 1))
        if off and on:
            means = [sum(y for _, y in part) / len(part) for part in (off, on)]
            gain = len(off) * len(on) / len(rows) * (means[0] - means[1]) ** 2
            if found is None or gain > found[0]:
                found = (gain, k, off, on)
    return found


def test_one_round_of_trees_equals_brute_force(spark):
    df, rows = frame(spark)
    f, metrics = fr.fit_forecaster(df, "gbt", cols=FLAGS, rounds=1, max_depth=2, scale=False)
    seen = [([int(bool(x)) for x in r[3:6]], r[2]) for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    train, test = seen[:360], seen[360:]
    gain, k, off, on = best_split(train)
    gains = [0.0] * len(FLAGS)
    gains[k] += gain
    leaves = {}
    for v, part in ((0, off), (1, on)):
        child = best_split(part)
        if child:
            gains[child[1]] += child[0]
            leaves[v] = child[1], [sum(y for _, y in p) / len(p) for p in child[2:]]
        else:
            leaves[v] = None, [sum(y for _, y in part) / len(part)]
    want = {name: g / sum(gains) for name, g in zip(FLAGS, gains)}
    got = {r.feature: r.importance for r in f.importances(3).collect()}
    assert got == pytest.approx(want) and want["is_windy"] == 0 and want["is_rainy"] > 0
    errors = []
    for flags, y in test:
        at, means = leaves[flags[k]]
        errors.append(means[0 if at is None else flags[at]] - y)
    m = metrics.first()
    assert m.n_rows == 40 and m.mae == pytest.approx(sum(map(abs, errors)) / 40)


def test_plane_through_two_lags_has_orthogonal_errors(spark):
    df, rows = frame(spark)
    f, _ = fr.fit_forecaster(df, "linear", cols=["lag_1", "lag_24"])
    train = sorted(rows, key=lambda r: (r[1], r[0]))[:360]
    scored = {(r.site_id, r.ts): r.prediction for r in f.score(df).collect()}
    e = [scored[r[0], r[1]] - r[2] for r in train]
    for x in ([1.0] * 360, [r[6] for r in train], [r[7] for r in train]):
        assert abs(sum(a * b for a, b in zip(e, x))) < 1e-6
