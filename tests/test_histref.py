"""A16 historical reference: the equi-join plan equals a brute-force scan of the 4 windows."""

import datetime as dt
import random

from velora.operators.histref import LEVEL_LABELS, historical_reference


def _brute(rows, targets):
    out = {}
    for site, t in targets:
        wins = [
            lambda r: r[1].isoweekday() == t.isoweekday() and r[1].hour == t.hour and r[1] >= t - dt.timedelta(weeks=4),
            lambda r: r[1].isoweekday() == t.isoweekday() and r[1].hour == t.hour,
            lambda r: r[1].hour == t.hour,
            lambda r: True,
        ]
        base = [r for r in rows if r[0] == site and t - dt.timedelta(weeks=8) <= r[1] <= t - dt.timedelta(hours=1)]
        for lvl, cond in enumerate(wins, 1):
            sel = [r for r in base if cond(r)]
            vals = [r[2] for r in sel if r[2] is not None]
            if sel and vals:
                out[(site, t)] = (lvl, len(sel), sum(vals) / len(vals))
                break
    return out


def test_matches_brute_force(spark):
    rnd = random.Random(11)
    base = dt.datetime(2025, 1, 1)
    rows = []
    for site in (1, 2):
        for _ in range(600):
            t = base + dt.timedelta(hours=rnd.randint(0, 24 * 120))
            rows.append((site, t, rnd.choice([None, 1, 2, 3, 7, 10])))
    targets = [(1, base + dt.timedelta(hours=rnd.randint(0, 24 * 130))) for _ in range(120)]
    targets += [(2, base + dt.timedelta(days=200)), (3, base + dt.timedelta(days=50))]  # no history -> no row
    raw = spark.createDataFrame(rows, "site_id long, ts timestamp_ntz, hourly_count long")
    tg = spark.createDataFrame(targets, "site_id long, ts timestamp_ntz")
    got = {(r.site_id, r.ts): (r.level, r.n, r.reference, r.label) for r in historical_reference(raw, tg).collect()}
    exp = _brute(rows, targets)
    assert set(got) == set(exp)
    for k, (lvl, n, v) in exp.items():
        glvl, gn, gv, label = got[k]
        assert (glvl, gn) == (lvl, n)
        assert abs(gv - v) < 1e-9
        assert label == f"{LEVEL_LABELS[lvl - 1]} (n={n})"
    assert len({v[0] for v in exp.values()}) >= 3  # several fallback levels exercised
