"""Registered queries over fitted models that SQL can state in closed form (M4, M5, T4, M9): one round of trees of
depth 2 on the six flags, and a linear model on two lags. Both are fitted by the same code as the full models."""

from __future__ import annotations

from velora.operators import stats as st
from velora.plans import forecast as fc
from velora.plans import forecaster as fr
from velora.registry import catalog_queries as c
from velora.registry import sql_parts as S
from velora.registry.queries import finalize, register
from velora.sources import tables as tb

FLAGS = ["is_holiday", "is_rush_hour", "is_night", "is_rainy", "is_windy", "is_snowy"]
LAGS = ["lag_1", "lag_24"]

_SPLIT = [S.COUNTS, S.features(), c._SPLIT_SQL]


def _value_of(name: str) -> str:
    """The value of the flag whose name stands in column ``name``; NULL flags are 0, as the model fills them."""
    return f"CASE {name} " + " ".join(f"WHEN '{f}' THEN coalesce(CAST({f} AS INTEGER), 0)" for f in FLAGS) + " END"


def _long(source: str) -> str:
    """One row per row and flag: the side of the root split (0 in the root), flag number, flag, its value, label."""
    one = "SELECT {side} AS side, {k} AS k, '{f}' AS flag, coalesce(CAST({f} AS INTEGER), 0) AS v, CAST(hourly_count AS DOUBLE) AS y FROM {source}"
    side = "side" if source == "sided" else "0"
    return "\nUNION ALL\n".join(one.format(side=side, k=k, f=f, source=source) for k, f in enumerate(FLAGS))


def _best(name: str, source: str) -> str:
    """The split of every side that lowers the squared error most: side, flag, gain, means of both parts. Ties: the first flag."""
    return f"""{name}_parts AS (
  SELECT side, k, flag, v, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m FROM ({_long(source)}) GROUP BY ALL
), {name} AS (
  SELECT a.side, a.flag, a.n * b.n / (a.n + b.n) * (a.m - b.m) * (a.m - b.m) AS gain, a.m AS m0, b.m AS m1
  FROM {name}_parts a JOIN {name}_parts b ON a.side = b.side AND a.k = b.k AND a.v = 0 AND b.v = 1
  WHERE a.m <> b.m
  QUALIFY row_number() OVER (PARTITION BY a.side ORDER BY gain DESC, a.k) = 1
)"""


_TREE = [
    "train AS (SELECT * FROM split WHERE NOT is_test)",
    _best("root", "train"),
    f"sided AS (SELECT train.*, {_value_of('root.flag')} AS side FROM train, root)",
    _best("child", "sided"),
    "sides AS (SELECT side, avg(hourly_count) AS m FROM sided GROUP BY side)",
]


def _leaves(source: str) -> str:
    """Rows of ``source`` with ``p``, the mean of the leaf they fall into."""
    return f"""SELECT x.*, CASE WHEN c.side IS NULL THEN s.m WHEN {_value_of('c.flag')} = 1 THEN c.m1 ELSE c.m0 END AS p
  FROM (SELECT {source}.*, {_value_of('root.flag')} AS side FROM {source}, root) x
  JOIN sides s ON s.side = x.side LEFT JOIN child c ON c.side = x.side"""


_METRICS = """SELECT avg(abs(p - y)) AS mae, sqrt(avg((p - y) * (p - y))) AS rmse,
  CASE WHEN var_pop(y) > 0 THEN 1.0 - sum((p - y) * (p - y)) / (var_pop(y) * count(y)) END AS r2, count(*) AS n_rows"""


def _small_trees(spark, sf):
    return fr.fit_forecaster(c._features(spark, sf), "gbt", cols=FLAGS, rounds=1, max_depth=2, scale=False)


register(
    "tree_importances",
    S.round_all(
        S.with_(*_SPLIT, *_TREE)
        + "SELECT f.feature, coalesce(sum(g.gain) / (SELECT sum(gain) FROM (FROM root UNION ALL FROM child)), 0.0) AS importance\n"
        + f"FROM (SELECT unnest({FLAGS}) AS feature) f LEFT JOIN (FROM root UNION ALL FROM child) g ON g.flag = f.feature GROUP BY f.feature",
        ["importance"],
    ),
)(lambda spark, sf: finalize(_small_trees(spark, sf)[0].importances(len(FLAGS))))

register(
    "tree_metrics",
    S.round_all(
        S.with_(*_SPLIT, *_TREE, "test AS (SELECT * FROM split WHERE is_test)")
        + f"{_METRICS} FROM (SELECT p, CAST(hourly_count AS DOUBLE) AS y FROM ({_leaves('test')}))",
        ["mae", "rmse", "r2"],
    ),
)(lambda spark, sf: finalize(_small_trees(spark, sf)[1]))


def _tree_forecast(spark, sf):
    """M9 with M8(b): saved trees, loaded and run over every site and hour."""
    counts, feats = c._counts(spark, sf), c._features(spark, sf)
    saved = fr.save_forecaster(_small_trees(spark, sf)[0], c._run_folder(spark, "small-trees"))
    f = fr.load_forecaster(spark, saved.path)
    out = fc.recursive_forecast_trees(feats, counts, tb.weather_forecast(counts), f.trees(), st.site_stats(counts), encode=f.encode, scale=f.scaler)
    return finalize(out)


register(
    "tree_forecast",
    S.round_all(
        S.with_(*_SPLIT, *_TREE, S.weather_forecast(), S.future_features(), S.history24())
        + f"SELECT h.site_id, x.ts, greatest(x.p, 0.0) AS hourly_count FROM hist h, ({_leaves('hf')}) x",
        ["hourly_count"],
    ),
)(_tree_forecast)

# Two lags: slopes from their covariances with each other and with the label.
_PLANE = [
    """moments AS (
  SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS v1, var_pop(x2) AS v2,
    covar_pop(x1, x2) AS c12, covar_pop(x1, y) AS c1, covar_pop(x2, y) AS c2
  FROM (SELECT CAST(lag_1 AS DOUBLE) AS x1, CAST(lag_24 AS DOUBLE) AS x2, CAST(hourly_count AS DOUBLE) AS y FROM split WHERE NOT is_test)
)""",
    """slopes AS (
  SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS a1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS a2 FROM moments
)""",
]


def _two_lags(spark, sf):
    return fr.fit_forecaster(c._features(spark, sf), "linear", cols=LAGS)


register(
    "linear_metrics",
    S.round_all(
        S.with_(*_SPLIT, *_PLANE)
        + f"{_METRICS} FROM (SELECT my + a1 * (lag_1 - m1) + a2 * (lag_24 - m2) AS p, CAST(hourly_count AS DOUBLE) AS y FROM split, slopes WHERE is_test)",
        ["mae", "rmse", "r2"],
    ),
)(lambda spark, sf: finalize(_two_lags(spark, sf)[1]))

register(
    "linear_importances",
    S.round_all(
        S.with_(*_SPLIT, *_PLANE)
        + "SELECT 'lag_1' AS feature, abs(a1) * sqrt(v1) AS importance FROM slopes UNION ALL SELECT 'lag_24', abs(a2) * sqrt(v2) FROM slopes",
        ["importance"],
    ),
)(lambda spark, sf: finalize(_two_lags(spark, sf)[0].importances(len(LAGS))))


def _two_lag_forecast(spark, sf):
    """M9 with M8(a): the fitted plane as the exact fold."""
    counts, feats = c._counts(spark, sf), c._features(spark, sf)
    scorer = fr.fit_forecaster(feats, "linear", cols=LAGS)[0].linear_scorer()
    return finalize(fc.recursive_forecast_linear(feats, counts, tb.weather_forecast(counts), scorer=scorer))


register(
    "forecast_two_lags",
    S.round_all(
        S.with_(
            *c._HIST_CTES,
            c._SPLIT_SQL,
            *_PLANE,
            c._fold_sql("(SELECT my - a1 * m1 - a2 * m2 FROM slopes) + (SELECT a1 FROM slopes) * r.hist[24] + (SELECT a2 FROM slopes) * r.hist[1]"),
        )
        + "SELECT * FROM wf",
        ["hourly_count"],
    ),
)(_two_lag_forecast)
