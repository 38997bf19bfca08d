"""Forecast job (M7, M9 with W8, M8, J3-J5, I5).

The horizon (48 h by default) and the history window (30 days) are
parameters. Everything that depends on the horizon is bounded by its hour
count; everything per site runs as one row per site.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.operators.one_row import with_one_row

from velora.functions.calendar import ntz_lit

from velora.functions.calendar import add_cyclic_features, floor_hour, hour_grid_after
from velora.functions.scalar import rainy, snowy, windy
from velora.operators.dedupe import last_per_key
from velora.operators.history import last_values
from velora.operators.quality import latest_hour
from velora.operators.recursive import FIXED_SCORER, LinearScorer, linear_fold
from velora.operators.trees import Ensemble, tree_forecast
from velora.plans.features import calendar_flags

HOUR_FEATURES = [
    "is_holiday", "is_rush_hour", "is_night", "apparent_temperature", "is_rainy", "is_windy", "is_snowy",
    "dow_sin", "dow_cos", "month_sin", "month_cos", "hour_sin", "hour_cos", "season_sin", "season_cos",
]
SITE_FEATURES = ["site_mean", "site_std", "site_min", "site_max"]


def forecast_start(raw: DataFrame, ts_col: str = "ts") -> DataFrame:
    """One row with ``start`` = the latest hour of the raw counts."""
    return raw.agg(F.max(ts_col).alias("start")).select(floor_hour("start").alias("start"))


def forecast_start_value(raw: DataFrame, ts_col: str = "ts"):
    """A4 as a scalar: the latest raw hour (one aggregate value), or None when empty.

    Resolving it up front lets every later time filter be a literal range that
    reaches the Parquet scan (pushdown, month-partition pruning) instead of a
    comparison against a joined column, which would scan the whole table.
    """
    return latest_hour(raw, ts_col)


def _start_frame(spark, start) -> DataFrame:
    return spark.range(1).select(ntz_lit(start).alias("start"))


def forecast_window(raw: DataFrame, horizon: int = 48) -> DataFrame:
    """The bookable window ``start + 1h .. start + horizon h`` (one row; NULLs when empty)."""
    s = forecast_start(raw)
    return s.select(
        (F.col("start") + F.expr("INTERVAL 1 HOUR")).alias("window_start"),
        (F.col("start") + F.make_dt_interval(F.lit(0), F.lit(horizon))).alias("window_end"),
    )


def future_features(
    start, weather_fc: DataFrame, horizon: int = 48, fill_temperature: bool = False, holidays: DataFrame | None = None
) -> DataFrame:
    """M7 (hour part): hours ``(start, start + horizon]`` with calendar, weather and cyclic features.

    Weather rows are floored to the hour, the last landed copy per hour kept,
    and restricted to the horizon (P9 half-open). A missing hour counts as no
    rain/snow/wind (J3); temperature stays NULL or, with
    ``fill_temperature``, takes the horizon mean (A18).
    """
    if not isinstance(start, DataFrame):
        # literal horizon: the weather scan gets a pushed-down time range
        lo = ntz_lit(start)
        hi = lo + F.make_dt_interval(F.lit(0), F.lit(horizon))
        weather_fc = weather_fc.filter((F.col("time") > lo - F.expr("INTERVAL 1 HOUR")) & (F.col("time") <= hi + F.expr("INTERVAL 1 HOUR")))
        start = _start_frame(weather_fc.sparkSession, start)
    hours = hour_grid_after(start, "start", horizon)
    w = weather_fc.withColumn("time", floor_hour("time")).filter(F.col("time").isNotNull())
    if "ingest_seq" not in w.columns:
        w = w.withColumn("ingest_seq", F.lit(0))
    w = last_per_key(w.select("time", "rain", "snowfall", "wind_speed_10m", "apparent_temperature", "ingest_seq"), ["time"], ["ingest_seq"])
    bounds = start.select(F.col("start"), (F.col("start") + F.make_dt_interval(F.lit(0), F.lit(horizon))).alias("end"))
    # one row of bounds attached to the weather horizon (both tiny, bounded by the horizon)
    w = with_one_row(w, bounds).filter((F.col("time") > F.col("start")) & (F.col("time") <= F.col("end")))
    hf = calendar_flags(hours, holidays=holidays).join(F.broadcast(w.drop("start", "end")), F.col("ts") == F.col("time"), "left")
    hf = hf.withColumns(
        {
            "is_rainy": rainy("rain", null_as_zero=True),
            "is_snowy": snowy("snowfall", null_as_zero=True),
            "is_windy": windy("wind_speed_10m", null_as_zero=True),
        }
    )
    if fill_temperature:
        m = hf.agg(F.avg("apparent_temperature").alias("__m"))
        hf = with_one_row(hf, m).withColumn(
            "apparent_temperature", F.coalesce("apparent_temperature", "__m")
        ).drop("__m")
    return add_cyclic_features(hf, "ts").select("ts", *HOUR_FEATURES)


def history_window(features: DataFrame, start, days: int = 30) -> DataFrame:
    """Feature rows with ``start - days <= ts <= start`` (the forecast's history).

    With a literal ``start`` the range is a pushed-down scan filter; a one-row
    frame is accepted too (then the filter runs after the scan).
    """
    if not isinstance(start, DataFrame):
        import datetime as dt

        if "month" in features.columns:  # a table stored by month: prune whole partitions
            s = start if isinstance(start, dt.datetime) else dt.datetime.fromisoformat(str(start))
            lo_m, hi_m = (s - dt.timedelta(days=days)).strftime("%Y-%m"), s.strftime("%Y-%m")
            features = features.filter(F.col("month").between(lo_m, hi_m))
        hi = ntz_lit(start)
        return features.filter((F.col("ts") >= hi - F.make_dt_interval(F.lit(days))) & (F.col("ts") <= hi))
    b = start.select(F.col("start"), (F.col("start") - F.make_dt_interval(F.lit(days))).alias("__from"))
    return (
        with_one_row(features, b)
        .filter((F.col("ts") >= F.col("__from")) & (F.col("ts") <= F.col("start")))
        .drop("start", "__from")
    )


def recursive_forecast_linear(
    features: DataFrame,
    raw: DataFrame,
    weather_fc: DataFrame,
    stats: DataFrame | None = None,
    scorer: LinearScorer = FIXED_SCORER,
    horizon: int = 48,
    history_days: int = 30,
    encode=None,
    start=None,
) -> DataFrame:
    """M9 with M8(a): (site_id, ts, hourly_count) for every site with history, every horizon hour.

    ``encode`` adds a trained model's site encoding to the site rows; ``start``
    is the latest raw hour if the caller knows it (then ``raw`` is not read).

    Sites are those with feature rows in the history window (J5); their site
    statistics are left-joined; the hours are one array shared by all sites
    (a one-row broadcast) and the recursion is a per-row fold.
    """
    start = start if start is not None else forecast_start_value(raw)
    if start is None:
        raise RuntimeError("no count rows: load counts before forecasting")
    hist_rows = history_window(features, start, history_days)
    hist = last_values(hist_rows, "site_id", "ts", "hourly_count", 24)
    if stats is not None:
        hist = hist.join(stats.select("site_id", *SITE_FEATURES), "site_id", "left")
    if encode is not None:
        hist = encode(hist)
    hf = future_features(start, weather_fc, horizon)
    hours = hf.agg(F.array_sort(F.collect_list(F.struct("ts", *HOUR_FEATURES))).alias("__hours"))
    folded = linear_fold(with_one_row(hist, hours), "__hours", scorer, HOUR_FEATURES)
    return folded.select("site_id", F.explode("forecast").alias("__f")).select(
        "site_id", F.col("__f.ts").alias("ts"), F.col("__f.pred").alias("hourly_count")
    )


def recursive_forecast_trees(
    features: DataFrame,
    raw: DataFrame,
    weather_fc: DataFrame,
    model: Ensemble,
    stats: DataFrame | None = None,
    horizon: int = 48,
    history_days: int = 30,
    encode=None,
    scale: Mapping[str, tuple[float, float]] | None = None,
    start=None,
) -> DataFrame:
    """M9 with M8(b): the same inputs as the linear form, scored by a tree ensemble.

    ``encode`` adds the model's site encoding to the site rows; ``scale`` is its scaler.
    """
    start = start if start is not None else forecast_start_value(raw)
    if start is None:
        raise RuntimeError("no count rows: load counts before forecasting")
    hist = last_values(history_window(features, start, history_days), "site_id", "ts", "hourly_count", 24)
    if stats is not None:
        hist = hist.join(stats.select("site_id", *SITE_FEATURES), "site_id", "left")
    if encode is not None:
        hist = encode(hist)
    hours = future_features(start, weather_fc, horizon)
    out = tree_forecast(hist, hours, model, scale)
    return out.select("site_id", "ts", F.col("pred").alias("hourly_count"))


def stamp_forecast(forecast: DataFrame, generated_at, model_uri: str) -> DataFrame:
    """Forecast fact rows: add ``generated_at`` (a parameter, never the clock) and ``model_uri``."""
    return forecast.withColumns(
        {"generated_at": ntz_lit(generated_at), "model_uri": F.lit(model_uri)}
    )
