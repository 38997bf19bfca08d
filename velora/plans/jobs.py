"""Whole jobs over stored tables (M4-M6, M9, M10 + K4/K6/K7, I1-I3 + K2/K3, K8, W9).

Each job reads Parquet tables, runs one lazy plan and writes its result;
paths are parameters (shared storage on a cluster). Large tables are written
partitioned by month of ``ts`` so later time filters prune files.
"""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions.calendar import ntz_lit

from velora.operators import quality as q
from velora.operators.dedupe import last_per_key
from velora.operators.recursive import FIXED_SCORER, LinearScorer
from velora.operators.stats import site_stats
from velora.plans.features import build_features
from velora.plans.forecast import recursive_forecast_linear, recursive_forecast_trees, stamp_forecast
from velora.plans.forecaster import ENCODED, Forecaster, fit_forecaster, load_forecaster, save_forecaster
from velora.plans.sites import site_dimension
from velora.plans.training import append_run, best_run, get_pointer, latest_run, run_record, set_pointer
from velora.sinks import tables as sk
from velora.streaming.incremental import update_counts_from_pages, weather_gap, weather_horizon


def site_features_job(spark: SparkSession, raw_path: str, out_path: str) -> None:
    """K7: site statistics over all raw history (with n), written whole."""
    raw = spark.read.parquet(raw_path)
    sk.overwrite(site_stats(raw, with_n=True), out_path)


def feature_table_job(
    spark: SparkSession, raw_path: str, weather_path: str, out_path: str, stats_path: str | None = None, by_month: bool = True
) -> None:
    """M10 + K4: the 25-column feature table, replacing the previous one."""
    raw = spark.read.parquet(raw_path)
    weather = spark.read.parquet(weather_path)
    stats = spark.read.parquet(stats_path) if stats_path else None
    feats = build_features(raw, weather, stats)
    if by_month:
        sk.write_by_month(feats, out_path)
    else:
        sk.overwrite(feats, out_path)


def weather_forecast_job(spark: SparkSession, raw_path: str, landed_forecast: DataFrame, out_path: str, horizon_hours: int = 168) -> None:
    """I3 + K3: keep the forecast weather on the horizon and replace the stored copy."""
    sk.overwrite(weather_horizon(spark.read.parquet(raw_path), landed_forecast, horizon_hours), out_path)


def training_job(
    spark: SparkSession,
    features_path: str,
    model_path: str,
    runs_path: str,
    pointer_path: str,
    name: str,
    run_id: str,
    started_at,
    kind: str = "gbt",
    **options,
) -> Forecaster:
    """Fit on the stored feature table, save the forecaster, log the run, point ``name`` at it."""
    f, metrics = fit_forecaster(spark.read.parquet(features_path), kind, **options)
    f = save_forecaster(f, model_path)
    append_run(runs_path, run_record(metrics, name, run_id, started_at, model_path))
    set_pointer(pointer_path, spark.read.parquet(runs_path).filter(F.col("run_id") == run_id), started_at)
    return f


def evaluate_model(spark: SparkSession, model_path: str, data: DataFrame, label: str = "hourly_count") -> DataFrame:
    """M5: load a saved forecaster and score a feature table as it is; A17 metrics."""
    return load_forecaster(spark, model_path).evaluate(data, label)


def choose_model(spark: SparkSession, runs_path: str, pointer_path: str, name: str, by: str = "pointer") -> str:
    """The model folder of ``name`` by its pointer, its latest run or its best run."""
    if by == "pointer":
        return get_pointer(spark.read.parquet(pointer_path), name)["model_uri"]
    runs = spark.read.parquet(runs_path).filter(F.col("name") == name)
    row = {"latest": latest_run, "best": best_run}[by](runs).first()
    if row is None:
        raise KeyError(f"no run of {name!r} is logged")
    return row["model_uri"]


def forecast_job(
    spark: SparkSession,
    raw_path: str,
    features_path: str,
    weather_fc_path: str,
    forecast_path: str,
    generated_at,
    scorer: LinearScorer | None = None,
    model_path: str | None = None,
    horizon: int = 48,
    history_days: int = 30,
    stats_path: str | None = None,
    by_month: bool = False,
) -> str:
    """M9: checks (Q1, Q3-Q5), history, horizon features, recursion, upsert (K5).

    ``model_path`` (see ``choose_model``) names a saved forecaster: a linear one
    runs as the fold M8(a), a tree one as M8(b). Without it the given, or a
    fixed, linear scorer runs. Returns the folder of the new forecast version,
    which ``current_version`` finds again; with ``by_month`` the forecast is a
    table by month at ``forecast_path``, of which only the months of the new
    hours are rewritten. The latest raw hour is looked up once.
    """
    raw = spark.read.parquet(raw_path)
    feats = spark.read.parquet(features_path)
    wfc = spark.read.parquet(weather_fc_path)
    start = q.check_aligned(raw, feats)
    lo = ntz_lit(start)
    window = wfc.filter((F.col("time") > lo) & (F.col("time") <= lo + F.make_dt_interval(F.lit(0), F.lit(horizon))))
    q.require_rows(window, "weather forecast for the horizon")
    q.require_values(window, "apparent_temperature", "weather forecast for the horizon")
    stats = spark.read.parquet(stats_path) if stats_path else site_stats(raw)
    if model_path is None:
        fc = recursive_forecast_linear(feats, raw, wfc, stats, scorer or FIXED_SCORER, horizon, history_days, start=start)
    else:
        f = load_forecaster(spark, model_path)
        q.require_columns(feats, [c for c in f.cols if c != ENCODED])
        if f.kind == "linear":
            fc = recursive_forecast_linear(feats, raw, wfc, stats, f.linear_scorer(), horizon, history_days, encode=f.encode, start=start)
        else:
            fc = recursive_forecast_trees(feats, raw, wfc, f.trees(), stats, horizon, history_days, encode=f.encode, scale=f.scaler, start=start)
    rows, keys = stamp_forecast(fc, generated_at, model_path or "linear:fixed"), ["site_id", "ts"]
    if by_month:
        sk.upsert_months(spark, forecast_path, rows, keys)
        return forecast_path
    return sk.upsert_to_new_version(spark, forecast_path, rows, keys)


def site_dimension_job(spark: SparkSession, raw: DataFrame, sites_path: str) -> str:
    """K6: upsert the sites of new raw rows into the stored dimension; sites that left raw stay."""
    new = site_dimension(raw)
    current = sk.current_version(spark, sites_path)
    out = f"{sites_path.rstrip('/')}_v{uuid.uuid4().hex[:12]}"
    table = sk.upsert(spark.read.parquet(current), new, ["site_id"]) if current else new
    table.write.mode("overwrite").parquet(out)
    sk.write_small_json(spark.createDataFrame([(out,)], "version string"), f"{sites_path.rstrip('/')}_current")
    return out


def weather_gap_load(spark: SparkSession, raw: DataFrame, landed_weather: DataFrame, weather_path: str) -> int:
    """I2 + K2: append the landed weather hours of the gap; returns how many.

    Q6: rows without a readable time are left out with a warning; it is an
    error if no landed row has one. Both counts come from one pass.
    """
    bad, good = landed_weather.agg(F.count_if(F.col("time").isNull()), F.count("time")).first()
    if bad and not good:
        raise ValueError(f"none of {bad} weather rows has a readable time")
    if bad:
        warnings.warn(f"{bad} weather rows without a readable time are left out of {good + bad}", stacklevel=2)
    stored = spark.read.parquet(weather_path) if sk.path_exists(spark, weather_path) else landed_weather.limit(0)
    gap = weather_gap(raw, stored).first()
    if gap is None:
        return 0
    day = F.to_date("time")
    rows = last_per_key(landed_weather.filter(day.between(F.lit(gap["start_day"]), F.lit(gap["end_day"]))), ["time"], ["ingest_seq"])
    return sk.append(rows, weather_path)


def update_job(
    spark: SparkSession, pages_path: str, landed_weather: DataFrame, landed_forecast: DataFrame, raw_path: str, weather_path: str,
    forecast_weather_path: str, sites_path: str, horizon_hours: int = 168,
) -> dict[str, int]:
    """I1 + I2 + I3 + K6: new counts, the weather of their days, the forecast weather and the sites they name."""
    counts = update_counts_from_pages(spark, pages_path, raw_path)
    raw = spark.read.parquet(raw_path)
    weather = weather_gap_load(spark, raw, landed_weather, weather_path)
    weather_forecast_job(spark, raw_path, landed_forecast, forecast_weather_path, horizon_hours)
    site_dimension_job(spark, raw, sites_path)
    return {"counts": counts, "weather": weather}
