"""Serving queries over the forecast and the feature table.

Each takes DataFrames and plain parameters and returns a DataFrame; filters
on ``ts``/``site_id`` are simple column predicates, so they reach the Parquet
scan of a stored forecast or feature table as pushed filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.calendar import ntz_lit

from velora.functions.calendar import floor_hour
from velora.functions.scalar import load_level, site_label


def _hour(dt) -> F.Column:
    """Parameter -> floored NTZ hour literal (P7 on a parameter)."""
    return floor_hour(ntz_lit(dt))


def predict_at(geo: DataFrame, dt) -> DataFrame:
    """Forecast of every site at one hour, busiest first (ties by site id)."""
    return (
        geo.filter(F.col("ts") == _hour(dt))
        .select("site_id", "site_name", "latitude", "longitude", "hourly_count")
        .orderBy(F.col("hourly_count").desc(), F.col("site_id"))
    )


def top_sites(geo: DataFrame, dt, n: int = 15, busiest: bool = True) -> DataFrame:
    """T2 + C10: top ``n`` busiest (or quietest) sites at one hour, with a label (top-k report)."""
    order = F.col("hourly_count").desc() if busiest else F.col("hourly_count").asc()
    return (
        geo.filter(F.col("ts") == _hour(dt))
        .select(site_label("site_name", "site_id").alias("station"), "site_id", "hourly_count")
        .orderBy(order, F.col("site_id"))
        .limit(n)
    )


def forecast_range(geo: DataFrame, start, end) -> DataFrame:
    """Every forecast row in ``[start, end]`` (floored), ordered by site name then hour.

    Unknown names sort last, as an ascending SQL order does in the reference's store.
    """
    return (
        geo.filter(F.col("ts").between(_hour(start), _hour(end)))
        .select("ts", "site_id", "site_name", "latitude", "longitude", "hourly_count")
        .orderBy(F.col("site_name").asc_nulls_last(), F.col("ts"), F.col("site_id"))
    )


def site_series(geo: DataFrame, site_id: int, start=None, end=None) -> DataFrame:
    """T5: one site's forecast series in time order."""
    df = geo.filter(F.col("site_id") == F.lit(site_id))
    if start is not None:
        df = df.filter(F.col("ts") >= _hour(start))
    if end is not None:
        df = df.filter(F.col("ts") <= _hour(end))
    return df.select("ts", "hourly_count").orderBy("ts")


def trends(features: DataFrame, forecast: DataFrame, site_id: int, start, end) -> DataFrame:
    """History and forecast of one site in ``[start, end]``, tagged by ``series``."""
    def part(df: DataFrame, series: str) -> DataFrame:
        return (
            df.filter((F.col("site_id") == F.lit(site_id)) & F.col("ts").between(_hour(start), _hour(end)))
            .select("ts", F.col("hourly_count").cast("double").alias("hourly_count"), F.lit(series).alias("series"))
        )

    return part(features, "history").unionByName(part(forecast, "forecast")).orderBy("series", "ts")


def one_row_per_site_hour(geo: DataFrame) -> DataFrame:
    """W7 (first step): one row per (site, hour); rows sorted by site and hour, first kept."""
    w = Window.partitionBy("site_id", "ts").orderBy(F.col("hourly_count").desc(), F.col("site_name"))
    return geo.withColumn("__rk", F.row_number().over(w)).filter(F.col("__rk") == 1).drop("__rk")


def site_options(geo: DataFrame) -> DataFrame:
    """W7 (second step) + C10: one labelled row per site, ordered by name then id."""
    return (
        geo.groupBy("site_id")
        .agg(F.min("site_name").alias("site_name"))
        .withColumn("site_label", site_label("site_name", "site_id"))
        .orderBy(F.col("site_name").asc_nulls_last(), "site_id")
    )


def default_site(geo: DataFrame, dt) -> DataFrame:
    """The busiest site at the chosen hour (ties: smallest id)."""
    at = geo.filter(F.col("ts") == _hour(dt))
    return at.agg(F.min_by(F.col("site_id"), F.struct(-F.col("hourly_count"), F.col("site_id"))).alias("site_id"))


def with_load_level(geo: DataFrame, low: float, high: float) -> DataFrame:
    """Calm / moderate / busy per forecast row."""
    return geo.withColumn("load_level", load_level("hourly_count", low, high))


def compare_with_reference(forecast: DataFrame, reference: DataFrame) -> DataFrame:
    """Forecast vs historical reference on (site, hour), with ``delta = forecast - reference``."""
    ref = reference.select("site_id", "ts", "label", F.col("reference"))
    return (
        forecast.select("site_id", "ts", "hourly_count")
        .join(ref, ["site_id", "ts"], "left")
        .withColumn("delta", F.col("hourly_count") - F.col("reference"))
    )
