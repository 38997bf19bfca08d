"""Site dimension (K6, C6) and the forecast-with-geometry view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.functions.scalar import coord_part
from velora.operators.dedupe import last_per_key


def site_dimension(raw: DataFrame) -> DataFrame:
    """K6: one row per site from raw rows whose coordinates are not NULL.

    Two names for one id keep the row with the latest stamp (the reference
    would fail on such a batch). A blank coordinate gives NULL lat/lon.
    """
    located = raw.filter(F.col("coordinates").isNotNull()).select("site_id", "site_name", "coordinates", "ts")
    newest = located.groupBy("site_id").agg(F.max("ts").alias("ts"))  # hash aggregate; few rows are left for the next
    latest = last_per_key(located.join(newest, ["site_id", "ts"], "left_semi"), ["site_id"], ["ts", "site_name", "coordinates"])
    return latest.select(
        "site_id",
        "site_name",
        coord_part("coordinates", 1).alias("latitude"),
        coord_part("coordinates", 2).alias("longitude"),
    )


def forecast_geo(forecast: DataFrame, sites: DataFrame) -> DataFrame:
    """Forecast left-joined to the site dimension on ``site_id``.

    The dimension has one row per site; AQE broadcasts it when its measured
    size is small and keeps a shuffle join otherwise.
    """
    cols = ["site_id", "ts", "hourly_count", "site_name", "latitude", "longitude"]
    extra = [c for c in ("generated_at", "model_uri") if c in forecast.columns]
    return forecast.join(sites, "site_id", "left").select(*cols, *extra)


def located_forecast(forecast: DataFrame, sites: DataFrame) -> DataFrame:
    """Forecast rows of sites that have both coordinates (inner join)."""
    located = sites.dropna(subset=["latitude", "longitude"]).distinct()
    return forecast.join(located, "site_id", "inner")
