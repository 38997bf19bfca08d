"""Feature table build (M10, with J1, J2, W1-W4, C1-C5, C8, A2).

One lazy plan instead of the reference's site-by-site loop:

    counts --P4--> W1-W4 (chunked row lags) --> calendar flags --J1 (weather)
    --J2 (site stats)--> cyclic encodings --> 25 columns

The weather side has one row per hour of the span and the stats side one row
per site. Neither carries a hint: Spark measures them at run time and
broadcasts a side only below its threshold. A small table of per-(site, bucket)
moments is written once when the plan is built; the rest is one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.functions.calendar import add_cyclic_features, holiday_flag, interval_flag_join, is_night, is_rush_hour, season
from velora.functions.scalar import rainy, snowy, windy
from velora.operators.dedupe import last_per_key
from velora.operators.lags import bucket_of, drop_warmup, row_lags
from velora.operators.stats import bucket_moments, site_stats_from_buckets
from velora.functions.calendar import floor_hour
from velora.session import checkpointed

FEATURE_COLUMNS = [
    "site_id", "hourly_count", "ts", "is_holiday", "is_rush_hour", "is_night", "apparent_temperature",
    "is_rainy", "is_windy", "is_snowy", "site_mean", "site_std", "site_min", "site_max",
    "lag_1", "lag_24", "rolling_mean_24", "dow_sin", "dow_cos", "month_sin", "month_cos",
    "hour_sin", "hour_cos", "season_sin", "season_cos",
]

MODEL_FEATURES = [c for c in FEATURE_COLUMNS if c not in ("hourly_count", "ts")]


def prepare_weather(weather_raw: DataFrame) -> DataFrame:
    """C8 + W6: hourly flags, one row per hour (the last landed wins).

    A NULL amount on a landed row gives a false flag; hours with no row at all
    stay NULL after the left join, as in the reference's history path.
    """
    w = weather_raw.withColumn("time", floor_hour("time")).filter(F.col("time").isNotNull())
    if "ingest_seq" not in w.columns:
        w = w.withColumn("ingest_seq", F.lit(0))
    w = last_per_key(w.select("time", "rain", "snowfall", "wind_speed_10m", "apparent_temperature", "ingest_seq"), ["time"], ["ingest_seq"])
    return w.select(
        F.col("time").alias("ts"),
        "apparent_temperature",
        rainy("rain").alias("is_rainy"),
        snowy("snowfall").alias("is_snowy"),
        windy("wind_speed_10m").alias("is_windy"),
    )


def calendar_flags(df: DataFrame, ts_col: str = "ts", holidays: DataFrame | None = None) -> DataFrame:
    """C1-C3 + J9 flags on an hour column; ``holidays`` (start_date, end_date) replaces the fixed calendar."""
    t = F.col(ts_col)
    out = df.withColumns({"is_rush_hour": is_rush_hour(t), "is_night": is_night(t)})
    if holidays is not None:
        return interval_flag_join(out, ts_col, holidays, "is_holiday")
    return out.withColumn("is_holiday", holiday_flag(t))


def build_features(
    counts: DataFrame,
    weather_raw: DataFrame,
    stats: DataFrame | None = None,
    chunk_rows: int = 65_536,
    holidays: DataFrame | None = None,
) -> DataFrame:
    """The 25-column feature table, one row per (site, hour) after warm-up.

    ``holidays`` is an optional calendar table (J9) in place of the fixed one.

    ``counts`` has (site_id, ts, hourly_count); ``stats`` defaults to A2 over
    all of ``counts`` (the reference's choice; pass ``site_stats_as_of`` to
    avoid the leak into a later test period).
    """
    base = (
        counts.select("site_id", "ts", "hourly_count")
        .dropna(subset=["site_id", "ts", "hourly_count"])
        .withColumn("ts", floor_hour("ts"))
    )
    # One pass over the counts yields small per-(site, 4-week bucket) partials
    # that serve both the lag offsets and the site statistics. They are
    # checkpointed (reliably, in the shared folder) so that the two consumers
    # read one small table instead of each re-aggregating the counts.
    moments = checkpointed(bucket_moments(base, bucket_of("ts")))
    stats = stats if stats is not None else site_stats_from_buckets(moments)
    core = core_features(base, prepare_weather(weather_raw), chunk_rows, holidays, moments)
    return with_site_stats(core, stats)


CORE_COLUMNS = [c for c in FEATURE_COLUMNS if c not in ("site_mean", "site_std", "site_min", "site_max")]


def with_site_stats(core: DataFrame, stats: DataFrame) -> DataFrame:
    """The 25 columns from the 21 that do not depend on a site's whole history."""
    return core.join(stats.select("site_id", "site_mean", "site_std", "site_min", "site_max"), "site_id", "left").select(*FEATURE_COLUMNS)


def core_features(
    base: DataFrame, weather: DataFrame, chunk_rows: int = 65_536, holidays: DataFrame | None = None, bucket_counts: DataFrame | None = None
) -> DataFrame:
    """The feature table without the site statistics, from clean counts and prepared weather."""
    # Lags first, on the three narrow columns: the shuffles of row_lags carry 3
    # columns, not 14, and the warm-up rows are gone before the joins.
    lagged = drop_warmup(
        row_lags(
            base, "site_id", ["ts", "hourly_count"], "hourly_count", lags=(1, 24), rolling=24, chunk_rows=chunk_rows,
            bucket_counts=bucket_counts,
        )
    )
    joined = calendar_flags(lagged, holidays=holidays).join(weather, "ts", "left")
    return add_cyclic_features(joined, "ts").select(*CORE_COLUMNS)
