"""Scans of the driver's Parquet tables and the frames derived from them.

The driver ships TPC-H-like tables plus an ``events`` stream. The count
domain (sites x hours) is derived from ``events`` by Spark: every user is a
site, so sites and rows grow with the input:

* ``counts``      (site_id, ts, hourly_count): events per site and hour.
* ``counts_wide`` the same after shifting each event by ``event_id % 600`` days,
                  so that it spans all seasons and holiday periods.
* ``counts_raw``  ``counts`` rendered as landed text (strings, zoned stamps,
                  coordinates text, duplicates, null ids, unparsable counts).
* ``weather``     hourly weather on the hour grid spanned by a counts frame.
* ``sites``       the site dimension, upserted from ``counts_raw`` (K6).

Scans read only the columns each frame needs; Catalyst prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions.calendar import floor_hour

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed derivation constants for the count domain.
SITE_BASE = 100056789
WIDE_SHIFT_DAYS = 600


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _site_id(user_id: F.Column) -> F.Column:
    return F.lit(SITE_BASE) + user_id


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts per site from ``events``.

    One hash aggregate on (site_id, hour); the partial (map-side) aggregate
    collapses a hot site to one row per hour per input split before the
    shuffle, so a site holding a third of the events costs no skew.
    """
    ev = read_table(spark, sf_dir, "events").select("user_id", "ts")
    return (
        ev.select(_site_id(F.col("user_id")).alias("site_id"), floor_hour("ts").alias("ts"))
        .groupBy("site_id", "ts")
        .agg(F.count(F.lit(1)).alias("hourly_count"))
    )


def counts_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``counts`` over a long calendar: each event shifted by ``event_id % 600`` days."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    shifted = F.col("ts") + F.make_dt_interval((F.col("event_id") % F.lit(WIDE_SHIFT_DAYS)).cast("int"))
    return (
        ev.select(_site_id(F.col("user_id")).alias("site_id"), floor_hour(shifted).alias("ts"))
        .groupBy("site_id", "ts")
        .agg(F.count(F.lit(1)).alias("hourly_count"))
    )


def counts_raw(counts_df: DataFrame) -> DataFrame:
    """Landed-text form of a counts frame, with the defects ingest must handle.

    * all columns are strings; ``ts`` carries a ``+01:00`` zone suffix,
    * ``site_id`` is NULL at 05:00 on the 2nd of each month,
    * ``hourly_count`` is ``'n/a'`` at 06:00 on the 3rd,
    * every row at 03:00 on the 1st of a month lands twice (second copy later),
    * coordinates are ``"lat,lon"`` text; NULL for sites with ``site_id % 10 = 8``
      (so the site dimension misses them) and blank for ``site_id % 10 = 7``.
    ``ingest_seq`` records landing order (first copy 0, repeat 1).
    """
    t = F.col("ts")
    base = counts_df.select(
        F.when((F.hour(t) == 5) & (F.dayofmonth(t) == 2), F.lit(None).cast("string"))
        .otherwise(F.col("site_id").cast("string"))
        .alias("site_id"),
        F.concat(F.lit("Site "), F.col("site_id").cast("string")).alias("site_name"),
        F.when((F.hour(t) == 6) & (F.dayofmonth(t) == 3), F.lit("n/a"))
        .otherwise(F.col("hourly_count").cast("string"))
        .alias("hourly_count"),
        F.concat(F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit("+01:00")).alias("ts"),
        F.when(F.col("site_id") % 10 == 8, F.lit(None).cast("string"))
        .when(F.col("site_id") % 10 == 7, F.lit(""))
        .otherwise(
            F.concat(
                F.lit("48.8"), (F.col("site_id") % 10).cast("string"), F.lit(",2.3"), (F.col("site_id") % 7).cast("string")
            )
        )
        .alias("coordinates"),
        F.lit(0).alias("ingest_seq"),
        ((F.hour(t) == 3) & (F.dayofmonth(t) == 1)).alias("__repeat"),
    )
    dup = base.filter("__repeat").withColumn("ingest_seq", F.lit(1))
    return base.unionByName(dup).drop("__repeat")


def weather(counts_df: DataFrame, extra_hours: int = 0, only_after_last: bool = False) -> DataFrame:
    """Hourly weather on the hour grid spanned by ``counts_df``.

    With h the hour number from the first count hour: rain ``(7h % 10) - 6``,
    snowfall ``(11h % 50) - 47`` (both floored at 0), wind ``13h % 30``,
    apparent temperature ``(17h % 300)/10 - 5``. Hours with ``h % 37 = 0`` are
    missing, rain is NULL when ``h % 41 = 0``, and hour 1 lands twice (the
    second, later copy 1 degree warmer) so readers must dedupe (W6).

    The grid has one row per hour of the span: it grows with time, not with
    the number of events, so it is a safe broadcast side.
    """
    bounds = counts_df.agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    end = F.col("t1") + F.make_dt_interval(F.lit(0), F.lit(extra_hours)) if extra_hours else F.col("t1")
    grid = bounds.select(
        "t1", F.posexplode(F.sequence(F.col("t0"), end, F.expr("INTERVAL 1 HOUR"))).alias("h", "time")
    ).filter(F.col("h") % 37 != 0)
    if only_after_last:
        grid = grid.filter(F.col("time") > F.col("t1"))
    grid = grid.drop("t1")
    h = F.col("h").cast("long")
    w = grid.select(
        "time",
        F.when(h % 41 == 0, F.lit(None).cast("double"))
        .otherwise(F.greatest((h * 7 % 10 - 6).cast("double"), F.lit(0.0)))
        .alias("rain"),
        F.greatest((h * 11 % 50 - 47).cast("double"), F.lit(0.0)).alias("snowfall"),
        (h * 13 % 30).cast("double").alias("wind_speed_10m"),
        ((h * 17 % 300).cast("double") / F.lit(10.0) - F.lit(5.0)).alias("apparent_temperature"),
        F.lit(0).alias("ingest_seq"),
        "h",
    )
    if only_after_last:
        return w.drop("h")
    repeat = w.filter(F.col("h") == 1).withColumns(
        {"apparent_temperature": F.col("apparent_temperature") + F.lit(1.0), "ingest_seq": F.lit(1)}
    )
    return w.unionByName(repeat).drop("h")


def weather_forecast(counts_df: DataFrame, horizon_hours: int = 168) -> DataFrame:
    """Forecast weather: the same hourly formulas for the hours after the last count hour (I3 horizon)."""
    return weather(counts_df, extra_hours=horizon_hours, only_after_last=True)


def raw_clean(raw_text: DataFrame) -> DataFrame:
    """Landed text -> the typed, deduplicated raw table.

    Coerce types (bad values NULL, zone suffix dropped), drop rows with a NULL
    site or stamp, keep the first landed row per (site_id, ts).
    """
    from velora.operators.dedupe import dedupe_raw
    from velora.operators.quality import coerce_counts

    typed = coerce_counts(raw_text)
    return dedupe_raw(typed, ["site_id", "ts"], ["ingest_seq"]).select(
        "site_id", "site_name", "hourly_count", "ts", "coordinates"
    )
