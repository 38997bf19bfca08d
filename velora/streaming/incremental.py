"""High-water-mark increments.

The reference pulls missing days from web feeds; here the feeds are landed
files, and these functions compute *what* to load (as one-row frames, so they
compose lazily) and run the load with the batch readers and sinks. ``today``
is always a parameter.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.operators.one_row import with_one_row

from velora.functions.calendar import floor_hour
from velora.operators.dedupe import last_per_key

DEFAULT_FIRST_DAY = "2020-01-01"


def count_gap(raw: DataFrame, today, first_day: str = DEFAULT_FIRST_DAY) -> DataFrame:
    """Days to fetch, ``max day + 1`` (or ``first_day`` when empty) to yesterday.

    One row (start_day, end_day) when there is a gap, no row otherwise.
    """
    yesterday = F.date_sub(F.lit(today).cast("date"), 1)
    m = raw.agg(F.max(F.to_date("ts")).alias("__max"))
    start = F.coalesce(F.date_add(F.col("__max"), 1), F.lit(first_day).cast("date"))
    keep = F.col("__max").isNull() | (F.col("__max") < yesterday)
    return m.filter(keep).select(start.alias("start_day"), yesterday.alias("end_day"))


def weather_gap(raw: DataFrame, weather: DataFrame) -> DataFrame:
    """Weather days to fetch: ``weather max + 1`` (or the first count day) to the last count day."""
    c = raw.agg(F.min(F.to_date("ts")).alias("__cmin"), F.max(F.to_date("ts")).alias("__cmax"))
    w = weather.agg(F.max(F.to_date("time")).alias("__wmax"))
    both = with_one_row(c, w)  # two one-row aggregates
    start = F.coalesce(F.date_add(F.col("__wmax"), 1), F.col("__cmin"))
    ok = F.col("__cmax").isNotNull() & (F.col("__wmax").isNull() | (F.col("__wmax") < F.col("__cmax")))
    return both.filter(ok).select(start.alias("start_day"), F.col("__cmax").alias("end_day"))


def weather_horizon(raw: DataFrame, weather_fc: DataFrame, horizon_hours: int = 168) -> DataFrame:
    """Forecast weather kept on ``[last count hour, + horizon]``, one row per hour (last landed wins)."""
    start = raw.agg(F.max("ts").alias("__s")).select(floor_hour("__s").alias("__s"))
    w = weather_fc.withColumn("time", floor_hour("time")).filter(F.col("time").isNotNull())
    if "ingest_seq" not in w.columns:
        w = w.withColumn("ingest_seq", F.monotonically_increasing_id())
    w = with_one_row(w, start).filter(
        (F.col("time") >= F.col("__s")) & (F.col("time") <= F.col("__s") + F.make_dt_interval(F.lit(0), F.lit(horizon_hours)))
    )
    return last_per_key(w.drop("__s"), ["time"], ["ingest_seq"])


def weather_source(end_day, today) -> str:
    """I4: ``'archive'`` for a range that ends before today, else ``'forecast'``."""
    end = dt.date.fromisoformat(str(end_day)[:10])
    now = dt.date.fromisoformat(str(today)[:10])
    return "archive" if end < now else "forecast"


def weather_source_of(day: Column, today) -> Column:
    """I4 on a column of days."""
    return F.when(day < F.lit(str(today)[:10]).cast("date"), "archive").otherwise("forecast")


def landed_days(gap: DataFrame) -> DataFrame:
    """C14 on a gap row: one row per day to fetch (an empty gap gives no rows)."""
    return gap.select(F.explode(F.sequence("start_day", "end_day")).alias("day"))


def bootstrap_counts(spark: SparkSession, csv_path: str, table_path: str) -> int:
    """First full load: skip when the table already holds rows (K14), else
    S1 -> P1-P4 -> K1. Returns the number of rows appended."""
    from velora.operators.quality import coerce_counts, drop_null_keys
    from velora.sinks.tables import append_new, exists_and_not_empty
    from velora.sources.files import read_counts_csv

    if exists_and_not_empty(spark, table_path):
        return 0
    typed = drop_null_keys(coerce_counts(read_counts_csv(spark, csv_path)))
    typed = typed.withColumn("ts", floor_hour("ts")).withColumn("ingest_seq", F.monotonically_increasing_id())
    return append_new(spark, table_path, typed)


def update_counts_from_pages(spark: SparkSession, pages_path: str, table_path: str, quarantine_path: str | None = None) -> int:
    """I1 load step: landed JSON pages -> P3/P4 -> K1. Returns the number of rows appended.

    Texts of bad pages are added to ``quarantine_path`` (default: beside the
    table), each file once; the good pages are loaded all the same.
    """
    from velora.sinks.tables import append_new
    from velora.sources.pages import page_texts, parse_pages, quarantined
    from velora.streaming.stream import page_counts

    pages = parse_pages(page_texts(spark, pages_path))
    append_new(spark, quarantine_path or f"{table_path.rstrip('/')}_quarantine", quarantined(pages), keys=("file",), ts=None)
    return append_new(spark, table_path, page_counts(pages).withColumn("ingest_seq", F.monotonically_increasing_id()))
