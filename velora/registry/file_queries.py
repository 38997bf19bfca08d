"""Registered queries over landed files, stored tables and checks.

Each lands rows derived from ``events`` as the feeds would (CSV, JSON pages,
JSON column arrays, Parquet), runs the operator on the landed files and returns
what it read or stored.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from velora.functions.calendar import HOLIDAY_PERIODS, add_time_features, interval_flag_join, iso_dow
from velora.functions.scalar import as_date
from velora.operators import quality as q
from velora.operators.histref import historical_reference, rounded
from velora.plans import jobs
from velora.plans import serving as sv
from velora.registry import catalog_queries as c
from velora.registry import sql_parts as S
from velora.registry.queries import finalize, register
from velora.sinks import tables as sk
from velora.sources import files as fl
from velora.sources import tables as tb
from velora.streaming import incremental as inc

_RAW = S.with_(S.COUNTS, S.counts_raw(), S.raw_clean())
_LANDED = {v: k for k, v in fl.CSV_COLUMNS.items() if "é" in k or v != "coordinates"}


def _landed_csv(spark, sf, sep: str) -> str:
    """``counts_raw`` as the bulk export: its header names in mixed case with blanks, one more column."""
    folder = c._run_folder(spark, "csv")
    raw = tb.counts_raw(c._counts(spark, sf))
    cols = [F.col(v).alias(k.replace("_", " ").capitalize()) for v, k in _LANDED.items()]
    raw.select(*cols, F.lit("X").alias("Identifiant technique")).write.option("sep", sep).option("header", True).csv(folder)
    return folder


# a delimited file does not tell a blank field from a missing one
register("csv_bulk_read", _RAW + "SELECT site_id, site_name, hourly_count, ts, nullif(coordinates, '') AS coordinates FROM counts_raw")(
    lambda spark, sf: fl.read_counts_csv(spark, _landed_csv(spark, sf, ";"))
)
register("csv_any_separator", _RAW + "SELECT site_id, site_name, hourly_count FROM counts_raw")(
    lambda spark, sf: q.rename_columns(
        q.standardize_columns(fl.read_csv_any_sep(spark, _landed_csv(spark, sf, ","))), fl.CSV_COLUMNS
    ).select("site_id", "site_name", "hourly_count")
)


def _pages_read(spark, sf):
    folder = c._run_folder(spark, "pages")
    c._pages(tb.counts_raw(c._counts(spark, sf))).select("total_count", "results").write.option("maxRecordsPerFile", 1).json(folder)
    return fl.read_count_pages(spark, folder)


_PART = "CAST(TRY_CAST(nullif(trim(split_part(coordinates, ',', {})), '') AS DOUBLE) AS VARCHAR)"
register(
    "pages_read",
    _RAW
    + f"SELECT site_id, site_name, hourly_count, ts, coalesce({_PART.format(1)} || ',' || {_PART.format(2)}, '') AS coordinates FROM counts_raw",
)(_pages_read)

_WEATHER = ["rain", "snowfall", "apparent_temperature", "wind_speed_10m"]


def _weather_json(spark, sf):
    folder = c._run_folder(spark, "weather")
    rows = F.collect_list(F.struct(F.date_format("time", "yyyy-MM-dd'T'HH:mm").alias("time"), *_WEATHER))
    days = tb.weather(c._counts(spark, sf)).groupBy(F.to_date("time").alias("day")).agg(rows.alias("r"))
    hourly = F.struct(*[F.col(f"r.{f}").alias(f) for f in ("time", *_WEATHER)])
    days.select(hourly.alias("hourly")).write.option("maxRecordsPerFile", 1).json(folder)
    return finalize(fl.read_weather_json(spark, folder).select("time", *_WEATHER))


register(
    "weather_json_read",
    S.round_all(S.with_(S.COUNTS, S.weather_raw()) + f"SELECT time, {', '.join(_WEATHER)} FROM weather_raw", _WEATHER),
)(_weather_json)


def _month_table(spark, sf):
    """A table by month, written twice; the second write replaces the first."""
    path = c._run_folder(spark, "by-month")
    rows = c._counts_wide(spark, sf)
    sk.overwrite(sk.with_month(rows.filter("hourly_count > 1")), path, ["month"])
    sk.write_by_month(rows, path)
    return spark.read.parquet(path).select("site_id", "ts", "hourly_count", "month")


register("month_table", S.with_(S.COUNTS_WIDE) + "SELECT site_id, ts, hourly_count, strftime(ts, '%Y-%m') AS month FROM counts_wide")(_month_table)


def _small_json(spark, sf):
    path = c._run_folder(spark, "json")
    sk.write_small_json(fl.date_range(c._counts_wide(spark, sf), "ts"), path)
    return spark.read.json(path)


register(
    "small_json",
    S.with_(S.COUNTS_WIDE) + "SELECT strftime(min(ts), '%Y/%m/%d') AS first_day, strftime(max(ts), '%Y/%m/%d') AS last_day FROM counts_wide",
)(_small_json)


def _bootstrap(spark, sf):
    """The first full load appends every key once, the second finds the table filled."""
    table, csv = f"{c._run_folder(spark, 'boot')}/raw", _landed_csv(spark, sf, ";")
    before = sk.exists_and_not_empty(spark, table)
    counts = [inc.bootstrap_counts(spark, csv, table) for _ in range(2)]
    stored = spark.read.parquet(table).agg(F.count(F.lit(1)).alias("n_stored"), F.sum("hourly_count").alias("total"))
    return stored.select(
        F.lit(before).alias("existed"), F.lit(counts[0]).cast("long").alias("first_load"), F.lit(counts[1]).cast("long").alias("second_load"),
        F.lit(sk.exists_and_not_empty(spark, table)).alias("exists_now"), "n_stored", "total",
    )


register(
    "bootstrap_guard",
    _RAW
    + "SELECT false AS existed, count(*) AS first_load, 0::BIGINT AS second_load, true AS exists_now, count(*) AS n_stored, sum(hourly_count)::BIGINT AS total FROM raw",
)(_bootstrap)

_FLAGS = ["is_holiday", "is_rush_hour", "is_night", "is_rainy", "is_windy", "is_snowy"]
register(
    "model_columns",
    c.FEAT + "\nUNION ALL\n".join(f"SELECT '{x}' AS column_name, count({x}) AS n_values, sum(CAST({x} AS DOUBLE)) AS total FROM features" for x in c._NUMERIC),
)(
    lambda spark, sf: (
        lambda df, cols: df.select(F.explode(F.array(*[F.struct(F.lit(x).alias("column_name"), F.col(x).cast("double").alias("v")) for x in cols])).alias("e"))
        .groupBy(F.col("e.column_name").alias("column_name"))
        .agg(F.count("e.v").alias("n_values"), F.sum("e.v").alias("total"))
    )(c._features(spark, sf), q.infer_feature_columns(c._features(spark, sf), "hourly_count", target_encode=["site_id"], exclude=["ts"]))
)
register("flags_as_int", c.FEAT + f"SELECT site_id, ts, {', '.join(f'CAST({x} AS INTEGER) AS {x}' for x in _FLAGS)} FROM features")(
    lambda spark, sf: q.bools_to_int(
        q.drop_columns(c._features(spark, sf), [x for x in c._features(spark, sf).columns if x not in ("site_id", "ts", *_FLAGS)] + ["missing"])
    )
)


def _aligned(spark, sf):
    """Q1, Q3, Q4: the checks of the forecast job on the stored tables, and the hours they compare."""
    raw, feats = c._counts(spark, sf), c._features(spark, sf)
    q.check_aligned(raw, feats)
    q.require_rows(feats, "feature table")
    q.require_values(feats, "lag_1", "feature table")
    return raw.agg(F.max("ts").alias("raw_hour")).select("raw_hour", F.lit(str(q.latest_hour(feats))).cast("timestamp_ntz").alias("feature_hour"))


register("tables_aligned", c.FEAT + "SELECT (SELECT max(ts) FROM counts) AS raw_hour, max(ts) AS feature_hour FROM features")(_aligned)

register(
    "reference_rounded",
    S.with_(S.COUNTS_WIDE, S.hist_ref()) + "SELECT site_id, ts, level, label, n, round_even(reference, 1) AS reference FROM href",
)(lambda spark, sf: rounded(historical_reference(c._counts_wide(spark, sf), c._counts_wide(spark, sf))))

register(
    "text_dates",
    _RAW + "SELECT DISTINCT substr(ts, 1, 10) AS text, CAST(TRY_CAST(substr(ts, 1, 10) AS DATE) AS TIMESTAMP) AS day FROM counts_raw UNION ALL SELECT DISTINCT hourly_count, NULL FROM counts_raw WHERE hourly_count = 'n/a'",
)(
    lambda spark, sf: (
        lambda raw: raw.select(F.substring("ts", 1, 10).alias("text"))
        .distinct()
        .unionByName(raw.filter("hourly_count = 'n/a'").select(F.col("hourly_count").alias("text")).distinct())
        .select("text", as_date("text").cast("timestamp_ntz").alias("day"))
    )(tb.counts_raw(c._counts(spark, sf)))
)

register(
    "weather_source_choice",
    S.with_(S.COUNTS) + "SELECT DISTINCT CAST(ts AS DATE)::TIMESTAMP AS day, CASE WHEN CAST(ts AS DATE) < (SELECT CAST(max(ts) AS DATE) FROM counts) THEN 'archive' ELSE 'forecast' END AS source FROM counts",
)(
    lambda spark, sf: (
        lambda today: c._counts(spark, sf)
        .select(F.to_date("ts").alias("d"))
        .distinct()
        .select(F.col("d").cast("timestamp_ntz").alias("day"), inc.weather_source_of(F.col("d"), today).alias("source"))
    )(c._start(spark, sf).date())
)


def _gap_load(spark, sf):
    """Weather up to the tenth is stored; the load appends the days after it, once."""
    path = f"{c._run_folder(spark, 'gap')}/weather"
    raw = c._counts(spark, sf)
    landed = tb.weather(raw)
    landed.filter(F.dayofmonth("time") <= 10).write.parquet(path)
    for _ in range(2):
        jobs.weather_gap_load(spark, raw, landed, path)
    return finalize(spark.read.parquet(path).select("time", *_WEATHER))


register(
    "weather_gap_load",
    S.round_all(S.with_(S.COUNTS, S.weather_raw()) + f"SELECT time, {', '.join(_WEATHER)} FROM weather_raw", _WEATHER),
)(_gap_load)


def _sites_upsert(spark, sf):
    """K6: the dimension from the second half of the month upserted over the one from the first half."""
    path = f"{c._run_folder(spark, 'sites')}/sites"
    raw = c._raw(spark, sf)
    jobs.site_dimension_job(spark, raw.filter(F.dayofmonth("ts") <= 15), path)
    jobs.site_dimension_job(spark, raw.filter(F.dayofmonth("ts") > 15), path)
    return finalize(spark.read.parquet(sk.current_version(spark, path)))


register("sites_upsert", S.round_all(c.CHAIN + "SELECT * FROM sites", ["latitude", "longitude"]))(_sites_upsert)

register("calendar_table_flags", S.with_(S.COUNTS_WIDE) + f"SELECT site_id, ts, {S.holiday_sql('ts')} AS is_holiday FROM counts_wide")(
    lambda spark, sf: interval_flag_join(
        c._counts_wide(spark, sf).select("site_id", "ts"),
        "ts",
        spark.createDataFrame(list(HOLIDAY_PERIODS), "start_date string, end_date string").select(
            F.to_date("start_date").alias("start_date"), F.to_date("end_date").alias("end_date")
        ),
    )
)

register(
    "one_row_per_site_hour",
    S.round_all(c.CHAIN + "SELECT site_id, ts, hourly_count + 1 AS hourly_count, site_name, latitude, longitude FROM geo", c.GEO_DOUBLES),
)(
    lambda spark, sf: finalize(
        sv.one_row_per_site_hour(
            c._geo(spark, sf).unionByName(c._geo(spark, sf).withColumn("hourly_count", F.col("hourly_count") + 1))
        )
    )
)

register(
    "time_features",
    S.with_(S.COUNTS_WIDE)
    + f"""SELECT DISTINCT ts, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, CAST(isodow(ts) AS INTEGER) AS iso_dow,
  ['Lundi','Mardi','Mercredi','Jeudi','Vendredi','Samedi','Dimanche'][isodow(ts)] AS day_name,
  CAST(month(ts) AS INTEGER) AS month, CAST(hour(ts) AS INTEGER) AS hour, {S.season_sql('ts')} AS season,
  {S.night_sql('ts')} AS is_night, {S.holiday_sql('ts')} AS is_holiday, {S.rush_sql('ts')} AS is_rush_hour
FROM counts_wide""",
)(lambda spark, sf: add_time_features(c._counts_wide(spark, sf).select("ts").distinct().withColumn("iso_dow", iso_dow("ts"))))
