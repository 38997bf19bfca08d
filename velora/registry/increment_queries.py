"""Registered queries over feeds that land in parts (S1-S3, U1, I1-I3, I7, K1, K7, M9, M10): bad pages, dialects per
file, tables that follow their landings, and the jobs as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from velora.functions.scalar import coord_part
from velora.operators import histindex as hx
from velora.operators import moments as mo
from velora.operators.observed import load_observed
from velora.operators.recursive import LinearScorer
from velora.plans import increments as inc
from velora.plans import jobs
from velora.registry import catalog_queries as c
from velora.registry import sql_parts as S
from velora.registry.queries import finalize, register
from velora.sinks import tables as sk
from velora.sources import files as fl
from velora.sources import pages as pg
from velora.sources import tables as tb

_RAW = S.with_(S.COUNTS, S.counts_raw(), S.raw_clean())

# --- pages: one folder per day, a page per block of 1000 site ids (rows without an id: by the end of the name) ---


def _block():
    return F.coalesce(F.floor(F.col("site_id").try_cast("long") / 1000), F.lit(-1) - F.substring("site_name", -2, 2).cast("long"))


def _landed_pages(spark, sf, folder: str, broken: bool) -> None:
    """``counts_raw`` as pages. Broken: every seventh page is cut off after two thirds, every seventh lacks its last record."""
    raw = tb.counts_raw(c._counts(spark, sf)).withColumn("day", F.substring("ts", 1, 10)).withColumn("page", _block())
    rec = F.struct(
        F.col("site_id").alias("id"), F.col("site_name").alias("name"), F.col("hourly_count").alias("sum_counts"), F.col("ts").alias("date"),
        F.struct(coord_part("coordinates", 1).alias("lat"), coord_part("coordinates", 2).alias("lon")).alias("coordinates"),
    )
    total = raw.groupBy("day").agg(F.count(F.lit(1)).alias("total_count"))
    pages = raw.groupBy("day", "page").agg(F.collect_list(rec).alias("results")).join(total, "day")
    kind = F.pmod(F.col("page") + F.substring("day", 9, 2).cast("int"), F.lit(7))
    results = F.when(kind == 5, F.slice("results", 1, F.size("results") - 1)).otherwise(F.col("results")) if broken else F.col("results")
    text = F.to_json(F.struct("total_count", results.alias("results")))
    if broken:
        text = F.when(kind == 3, F.left(text, F.floor(F.length(text) * 2 / 3).cast("int"))).otherwise(text)
    dealt = pages.select("day", "page", text.alias("value")).repartition("day")
    dealt.write.partitionBy("day", "page").option("maxRecordsPerFile", 1).mode("append").text(folder)


_PAGES_SQL = """, dealt AS (
  SELECT substr(ts, 1, 10) AS day, coalesce(TRY_CAST(site_id AS BIGINT) // 1000, -1 - CAST(right(site_name, 2) AS BIGINT)) AS page FROM counts_raw),
per_day AS (SELECT day, count(*) AS total FROM dealt GROUP BY day),
pages AS (
  SELECT day, page, count(*) AS n, ((page + CAST(substr(day, 9, 2) AS BIGINT)) % 7 + 7) % 7 AS kind FROM dealt GROUP BY day, page),
report AS (
  SELECT day, page, CASE WHEN kind <> 3 THEN total END AS announced,
    CASE kind WHEN 3 THEN 0 WHEN 5 THEN n - 1 ELSE n END AS landed, CASE WHEN kind = 3 THEN 'unreadable' END AS reason
  FROM pages JOIN per_day USING (day))
"""
_PAGE = "CAST(regexp_extract(file, '/page=(-?[0-9]+)/', 1) AS BIGINT) AS page"
_DAY = "substr(request, 5) AS day"


def _parsed(spark, sf):
    folder = c._run_folder(spark, "broken-pages")
    _landed_pages(spark, sf, folder, broken=True)
    return pg.parse_pages(pg.page_texts(spark, folder))


register("page_report", _RAW[:-1] + _PAGES_SQL + "SELECT day, page, announced, landed, reason FROM report")(
    lambda spark, sf: pg.page_report(_parsed(spark, sf)).selectExpr(_DAY, _PAGE, "announced", "landed", "reason")
)
register(
    "request_totals",
    _RAW[:-1]
    + _PAGES_SQL
    + """SELECT day, count(*) AS pages, max(announced) AS announced, sum(landed)::BIGINT AS landed, count(reason) AS bad_pages,
  CASE WHEN max(announced) IS NOT NULL THEN greatest(max(announced) - sum(landed), 0)::BIGINT END AS missing, coalesce(max(announced) - sum(landed) <= 0, false) AS complete FROM report GROUP BY day""",
)(lambda spark, sf: pg.request_totals(_parsed(spark, sf)).selectExpr(_DAY, "pages", "announced", "landed", "bad_pages", "missing", "complete"))


def _streamed(spark, sf, mended: bool):
    """I7 on broken pages; mended: the whole pages land after them, beside the broken ones."""
    from velora.streaming.stream import start_count_ingest

    root = c._run_folder(spark, "stream-pages")
    landing, table = f"{root}/landing", f"{root}/raw"
    for broken in (True, False) if mended else (True,):
        _landed_pages(spark, sf, landing, broken)
        start_count_ingest(spark, landing, table, f"{root}/checkpoint").awaitTermination()
    return table


register(
    "stream_quarantine",
    _RAW[:-1] + _PAGES_SQL + "SELECT day, page, reason, true AS has_text FROM report WHERE reason IS NOT NULL",
)(
    lambda spark, sf: spark.read.parquet(_streamed(spark, sf, False) + "_quarantine").selectExpr(
        _DAY, _PAGE, "reason", "length(text) > 0 AS has_text"
    )
)
register("stream_mended", _RAW + "SELECT site_id, ts, hourly_count FROM raw")(
    lambda spark, sf: spark.read.parquet(_streamed(spark, sf, True)).select("site_id", "ts", "hourly_count")
)


# --- CSV files of several dialects in one folder ---


def _mixed_csv(spark, sf):
    """The export in two dialects: semicolons, and commas with another column order, other spellings and quotes."""
    folder = c._run_folder(spark, "mixed-csv")
    raw = tb.counts_raw(c._counts(spark, sf))
    names = {v: k for k, v in fl.CSV_COLUMNS.items() if v != "coordinates" or "é" in k}
    plain = {v: k for k, v in fl.CSV_COLUMNS.items() if v != "coordinates" or "é" not in k}
    odd = F.hour(F.substring("ts", 1, 19).cast("timestamp_ntz")) % 2 == 1
    first = [F.col(v).alias(k.replace("_", " ").capitalize()) for v, k in names.items()]
    second = [F.lit("a,b").alias("Note"), *[F.col(v).alias(k) for v, k in reversed(plain.items())]]
    raw.filter(odd).select(*first, F.lit("X").alias("Identifiant technique")).write.option("sep", ";").option("header", True).csv(folder)
    raw.filter(~odd).select(*second).write.mode("append").option("sep", ",").option("header", True).csv(folder)
    return fl.read_counts_any_csv(spark, folder)


register("csv_mixed_dialects", _RAW + "SELECT site_id, site_name, hourly_count, ts, nullif(coordinates, '') AS coordinates FROM counts_raw")(_mixed_csv)


# --- tables that follow their landings (K1, K7, M10), and whole jobs (M9, I1-I3) ---


def _land(spark, sf, parts, features: bool):
    """``counts_wide`` lands in parts; moments follow each landing, and the feature table where asked."""
    root = c._run_folder(spark, "landings")
    raw, moments, changes, feats, weather = (f"{root}/{x}" for x in ("raw", "moments", "changes", "features", "weather"))
    wide = c._counts_wide(spark, sf)
    if features:
        tb.weather(wide).write.parquet(weather)
    for part in parts:
        inc.land_counts(spark, wide.filter(part), raw, moments, changes)
        if features:
            inc.update_features(spark, raw, weather, moments, changes, feats)
    return feats, moments


_THIRD = "pmod(dayofyear(ts) + hour(ts), 3)"
_STATS = ["site_mean", "site_std", "site_min", "site_max"]
register("site_stats_landed", S.round_all(S.with_(S.COUNTS_WIDE, S.site_stats("counts_wide", with_n=True)) + "SELECT * FROM stats", _STATS))(
    lambda spark, sf: finalize(
        mo.site_stats_from_moments(spark.read.parquet(_land(spark, sf, [f"{_THIRD} = {k}" for k in (1, 0, 2)], False)[1]), with_n=True)
    )
)

_LATE = "(date_format(ts, 'yyyy-MM') = '2024-06' AND pmod(site_id, 10) = 3)"
_NEW = "(ts >= TIMESTAMP_NTZ '2025-03-01 00:00:00')"
register("features_landed", S.round_all(S.with_(S.COUNTS_WIDE, S.features("counts_wide")) + "SELECT * FROM features", c.FEATURE_DOUBLES))(
    lambda spark, sf: finalize(inc.feature_view(spark, *_land(spark, sf, [f"NOT {_LATE} AND NOT {_NEW}", _LATE, _NEW], True)))
)


def _landed_references(spark, sf):
    """A16 from the index that three landings made, the oldest rows among the last."""
    root = c._run_folder(spark, "reference-index")
    wide = c._counts_wide(spark, sf)
    for k in (1, 2, 0):
        sk.append_new(spark, f"{root}/raw", sk.with_month(wide.filter(f"{_THIRD} = {k}")), then=lambda rows: hx.land_index(spark, rows, f"{root}/index"))
    return finalize(hx.reference_from_index(spark.read.parquet(f"{root}/index"), wide))


register("reference_landed", S.round_all(S.with_(S.COUNTS_WIDE, S.hist_ref()) + "SELECT * FROM href", ["reference"]))(_landed_references)


# --- Q1, Q3, Q4, Q6 from the load's own pass ---

_SEEN = "rows missing_ids unreadable_ids missing_times unreadable_times missing_counts unreadable_counts kept kept_counts appended".split()


def _observed_loads(spark, sf):
    """``counts_raw`` as it lands, and with unreadable ids and times and missing times; one row of counts each."""
    root = c._run_folder(spark, "observed")
    raw = tb.counts_raw(c._counts(spark, sf))
    at = F.substring("ts", 9, 5)
    harmed = raw.withColumns(
        {
            "site_id": F.when(at == "06 09", F.lit("S-7")).otherwise(F.col("site_id")),
            "ts": F.when(at == "04 07", F.lit("not a time")).when(at == "05 08", F.lit(" ")).otherwise(F.col("ts")),
        }
    )
    out = []
    for name, text in (("as landed", raw), ("harmed", harmed)):
        seen = load_observed(spark, text, f"{root}/{name.replace(' ', '-')}")
        out.append((name, *[seen[k] for k in _SEEN], seen["first_ts"], seen["last_ts"]))
    types = ", ".join(f"{k} bigint" for k in _SEEN)
    return spark.createDataFrame(out, f"load string, {types}, first_ts timestamp_ntz, last_ts timestamp_ntz")


_OBSERVED_SQL = """, landed AS (SELECT 'as landed' AS load, site_id, hourly_count, ts FROM counts_raw
  UNION ALL SELECT 'harmed', CASE WHEN substr(ts, 9, 5) = '06 09' THEN 'S-7' ELSE site_id END, hourly_count,
    CASE substr(ts, 9, 5) WHEN '04 07' THEN 'not a time' WHEN '05 08' THEN ' ' ELSE ts END FROM counts_raw),
typed AS (SELECT *, TRY_CAST(site_id AS BIGINT) AS i, TRY_CAST(substr(ts, 1, 19) AS TIMESTAMP) AS t, TRY_CAST(hourly_count AS BIGINT) AS v FROM landed)
SELECT load, count(*) AS rows,
  count(*) FILTER (coalesce(trim(site_id), '') = '') AS missing_ids, count(*) FILTER (i IS NULL AND trim(site_id) <> '') AS unreadable_ids,
  count(*) FILTER (coalesce(trim(ts), '') = '') AS missing_times, count(*) FILTER (t IS NULL AND trim(ts) <> '') AS unreadable_times,
  count(*) FILTER (coalesce(trim(hourly_count), '') = '') AS missing_counts, count(*) FILTER (v IS NULL AND trim(hourly_count) <> '') AS unreadable_counts,
  count(*) FILTER (i IS NOT NULL AND t IS NOT NULL) AS kept, count(v) FILTER (i IS NOT NULL AND t IS NOT NULL) AS kept_counts,
  count(DISTINCT (i, t)) FILTER (i IS NOT NULL AND t IS NOT NULL) AS appended,
  min(t) FILTER (i IS NOT NULL) AS first_ts, max(t) FILTER (i IS NOT NULL) AS last_ts
FROM typed GROUP BY load"""

register("observed_loads", _RAW[:-1] + _OBSERVED_SQL)(_observed_loads)


def _history_streamed(spark, sf):
    """W8 as streaming state: pages land in three runs, the newest days first and the oldest last."""
    from velora.streaming.history import start_history_stream, stored_history

    root = c._run_folder(spark, "history-stream")
    pages = c._pages(tb.counts_raw(c._counts(spark, sf)))
    for lo, hi in (("21", "99"), ("00", "11"), ("11", "21")):
        day = F.substring("day", 9, 2)
        part = pages.filter((day >= lo) & (day < hi)).select("total_count", "results")
        part.repartition(4).write.mode("append").option("maxRecordsPerFile", 1).json(f"{root}/landing")
        start_history_stream(spark, f"{root}/landing", f"{root}/history", f"{root}/checkpoint").awaitTermination()
    return stored_history(spark, f"{root}/history").select("site_id", F.transform("history", lambda x: F.round(x, 6) + F.lit(0.0)).alias("history"))


register(
    "history_streamed",
    _RAW[:-1] + ", " + S.history24("raw", "raw", "hist", 100000) + " SELECT site_id, list_transform(history, lambda x: round(x, 6) + 0.0) AS history FROM hist",
)(_history_streamed)


def _forecast_job(spark, sf):
    """M9 over stored tables, twice into one forecast table by month; the second run replaces the first's values."""
    root = c._run_folder(spark, "forecast-job")
    raw, feats, wfc, stats, out = (f"{root}/{x}" for x in ("raw", "features", "wfc", "stats", "forecast"))
    counts = c._counts(spark, sf)
    sk.write_by_month(counts, raw)
    sk.write_by_month(c._features(spark, sf), feats)
    jobs.weather_forecast_job(spark, raw, tb.weather_forecast(counts), wfc)
    jobs.site_features_job(spark, raw, stats)
    half = LinearScorer(1.0, {"lag_1": 0.5})
    for k, scorer in enumerate((half, None)):
        jobs.forecast_job(spark, raw, feats, wfc, out, c._start(spark, sf) + c._td(k), scorer, stats_path=stats, by_month=True)
    return finalize(spark.read.parquet(out).select("site_id", "ts", "hourly_count"))


register("forecast_job", S.round_all(c.CHAIN + "SELECT site_id, ts, hourly_count FROM fc", ["hourly_count"]))(_forecast_job)


def _update_job(spark, sf):
    """The broken pages land first, the whole ones after them; counts, weather and sites follow each."""
    root = c._run_folder(spark, "update-job")
    at = {x: f"{root}/{x}" for x in ("pages1", "pages2", "raw", "weather", "wfc", "sites")}
    counts = c._counts(spark, sf)
    for k, broken in (("pages1", True), ("pages2", False)):
        _landed_pages(spark, sf, at[k], broken)
        jobs.update_job(
            spark, at[k], tb.weather(counts), tb.weather_forecast(counts), at["raw"], at["weather"], at["wfc"], at["sites"]
        )
    sites = spark.read.parquet(sk.current_version(spark, at["sites"])).select("site_id", F.col("latitude").isNotNull().cast("int").alias("placed"))
    raw = spark.read.parquet(at["raw"]).join(sites, "site_id", "left")
    return raw.groupBy("site_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("hourly_count").alias("total"), F.max("ts").alias("last_ts"), F.coalesce(F.max("placed"), F.lit(0)).alias("placed")
    )


register(
    "update_job",
    c.CHAIN + "SELECT r.site_id, count(*) AS n, sum(hourly_count)::BIGINT AS total, max(ts) AS last_ts, max(CASE WHEN s.latitude IS NULL THEN 0 ELSE 1 END)::INTEGER AS placed FROM raw r LEFT JOIN sites s ON s.site_id = r.site_id GROUP BY 1",
)(_update_job)
