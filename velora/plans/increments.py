"""Landing rows without recomputing what did not change.

Three stored tables go together: raw counts by month, the moments of (site,
month) (``operators.moments``), and the feature table without site statistics
(``CORE_COLUMNS``), by month. ``land_counts`` appends the new rows of a batch
and adds them to the moments. ``update_features`` then rebuilds the rows whose
lags can have changed: those of the new rows and of the 24 rows after each of
them in their site. Both read the touched months only. ``feature_view`` joins
the statistics of all history, so that it equals a full build at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velora.operators import moments as mo
from velora.plans.features import core_features, prepare_weather, with_site_stats
from velora.sinks import tables as sk

REACH = 24  # rows before a row that its lags and rolling mean look at


def _months(df: DataFrame, ts: str = "ts") -> list[str]:
    """The distinct months of a frame: one short text per month."""
    return sorted(r[0] for r in df.select(F.date_format(ts, "yyyy-MM")).distinct().collect())


def _of_months(df: DataFrame, months: list[str]) -> DataFrame:
    return df.filter(F.col("month").isin(months))


def land_counts(spark: SparkSession, new: DataFrame, raw_path: str, moments_path: str, changes_path: str) -> int:
    """K1 + K7: append the rows with new keys, add them to the moments, note their keys; returns how many.

    ``changes_path`` collects (site_id, ts) of appended rows until
    ``update_features`` has seen them. If an earlier call was lost between its
    append and its merge, the moments of a month disagree with the month's
    number of raw rows (known from file footers); such months are taken from
    raw again, whole, when they are next touched.
    """
    sk.recover_months(spark, moments_path)

    def follow(added: DataFrame) -> None:
        rows = added.select("site_id", "ts", "hourly_count")
        rows.select("site_id", "ts").write.mode("append").parquet(changes_path)
        merge_landed(spark, rows, raw_path, moments_path)

    if not sk.path_exists(spark, raw_path):
        new = sk.with_month(new)  # the first landing sets the layout
    return sk.append_new(spark, raw_path, new, then=follow)


def merge_landed(spark: SparkSession, rows: DataFrame, raw_path: str, moments_path: str) -> None:
    """Add appended rows to the stored moments; only the touched months are read and written."""
    months = _months(rows)
    merged = mo.month_moments(rows)
    if sk.path_exists(spark, moments_path):
        stored = _of_months(spark.read.parquet(moments_path), months).drop("month")
        merged = mo.merge_moments(stored, merged)
    sk.replace_months(spark, moments_path, merged, "month_start")
    stale = stale_months(spark, raw_path, moments_path, months)
    if stale:
        sk.replace_months(spark, moments_path, mo.month_moments(_of_months(spark.read.parquet(raw_path), stale)), "month_start")


def stale_months(spark: SparkSession, raw_path: str, moments_path: str, months: list[str]) -> list[str]:
    """The months whose moments do not have as many rows as raw: counted from the months' file footers."""
    raw = _of_months(spark.read.parquet(raw_path), months).groupBy("month").agg(F.count(F.lit(1)).alias("n"))
    state = _of_months(spark.read.parquet(moments_path), months).groupBy("month").agg(F.sum("rows").alias("m"))
    return sorted(r["month"] for r in raw.join(state, "month", "full").filter(~F.col("n").eqNullSafe(F.col("m"))).collect())


def changed_months(state: DataFrame, touched: DataFrame, reach: int = REACH) -> DataFrame:
    """(site_id, month_start, rebuild): the months to read, and whether to rebuild or only to look back at them.

    ``touched`` (site_id, month_start) has the months with new rows. A later
    month is rebuilt too if it starts fewer than ``reach`` rows behind the last
    row of a touched one; an earlier one is read if it ends fewer than ``reach``
    rows before a rebuilt one. Row numbers come from the moments and count the
    rows with a value only, as the lags do.
    """
    state = state.select("site_id", "month_start", F.col("n").alias("rows")).join(touched.select("site_id").distinct(), "site_id", "left_semi")
    state = state.join(touched.distinct().withColumn("__t", F.lit(True)), mo.KEYS, "left")
    w = Window.partitionBy("site_id").orderBy("month_start")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    s = state.withColumn("__end", F.sum("rows").over(w)).withColumn("__begin", F.col("__end") - F.col("rows"))
    last = F.max(F.when(F.col("__t"), F.col("__end"))).over(before)
    s = s.withColumn("rebuild", F.coalesce(F.col("__t"), F.col("__begin") - last < reach, F.lit(False)))
    first = F.min(F.when(F.col("rebuild"), F.col("__begin"))).over(after)
    s = s.withColumn("__look", F.coalesce(first - F.col("__end") < reach, F.lit(False)))
    return s.filter("rebuild OR __look").select(*mo.KEYS, "rebuild")


def update_features(
    spark: SparkSession, raw_path: str, weather_path: str, moments_path: str, changes_path: str, features_path: str,
    holidays: DataFrame | None = None, weather_changes: DataFrame | None = None,
) -> list[str]:
    """M10 on what changed since the last call; returns the months rewritten.

    ``weather_changes`` (time) names hours whose weather landed later than the
    counts: their months are rebuilt for every site that has rows in them. The
    noted changes are dropped only after the features are stored; a call that
    is lost on the way is done again by the next. Landing and updating take
    turns: there is one writer at a time.
    """
    sk.recover_months(spark, features_path)
    state = spark.read.parquet(moments_path)
    parts = []
    if sk.path_exists(spark, changes_path):
        changes = spark.read.schema("site_id bigint, ts timestamp_ntz").parquet(changes_path)
        parts.append(changes.select("site_id", mo.month_start().alias("month_start")).distinct())
    if weather_changes is not None:
        hours = weather_changes.select(mo.month_start("time").alias("month_start")).distinct()
        parts.append(state.join(hours, "month_start", "left_semi").select("site_id", "month_start"))
    if not parts:
        return []
    touched = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()
    plan = changed_months(state, touched)
    wanted = plan.select(F.date_format("month_start", "yyyy-MM").alias("m"), "rebuild").groupBy("m").agg(F.max("rebuild").alias("rebuild")).collect()
    months = sorted(r["m"] for r in wanted if r["rebuild"])
    if not months:
        return []

    raw = _of_months(spark.read.parquet(raw_path), [r["m"] for r in wanted])
    base = raw.select("site_id", "ts", "hourly_count", mo.month_start().alias("month_start")).join(plan.select(*mo.KEYS), mo.KEYS, "left_semi")
    weather = prepare_weather(spark.read.parquet(weather_path))
    fresh = core_features(base.drop("month_start").dropna(), weather, holidays=holidays)
    rebuilt = plan.filter("rebuild").select(*mo.KEYS)
    fresh = fresh.withColumn("month_start", mo.month_start()).join(rebuilt, mo.KEYS, "left_semi").drop("month_start")
    if sk.path_exists(spark, features_path):
        stored = _of_months(spark.read.parquet(features_path), months).drop("month").withColumn("month_start", mo.month_start())
        fresh = stored.join(rebuilt, mo.KEYS, "left_anti").drop("month_start").unionByName(fresh)
    sk.replace_months(spark, features_path, fresh)
    if sk.path_exists(spark, changes_path):
        sk.remove_folder(spark, changes_path)
    return months


def feature_view(spark: SparkSession, features_path: str, moments_path: str) -> DataFrame:
    """The 25-column feature table: stored features with the statistics of all landed history (A2)."""
    return with_site_stats(spark.read.parquet(features_path).drop("month"), mo.site_stats_from_moments(spark.read.parquet(moments_path)))
