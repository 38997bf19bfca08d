"""Writes and table maintenance.

Tables are Parquet folders. Spark cannot overwrite a folder it is reading, so
every rewrite (upsert, dedupe, purge) writes a new version folder and returns
its path; the caller swaps its pointer. Appends are plain ``mode("append")``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.functions.calendar import ntz_lit

from velora.operators.dedupe import first_per_key, last_per_key


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)  # noqa: SLF001


def exists_and_not_empty(spark: SparkSession, path: str) -> bool:
    """The table exists and holds at least one row (reads one row, not a count)."""
    if not path_exists(spark, path):
        return False
    return not spark.read.parquet(path).limit(1).isEmpty()


def new_rows(existing: DataFrame | None, new: DataFrame, keys: Sequence[str] = ("site_id", "ts"), order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing``; within ``new`` the first landed wins."""
    keys = list(keys)
    batch = new.dropna(subset=keys)
    batch = first_per_key(batch, keys, [c for c in order if c in batch.columns]) if any(c in batch.columns for c in order) else batch.dropDuplicates(keys)
    if existing is None:
        return batch
    return batch.join(existing.select(*keys), keys, "left_anti")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a staging folder that this module made."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)  # noqa: SLF001


def _staging(path: str) -> str:
    return f"{path.rstrip('/')}_staging_{uuid.uuid4().hex}"


def append_new(
    spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str] = ("site_id", "ts"), ts: str | None = "ts",
    then: Callable[[DataFrame], None] | None = None,
) -> int:
    """K1: append the rows whose key is new and return how many were appended.

    The batch is written once (so that its source is read once), then only
    stored rows inside its time range can conflict: the stored table is read
    with that range as literal filters (pushed down, and month partitions
    pruned). A table stored by month keeps its layout: ``month`` is derived
    from ``ts`` and the rows go into their month's folder. ``then`` is called
    with the appended rows (a stored copy that lives as long as the call), so
    that what is derived from the table can follow without reading it again.
    """
    by_month = False
    existing = spark.read.parquet(path) if path_exists(spark, path) else None
    if existing is not None:
        by_month = "month" in existing.columns
    staged, picked = _staging(path), _staging(path)
    try:
        new.write.mode("overwrite").parquet(staged)
        batch = spark.read.schema(new.schema).parquet(staged)
        if existing is not None and ts and ts in keys:
            lo, hi = batch.agg(F.min(ts), F.max(ts)).first()
            if lo is None:
                return 0
            if by_month:
                existing = existing.filter(F.col("month").between(lo.strftime("%Y-%m"), hi.strftime("%Y-%m")))
            existing = existing.filter(F.col(ts).between(ntz_lit(lo), ntz_lit(hi)))
        rows = new_rows(existing, batch, keys)
        cols = [c for c in (existing.columns if existing is not None else rows.columns) if c not in ("ingest_seq", "month")]
        if existing is None and "month" in new.columns:
            by_month = True
        rows.select(*cols).write.mode("overwrite").parquet(picked)
        added = spark.read.schema(rows.select(*cols).schema).parquet(picked)
        n = added.count()
        if n and by_month:
            with_month(added, ts).write.mode("append").partitionBy("month").parquet(path)
        elif n:
            added.write.mode("append").parquet(path)
        if n and then:
            then(added)
        return n
    finally:
        remove_folder(spark, staged)
        remove_folder(spark, picked)


def upsert(existing: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None) -> DataFrame:
    """K5/K6/K7: rows of ``new`` replace rows of ``existing`` with the same key.

    Of several rows of ``new`` with one key the last by ``order`` (default: the
    other columns) counts. One hash aggregate on the batch, one anti join and a
    union; no MERGE support is needed.
    """
    keys = list(keys)
    cols = existing.columns
    rest = [c for c in cols if c not in keys]
    batch = last_per_key(new.select(*cols, *[c for c in order or () if c not in cols]), keys, list(order or rest))
    return existing.join(batch.select(*keys), keys, "left_anti").unionByName(batch.select(*cols))


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder that holds the table's current version, or None before the first write."""
    pointer = f"{path.rstrip('/')}_current"
    return spark.read.json(pointer).first()["version"] if path_exists(spark, pointer) else None


def upsert_to_new_version(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], ts: str = "ts") -> str:
    """K5: write the upserted table as a new version, sorted and by month of ``ts``; record and return its folder.

    The current version (``current_version``) is the input of the next call, so
    successive runs build on each other; readers follow the recorded pointer,
    which changes only after the new version is complete.
    """
    current = current_version(spark, path) or (path if path_exists(spark, path) else None)
    out = f"{path.rstrip('/')}_v{uuid.uuid4().hex[:12]}"
    if current:
        stored = spark.read.parquet(current)
        table = upsert(stored.drop("month"), new.drop("month"), keys)
    else:
        rest = [c for c in new.columns if c not in keys]
        table = last_per_key(new, list(keys), rest)
    write_by_month(table, out, ts)
    write_small_json(spark.createDataFrame([(out,)], "version string"), f"{path.rstrip('/')}_current")
    return out


def upsert_months(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], ts: str = "ts") -> list[str]:
    """K5 on a table stored by month: rewrite only the months that ``new`` touches; returns them.

    The rewritten months are staged in full first and then replace their
    folders (``replace_months``); other months are not read.
    """
    recover_months(spark, path)
    batch = with_month(new.drop("month"), ts)
    months = sorted(r[0] for r in batch.select("month").distinct().collect())  # one row per month of the batch
    table = spark.read.parquet(path).filter(F.col("month").isin(months)) if path_exists(spark, path) else batch.limit(0)
    replace_months(spark, path, upsert(table.drop("month"), batch.drop("month"), keys), ts)
    return months


def replace_months(spark: SparkSession, path: str, rows: DataFrame, ts: str = "ts") -> None:
    """Replace the months that ``rows`` holds, in full, by ``rows``; ``rows`` may be read from the table itself.

    The new months are staged first and their folder is recorded beside the
    table; then they replace the stored ones (dynamic partition overwrite), and
    only then do the record and the staged copy go. If the driver or the write
    is lost in between, ``recover_months`` finishes the replacement.
    """
    staged = _staging(path)
    try:
        write_by_month(rows, staged, ts)
    except BaseException:
        remove_folder(spark, staged)
        raise
    write_small_json(spark.createDataFrame([(staged,)], "staged string"), _redo(path))
    recover_months(spark, path)


def recover_months(spark: SparkSession, path: str) -> bool:
    """Finish a recorded replacement of months, if there is one; running it twice does no harm."""
    if not path_exists(spark, _redo(path)):
        return False
    record = spark.read.schema("staged string").json(_redo(path)).first()
    if record is None:  # lost before the record was complete: the table is untouched
        remove_folder(spark, _redo(path))
        return False
    _overwrite_months(spark, path, record["staged"])
    remove_folder(spark, _redo(path))
    remove_folder(spark, record["staged"])
    return True


def _overwrite_months(spark: SparkSession, path: str, staged: str) -> None:
    if not _has_months(spark, staged):  # no rows, no months
        return
    rows = spark.read.parquet(staged)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def _has_months(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)  # noqa: SLF001
    return any(f.getPath().getName().startswith("month=") for f in found)


def _redo(path: str) -> str:
    return f"{path.rstrip('/')}_redo"


def write_by_month(df: DataFrame, path: str, ts: str = "ts", key: str = "site_id") -> None:
    """K4: a table by month of ``ts``, its files sorted by (key, ts) so that filters on either skip row groups.

    Rows are dealt by month and a hash of the key: a few files per month, and
    no task holds a whole month.
    """
    dealt = with_month(df, ts).repartition("month", F.pmod(F.xxhash64(key), F.lit(8)))
    dealt.sortWithinPartitions("month", key, ts).write.mode("overwrite").partitionBy("month").parquet(path)


def append(df: DataFrame, path: str) -> int:
    """K2: append rows and return how many; they are staged first, so the source is read once."""
    spark = df.sparkSession
    staged = _staging(path)
    try:
        df.write.mode("overwrite").parquet(staged)
        rows = spark.read.schema(df.schema).parquet(staged)
        n = rows.count()
        if n:
            rows.write.mode("append").parquet(path)
        return n
    finally:
        remove_folder(spark, staged)


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] | None = None) -> None:
    """Replace a table (optionally partitioned, e.g. by month of ``ts``)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_small_json(df: DataFrame, path: str) -> None:
    """K9: a small result (metrics, a date range) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def purge_recent(df: DataFrame, now, days: int = 7, ts: str = "ts") -> DataFrame:
    """Keep rows older than ``now - days``; ``now`` is a parameter, never the clock."""
    cutoff = ntz_lit(now) - F.make_dt_interval(F.lit(days))
    return df.filter(F.col(ts) < cutoff)


def with_month(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Partition column for large feature/raw tables: the month of ``ts``."""
    return df.withColumn("month", F.date_format(F.col(ts), "yyyy-MM"))
