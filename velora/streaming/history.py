"""W8 as keyed streaming state: each site's newest values, corrected by late rows, without reading history again.

The stream of count rows is grouped by site; the state store keeps, per site,
the newest ``n`` (hour, count) pairs in time order. A row that lands late is
put into its place if it belongs to the newest ``n``, and is left out
otherwise; both are right, as a pair that was pushed out by ``n`` newer ones can
never return. Of several rows of one hour the first batch's counts, and within
a batch the smallest value, as row order means nothing there; rows without a
site, hour or count are left out. The changed sites of each batch replace their
rows in a small table (one row per site), which is what M8 starts from.

A site's rows of one batch pass through one task in Arrow batches, and only ``n``
pairs are held; ``max_files`` bounds a batch. State and output recover from the
checkpoint: a batch that is run again writes the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from velora.functions.calendar import ntz_lit
from velora.operators.history import padded
from velora.sinks import tables as sk
from velora.streaming.stream import MAX_FILES, count_stream

N = 24
_OUT = "site_id bigint, hours array<bigint>, counts array<double>"
_STATE = "hours array<bigint>, counts array<double>"
#: ``hours`` are counted from here.


def _hours(ts: str | Column) -> Column:
    """Whole hours since 1970 of a stamp without a zone."""
    return F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts) if isinstance(ts, str) else ts)


def newest_pairs(state: tuple[list, list], batches: Iterator[pd.DataFrame], n: int = N) -> tuple[list, list]:
    """The newest ``n`` hours and their counts of the state and the new rows (hour, count), oldest first."""
    held = dict(zip(*state))
    new: dict[int, float] = {}
    for rows in batches:
        rows = rows.sort_values("count").drop_duplicates("hour").nlargest(n, "hour")
        for hour, count in zip(rows["hour"], rows["count"]):
            new[int(hour)] = min(float(count), new.get(int(hour), np.inf))
        if len(new) > 4 * n:  # older hours of this batch can't be among the newest n
            new = dict(sorted(new.items())[-n:])
    pairs = sorted((new | held).items())[-n:]
    return [h for h, _ in pairs], [c for _, c in pairs]


def history_stream(counts: DataFrame, n: int = N) -> DataFrame:
    """A streaming frame (site_id, hours, counts) of the sites that a batch changes; ``counts``: site_id, ts (hours), hourly_count."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = tuple(list(x) for x in state.get) if state.exists else ([], [])
        new = newest_pairs(old, batches, n)
        state.update(new)
        if new != old:
            yield pd.DataFrame({"site_id": [key[0]], "hours": [new[0]], "counts": [new[1]]})

    hour = _hours("ts")
    rows = counts.dropna(subset=["site_id", "ts", "hourly_count"])
    rows = rows.select(F.col("site_id").cast("long"), hour.alias("hour"), F.col("hourly_count").cast("double").alias("count"))
    return rows.groupBy("site_id").applyInPandasWithState(follow, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def start_history_stream(spark: SparkSession, landing: str, table_path: str, checkpoint: str, available_now: bool = True, max_files: int = MAX_FILES, n: int = N):
    """Follow a landing folder of pages into the table of newest values (``current_version``); returns the StreamingQuery.

    Each batch is written once, replaces its sites' rows in a new version of the
    table, and then the recorded version changes: a reader sees whole batches.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        session, staged = batch.sparkSession, f"{table_path.rstrip('/')}_staging_{uuid.uuid4().hex}"
        try:
            batch.write.parquet(staged)
            changed = session.read.schema(_OUT).parquet(staged)
            if changed.isEmpty():
                return
            current = sk.current_version(session, table_path)
            table = sk.upsert(session.read.parquet(current), changed, ["site_id"]) if current else changed
            out = f"{table_path.rstrip('/')}_v{uuid.uuid4().hex[:12]}"
            table.write.parquet(out)
            sk.write_small_json(session.createDataFrame([(out,)], "version string"), f"{table_path.rstrip('/')}_current")
        finally:
            sk.remove_folder(session, staged)

    w = history_stream(count_stream(spark, landing, max_files), n).writeStream.outputMode("update")
    w = w.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def stored_history(spark: SparkSession, table_path: str, since=None, n: int = N) -> DataFrame:
    """(site_id, history): as ``last_values`` over all rows that landed, or over those not before ``since``; sites without any are left out."""
    current = sk.current_version(spark, table_path)
    table = spark.read.parquet(current) if current else spark.createDataFrame([], _OUT)
    pairs = F.arrays_zip("hours", "counts")
    if since is not None:
        first = _hours(ntz_lit(since))
        pairs = F.filter(pairs, lambda x: x["hours"] >= first)
    values = table.select("site_id", F.transform(pairs, lambda x: x["counts"]).alias("values"))
    return padded(values.filter(F.size("values") > 0), "site_id", "values", n)
