"""Row-position lags and rolling means over per-key time series.

``lag_k`` is the value k *rows* back within the key (not k hours back), and
``rolling_mean_n`` the mean of the n rows before the current one, NULL unless
all n exist. This is what a per-key ``Window.partitionBy(key).orderBy(ts)``
computes, but that window puts a whole key into one task. Here the series is
cut into bounded chunks instead:

1. count rows per (key, time bucket) -- a small table -- and take running
   offsets per key over it (a window over #buckets rows per key);
2. pack whole buckets into chunks on that table: a chunk is a run of buckets
   that start within the same ``chunk_rows`` rows of the key;
3. a bucket that holds any of the last H rows before a later chunk (H = max lag
   / rolling width) also goes to that chunk, as a halo;
4. deal the rows once, by (key, chunk), take lags by a window over (key,
   chunk), and drop the halo rows.

A task sees at most ``chunk_rows`` rows, one bucket and the halo buckets of a
key, whatever the key's size, and the result is identical to the single-window
form. The rows are shuffled once; the bucket table is joined to them by
whatever plan its size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BUCKET_DAYS = 28


def bucket_of(ts: str | F.Column, bucket_days: int = BUCKET_DAYS) -> F.Column:
    """The coarse time bucket used to number rows: ``bucket_days``-day blocks since 1970."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_date(F.to_date(t)) / F.lit(bucket_days)).cast("long")


def row_lags(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    value: str,
    lags: Sequence[int] = (1, 24),
    rolling: int | None = 24,
    chunk_rows: int = 65_536,
    bucket_days: int = BUCKET_DAYS,
    time_col: str | None = None,
    bucket_counts: DataFrame | None = None,
) -> DataFrame:
    """Add ``lag_<k>`` for each k and ``rolling_mean_<n>`` to ``df``.

    ``order`` must make rows unique within a key (add tie-breakers if not).
    ``time_col`` (default ``order[0]``) is the stamp used for the coarse bucket.
    ``bucket_counts`` (key, __bucket, __n) may be passed when the caller has
    already counted rows per bucket (e.g. with other statistics in one pass).
    """
    order = list(order)
    time_col = time_col or order[0]
    halo = max(list(lags) + ([rolling] if rolling else []))
    if chunk_rows < halo:
        raise ValueError("chunk_rows must be at least the largest lag / rolling width")

    with_bucket = df.withColumn("__bucket", bucket_of(time_col, bucket_days))

    # 1. offsets per (key, bucket): one row per key and bucket, windowed per key.
    per_bucket = (
        bucket_counts.select(key, "__bucket", "__n")
        if bucket_counts is not None
        else with_bucket.groupBy(key, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    )
    w_off = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_bucket.select(key, "__bucket", "__n", F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__offset"))

    # 2. chunk of each bucket.
    placed = placed.withColumn("__chunk", F.floor(F.col("__offset") / F.lit(chunk_rows)))

    # 3. later chunks that start fewer than `halo` rows behind a bucket's end; they are among its next `halo` buckets.
    following = Window.partitionBy(key).orderBy("__bucket").rowsBetween(1, halo)
    near = F.collect_list(F.struct(F.col("__offset").alias("o"), F.col("__chunk").alias("c"))).over(following)
    end, own = F.col("__offset") + F.col("__n"), F.struct(F.col("__chunk").alias("c"), F.lit(False).alias("h"))
    later = F.array_distinct(F.transform(F.filter("__near", lambda x: (x["o"] < end + halo) & (x["c"] > F.col("__chunk"))), lambda x: x["c"]))
    copies = placed.withColumn("__near", near).select(
        key, "__bucket", F.concat(F.array(own), F.transform(later, lambda c: F.struct(c.alias("c"), F.lit(True).alias("h")))).alias("__copies")
    )
    spread = (
        with_bucket.join(copies, [key, "__bucket"])
        .withColumn("__copy", F.explode("__copies"))
        .select(*df.columns, F.col("__copy.c").alias("__chunk"), F.col("__copy.h").alias("__halo"))
        .repartition(key, "__chunk")
    )

    # 4. lags inside each chunk.
    w = Window.partitionBy(key, "__chunk").orderBy(*order)
    cols = {f"lag_{k}": F.lag(F.col(value), k).over(w).cast("double") for k in lags}
    if rolling:
        wr = w.rowsBetween(-rolling, -1)
        cols[f"rolling_mean_{rolling}"] = F.when(
            F.count(F.col(value)).over(wr) == F.lit(rolling), F.avg(F.col(value)).over(wr)
        )
    out = spread.withColumns(cols).filter(~F.col("__halo"))
    return out.drop("__chunk", "__halo")


def drop_warmup(df: DataFrame, cols: Sequence[str] = ("lag_1", "lag_24", "rolling_mean_24")) -> DataFrame:
    """Drop rows where any lag feature is NULL (the first rows of each key)."""
    return df.dropna(subset=list(cols))
