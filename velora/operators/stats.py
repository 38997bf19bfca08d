"""Aggregations over counts and features.

All are hash aggregates with partial (map-side) combine; a hot key is reduced
to one partial row per input split before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.operators.one_row import with_one_row

from velora.functions.calendar import ntz_lit


def site_stats(df: DataFrame, key: str = "site_id", value: str = "hourly_count", with_n: bool = False) -> DataFrame:
    """A1/A2: mean, sample std (NULL for one row), max, min per site; NULL values skipped."""
    aggs = [
        F.avg(value).cast("double").alias("site_mean"),
        F.stddev_samp(value).cast("double").alias("site_std"),
        F.min(value).cast("double").alias("site_min"),
        F.max(value).cast("double").alias("site_max"),
    ]
    if with_n:
        aggs = [F.count(value).alias("n")] + aggs
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(*aggs)


def bucket_moments(df: DataFrame, bucket: F.Column, key: str = "site_id", value: str = "hourly_count") -> DataFrame:
    """Per (key, bucket): row count ``__n``, and count / sum / population variance /
    min / max of the non-NULL values -- the mergeable partials of ``site_stats``."""
    v = F.col(value).cast("double")
    return df.withColumn("__bucket", bucket).groupBy(key, "__bucket").agg(
        F.count(F.lit(1)).alias("__n"),
        F.count(v).alias("__c"),
        F.sum(v).alias("__s"),
        F.var_pop(v).alias("__vp"),
        F.min(v).alias("__min"),
        F.max(v).alias("__max"),
    )


def site_stats_from_buckets(moments: DataFrame, key: str = "site_id", with_n: bool = False) -> DataFrame:
    """A1/A2 merged from per-bucket partials (the same merge Spark applies to its
    own partial ``stddev_samp`` buffers): M2 = sum(c_b * var_b) + sum(c_b * (mean_b - mean)^2)."""
    m = moments.filter(F.col("__c") > 0).withColumn("__mb", F.col("__s") / F.col("__c"))
    tot = m.groupBy(key).agg(F.sum("__c").alias("__tot_c"), F.sum("__s").alias("__tot_s"))
    j = m.join(tot, key).withColumn("__mean", F.col("__tot_s") / F.col("__tot_c"))
    m2 = F.col("__c") * F.col("__vp") + F.col("__c") * F.pow(F.col("__mb") - F.col("__mean"), 2)
    out = j.groupBy(key).agg(
        F.first("__tot_c").alias("n"),
        F.first("__mean").alias("site_mean"),
        F.sum(m2).alias("__m2"),
        F.min("__min").alias("site_min"),
        F.max("__max").alias("site_max"),
    )
    std = F.when(F.col("n") > 1, F.sqrt(F.col("__m2") / (F.col("n") - 1)))
    cols = [key] + (["n"] if with_n else []) + ["site_mean", std.alias("site_std"), "site_min", "site_max"]
    return out.select(*cols)


def site_stats_as_of(df: DataFrame, as_of, ts_col: str = "ts", **kw) -> DataFrame:
    """A2 restricted to history up to ``as_of`` (avoids leaking a later test period)."""
    return site_stats(df.filter(F.col(ts_col) <= ntz_lit(as_of)), **kw)


def time_range(df: DataFrame, col: str = "ts") -> DataFrame:
    """A3/A4: min and max of a time column (NULLs for an empty frame)."""
    return df.agg(F.min(col).alias("min_ts"), F.max(col).alias("max_ts"))


def months_spanned(df: DataFrame, col: str = "ts") -> DataFrame:
    """``(y2-y1)*12 + (m2-m1) + 1`` between the first and last stamp."""
    r = time_range(df, col)
    return r.select(
        ((F.year("max_ts") - F.year("min_ts")) * 12 + (F.month("max_ts") - F.month("min_ts")) + 1).alias("n_months")
    )


def table_shape(df: DataFrame, name: str) -> DataFrame:
    """A5: row and column counts of a table, as one row."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
    )


def distinct_sites(df: DataFrame, key: str = "site_id") -> DataFrame:
    """Number of distinct sites."""
    return df.agg(F.countDistinct(key).alias("n_sites"))


def regression_metrics(df: DataFrame, label: str = "y", pred: str = "prediction") -> DataFrame:
    """MAE, RMSE, R^2 and row count in one pass; the total sum of squares is n times the population variance."""
    e = F.col(pred) - F.col(label)
    y = F.col(label).cast("double")
    return df.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.sum(e * e)).alias("__sse"),
        (F.var_pop(y) * F.count(y)).alias("__sst"),
        F.count(F.lit(1)).alias("n_rows"),
    ).select(
        "mae",
        "rmse",
        F.when(F.col("__sst") > 0, F.lit(1.0) - F.col("__sse") / F.col("__sst")).alias("r2"),
        "n_rows",
    )


def mean_impute(df: DataFrame, col: str) -> DataFrame:
    """Replace NULLs of ``col`` by its mean over the frame.

    The mean is a one-row aggregate joined back (broadcast of one row), not an
    unpartitioned window over every row.
    """
    m = df.agg(F.avg(col).alias("__mean"))
    return with_one_row(df, m).withColumn(col, F.coalesce(F.col(col), F.col("__mean"))).drop("__mean")
