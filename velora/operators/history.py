"""The last n values per site, oldest first, padded to n.

One rank per site, cut at n: Spark limits each task to its own newest n rows per
site before it shuffles (``WindowGroupLimit``), so a site of any size reaches
its task as n rows per task of the scan, and no list holds more than n values.
A series shorter than n is left-padded with its own mean rounded half-even;
callers treat a missing site as n zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_values(df: DataFrame, key: str = "site_id", ts: str = "ts", value: str = "hourly_count", n: int = 24) -> DataFrame:
    """(key, history array<double> of length n, oldest first)."""
    t = F.col(ts)
    cut = df.select(key, t.alias("__t"), F.col(value).cast("double").alias("__v"))
    newest = Window.partitionBy(key).orderBy(F.col("__t").desc())
    cut = cut.withColumn("__rk", F.row_number().over(newest)).filter(F.col("__rk") <= n).drop("__rk")
    per_site = cut.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("__t").alias("t"), F.col("__v").alias("v")))).alias("__s"))
    vals = F.transform(F.col("__s"), lambda x: x["v"])
    return padded(per_site.select(key, vals.alias("__vals")), key, "__vals", n)


def padded(series: DataFrame, key: str, values: str, n: int = 24) -> DataFrame:
    """(key, history) of (key, values oldest first, at most n): short series begin with their own mean, rounded half-even."""
    size = F.size(values)
    mean = F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), size)
    pad = F.array_repeat(F.bround(mean, 0), F.lit(n) - size)
    return series.select(key, F.when(size >= n, F.col(values)).otherwise(F.concat(pad, F.col(values))).alias("history"))
