"""Site statistics kept as mergeable state (K7, A1, A2).

The state has one row per (site, month): the number of rows, and n, mean, sum of
squared deviations, minimum and maximum of the non-NULL counts. Two states merge
pairwise (Chan, Golub and LeVeque 1979) without cancellation, so rows that land
later, also late ones, are added from themselves alone; the rows that landed
before are not read again. Site statistics follow from the months' rows. The row
counts also tell which rows lie within so many rows of a changed one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.operators.stats import site_stats_from_buckets

KEYS = ["site_id", "month_start"]
VALUES = ["rows", "n", "mean", "m2", "min", "max"]


def month_start(ts: str = "ts"):
    """First instant of the month of a stamp."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.lit(1), F.lit(0), F.lit(0), F.lit(0))


def month_moments(rows: DataFrame, value: str = "hourly_count") -> DataFrame:
    """The state of some rows (site_id, ts, value); rows with a NULL value count in ``rows`` only."""
    v = F.col(value).cast("double")
    return rows.groupBy("site_id", month_start().alias("month_start")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
    )


def merge_moments(a: DataFrame, b: DataFrame) -> DataFrame:
    """The state of the rows behind both states."""
    x = a.select(*KEYS, *[F.col(c).alias(f"a_{c}") for c in VALUES])
    y = b.select(*KEYS, *[F.col(c).alias(f"b_{c}") for c in VALUES])
    j = x.join(y, KEYS, "full")
    na, nb = F.coalesce("a_n", F.lit(0)), F.coalesce("b_n", F.lit(0))
    n, both = na + nb, (na > 0) & (nb > 0)
    delta = F.col("b_mean") - F.col("a_mean")
    share = nb / F.nullif(n, F.lit(0))
    return j.select(
        *KEYS,
        (F.coalesce("a_rows", F.lit(0)) + F.coalesce("b_rows", F.lit(0))).alias("rows"),
        n.alias("n"),
        F.when(both, F.col("a_mean") + delta * share).otherwise(F.coalesce("a_mean", "b_mean")).alias("mean"),
        F.when(both, F.col("a_m2") + F.col("b_m2") + delta * delta * na * share).otherwise(F.coalesce("a_m2", "b_m2")).alias("m2"),
        F.least("a_min", "b_min").alias("min"),
        F.greatest("a_max", "b_max").alias("max"),
    )


def site_stats_from_moments(state: DataFrame, with_n: bool = False) -> DataFrame:
    """A1/A2 of all rows behind the state."""
    c = F.col("n")
    buckets = state.select(
        "site_id", c.alias("__c"), (F.col("mean") * c).alias("__s"), (F.col("m2") / F.nullif(c, F.lit(0))).alias("__vp"),
        F.col("min").alias("__min"), F.col("max").alias("__max"),
    )
    return site_stats_from_buckets(buckets, with_n=with_n)
