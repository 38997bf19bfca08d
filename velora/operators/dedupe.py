"""One-row-per-key operators.

Where the rule is "first / last by some order", we use ``min_by``/``max_by`` on
a struct of the row, with a map-side partial step, so duplicate-heavy keys are
combined before the shuffle. Spark runs it as a sort aggregate (a struct with
strings is no hash-aggregate buffer); ``site_dimension`` therefore takes the
latest stamp in a hash aggregate first and joins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: bool) -> DataFrame:
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).distinct()
    ordering = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in rest])
    agg = F.min_by(row, ordering) if first else F.max_by(row, ordering)
    return df.groupBy(*keys).agg(agg.alias("__row")).select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the first row per key by ``order`` (e.g. ``ingest_seq``)."""
    return _pick(df, keys, order, first=True)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep the last row per key by ``order``."""
    return _pick(df, keys, order, first=False)


def dedupe_raw(df: DataFrame, keys: Sequence[str] = ("site_id", "ts"), order: Sequence[str] = ("ingest_seq",)) -> DataFrame:
    """Drop rows with a NULL key, then keep one row per key (first landed)."""
    return first_per_key(df.dropna(subset=list(keys)), keys, order)


def busiest(df: DataFrame, key: str = "site_id", value: str = "hourly_count") -> DataFrame:
    """The key with the largest value (ties: smallest key). One row."""
    return df.agg(F.min_by(F.col(key), F.struct(-F.col(value), F.col(key))).alias(key))
