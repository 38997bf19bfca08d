"""Registered queries: one per operator of the survey's inventory.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the
DuckDB oracle text that computes the same rows from the same driver tables
(``None`` where only a rows/schema check is possible). Double columns are
rounded to 6 places on both sides (``+ 0.0`` folds ``-0.0``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velora.registry import sql_parts as S

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def finalize(df: DataFrame) -> DataFrame:
    """Round double columns to 6 places and fold -0.0 (oracle comparison form)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append((F.round(F.col(f.name), 6) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def queries() -> dict[str, QueryFn]:
    from velora.registry import catalog_queries, file_queries, increment_queries, model_queries  # noqa: F401  (register)

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from velora.registry import catalog_queries, file_queries, increment_queries, model_queries  # noqa: F401

    return dict(_SQL)
