"""Attaching a one-row result (a global aggregate) to every row of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Append the columns of ``one`` to every row of ``df``.

    ``one`` is a global aggregate (``agg`` without grouping) or another frame
    of exactly one row; any other number of rows is an error when the plan
    runs. So the join is a broadcast of one row and never emits row pairs. This
    is how a scalar computed by Spark (a mean, a prior, a horizon bound)
    reaches a row-level expression without passing through the driver.
    """
    only = one.agg(*[F.first(F.col(c)).alias(c) for c in one.columns], F.count(F.lit(1)).alias("__rows"))
    is_one = F.when(F.col("__rows") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("with_one_row needs exactly one row")).cast("boolean"))
    return df.crossJoin(F.broadcast(only.filter(is_one).drop("__rows")))
