"""Split, encoding, scaling and run log.

* M3/W11 ``chrono_split``: the last ``int(n * ratio)`` rows in (ts, site_id)
  order are the test set. Rows are counted per hour, the cut is located on that
  small table and applied as a literal predicate.
* M1 ``fit_target_encoding``: smoothed per-site target mean,
  ``prior*(1-l) + mean*l`` with ``l = 1/(1+exp(-(n-k)/f))``; a site seen once
  or never gets the prior.
* M2 ``fit_scaler``: mean and population deviation per column on the train
  rows (zero deviation scales by 1).
* M4-M6 are in ``plans/forecaster.py``.
* M11/K8: ``model_runs`` rows (run id, start, uri, metrics map) and W9 picks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.operators.one_row import with_one_row

from velora.functions.calendar import ntz_lit


# Target-encoding smoothing parameters (the public defaults of the usual encoder).
TE_MIN_SAMPLES = 20
TE_SMOOTHING = 10.0


def split_point(df: DataFrame, ratio: float, ts: str = "ts", tie: str = "site_id"):
    """M3: (cut hour, smallest test ``tie`` in it) of the last ``int(n * ratio)`` rows; (None, None) if that is 0 rows.

    One pass counts the rows per hour; days, then the hours of one day, are
    walked on that small stored table, and only the rows of the cut hour are
    looked at one by one.
    """
    from velora.session import checkpointed

    per_ts = checkpointed(df.groupBy(ts).agg(F.count(F.lit(1)).alias("c")).withColumn("day", F.to_date(ts)))
    k = math.floor((per_ts.agg(F.sum("c")).first()[0] or 0) * ratio)
    if k <= 0:
        return None, None

    def last_at(rows: DataFrame, key: str, wanted: int):
        """The latest ``key`` from which on there are ``wanted`` rows or more, and the rows after it."""
        w = Window.orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, -1)
        after = rows.withColumn("after", F.coalesce(F.sum("c").over(w), F.lit(0)))
        r = after.filter((F.col("after") < wanted) & (F.col("after") + F.col("c") >= wanted)).first()
        return r[key], r["after"]

    day, after_day = last_at(per_ts.groupBy("day").agg(F.sum("c").alias("c")), "day", k)  # one row per day of the span
    cut, after = last_at(per_ts.filter(F.col("day") == F.lit(day)), ts, k - after_day)
    inside = df.filter(F.col(ts) == ntz_lit(cut)).select(tie).orderBy(F.col(tie).desc()).limit(k - after_day - after)
    return cut, inside.agg(F.min(tie)).first()[0]


def chrono_split(df: DataFrame, ratio: float = 0.1, ts: str = "ts", tie: str = "site_id") -> DataFrame:
    """Add ``is_test``: true for the last ``int(n * ratio)`` rows by (ts, tie), which make a row unique.

    The cut is found first (``split_point``) and applied as one literal
    predicate: no join, no window over rows. A test size of 0 keeps every row
    in train.
    """
    cut, first = split_point(df, ratio, ts, tie)
    if cut is None:
        return df.withColumn("is_test", F.lit(False))
    t = F.col(ts)
    return df.withColumn("is_test", (t > ntz_lit(cut)) | ((t == ntz_lit(cut)) & (F.col(tie) >= F.lit(first))))


def fit_target_encoding(
    train: DataFrame, col: str = "site_id", target: str = "hourly_count", k: int = TE_MIN_SAMPLES, f: float = TE_SMOOTHING
) -> DataFrame:
    """M1 fit: (col, te_value) per category, plus the prior in column ``prior``."""
    prior = train.agg(F.avg(target).alias("prior"))
    stats = train.groupBy(col).agg(F.count(target).alias("__n"), F.avg(target).alias("__m"))
    lam = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("__n") - F.lit(k)) / F.lit(f)))
    enc = F.when(F.col("__n") == 1, F.col("prior")).otherwise(F.col("prior") * (F.lit(1.0) - lam) + F.col("__m") * lam)
    return with_one_row(stats, prior).select(col, enc.alias("te_value"), "prior")


def apply_target_encoding(df: DataFrame, enc: DataFrame, col: str = "site_id", out: str | None = None) -> DataFrame:
    """M1 apply: unseen or NULL categories get the prior."""
    out = out or f"{col}_te"
    prior = enc.agg(F.first("prior").alias("__prior"))
    joined = df.join(enc.select(col, "te_value"), col, "left")
    return (
        with_one_row(joined, prior)
        .withColumn(out, F.coalesce(F.col("te_value"), F.col("__prior")))
        .drop("te_value", "__prior")
    )


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M2 fit: long form (column, mean, std) with the population deviation."""
    row = train.agg(*[F.avg(F.col(c).cast("double")).alias(f"m|{c}") for c in cols], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s|{c}") for c in cols])
    entries = [F.struct(F.lit(c).alias("column"), F.col(f"`m|{c}`").alias("mean"), F.col(f"`s|{c}`").alias("std")) for c in cols]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def scaler_params(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted scaler as {column: (mean, std)}: one row per feature column, like
    the mean/std vectors an MLlib scaler model keeps (bounded by the column count)."""
    return {r["column"]: (r["mean"], r["std"]) for r in scaler.collect()}


def apply_scaler(df: DataFrame, scaler, cols: Sequence[str]) -> DataFrame:
    """M2 apply: (x - mean) / std, std 0 or NULL -> 1, as literal column expressions (no join)."""
    params = scaler if isinstance(scaler, dict) else scaler_params(scaler)
    exprs = {}
    for c in cols:
        mean, std = params.get(c, (None, None))
        mean = 0.0 if mean is None else float(mean)
        std = 1.0 if not std else float(std)
        exprs[c] = (F.col(c).cast("double") - F.lit(mean)) / F.lit(std)
    return df.withColumns(exprs)


def linear_prediction(df: DataFrame, intercept: float, coefs: Mapping[str, float], out: str = "prediction", clip: bool = True) -> DataFrame:
    """Score a fixed linear model as a column expression (clipped at 0 like the forecast)."""
    s = F.lit(float(intercept))
    for c, w in coefs.items():
        s = s + F.lit(float(w)) * F.col(c).cast("double")
    return df.withColumn(out, F.greatest(s, F.lit(0.0)) if clip else s)


def run_record(metrics: DataFrame, name: str, run_id: str, started_at, model_uri: str) -> DataFrame:
    """One ``model_runs`` row from a metrics frame (metrics as a map)."""
    return metrics.select(
        F.lit(name).alias("name"),
        F.lit(run_id).alias("run_id"),
        ntz_lit(started_at).alias("started_at"),
        F.lit(model_uri).alias("model_uri"),
        F.create_map(F.lit("mae"), F.col("mae"), F.lit("rmse"), F.col("rmse"), F.lit("r2"), F.col("r2")).alias("metrics"),
        F.col("mae"),
        F.col("rmse"),
        F.col("r2"),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """The latest run per name by start time (ties: largest run id)."""
    w = Window.partitionBy("name").orderBy(F.col("started_at").desc(), F.col("run_id").desc())
    return runs.withColumn("__rk", F.row_number().over(w)).filter("__rk = 1").drop("__rk")


def best_run(runs: DataFrame) -> DataFrame:
    """The run with the lowest RMSE per name (ties: earliest run id)."""
    w = Window.partitionBy("name").orderBy(F.col("rmse").asc_nulls_last(), F.col("run_id"))
    return runs.withColumn("__rk", F.row_number().over(w)).filter("__rk = 1").drop("__rk")


def current_pointer(runs: DataFrame, name: str) -> DataFrame:
    """K8 read: the current pointer for ``name`` (latest row); empty means no pointer."""
    return latest_run(runs.filter(F.col("name") == F.lit(name)))


def get_pointer(runs: DataFrame, name: str):
    """K8 read as a value: the current pointer row for ``name``; a missing name raises."""
    row = current_pointer(runs, name).first()
    if row is None:
        raise KeyError(f"no model pointer named {name!r}")
    return row


def append_run(runs_path: str, record: DataFrame) -> None:
    """Add one run to the stored run log."""
    record.write.mode("append").parquet(runs_path)


def set_pointer(pointer_path: str, run: DataFrame, set_at) -> None:
    """K8: point a name at a run (one row per change; the latest counts)."""
    row = run.select("name", "run_id", "model_uri", ntz_lit(set_at).alias("started_at"))
    row.write.mode("append").parquet(pointer_path)
