"""Q1, Q3, Q4, Q6 from the load's own pass: ``DataFrame.observe`` counts while the rows are written.

The counts are read after the write, so no check is a job of its own. They are
sums and extremes over all landed rows, before rows without a key go. A lost
executor may have rows of a stage read again; the observed stage is the one that
writes the staged batch, and Spark takes the metrics of its successful tasks.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from velora.operators.quality import coerce_counts, drop_null_keys
from velora.sinks import tables as sk

_TYPED = {"site_id": "ids", "ts": "times", "hourly_count": "counts"}


def observed_counts(text: DataFrame) -> tuple[DataFrame, Observation]:
    """Typed rows with a key (P3, P4) of landed text, and the counts that a write of them fills in.

    ``rows``; ``missing_*`` (NULL or blank) and ``unreadable_*`` (other text that
    gives no value) of ids, times and counts; ``kept`` rows with a key;
    ``kept_counts`` of them with a count; ``first_ts`` and ``last_ts``.
    """
    typed = coerce_counts(text.withColumns({f"__{c}": F.trim(F.col(c).cast("string")) for c in _TYPED}))
    metrics = [F.count(F.lit(1)).alias("rows")]
    for c, name in _TYPED.items():
        blank = F.coalesce(F.col(f"__{c}") == "", F.lit(True))
        metrics += [F.count_if(blank).alias(f"missing_{name}"), F.count_if(F.col(c).isNull() & ~blank).alias(f"unreadable_{name}")]
    kept = F.col("site_id").isNotNull() & F.col("ts").isNotNull()
    metrics += [F.count_if(kept).alias("kept"), F.count_if(kept & F.col("hourly_count").isNotNull()).alias("kept_counts")]
    metrics += [F.min(F.when(kept, F.col("ts"))).alias("first_ts"), F.max(F.when(kept, F.col("ts"))).alias("last_ts")]
    seen = Observation()
    rows = typed.observe(seen, *metrics).drop(*[f"__{c}" for c in _TYPED])
    return drop_null_keys(rows), seen


def load_observed(spark: SparkSession, text: DataFrame, path: str) -> dict:
    """K1 with checks: append the new rows of landed text; returns the observed counts and how many rows were ``appended``.

    Text that gives no value is left out with a warning (Q6). It is an error if
    rows landed and none has a key (Q3, Q4); nothing is appended then.
    """
    rows, seen = observed_counts(text)
    appended = sk.append_new(spark, path, rows)
    found = dict(seen.get) | {"appended": appended}
    if found["rows"] and not found["kept"]:
        raise ValueError(f"none of {found['rows']} landed rows has a readable id and time")
    bad = {name: found[f"unreadable_{name}"] for name in _TYPED.values() if found[f"unreadable_{name}"]}
    if bad:
        warnings.warn(f"unreadable text in {found['rows']} landed rows: {bad}", stacklevel=2)
    return found
