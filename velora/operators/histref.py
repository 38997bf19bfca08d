"""Historical reference for (site, hour) targets, with a 4-step fallback.

For a target hour t (day d, clock hour h) the candidate windows all end at
t - 1h (inclusive):

1. the 4 weeks before, same weekday and hour   -> rows at t - 7k days, k = 1..4
2. the 8 weeks before, same weekday and hour   -> k = 1..8
3. the 8 weeks before, same hour               -> rows at t - j days, j = 1..56
4. the 8 weeks before, any hour                -> [t - 56 days, t - 1h]

The first window holding a row (with a non-NULL count) wins; its mean is the
reference and its row count is reported. No window -> no row.

Plan: no range join and no per-target expansion. Raw rows are aggregated per
(site, day, hour) (sum, non-NULL count, row count). Each target adds a zero
"probe" row at its own (site, d, h), and one at (site, d - 56, h). Window sums
over RANGE frames of day numbers then give every level at the probe rows:

* level 3: partition (site, hour), days [-56, -1];
* levels 1 and 2: partition (site, hour, weekday), days [-28, -7] and [-56, -7];
* level 4: day d before h (partition (site, day), hours before the probe), day
  d - 56 from h on (hours from the probe on), and the whole days d-55..d-1
  from daily totals (partition site, days [-55, -1]).

Partitions are bounded by the calendar, not by the data: (site, hour) and
(site, hour, weekday) hold one row per day or week of the span, (site, day)
at most 24 rows plus probes, and the daily series one row per day. A hot
site costs no more than a quiet one with the same span.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velora.functions.calendar import floor_hour, ntz_lit

# Labels of the four windows (our wording).
LEVEL_LABELS = (
    "4-week mean (same weekday and hour)",
    "8-week mean (same weekday and hour)",
    "8-week mean (same hour)",
    "8-week mean (all hours)",
)
SPAN_DAYS = 56
_V = ("s", "c", "r")  # sum of values, non-NULL count, row count


def hourly_cells(raw: DataFrame, key: str = "site_id", ts: str = "ts", value: str = "hourly_count") -> DataFrame:
    """(key, day, hour, s, c, r): one row per site and clock hour that has data."""
    t = floor_hour(ts)
    v = F.col(value).cast("double")
    return (
        raw.select(key, F.to_date(t).alias("day"), F.hour(t).alias("hour"), v.alias("__v"))
        .groupBy(key, "day", "hour")
        .agg(F.coalesce(F.sum("__v"), F.lit(0.0)).alias("s"), F.count("__v").alias("c"), F.count(F.lit(1)).alias("r"))
    )


def _sums(w: Window, prefix: str) -> list[F.Column]:
    return [F.sum(F.col(x)).over(w).alias(f"{prefix}_{x}") for x in _V]


def historical_reference(
    raw: DataFrame, targets: DataFrame, key: str = "site_id", ts: str = "ts", value: str = "hourly_count"
) -> DataFrame:
    """(site_id, ts, level, label, n, reference) for each target with some history.

    The targets' first and last hour are resolved first, so that only the 56
    days before them are read (literal, pushed-down bounds), and of those only
    the targets' sites.
    """
    lo, hi = targets.agg(F.min(floor_hour(ts)), F.max(floor_hour(ts))).first()
    if lo is not None:
        first = ntz_lit(lo.replace(hour=0) - dt.timedelta(days=SPAN_DAYS))
        raw = raw.filter((F.col(ts) >= first) & (F.col(ts) < ntz_lit(hi)))
    raw = raw.join(targets.select(key).distinct(), key, "left_semi")
    tg = targets.select(key, floor_hour(ts).alias("__t")).distinct()
    tg = tg.select(key, "__t", F.to_date("__t").alias("day"), F.hour("__t").alias("hour"))
    cells = hourly_cells(raw, key, ts, value).withColumn("__kind", F.lit(0)).withColumn("__t", F.lit(None).cast("timestamp_ntz"))
    zeros = [F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("c"), F.lit(0).cast("bigint").alias("r")]
    probe_now = tg.select(key, "day", "hour", *zeros, F.lit(1).alias("__kind"), "__t")
    probe_first = tg.select(key, F.date_sub("day", SPAN_DAYS).alias("day"), "hour", *zeros, F.lit(2).alias("__kind"), "__t")
    u = cells.unionByName(probe_now).unionByName(probe_first).withColumns(
        {"__dn": F.unix_date("day"), "__wd": F.dayofweek("day")}
    )

    w3 = Window.partitionBy(key, "hour").orderBy("__dn").rangeBetween(-SPAN_DAYS, -1)
    w1 = Window.partitionBy(key, "hour", "__wd").orderBy("__dn").rangeBetween(-28, -7)
    w2 = Window.partitionBy(key, "hour", "__wd").orderBy("__dn").rangeBetween(-SPAN_DAYS, -7)
    before = Window.partitionBy(key, "day").orderBy("hour").rangeBetween(Window.unboundedPreceding, -1)
    from_h = Window.partitionBy(key, "day").orderBy("hour").rangeBetween(0, Window.unboundedFollowing)
    scored = u.select(
        key, "__t", "__kind", "day",
        *_sums(w1, "l1"), *_sums(w2, "l2"), *_sums(w3, "l3"), *_sums(before, "b"), *_sums(from_h, "f"),
    ).filter(F.col("__kind") > 0)
    # one row per target: the probe at d carries levels 1-3 and the part of day
    # d before h, the probe at d-56 the part of that day from h on. Combining
    # them with a group-by (not a self-join) keeps a single evaluation of the
    # windows above.
    is_now = F.col("__kind") == 1
    now_cols = [f"{p}_{x}" for p in ("l1", "l2", "l3", "b") for x in _V]
    first_cols = [f"f_{x}" for x in _V]
    combined = scored.groupBy(key, "__t").agg(
        F.max(F.when(is_now, F.col("day"))).alias("day"),
        *[F.sum(F.when(is_now, F.col(c))).alias(c) for c in now_cols],
        *[F.sum(F.when(~is_now, F.col(c))).alias(c) for c in first_cols],
    )

    # whole days d-55 .. d-1 from daily totals
    daily = cells.groupBy(key, "day").agg(*[F.sum(x).alias(x) for x in _V]).withColumn("__probe", F.lit(False))
    day_probes = tg.select(key, "day").distinct().select(key, "day", *zeros, F.lit(True).alias("__probe"))
    wm = Window.partitionBy(key).orderBy("__dn").rangeBetween(-(SPAN_DAYS - 1), -1)
    mid = (
        daily.unionByName(day_probes)
        .withColumn("__dn", F.unix_date("day"))
        .select(key, "day", "__probe", *_sums(wm, "m"))
        .filter("__probe")
        .drop("__probe")
    )

    per_target = combined.join(mid, [key, "day"], "left")

    def z(c: str) -> F.Column:
        return F.coalesce(F.col(c), F.lit(0.0) if c.endswith("_s") else F.lit(0).cast("bigint"))

    vals = {}
    for x in _V:
        for lvl in (1, 2, 3):
            vals[f"l{lvl}_{x}"] = z(f"l{lvl}_{x}")
        vals[f"l4_{x}"] = z(f"f_{x}") + z(f"m_{x}") + z(f"b_{x}")
    per_target = per_target.select(key, "__t", *[v.alias(k) for k, v in vals.items()])

    return first_level(per_target, key, ts)


def first_level(per_target: DataFrame, key: str, ts: str) -> DataFrame:
    """The first window that holds a row and a value, from (key, __t) and l1_s .. l4_r; targets without one go."""
    levels = []
    for i in range(1, 5):
        ok = (F.col(f"l{i}_r") > 0) & (F.col(f"l{i}_c") > 0)
        levels.append((ok, i, F.col(f"l{i}_r"), F.col(f"l{i}_s") / F.col(f"l{i}_c")))
    level = F.when(levels[0][0], F.lit(1))
    n = F.when(levels[0][0], levels[0][2])
    val = F.when(levels[0][0], levels[0][3])
    for ok, i, rows, mean in levels[1:]:
        level = level.when(ok, F.lit(i))
        n = n.when(ok, rows)
        val = val.when(ok, mean)
    labels = F.array(*[F.lit(x) for x in LEVEL_LABELS])
    out = per_target.select(key, F.col("__t").alias(ts), level.alias("level"), n.alias("n"), val.alias("reference"))
    out = out.filter(F.col("level").isNotNull())
    return out.withColumn(
        "label", F.format_string("%s (n=%d)", F.element_at(labels, F.col("level")), F.col("n"))
    ).select(key, ts, "level", "label", "n", "reference")


def rounded(df: DataFrame, col: str = "reference") -> DataFrame:
    """C12 on the reference value (one decimal, half to even), as served."""
    return df.withColumn(col, F.bround(F.col(col), 1))
