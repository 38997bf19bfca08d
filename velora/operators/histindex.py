"""A16 from a stored index: every window is a difference of running sums, and late rows change their own blocks only.

The 56 days of the windows are two blocks of 28 days, so a target looks into
the block of its own day and the two before it. The index has one row per
(site, series, block) with data; its ``entries`` are sorted by position and
hold, per non-empty position, the running (sum, non-NULL count, rows) of the
block, and the running values of the positions of the same weekday. Series:

* 0..23: that clock hour; positions are the days of a 28-day block;
* ``ALL_HOURS``: whole days; the same positions;
* ``IN_DAY``: the hours of one day; the block is the day.

An entry list has 28 entries at most, so a busy site costs no more than a quiet
one with the same span. The rows of a block are stored under the month of the
block's first day: ``land_index`` reads and replaces the touched months only.
``reference_from_index`` needs one join by (site, series, block) and one sum
per target, and neither raw rows nor windows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velora.functions.calendar import floor_hour
from velora.operators.histref import SPAN_DAYS, first_level, hourly_cells
from velora.sinks import tables as sk

BLOCK = SPAN_DAYS // 2
ALL_HOURS, IN_DAY = -1, 24
KEYS = ["site_id", "series", "block"]
_V = ("s", "c", "r")
_EPOCH = dt.date(1970, 1, 1)


def _block_start(days: Column) -> Column:
    """First instant of the 28-day block of a day number."""
    day = F.date_from_unix_date((F.floor(days / BLOCK) * BLOCK).cast("int"))
    return F.make_timestamp_ntz(F.year(day), F.month(day), F.day(day), F.lit(0), F.lit(0), F.lit(0))


def index_cells(raw: DataFrame) -> DataFrame:
    """(site_id, series, block, block_start, pos, s, c, r) of raw rows (site_id, ts, hourly_count); rows without a key are left out."""
    cells = hourly_cells(raw.dropna(subset=["site_id", "ts"])).withColumn("d", F.unix_date("day"))
    in_block = [F.floor(F.col("d") / BLOCK).cast("int").alias("block"), F.pmod("d", F.lit(BLOCK)).cast("int").alias("pos")]
    places = F.array(
        F.struct(F.col("hour").alias("series"), *in_block),
        F.struct(F.lit(ALL_HOURS).alias("series"), *in_block),
        F.struct(F.lit(IN_DAY).alias("series"), F.col("d").alias("block"), F.col("hour").alias("pos")),
    )
    placed = cells.select("site_id", F.explode(places).alias("p"), _block_start(F.col("d")).alias("block_start"), *_V)
    return placed.groupBy("site_id", "p", "block_start").agg(*[F.sum(x).alias(x) for x in _V]).select("site_id", "p.*", "block_start", *_V)


def _rows_of(cells: DataFrame) -> DataFrame:
    """Index rows of cells, one cell per place: running sums over at most 28 positions, then one list."""
    run = Window.partitionBy(*KEYS).orderBy("pos")
    same_day = Window.partitionBy(*KEYS, F.col("pos") % 7).orderBy("pos")
    sums = [F.sum(x).over(run).alias(f"p_{x}") for x in _V] + [F.sum(x).over(same_day).alias(f"w_{x}") for x in _V]
    entry = F.struct("pos", *_V, *[f"{k}_{x}" for k in "pw" for x in _V])
    summed = cells.repartition(*KEYS).select(*KEYS, "block_start", "pos", *_V, *sums)
    return summed.groupBy(*KEYS, "block_start").agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def build_index(raw: DataFrame) -> DataFrame:
    """The index of raw rows: site_id, series, block, block_start, entries."""
    return _rows_of(index_cells(raw))


def land_index(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Add appended rows to the stored index; blocks of other months are neither read nor written.

    The stored cells of the touched months and the new ones are summed and
    their running sums made anew, so rows of any age may land. A replacement
    that was lost on the way is finished first.
    """
    sk.recover_months(spark, path)
    cells = index_cells(rows)
    months = sorted(r[0] for r in rows.dropna(subset=["site_id", "ts"]).select(F.date_format(_block_start(F.unix_date(F.to_date("ts"))), "yyyy-MM")).distinct().collect())
    if not months:
        return
    if sk.path_exists(spark, path):
        stored = spark.read.parquet(path).filter(F.col("month").isin(months))
        old = stored.select(*KEYS, "block_start", F.explode("entries").alias("e")).select(*KEYS, "block_start", "e.pos", *[f"e.{x}" for x in _V])
        both = old.unionByName(cells)
        cells = both.groupBy(*KEYS, "block_start", "pos").agg(*[F.sum(x).alias(x) for x in _V])
    sk.replace_months(spark, path, _rows_of(cells), "block_start")


def _at(upto: Column, same_weekday: bool = False) -> Column:
    """The last entry at or before a position (of its weekday); NULL if there is none."""
    def hit(x: Column) -> Column:
        ok = x["pos"] <= upto
        return ok & (F.pmod(x["pos"], F.lit(7)) == F.pmod(F.col("at_wd"), F.lit(7))) if same_weekday else ok

    return F.try_element_at(F.filter("entries", hit), F.lit(-1))


def reference_from_index(index: DataFrame, targets: DataFrame, ts: str = "ts") -> DataFrame:
    """As ``historical_reference``: (site_id, ts, level, label, n, reference) for each target with some history.

    The targets' first and last hour are resolved first; only the index months
    of the 84 days before them are read.
    """
    tg = targets.select("site_id", floor_hour(ts).alias("__t")).dropna().distinct()
    lo, hi = tg.agg(F.min("__t"), F.max("__t")).first()
    if lo is not None and "month" in index.columns:
        first = _EPOCH + dt.timedelta(days=((lo.date() - _EPOCH).days // BLOCK - 2) * BLOCK)
        index = index.filter(F.col("month").between(first.strftime("%Y-%m"), hi.strftime("%Y-%m")))
    d, h = F.unix_date(F.to_date("__t")), F.hour("__t")
    b, pos = F.floor(d / BLOCK).cast("int"), F.pmod(d, F.lit(BLOCK)).cast("int")

    def probe(series: Column, block: Column, at: Column, role: str) -> Column:
        return F.struct(series.alias("series"), block.cast("int").alias("block"), (at - 1).alias("at"), pos.alias("at_wd"), F.lit(role).alias("role"))

    probes = [probe(s, b - k, pos, f"{name}{k}") for s, name in ((h, "h"), (F.lit(ALL_HOURS), "d")) for k in (0, 1, 2)]
    probes += [probe(F.lit(IN_DAY), d, h, "day"), probe(F.lit(IN_DAY), d - SPAN_DAYS, h, "first_day")]
    asked = tg.select("site_id", "__t", F.explode(F.array(*probes)).alias("p")).select("site_id", "__t", "p.*")
    found = asked.join(index.select(*KEYS, "entries"), KEYS).select(
        "site_id", "__t", "role",
        _at(F.col("at")).alias("p"), _at(F.lit(BLOCK)).alias("all"),
        _at(F.col("at_wd") - 7, same_weekday=True).alias("w"), _at(F.lit(BLOCK), same_weekday=True).alias("w_all"),
    )

    def part(x: str, level: int) -> Column:
        """What a probe adds to a level: the running value before the target's place, the block's, or their difference."""
        def z(entry: str, kind: str) -> Column:
            return F.coalesce(F.col(entry)[f"{kind}_{x}"], F.lit(0))

        before, whole = z("p", "p"), z("all", "p")
        w_before, w_whole = z("w", "w"), z("w_all", "w")
        by_role = {
            1: {"h0": w_before, "h1": w_whole - w_before},
            2: {"h0": w_before, "h1": w_whole, "h2": w_whole - w_before},
            3: {"h0": before, "h1": whole, "h2": whole - before},
            4: {"d0": before, "d1": whole, "d2": whole - before, "day": before, "first_day": -before},
        }[level]
        out = F.lit(0)
        for role, v in by_role.items():
            out = F.when(F.col("role") == role, v).otherwise(out)
        return F.sum(out).alias(f"l{level}_{x}")

    sums = found.groupBy("site_id", "__t").agg(*[part(x, level) for level in (1, 2, 3, 4) for x in _V])
    return first_level(sums, "site_id", ts)
