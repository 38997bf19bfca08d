"""Calendar column expressions.

Every stamp is a ``TIMESTAMP_NTZ`` holding local clock time; nothing here
depends on the session time zone. All functions return ``Column`` objects so
they stay inside whole-stage codegen; no Python runs per row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# Season start dates (month, day): spring 03-20, summer 06-21, autumn 09-22,
# winter 12-21; a date before 03-20 is still winter.
SEASON_STARTS = (("spring", 3, 20), ("summer", 6, 21), ("autumn", 9, 22), ("winter", 12, 21))
# Night bounds per season, fractional clock hours: night if h >= start or h < end.
NIGHT_BOUNDS = {"winter": (17.0, 8.0), "spring": (20.5, 6.0), "summer": (22.0, 5.0), "autumn": (19.0, 7.0)}
# Rush hours: [7, 10) and [17, 20).
RUSH_WINDOWS = ((7, 10), (17, 20))
# School holiday periods, [start, end) with midnight bounds.
HOLIDAY_PERIODS = (
    ("2024-10-19", "2024-11-05"),
    ("2024-12-21", "2025-01-07"),
    ("2025-02-15", "2025-03-04"),
    ("2025-04-12", "2025-04-29"),
    ("2025-05-29", "2025-06-01"),
    ("2025-07-05", "2025-09-02"),
)
# Season index for the cyclic encoding.
SEASON_INDEX = {"winter": 0, "spring": 1, "summer": 2, "autumn": 3}
# French day names, Monday first.
DAY_NAMES_FR = ("Lundi", "Mardi", "Mercredi", "Jeudi", "Vendredi", "Samedi", "Dimanche")
# Weather thresholds: rainy if rain > 0, snowy if snowfall > 0, windy if wind > 15.
WIND_THRESHOLD = 15.0
# ---------------------------------------------------------------------------


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def ntz_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal built from wall-clock text.

    ``F.lit(datetime)`` would make a zoned TIMESTAMP from the Python process's
    zone and the cast would read it back in the session's zone; going through
    text involves no zone at all. A zone on the input is dropped, keeping the
    clock time (P6).
    """
    import datetime as dt

    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ")
    elif isinstance(value, dt.date):
        text = value.isoformat()
    else:
        text = str(value)
    return F.lit(text).cast("timestamp_ntz")


def floor_hour(ts: str | Column) -> Column:
    """Floor an NTZ stamp to the hour, staying NTZ (no session zone involved)."""
    t = _c(ts)
    return t - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(t), F.extract(F.lit("SECOND"), t))


def weekday0(ts: str | Column) -> Column:
    """C4: weekday with 0 = Monday ... 6 = Sunday."""
    return F.weekday(_c(ts))


def iso_dow(ts: str | Column) -> Column:
    """C4: ISO weekday, 1 = Monday ... 7 = Sunday."""
    return F.weekday(_c(ts)) + F.lit(1)


def day_name_fr(ts: str | Column) -> Column:
    """C4: French day name."""
    names = F.array(*[F.lit(n) for n in DAY_NAMES_FR])
    return F.element_at(names, F.weekday(_c(ts)) + F.lit(1))


def season_number(ts: str | Column) -> Column:
    """0 winter, 1 spring, 2 summer, 3 autumn, from month/day (midnight boundaries, exact)."""
    t = _c(ts)
    md = F.month(t) * 100 + F.dayofmonth(t)
    (_, sm, sd), (_, um, ud), (_, am, ad), (_, wm, wd) = SEASON_STARTS
    return (
        F.when(md < sm * 100 + sd, F.lit(0))
        .when(md < um * 100 + ud, F.lit(1))
        .when(md < am * 100 + ad, F.lit(2))
        .when(md < wm * 100 + wd, F.lit(3))
        .otherwise(F.lit(0))
    )


_SEASON_BY_NUMBER = sorted(SEASON_INDEX, key=SEASON_INDEX.get)  # winter, spring, summer, autumn


def season(ts: str | Column) -> Column:
    """Season name."""
    return F.element_at(F.array(*[F.lit(n) for n in _SEASON_BY_NUMBER]), season_number(ts) + 1)


def is_night(ts: str | Column, season_col: str | Column | None = None) -> Column:
    """Night flag by season (``h >= start or h < end``); an unknown season gives false.

    The bounds are looked up by season number from two small literal arrays,
    which keeps the expression compact (one CASE for the season, not four).
    """
    t = _c(ts)
    idx = season_number(t) if season_col is None else season_index(season_col, unknown_as_zero=False).cast("int")
    starts = F.array(*[F.lit(NIGHT_BOUNDS[n][0]) for n in _SEASON_BY_NUMBER])
    ends = F.array(*[F.lit(NIGHT_BOUNDS[n][1]) for n in _SEASON_BY_NUMBER])
    h = F.hour(t) + F.minute(t) / F.lit(60.0)
    # guard the lookup: element_at's generated code rejects a NULL index read as 0
    night = F.when(idx.isNotNull(), (h >= F.element_at(starts, idx + 1)) | (h < F.element_at(ends, idx + 1)))
    return F.coalesce(night, F.lit(False))


def is_rush_hour(ts: str | Column) -> Column:
    """Rush hour flag on the clock hour."""
    h = F.hour(_c(ts))
    cond = None
    for lo, hi in RUSH_WINDOWS:
        c = (h >= lo) & (h < hi)
        cond = c if cond is None else cond | c
    return cond


def holiday_flag(ts: str | Column, periods: Sequence[tuple[str, str]] = HOLIDAY_PERIODS) -> Column:
    """J9 for a fixed calendar: ``start <= ts < end`` for any period.

    A handful of periods is an OR of range predicates on the column: no join,
    no shuffle, inside codegen. Use :func:`interval_flag_join` when the
    calendar is itself a table of unknown length.
    """
    t = _c(ts)
    cond = F.lit(False)
    for start, end in periods:
        cond = cond | ((t >= ntz_lit(start)) & (t < ntz_lit(end)))
    return cond


def interval_flag_join(
    df: DataFrame, ts_col: str, intervals: DataFrame, out_col: str = "is_holiday"
) -> DataFrame:
    """J9 for a calendar table ``intervals(start_date DATE, end_date DATE)``, end exclusive.

    All bounds are midnights, so each interval is exploded to its days and the
    test becomes an equi-join on ``to_date(ts)`` (hash join, not a nested loop).
    Intervals without a day (end not after start, or a NULL bound) flag nothing.
    The day table is distinct, so the join never multiplies rows; Spark chooses
    how to join it from its measured size.
    """
    days = (
        intervals.filter(F.col("start_date") < F.col("end_date")).select(
            F.explode(F.sequence(F.col("start_date"), F.date_sub(F.col("end_date"), 1))).alias("__day")
        )
        .distinct()
        .withColumn(out_col, F.lit(True))
    )
    out = df.withColumn("__day", F.to_date(F.col(ts_col))).join(days, "__day", "left")
    return out.withColumn(out_col, F.coalesce(F.col(out_col), F.lit(False))).drop("__day")


def season_index(season_col: str | Column, unknown_as_zero: bool = True) -> Column:
    """C5 helper: winter 0, spring 1, summer 2, autumn 3; unknown -> 0 (or NULL)."""
    s = F.lower(_c(season_col))
    expr = None
    for name, idx in SEASON_INDEX.items():
        expr = F.when(s == name, F.lit(float(idx))) if expr is None else expr.when(s == name, F.lit(float(idx)))
    return expr.otherwise(F.lit(0.0) if unknown_as_zero else F.lit(None).cast("double"))


def cyclic(x: str | Column, period: float) -> tuple[Column, Column]:
    """(sin, cos) of 2*pi*x/period."""
    angle = F.lit(2.0 * math.pi) * _c(x).cast("double") / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def add_cyclic_features(df: DataFrame, ts_col: str = "ts", season_col: str | None = None) -> DataFrame:
    """weekday/7, month/12, hour/24 and season/4 encodings from the stamp."""
    t = F.col(ts_col)
    dow_s, dow_c = cyclic(weekday0(t), 7)
    mon_s, mon_c = cyclic(F.month(t), 12)
    hr_s, hr_c = cyclic(F.hour(t), 24)
    se_s, se_c = cyclic(season_index(season_col) if season_col else season_number(t), 4)
    return df.withColumns(
        {
            "dow_sin": dow_s,
            "dow_cos": dow_c,
            "month_sin": mon_s,
            "month_cos": mon_c,
            "hour_sin": hr_s,
            "hour_cos": hr_c,
            "season_sin": se_s,
            "season_cos": se_c,
        }
    )


def add_time_features(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Calendar parts and flags of an (already floored) hour column."""
    t = F.col(ts_col)
    return df.withColumns(
        {
            "weekday": weekday0(t),
            "day_name": day_name_fr(t),
            "month": F.month(t),
            "hour": F.hour(t),
            "season": season(t),
            "is_night": is_night(t),
            "is_holiday": holiday_flag(t),
            "is_rush_hour": is_rush_hour(t),
        }
    )


def hour_grid(spark, start, end, col: str = "ts") -> DataFrame:
    """Hours in ``(start, end]``, NTZ. ``start``/``end`` are literals or NTZ strings.

    The grid length is the horizon (hours), not the data size.
    """
    s = ntz_lit(start)
    e = ntz_lit(end)
    return spark.range(1).select(
        F.explode(F.sequence(s + F.expr("INTERVAL 1 HOUR"), e, F.expr("INTERVAL 1 HOUR"))).alias(col)
    )


def hour_grid_after(df_bounds: DataFrame, start_col: str, hours: int, col: str = "ts") -> DataFrame:
    """C13 from a one-row frame holding the start stamp: hours start+1h .. start+N h."""
    s = F.col(start_col)
    return df_bounds.select(
        F.explode(
            F.sequence(s + F.expr("INTERVAL 1 HOUR"), s + F.make_dt_interval(F.lit(0), F.lit(hours)), F.expr("INTERVAL 1 HOUR"))
        ).alias(col)
    )
