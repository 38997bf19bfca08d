"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from velora.functions.calendar import WIND_THRESHOLD


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def coord_part(text: str | Column, i: int) -> Column:
    """I-th part (1 = latitude, 2 = longitude) of ``"lat,lon"`` text; blank/bad -> NULL."""
    part = F.split_part(_c(text), F.lit(","), F.lit(i))
    return F.nullif(F.trim(part), F.lit("")).try_cast("double")


def coord_text(lat: str | Column, lon: str | Column) -> Column:
    """``"lat,lon"`` from two numbers (or a struct's fields)."""
    return F.concat_ws(",", _c(lat).cast("string"), _c(lon).cast("string"))


def rainy(rain: str | Column, null_as_zero: bool = False) -> Column:
    """Rain > 0. A NULL amount gives false (a missing weather row stays NULL after a join)."""
    r = _c(rain)
    return F.coalesce(r, F.lit(0.0)) > 0 if null_as_zero else F.coalesce(r > 0, F.lit(False))


def snowy(snow: str | Column, null_as_zero: bool = False) -> Column:
    s = _c(snow)
    return F.coalesce(s, F.lit(0.0)) > 0 if null_as_zero else F.coalesce(s > 0, F.lit(False))


def windy(wind: str | Column, null_as_zero: bool = False) -> Column:
    """Wind > 15 (strict)."""
    w = _c(wind)
    return F.coalesce(w, F.lit(0.0)) > WIND_THRESHOLD if null_as_zero else F.coalesce(w > WIND_THRESHOLD, F.lit(False))


def load_level(value: str | Column, low: float, high: float) -> Column:
    """C9: 'calm' below ``low``, 'moderate' below ``high``, else 'busy'; high <= low means high = low + 10."""
    if high <= low:
        high = low + 10
    v = _c(value)
    return F.when(v < F.lit(low), "calm").when(v < F.lit(high), "moderate").otherwise("busy")


def site_label(name: str | Column, site_id: str | Column) -> Column:
    """``"name (ID n)"``; NULL when the name is unknown."""
    return F.concat(_c(name), F.lit(" (ID "), _c(site_id).cast("long").cast("string"), F.lit(")"))


def round1(x: str | Column) -> Column:
    """Round to one decimal, half to even (2.25 -> 2.2)."""
    return F.bround(_c(x), 1)


def as_date(x: str | Column) -> Column:
    """text/date/timestamp -> DATE, bad -> NULL."""
    return _c(x).try_cast("date")
