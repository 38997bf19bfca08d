"""Tail probabilities for the statistics pages (A13-A15), as Arrow-batched pandas UDFs.

SciPy is not available, so the two-sided Student t p-value uses the
regularized incomplete beta function, I_x(a, b), by its continued fraction
(modified Lentz), vectorised over a batch with NumPy; the chi-square
survival with one degree of freedom is ``erfc(sqrt(x / 2))``.
These run on one row per test, never per data row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _betacf(a: np.ndarray, b: np.ndarray, x: np.ndarray, iters: int = 300, eps: float = 1e-15) -> np.ndarray:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c = np.ones_like(x)
    d = 1.0 - qab * x / qap
    d = np.where(np.abs(d) < tiny, tiny, d)
    d = 1.0 / d
    h = d.copy()
    for m in range(1, iters + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        h = h * d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = np.where(np.abs(d) < tiny, tiny, d)
        c = 1.0 + aa / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        d = 1.0 / d
        delta = d * c
        h = h * delta
        if np.all(np.abs(delta - 1.0) < eps):
            break
    return h


def betainc_reg(a, b, x) -> np.ndarray:
    """Regularized incomplete beta I_x(a, b) for arrays (0 <= x <= 1)."""
    a, b, x = (np.asarray(v, dtype=float) for v in np.broadcast_arrays(a, b, x))
    out = np.full(x.shape, np.nan)
    ok = (x >= 0) & (x <= 1) & (a > 0) & (b > 0)
    lg = np.vectorize(math.lgamma)
    with np.errstate(divide="ignore", invalid="ignore"):
        lbt = np.where(
            ok & (x > 0) & (x < 1),
            lg(np.where(ok, a + b, 1.0)) - lg(np.where(ok, a, 1.0)) - lg(np.where(ok, b, 1.0))
            + a * np.log(np.where(x > 0, x, 1.0)) + b * np.log(np.where(x < 1, 1.0 - x, 1.0)),
            0.0,
        )
        bt = np.exp(lbt)
        direct = x < (a + 1.0) / (a + b + 2.0)
        xs = np.where(ok, x, 0.5)
        f1 = bt * _betacf(a, b, xs) / a
        f2 = 1.0 - bt * _betacf(b, a, 1.0 - xs) / b
        val = np.where(direct, f1, f2)
    val = np.where(x == 0, 0.0, np.where(x == 1, 1.0, val))
    return np.where(ok, val, out)


def t_two_sided_p(t, df) -> np.ndarray:
    """P(|T| >= |t|) for Student t with ``df`` degrees of freedom."""
    t = np.asarray(t, dtype=float)
    df = np.asarray(df, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = df / (df + t * t)
        p = betainc_reg(df / 2.0, 0.5, x)
    return np.where(np.isinf(t), 0.0, p)


def chi2_1df_sf(x) -> np.ndarray:
    """Survival function of chi-square with one degree of freedom."""
    x = np.asarray(x, dtype=float)
    return np.array([math.erfc(math.sqrt(v / 2.0)) if v >= 0 else float("nan") for v in x.ravel()]).reshape(x.shape)


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    """Pandas UDF: two-sided t p-value per row (one row per test)."""
    valid = t.notna() & df.notna() & (df > 0)
    out = pd.Series(np.nan, index=t.index)
    if valid.any():
        out[valid] = t_two_sided_p(t[valid].to_numpy(), df[valid].to_numpy())
    return out


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(x: pd.Series) -> pd.Series:
    """Pandas UDF: chi-square (1 df) survival per row."""
    valid = x.notna()
    out = pd.Series(np.nan, index=x.index)
    if valid.any():
        out[valid] = chi2_1df_sf(x[valid].to_numpy())
    return out
