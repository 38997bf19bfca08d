"""M8: recursive multi-hour forecast per site.

(a) ``linear_fold``: for a linear scorer the whole recursion is one
    ``aggregate`` higher-order function per site row. The state is the
    24-value FIFO and the list of outputs; each step reads lag_1 (newest),
    lag_24 (oldest) and the FIFO mean, scores, clips at 0 and pushes. It runs
    in the JVM, sites in parallel, with no shuffle and no Python.
(b) for tree ensembles: ``operators/trees.py``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAG_FEATURES = ("lag_1", "lag_24", "rolling_mean_24")


@dataclass(frozen=True)
class LinearScorer:
    """``intercept + sum(coef[f] * f)``; lag features are read from the FIFO.

    ``fill`` gives the value used for a NULL feature (absent: NULL propagates).
    """

    intercept: float = 0.0
    coefs: Mapping[str, float] = field(default_factory=dict)
    fill: Mapping[str, float] = field(default_factory=dict)


def scorer_from_linear_model(model, cols, scaler: Mapping[str, tuple] | None = None) -> LinearScorer:
    """An exact ``LinearScorer`` for a fitted (assembler + LinearRegression) pipeline.

    With features standardised as ``(x - mean) / std`` and NULLs filled with 0
    after scaling, the model is affine in the raw features: coefficient
    ``w / std``, intercept ``b - sum(w * mean / std)``, and a NULL raw value
    acts as ``mean``. The fold (M8 a) then replaces 48 step-wise transforms.
    """
    lr = model.stages[-1]
    weights = lr.coefficients.toArray().tolist()
    intercept = float(lr.intercept)
    coefs, fill = {}, {}
    for c, w in zip(cols, weights):
        mean, std = (scaler or {}).get(c, (None, None))
        mean = 0.0 if mean is None else float(mean)
        std = 1.0 if not std else float(std)
        coefs[c] = w / std
        intercept -= w * mean / std
        fill[c] = mean
    return LinearScorer(intercept, coefs, fill)


# A fixed scorer used to make the recursion checkable against SQL.
FIXED_SCORER = LinearScorer(
    intercept=0.1,
    coefs={"lag_1": 0.5, "lag_24": 0.3, "rolling_mean_24": 0.2, "is_rush_hour": 1.0, "hour_cos": -0.5},
)


def _hour_term(scorer: LinearScorer, h: Column, hour_fields: Sequence[str], site_fields: Sequence[str]) -> Column:
    term = F.lit(float(scorer.intercept))
    for f, c in scorer.coefs.items():
        if f in LAG_FEATURES:
            continue
        if f in hour_fields:
            x = h[f].cast("double")
        elif f in site_fields:
            x = F.col(f).cast("double")
        else:
            raise ValueError(f"feature {f} is neither an hour nor a site column")
        if f in scorer.fill:
            x = F.coalesce(x, F.lit(float(scorer.fill[f])))
        term = term + F.lit(float(c)) * x
    return term


def linear_fold(
    sites: DataFrame,
    hours_col: str,
    scorer: LinearScorer,
    hour_fields: Sequence[str],
    history_col: str = "history",
    n: int = 24,
) -> DataFrame:
    """Add ``forecast``: array<struct<ts, pred>>, one per element of ``hours_col`` (time-sorted).

    ``sites`` has one row per site with the FIFO (``history``, oldest first)
    and the site's own feature columns; ``hours_col`` is an array of structs
    holding ``ts`` and the hour features.
    """
    site_fields = [c for c in sites.columns if c not in (hours_col, history_col)]
    c1 = float(scorer.coefs.get("lag_1", 0.0))
    c24 = float(scorer.coefs.get("lag_24", 0.0))
    cm = float(scorer.coefs.get("rolling_mean_24", 0.0))
    hist0 = F.coalesce(F.col(history_col), F.array_repeat(F.lit(0.0), n))
    init = F.struct(hist0.alias("hist"), F.array().cast("array<struct<ts:timestamp_ntz,pred:double>>").alias("out"))

    def step(acc, h):
        hist = acc["hist"]
        mean = F.aggregate(hist, F.lit(0.0), lambda s, v: s + v) / F.size(hist)
        score = _hour_term(scorer, h, hour_fields, site_fields) + F.lit(c1) * F.element_at(hist, -1) + F.lit(
            c24
        ) * F.element_at(hist, 1) + F.lit(cm) * mean
        pred = F.greatest(score, F.lit(0.0))
        # bind the prediction once, then build the next state from it
        return F.element_at(
            F.transform(
                F.array(pred),
                lambda p: F.struct(
                    F.slice(F.concat(hist, F.array(p)), 2, n).alias("hist"),
                    F.concat(acc["out"], F.array(F.struct(h["ts"].cast("timestamp_ntz").alias("ts"), p.alias("pred")))).alias("out"),
                ),
            ),
            1,
        )

    return sites.withColumn("forecast", F.aggregate(F.col(hours_col), init, step)["out"])
