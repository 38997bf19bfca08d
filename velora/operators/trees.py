"""M8(b): recursive forecasts with a tree ensemble, all sites of a batch at once.

The ensemble is a node table (tree, node, feature, threshold, left, right,
value, weight): a few rows per tree, written by hand or read from a saved
gradient-boosted model. It goes to every task as padded arrays. A task takes
Arrow batches of site rows; for each hour of the horizon it looks up the lag
features in the sites' FIFOs, walks all trees level by level for the whole
batch and pushes the prediction. No loop over Spark plans, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NODE_COLUMNS = "tree int, node int, feature int, threshold double, left int, right int, value double, weight double"
LAGS = ("lag_1", "lag_24", "rolling_mean_24")


@dataclass(frozen=True)
class Ensemble:
    """Padded node arrays (trees x nodes); a leaf has feature -1. ``names``: the feature of each index."""

    names: list[str]
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    weight: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Weighted sum of the trees for every row of ``x`` (rows x names); a value at the threshold goes left."""
        trees = np.arange(len(self.weight))[None, :]
        at = np.zeros((len(x), len(self.weight)), dtype=np.int32)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[trees, at]
            go_left = x[rows, np.maximum(f, 0)] <= self.threshold[trees, at]
            at = np.where(f < 0, at, np.where(go_left, self.left[trees, at], self.right[trees, at]))
        return (self.value[trees, at] * self.weight[None, :]).sum(axis=1)


def ensemble(nodes: DataFrame, names: Sequence[str]) -> Ensemble:
    """From a node table; it holds a fitted model, at most 2^depth rows per tree."""
    rows = nodes.select("tree", "node", "feature", "threshold", "left", "right", "value", "weight").collect()
    trees = max(r["tree"] for r in rows) + 1
    size = max(r["node"] for r in rows) + 1
    a = {
        "feature": np.full((trees, size), -1, dtype=np.int32),
        "threshold": np.zeros((trees, size)),
        "left": np.zeros((trees, size), dtype=np.int32),
        "right": np.zeros((trees, size), dtype=np.int32),
        "value": np.zeros((trees, size)),
    }
    weight = np.ones(trees)
    kids: dict[tuple[int, int], tuple[int, int]] = {}
    for r in rows:
        weight[r["tree"]] = r["weight"]
        a["value"][r["tree"], r["node"]] = r["value"]
        if r["feature"] is not None and r["feature"] >= 0:
            for k in ("feature", "threshold", "left", "right"):
                a[k][r["tree"], r["node"]] = r[k]
            kids[r["tree"], r["node"]] = (r["left"], r["right"])

    def depth(tree: int, node: int) -> int:
        return 1 + max(depth(tree, k) for k in kids[tree, node]) if (tree, node) in kids else 0

    return Ensemble(list(names), **a, weight=weight, depth=max(depth(t, 0) for t in range(trees)))


def nodes_of_saved_model(spark, stage_path: str) -> DataFrame:
    """The node table of a gradient-boosted model saved by MLlib (its folder inside the pipeline's ``stages``)."""
    n = spark.read.parquet(f"{stage_path}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{stage_path}/treesMetadata").toDF("treeID", "meta", "weight").select("treeID", "weight")
    leaf = F.col("leftChild") < 0
    return n.join(weights, "treeID").select(
        F.col("treeID").alias("tree"),
        F.col("id").alias("node"),
        F.when(leaf, F.lit(-1)).otherwise(F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("prediction").alias("value"),
        F.col("weight").cast("double").alias("weight"),
    )


def tree_forecast(
    sites: DataFrame,
    hours: DataFrame,
    model: Ensemble,
    scale: Mapping[str, tuple[float, float]] | None = None,
    history_col: str = "history",
    fallback_col: str | None = "site_mean",
    n: int = 24,
) -> DataFrame:
    """(site_id, ts, pred) for every site row and hour of the horizon.

    ``sites`` holds the FIFO and the site features, ``hours`` the hour features
    (one row per hour of the horizon). Features are scaled by ``scale`` (mean,
    deviation), then a NULL counts as 0, as in training. A site without history
    starts from zeros; a site whose prediction is not a number gets its mean;
    predictions are floored at 0.
    """
    grid = hours.orderBy("ts").toPandas()  # the horizon: a parameter
    stamps = [t.to_pydatetime() for t in pd.to_datetime(grid["ts"])]
    site_names = [c for c in model.names if c in sites.columns]
    hour_names = [c for c in model.names if c in grid.columns]
    missing = [c for c in model.names if c not in (*site_names, *hour_names, *LAGS)]
    if missing:
        raise ValueError(f"features {missing} are neither hour nor site columns")
    hour_values = {c: pd.to_numeric(grid[c]).astype(float).to_numpy() for c in hour_names}
    shared = sites.sparkSession.sparkContext.broadcast(model)  # a fitted model: 2^depth nodes per tree
    params = {c: (m if m is not None else 0.0, s or 1.0) for c, (m, s) in (scale or {}).items()}
    keep = list(dict.fromkeys(["site_id", history_col, *site_names, *([fallback_col] if fallback_col in sites.columns else [])]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value

        def scaled(name: str, v: np.ndarray) -> np.ndarray:
            mean, std = params.get(name, (0.0, 1.0))
            return np.nan_to_num((v - mean) / std, nan=0.0)

        for df in batches:
            k = len(df)
            fifo = np.array([np.zeros(n) if h is None else np.asarray(h, dtype=float) for h in df[history_col]]).reshape(k, n)
            x = np.zeros((k, len(m.names)))
            for j, c in enumerate(m.names):
                if c in site_names:
                    x[:, j] = scaled(c, pd.to_numeric(df[c]).astype(float).to_numpy())
            fallback = pd.to_numeric(df[fallback_col]).fillna(0.0).to_numpy() if fallback_col in df.columns else np.zeros(k)
            out = np.zeros((k, len(stamps)))
            for i in range(len(stamps)):
                lags = {"lag_1": fifo[:, -1], "lag_24": fifo[:, 0], "rolling_mean_24": fifo.mean(axis=1)}
                for j, c in enumerate(m.names):
                    if c in lags:
                        x[:, j] = scaled(c, lags[c])
                    elif c in hour_values:
                        x[:, j] = scaled(c, np.full(k, hour_values[c][i]))
                p = m.predict(x)
                p = np.maximum(np.where(np.isfinite(p), p, fallback), 0.0)
                out[:, i] = p
                fifo = np.concatenate([fifo[:, 1:], p[:, None]], axis=1)
            yield pd.DataFrame(
                {"site_id": np.repeat(df["site_id"].to_numpy(), len(stamps)), "ts": stamps * k, "pred": out.ravel()}
            )

    return sites.select(*keep).mapInPandas(run, "site_id bigint, ts timestamp_ntz, pred double")
