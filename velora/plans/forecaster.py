"""A trained forecaster as one thing: site encoder, scaler and model (M4, M5, M6, T4).

It is fitted on the train part of a feature table, saved and loaded as one
folder, and scores the 25-column feature table as it is:

* ``encoding/``: the site target encoding, as Parquet (one row per site);
* ``params/``: the feature list, the prior and the scaler, as one JSON row;
* ``model/``: the MLlib pipeline (assembler and regressor).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velora.operators.boosting import fit_boosted
from velora.operators.quality import infer_feature_columns, require_columns
from velora.operators.recursive import LinearScorer, scorer_from_linear_model
from velora.operators.stats import regression_metrics
from velora.operators.trees import Ensemble, ensemble, nodes_of_saved_model
from velora.plans.training import chrono_split, fit_scaler, fit_target_encoding, scaler_params
from velora.session import checkpointed

TARGET = "hourly_count"
ENCODED = "site_te"
# Gradient boosting: rounds, rate and seed as the reference sets them. It sets no
# depth limit; MLlib needs one, and 5 (its default) keeps 2^5 leaves per tree, about
# as many as the 31 leaves that leaf-wise boosters grow by default.
GBT_ROUNDS = 500
GBT_STEP = 0.05
GBT_SEED = 42
GBT_DEPTH = 5
# Up to as many train rows MLlib's own fit takes no longer (its time is that of its jobs); beyond, the same trees
# are grown from packed rows (``operators/boosting.py``).
MLLIB_ROWS = 500_000


@dataclass(frozen=True)
class Forecaster:
    kind: str
    cols: list[str]
    prior: float
    scaler: dict[str, tuple[float, float]] | None
    encoding: DataFrame
    model: PipelineModel
    path: str | None = None

    def prepared(self, features: DataFrame) -> DataFrame:
        """Encoded, scaled and NULL-filled model inputs beside the columns of ``features``."""
        x = self.encode(features)
        require_columns(x, self.cols)
        values = {}
        for c in self.cols:
            v = F.col(c).cast("double")
            if self.scaler is not None:
                mean, std = self.scaler.get(c, (None, None))
                v = (v - F.lit(0.0 if mean is None else float(mean))) / F.lit(float(std) if std else 1.0)
            values[f"__x_{c}"] = F.coalesce(v, F.lit(0.0))
        return x.withColumns(values)

    def encode(self, df: DataFrame) -> DataFrame:
        """Adds the site encoding; unseen and NULL sites get the prior. No other column changes."""
        if ENCODED not in self.cols:
            return df
        te = self.encoding.select("site_id", "te_value")
        out = df.join(te, "site_id", "left").withColumn(ENCODED, F.coalesce("te_value", F.lit(self.prior)))
        return out.drop("te_value")

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` plus ``prediction``."""
        out = self.model.transform(self.prepared(features))
        return out.select(*features.columns, "prediction")

    def evaluate(self, features: DataFrame, label: str = TARGET) -> DataFrame:
        """M5: MAE, RMSE, R^2 and row count on a feature table."""
        return regression_metrics(self.score(features), label, "prediction")

    def importances(self, top_n: int = 10) -> DataFrame:
        """T4: features by importance (trees) or by |coefficient| (linear models); a top-k report."""
        est = self.model.stages[-1]
        values = est.featureImportances.toArray() if hasattr(est, "featureImportances") else abs(est.coefficients.toArray())
        rows = [(c, float(v)) for c, v in zip(self.cols, values)]
        df = self.encoding.sparkSession.createDataFrame(rows, "feature string, importance double")
        return df.orderBy(F.col("importance").desc(), "feature").limit(top_n)

    def linear_scorer(self) -> LinearScorer:
        """A linear forecaster as an exact fold scorer (M8 a)."""
        return scorer_from_linear_model(self.model, self.cols, self.scaler)

    def trees(self) -> Ensemble:
        """A saved tree forecaster's nodes (M8 b)."""
        if not self.path:
            raise ValueError("save the forecaster first: its trees are read from the saved model")
        spark = self.encoding.sparkSession
        return ensemble(nodes_of_saved_model(spark, _stage(spark, f"{self.path}/model/stages")), self.cols)


def _stage(spark: SparkSession, folder: str) -> str:
    """The folder of the last stage of a saved pipeline."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)  # noqa: SLF001
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)  # noqa: SLF001
    return max((f.getPath().toString() for f in found), key=lambda x: int(x.rsplit("/", 1)[1].split("_", 1)[0]))


def fit_forecaster(
    features: DataFrame,
    kind: str = "gbt",
    ratio: float = 0.1,
    cols: list[str] | None = None,
    rounds: int = GBT_ROUNDS,
    step: float = GBT_STEP,
    max_depth: int = GBT_DEPTH,
    seed: int = GBT_SEED,
    scale: bool = True,
) -> tuple[Forecaster, DataFrame]:
    """M4: split by time, fit encoder, scaler and model on the train rows; returns the forecaster and its test metrics.

    ``cols`` restricts the features; by default all numeric and boolean columns
    plus the site encoding. The prepared train rows are checkpointed once, as
    the fit reads them many times.
    """
    split = chrono_split(features.drop("month"), ratio)
    train = split.filter(~F.col("is_test")).drop("is_test")
    cols = cols or [ENCODED, *infer_feature_columns(features.drop("month"), TARGET, target_encode=["site_id"], exclude=["ts"])]
    encoding, prior = None, 0.0
    if ENCODED in cols:
        encoding = checkpointed(fit_target_encoding(train, "site_id", TARGET))
        prior = float(train.agg(F.avg(TARGET)).first()[0] or 0.0)
    else:
        encoding = features.sparkSession.createDataFrame([], "site_id bigint, te_value double, prior double")
    bare = Forecaster(kind, cols, prior, None, encoding, None)
    scaler = scaler_params(fit_scaler(bare.encode(train), cols)) if scale else None  # one entry per feature
    bare = Forecaster(kind, cols, prior, scaler, encoding, None)
    # rebalanced by size: the fit reads these rows several times
    ready = checkpointed(bare.prepared(train).select(TARGET, *[f"__x_{c}" for c in cols]).hint("rebalance"))
    assembler = VectorAssembler(inputCols=[f"__x_{c}" for c in cols], outputCol="features")
    if kind == "gbt":
        est = GBTRegressor(labelCol=TARGET, featuresCol="features", maxIter=rounds, stepSize=step, maxDepth=max_depth, seed=seed)
        if ready.count() <= MLLIB_ROWS:
            model = Pipeline(stages=[assembler, est]).fit(ready)
        else:
            model = PipelineModel([assembler, fit_boosted(ready, [f"__x_{c}" for c in cols], est)])
    elif kind == "linear":
        model = Pipeline(stages=[assembler, LinearRegression(labelCol=TARGET, solver="normal")]).fit(ready)
    else:
        raise ValueError(f"unknown model kind {kind}")
    done = Forecaster(kind, cols, prior, scaler, encoding, model)
    return done, done.evaluate(split.filter("is_test").drop("is_test"))


def save_forecaster(f: Forecaster, path: str) -> Forecaster:
    """M6: encoder, scaler and model in one folder; returns the forecaster bound to it."""
    spark = f.encoding.sparkSession
    f.encoding.select("site_id", "te_value").write.mode("overwrite").parquet(f"{path}/encoding")
    means = [None if f.scaler is None else f.scaler.get(c, (None, None))[0] for c in f.cols]
    stds = [None if f.scaler is None else f.scaler.get(c, (None, None))[1] for c in f.cols]
    schema = "kind string, cols array<string>, prior double, scaled boolean, means array<double>, stds array<double>"
    row = spark.createDataFrame([(f.kind, f.cols, f.prior, f.scaler is not None, means, stds)], schema)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/params")
    f.model.write().overwrite().save(f"{path}/model")
    return Forecaster(f.kind, f.cols, f.prior, f.scaler, spark.read.parquet(f"{path}/encoding"), f.model, path)


def load_forecaster(spark: SparkSession, path: str) -> Forecaster:
    """M6."""
    p = spark.read.parquet(f"{path}/params").first()
    scaler = dict(zip(p["cols"], zip(p["means"], p["stds"]))) if p["scaled"] else None
    model = PipelineModel.load(f"{path}/model")
    return Forecaster(p["kind"], list(p["cols"]), p["prior"], scaler, spark.read.parquet(f"{path}/encoding"), model, path)
