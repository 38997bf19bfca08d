"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velora.session import shared_scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run below the folder in ``spark.checkpoint.dir``."""
    return shared_scratch_path(spark, f"llm/{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs the tasks of the current job only.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_key(*cols: str | Column) -> Column:
    """64-bit key of the given columns; nulls at different places give different keys."""
    parts: list[Column] = []
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c, c.isNull()]
    return F.xxhash64(*parts)


def is_held_out(doc_id: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text leaves remainder ``fold``; false where the id is null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph (a, b) -> (node, component).

    Alternating large-star and small-star rounds: each step takes a minimum per
    node (partial aggregates on the map side, so a hub costs one row per task)
    and joins it back to the edges. Rounds end when the edges no longer change;
    they are then one star per component. Only a count and a sum reach the driver.
    """
    e = stored(edges.select("a", "b").filter("a <> b").distinct(), f"{name}-0")
    state = None
    for i in range(1, rounds + 1):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every larger neighbour moves to the smallest node of the neighbourhood
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # small star: the node and its smaller neighbours move to the smallest of them
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        e = stored(small.filter("a <> b").distinct(), f"{name}-{i}")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def bounded_sample(df: DataFrame, label: str, key: str, per_label: int, max_labels: int = 200) -> DataFrame:
    """At most ``per_label`` rows of each of the ``max_labels`` most frequent labels: those of the smallest key hash.

    Rows are first thinned by their hash to about three times the wanted number
    per label, so that the ranking never sees a whole label, however frequent.
    """
    counts = df.groupBy(label).count().orderBy(F.desc("count"), label).limit(max_labels).collect()
    share = F.lit(None).cast("double")
    for r in counts:
        share = F.when(F.col(label) == F.lit(r[0]), F.lit(min(1.0, 3.0 * per_label / r[1]))).otherwise(share)
    h = F.xxhash64(key)
    thinned = df.withColumn("__h", h).filter(F.pmod("__h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < share)
    rank = F.row_number().over(Window.partitionBy(label).orderBy("__h", key))
    return thinned.withColumn("__n", rank).filter(F.col("__n") <= per_label).drop("__h", "__n")
