"""M4: gradient-boosted regression trees over binned columns, as Spark jobs over packed rows.

MLlib's ``GBTRegressor`` walks objects row by row and adds to the statistics of
every column on its own, for all rows at every level of 500 trees. The same
trees (squared error, the first tree on the label, every later one on twice the
rest, splits at the borders of at most 32 bins a column) are grown here from
rows kept as blocks of bin codes:

* columns of few bins share a code (their bin counts multiply to ``CELLS`` at
  most), so that one count of codes serves several columns;
* a job per level counts only the smaller child of every split (the other is
  the parent less it); its tasks send sums of nodes x bins, whatever the rows;
* bins come from about ``SAMPLE_ROWS`` rows, as in MLlib; every row is binned
  and counted in every round.

The result is an MLlib ``GBTRegressionModel``, written in its saved form.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velora.session import ensure_checkpoint_dir, shared_scratch_path

BINS = 32
CELLS = 4096
SAMPLE_ROWS = 10_000
TASK_ROWS = 20_000
BLOCK_ROWS = 1 << 19
CHECKPOINT_ROUNDS = 25
TIE = 1e-9  # gains closer than this share of the best count as equal: the first column wins, however rows are dealt
_NODE_TYPE = (
    "tree int, weight double, node int, n double, total double, squares double, gain double, left int, right int, "
    "feature int, threshold double"
)
Splits = dict[int, tuple[int, int, int, int]]  # node: column, border, left, right


def split_points(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """At most ``bins - 1`` borders between the values: all middles, or those nearest to equal shares of rows."""
    found, counts = np.unique(values, return_counts=True)
    middles = (found[:-1] + found[1:]) / 2.0
    if len(middles) < bins:
        return middles
    stride = len(values) / bins
    target, seen, out = stride, counts[0], []
    for i in range(1, len(found)):
        before, seen = seen, seen + counts[i]
        if abs(before - target) < abs(seen - target):
            out.append(middles[i - 1])
            target += stride
    return np.array(out)


def bundles(sizes: Sequence[int], cells: int = CELLS) -> list[list[int]]:
    """Columns that share a code: the largest first, each into the first bundle with room for it."""
    out: list[list[int]] = []
    for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
        if sizes[f] < 2:
            continue  # a constant cannot be split
        for b in out:
            if math.prod(sizes[g] for g in b) * sizes[f] <= cells:
                b.append(f)
                break
        else:
            out.append([f])
    return out


class Layout:
    """Where a column's bin stands in the codes; every row of codes is one bundle."""

    def __init__(self, borders: list[np.ndarray]):
        self.borders = borders
        self.sizes = [len(b) + 1 for b in borders]
        self.bundles = bundles(self.sizes)
        self.shapes = [tuple(self.sizes[f] for f in b) for b in self.bundles]
        self.of = {f: (b, k) for b, bundle in enumerate(self.bundles) for k, f in enumerate(bundle)}

    def pack(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows: codes and labels as bytes."""
        for batch in batches:
            n = batch.num_rows
            codes = np.zeros((len(self.bundles), n), np.uint16)
            for b, bundle in enumerate(self.bundles):
                bins = [np.searchsorted(self.borders[f], batch.column(1 + f).to_numpy(zero_copy_only=False)) for f in bundle]
                codes[b] = np.ravel_multi_index(bins, self.shapes[b])
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(float)
            if np.isnan(label).any():
                raise ValueError("labels must not be null or NaN")
            yield pa.RecordBatch.from_arrays([pa.array([codes.tobytes()]), pa.array([label.tobytes()])], names=["codes", "label"])

    def blocks(self, packed: Iterator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(codes, label, prediction so far) of at most about ``BLOCK_ROWS`` rows each."""
        codes, labels, n = [], [], 0

        def joined():
            label = np.concatenate(labels)
            return np.concatenate(codes, axis=1), label, np.zeros(len(label))

        for row in packed:
            label = np.frombuffer(row["label"])
            codes.append(np.frombuffer(row["codes"], np.uint16).reshape(len(self.bundles), len(label)))
            labels.append(label)
            n += len(label)
            if n >= BLOCK_ROWS:
                yield joined()
                codes, labels, n = [], [], 0
        if n:
            yield joined()

    def _columns(self, cells: list[np.ndarray]) -> np.ndarray:
        """Sums per column and bin (padded to ``BINS``) from those per code."""
        out = np.zeros((len(self.sizes), BINS))
        for f, (b, k) in self.of.items():
            grid = cells[b].reshape(self.shapes[b])
            out[f, : self.sizes[f]] = grid.sum(axis=tuple(j for j in range(grid.ndim) if j != k))
        return out

    def cells(self, codes: np.ndarray, rest: np.ndarray, rows: np.ndarray | None) -> list[np.ndarray]:
        """Per bundle: count and sum of ``rest`` per code; then the totals. ``rows`` None: all rows."""
        some = rest if rows is None else rest[rows]
        out = []
        for b, shape in enumerate(self.shapes):
            code = codes[b] if rows is None else codes[b][rows]
            out += [np.bincount(code, minlength=math.prod(shape)), np.bincount(code, some, math.prod(shape))]
        return [*out, _totals(some)]

    def sums(self, cells: list[np.ndarray]) -> np.ndarray:
        """Count and sum per column and bin, then the totals."""
        return np.concatenate([self._columns(cells[0:-1:2]).ravel(), self._columns(cells[1:-1:2]).ravel(), cells[-1]])

    def places(self, codes: np.ndarray, splits: Splits) -> dict[int, np.ndarray | None]:
        """The rows in every node of a tree that is not split."""
        at: dict[int, np.ndarray | None] = {0: None}
        for node, (column, place, left, right) in splits.items():  # parents before children
            rows = at.pop(node)
            b, k = self.of[column]
            beyond = np.indices(self.shapes[b])[k].ravel() > place
            over = beyond[codes[b] if rows is None else codes[b][rows]]
            for kid, here in ((left, np.flatnonzero(~over)), (right, np.flatnonzero(over))):
                at[kid] = here if rows is None else rows[here]
        return at


def _totals(some: np.ndarray) -> np.ndarray:
    return np.array([len(some), some.sum(), np.dot(some, some)])


def _rest(label: np.ndarray, made: np.ndarray, first: bool) -> np.ndarray:
    """What the next tree is fitted to."""
    return label if first else 2.0 * (label - made)


def _level(layout: Layout, splits: Splits, wanted: list[int], first: bool, last: bool):
    """A task's sums for the nodes ``wanted`` of a tree grown so far (``last``: their totals only)."""

    def run(blocks):
        added = None
        for codes, label, made in blocks:
            rest, at = _rest(label, made, first), layout.places(codes, splits)
            if last:
                got = [[_totals(rest[at[w]])] for w in wanted]
            else:
                got = [layout.cells(codes, rest, at[w]) for w in wanted]
            added = got if added is None else [[x + y for x, y in zip(m, n)] for m, n in zip(added, got)]
        if added is not None:
            yield [cells[0] if last else layout.sums(cells) for cells in added]

    return run


def _raised(layout: Layout, splits: Splits, values: dict[int, float]):
    """The blocks after a tree: every row's prediction grows by its leaf's value."""

    def run(blocks):
        for codes, label, made in blocks:
            made = made.copy()
            for leaf, rows in layout.places(codes, splits).items():
                made[slice(None) if rows is None else rows] += values[leaf]
            yield codes, label, made

    return run


def _best(h: np.ndarray, columns: int) -> tuple[float, int, int, float]:
    """(gain, column, border, rows to the left) of the split that lowers the squared error most; gain 0: none."""
    n, total, squares = h[-3:]
    if n < 2 or squares / n - (total / n) ** 2 <= 1e-14 * (squares / n):
        return 0.0, -1, -1, 0.0
    left = np.cumsum(h[:-3].reshape(2, columns, BINS), axis=2)[:, :, :-1]
    n_left, t_left = left[0], left[1]
    n_right, t_right = n - n_left, total - t_left
    ok = (n_left > 0.5) & (n_right > 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (t_left * t_left / n_left + t_right * t_right / n_right - total * total / n) / n, 0.0)
    best = gain.max(initial=0.0)
    if best <= 0:
        return 0.0, -1, -1, 0.0
    column, place = np.unravel_index(np.argmax(gain >= best * (1 - TIE)), gain.shape)
    return float(gain[column, place]), int(column), int(place), float(n_left[column, place])


def _tree(state: RDD, layout: Layout, depth: int, first: bool) -> tuple[list[dict], Splits]:
    """One tree: its nodes (the place in the list is the number) and its splits."""

    def counted(wanted: list[int], last: bool = False) -> list[np.ndarray]:
        parts = state.mapPartitions(_level(layout, dict(splits), wanted, first, last)).collect()  # per task: nodes x bins
        return [np.sum([p[i] for p in parts], axis=0) for i in range(len(wanted))]

    splits: Splits = {}
    nodes: list[dict] = [{"kids": None}]
    nodes[0]["sums"] = counted([0])[0]
    level = [0]
    for d in range(depth):
        fresh, small = [], []
        for at in level:
            node = nodes[at]
            gain, column, place, n_left = _best(node["sums"], len(layout.sizes))
            if gain > 0:
                kids = (len(nodes), len(nodes) + 1)
                nodes += [{"kids": None}, {"kids": None}]
                splits[at] = (column, place, *kids)
                node.update(kids=kids, gain=gain, column=column, place=place)
                fresh.append(node)
                small.append(kids[0] if n_left * 2 <= node["sums"][-3] else kids[1])
        if not fresh:
            break
        for node, less, sums in zip(fresh, small, counted(small, d + 1 == depth)):  # leaves need only their totals
            more = sum(node["kids"]) - less
            nodes[less]["sums"], nodes[more]["sums"] = sums, node["sums"][-len(sums) :] - sums
        level = [k for node in fresh for k in node["kids"]]
    return nodes, splits


def _table(nodes: list[dict], tree: int, weight: float, borders: list[np.ndarray]) -> list[tuple]:
    """The nodes in preorder, as MLlib numbers them; two leaves of one value are one leaf."""

    def merge(node: dict) -> None:
        for k in node["kids"] or ():
            merge(nodes[k])
        if node["kids"] and not any(nodes[k]["kids"] for k in node["kids"]):
            a, b = (nodes[k]["sums"][-2] / nodes[k]["sums"][-3] for k in node["kids"])
            if a == b:
                node["kids"] = None

    out: list[tuple] = []

    def add(node: dict) -> int:
        at = len(out)
        stats = tuple(float(x) for x in node["sums"][-3:])
        out.append(())
        end = (-1.0, -1, -1, -1, 0.0)
        if node["kids"]:
            threshold = float(borders[node["column"]][node["place"]])
            end = (node["gain"], *(add(nodes[k]) for k in node["kids"]), node["column"], threshold)
        out[at] = (tree, weight, at, *stats, *end)
        return at

    merge(nodes[0])
    add(nodes[0])
    return out


def boosted_nodes(rows: DataFrame, label: str, cols: Sequence[str], rounds: int, step: float, depth: int, seed: int) -> DataFrame:
    """The nodes of ``rounds`` trees fitted on all of ``rows`` (stored: it is read three times)."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit on")
    x = rows.select(F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in cols])
    some = x if n <= SAMPLE_ROWS else x.sample(SAMPLE_ROWS / n, seed)
    values = some.toPandas()  # about SAMPLE_ROWS rows
    layout = Layout([split_points(values[c].to_numpy(), min(BINS, n)) for c in cols])
    tasks = min(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_ROWS))
    packed = x.repartition(tasks).mapInArrow(layout.pack, "codes binary, label binary")
    state = packed.rdd.mapPartitions(layout.blocks).persist(StorageLevel.MEMORY_AND_DISK)
    table: list[tuple] = []
    before = None
    try:
        for tree in range(rounds):
            weight = step if tree else 1.0
            nodes, splits = _tree(state, layout, depth, first=tree == 0)  # its first job stores ``state``
            if before is not None:
                before.unpersist()
            values = {i: weight * float(m["sums"][-2] / m["sums"][-3]) for i, m in enumerate(nodes) if not m["kids"]}
            table += _table(nodes, tree, weight, layout.borders)
            if tree + 1 < rounds:
                before, state = state, state.mapPartitions(_raised(layout, splits, values), True).persist(StorageLevel.MEMORY_AND_DISK)
                if (tree + 1) % CHECKPOINT_ROUNDS == 0:
                    state.checkpoint()
    finally:
        for kept in (before, state):
            if kept is not None:
                kept.unpersist()
    return spark.createDataFrame(table, _NODE_TYPE)  # a fitted model: 2^depth rows a tree


def fit_boosted(rows: DataFrame, cols: Sequence[str], estimator: GBTRegressor) -> GBTRegressionModel:
    """The model that ``estimator`` describes, fitted on the columns ``cols`` of ``rows`` (they make up its vector)."""
    spark, label = rows.sparkSession, estimator.getLabelCol()
    rounds, step, depth = estimator.getMaxIter(), estimator.getStepSize(), estimator.getMaxDepth()
    root = shared_scratch_path(spark, f"velora-trees/{uuid.uuid4().hex}")
    # the saved form of a model of one leaf on as many columns gives the frame; only trees and their number differ
    zero = Vectors.dense([0.0] * len(cols))
    frame = spark.createDataFrame([(zero, 0.0), (zero, 0.0)], [estimator.getFeaturesCol(), label])
    estimator.copy({estimator.maxIter: 1}).fit(frame).write().save(f"{root}/frame")
    meta = json.loads(spark.read.text(f"{root}/frame/metadata").first()[0])
    meta["numTrees"], meta["paramMap"]["maxIter"] = rounds, rounds
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{root}/model/metadata")
    boosted_nodes(rows, label, cols, rounds, step, depth, estimator.getSeed()).write.parquet(f"{root}/nodes")
    nodes = spark.read.parquet(f"{root}/nodes")
    like = spark.read.parquet(f"{root}/frame/data").schema
    leaf = F.col("left") < 0
    mean = F.col("total") / F.col("n")
    data = {
        "id": F.col("node"), "prediction": mean, "gain": F.col("gain"), "rawCount": F.col("n").cast("long"),
        "impurity": F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)),
        "impurityStats": F.array("n", "total", "squares"), "leftChild": F.col("left"), "rightChild": F.col("right"),
        "split": F.struct(
            F.col("feature").alias("featureIndex"),
            F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("threshold")).alias("leftCategoriesOrThreshold"),
            F.lit(-1).alias("numCategories"),
        ),
    }
    kept = like["nodeData"].dataType
    shaped = F.struct(*[data[f.name].cast(f.dataType).alias(f.name) for f in kept.fields])
    nodes.select(F.col("tree").cast(like["treeID"].dataType).alias("treeID"), shaped.alias("nodeData")).write.parquet(f"{root}/model/data")
    trees = spark.read.parquet(f"{root}/frame/treesMetadata")
    tree, text, weight = trees.columns  # number, description and weight of a tree
    own = nodes.filter("node = 0").select(F.col("tree").cast(trees.schema[tree].dataType).alias(tree), F.col("weight").alias(weight))
    own.crossJoin(F.broadcast(trees.select(text).limit(1))).select(*trees.columns).write.parquet(f"{root}/model/treesMetadata")
    return GBTRegressionModel.load(f"{root}/model")
