"""Tree models of large tables, fitted on cells (see ``cells``): rows alike in all bins are one weighted row.

Boosted trees and single trees are Spark's, fitted on the weighted cells; they are the trees of the rows, up to the rounding
of sums. A forest draws a bootstrap sample: each row comes into a tree's sample a Poisson number of times, so a cell of n rows
comes a Poisson number of times of mean n, which is drawn at once. The cells go to all tasks, and each task grows
whole trees, level by level, with the splits, feature draws and pruning of Spark's forests, but with draws of its own.
All come back as Spark's models, whose thresholds are those of the features.

Cells that don't fit a task, and parameters that tell rows of a cell apart, leave the fit to Spark and the rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassificationModel, DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators.cells import cells
from flowlens.session import require_checkpoint_dir, ship_package
from flowlens.sources.state import written

LEAST_ROWS = 1_000_000  # fewer are fitted by row
MOST_CELLS = 1 << 23  # that a task holds for a forest: with a tree's samples and places about 0.4 GB
HISTOGRAMS = 1 << 22  # numbers of the histograms of one feature and some nodes
NODES = """treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double,
    leftChild int, rightChild int, f int, cut double"""


def fit(estimator, df: DataFrame, features: str = "features", label: str = "y"):
    """The model of an estimator whose columns are set, or None if rows must be looked at one by one."""
    if not _by_cells(estimator):
        return None
    none = "__held"
    rows = df.select(F.col(features).alias("features"), F.col(label).alias("y"), F.lit(False).alias(none))
    with cells(rows, none, estimator.getMaxBins(), estimator.getSeed()) as (few, cuts):
        count = few.count()
        if isinstance(estimator, RandomForestClassifier):
            return _forest(estimator, few, cuts) if count <= MOST_CELLS else None
        # as many bins as make Spark look at every cell for its thresholds: there are none but between the bins
        most = max(estimator.getMaxBins(), math.isqrt(count) + 1)
        own = estimator.copy({estimator.maxBins: most}).setWeightCol("n").setFeaturesCol("features").setLabelCol("y")
        return _on_values(df.sparkSession, own.fit(few), cuts).setFeaturesCol(features)


def _by_cells(estimator) -> bool:
    if not isinstance(estimator, (DecisionTreeClassifier, GBTClassifier, RandomForestClassifier)):
        return False
    plain = estimator.getMinInstancesPerNode() == 1 and not estimator.getMinWeightFractionPerNode() and not estimator.isSet("weightCol")
    if isinstance(estimator, DecisionTreeClassifier):
        return plain
    if isinstance(estimator, GBTClassifier):
        return plain and estimator.getSubsamplingRate() == 1 and not estimator.isSet("validationIndicatorCol")
    return (plain and estimator.getImpurity() == "gini" and estimator.getSubsamplingRate() == 1 and not estimator.getMinInfoGain()
            and _wanted(estimator, 1) is not None)


def _wanted(estimator: RandomForestClassifier, width: int) -> int | None:
    """Features that a node chooses among."""
    kind = estimator.getFeatureSubsetStrategy()
    if kind == "auto":
        kind = "all" if estimator.getNumTrees() == 1 else "sqrt"
    return {"all": width, "sqrt": math.ceil(math.sqrt(width)), "onethird": math.ceil(width / 3),
            "log2": max(1, math.ceil(math.log2(width)))}.get(kind)


def _on_values(spark: SparkSession, model, cuts: list[np.ndarray]):
    """A model of bins' numbers as one of the features: thresholds are values, and a node's rows those of its cells."""
    path = f"{require_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    model.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    single = isinstance(model, DecisionTreeClassificationModel)
    one = (lambda name: F.col(name)) if single else (lambda name: F.col("nodeData")[name])
    values = F.array(*[F.array(*[F.lit(float(v)) for v in c]).cast("array<double>") for c in cuts])
    split, stats = one("split"), one("impurityStats")
    told = F.get(F.get(values, split["featureIndex"]), F.floor(F.get(split["leftCategoriesOrThreshold"], F.lit(0))).cast("int"))
    told = F.when(split["featureIndex"] < 0, split["leftCategoriesOrThreshold"]).otherwise(F.array(told))
    counted = F.aggregate(stats, F.lit(0.0), lambda s, v: s + v) if single else F.get(stats, F.lit(0))  # of classes, or a variance's first
    new = {"split": split.withField("leftCategoriesOrThreshold", told), "rawCount": F.round(counted).cast("long")}
    if single:
        placed = data.withColumns(new)
    else:
        node = F.col("nodeData")
        for name, value in new.items():
            node = node.withField(name, value)
        placed = data.withColumn("nodeData", node)
    written(placed).write.mode("overwrite").parquet(f"{path}/data")
    return type(model).load(path)


def _forest(estimator: RandomForestClassifier, few: DataFrame, cuts: list[np.ndarray]):
    spark = few.sparkSession
    ship_package(spark)
    x, y, n = _table(few, [len(c) + 1 for c in cuts])
    classes, width, trees = max(2, int(y.max()) + 1), len(cuts), estimator.getNumTrees()
    told = spark.sparkContext.broadcast((x, y, n, cuts))
    wanted, depth, seed, draw = _wanted(estimator, width), estimator.getMaxDepth(), estimator.getSeed(), estimator.getBootstrap()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, n, cuts = told.value
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed % (1 << 63), tree])
                w = rng.poisson(n) if draw else n
                yield _rows_of(tree, grown(x, y, w, [len(c) + 1 for c in cuts], classes, depth, wanted, rng), cuts)

    # a model of as many trees and classes of a few rows gives the rest of the files
    some = spark.createDataFrame([(k, [float(k)] * width) for k in range(classes)], "y int, x array<double>")
    own = estimator.copy().setFeaturesCol("features").setLabelCol("y")
    frame = own.fit(some.select("y", array_to_vector("x").alias("features")))
    path = f"{require_checkpoint_dir(spark)}/cells-{uuid.uuid4().hex}"
    frame.write().save(path)
    schema = spark.read.parquet(f"{path}/data").schema
    leaf = F.col("f") < 0
    split = F.struct(F.col("f").alias("featureIndex"), F.when(leaf, F.array().cast("array<double>")).otherwise(F.array("cut"))
                     .alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    values = {"split": split} | {c: F.col(c) for c in ("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild")}
    kind = schema["nodeData"].dataType
    node = F.struct(*[values[f.name].alias(f.name) for f in kind.fields]).cast(kind)
    made = spark.range(0, trees, 1, trees).mapInArrow(run, NODES)
    made.select(F.col("treeID").cast(schema["treeID"].dataType), node.alias("nodeData")).write.mode("overwrite").parquet(f"{path}/data")
    told.unpersist()
    return type(frame).load(path).setFeaturesCol(estimator.getFeaturesCol())


def _table(few: DataFrame, sizes: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (features by cells), classes and numbers of rows of all cells, in the order of bins and classes."""
    kind = np.uint8 if max(sizes, default=1) <= 256 else np.uint16
    if few.where("y IS NULL OR y < 0 OR y > 255").limit(1).count():
        raise ValueError("labels must be 0 to 255")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(kind)
            columns = [x, batch.column(1).to_numpy().astype(np.uint8), batch.column(2).to_numpy().astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["x", "y", "n"])

    packed = few.select(vector_to_array("features").alias("x"), F.col("y").cast("int"), "n").mapInArrow(run, "x binary, y binary, n binary").collect()
    parts = [np.frombuffer(b"".join(bytes(r[i]) for r in packed), t) for i, t in enumerate((kind, np.uint8, np.int64))]
    x = parts[0].reshape(-1, len(sizes))
    order = np.lexsort((parts[1], *x.T[::-1]))  # whatever the order in which cells came
    return np.ascontiguousarray(x[order].T), parts[1][order], parts[2][order]


def _gini(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    return 1 - ((counts / np.maximum(n, 1e-300)[..., None]) ** 2).sum(axis=-1)


def _best(x: np.ndarray, y: np.ndarray, w: np.ndarray, node: np.ndarray, total: np.ndarray, sizes: Sequence[int], chosen: np.ndarray):
    """Per node the best split's gain, feature, last bin on the left and left counts; gain -inf if none parts its rows."""
    k, classes = total.shape
    gain, feature, cut, left = np.full(k, -np.inf), np.full(k, -1), np.zeros(k, np.int64), np.zeros_like(total)
    n = total.sum(axis=1)
    own = _gini(total, n)
    for j, bins in enumerate(sizes):
        if bins < 2:
            continue
        at = node * bins
        at += x[j]
        at *= classes
        at += y
        below = np.bincount(at, w, k * bins * classes).reshape(k, bins, classes).cumsum(axis=1)[:, :-1]
        nl = below.sum(axis=2)
        above = total[:, None] - below
        nr = n[:, None] - nl
        worth = own[:, None] - nl / n[:, None] * _gini(below, nl) - nr / n[:, None] * _gini(above, nr)
        worth[(nl == 0) | (nr == 0) | ~chosen[:, j, None]] = -np.inf
        place = worth.argmax(axis=1)
        top = worth[np.arange(k), place]
        better = top > gain
        gain[better], feature[better], cut[better] = top[better], j, place[better]
        left[better] = below[better, place[better]]
    return gain, feature, cut, left


def grown(x: np.ndarray, y: np.ndarray, w: np.ndarray, sizes: Sequence[int], classes: int, depth: int, wanted: int, rng: np.random.Generator) -> dict:
    """A tree's nodes in level order: counts, gain, feature (-1 for leaves), cut, left child (the right one follows),
    and the first node of every level."""
    some = np.flatnonzero(w)
    x, y, w, node = x[:, some], y[some].astype(np.intp), w[some].astype(float), np.zeros(len(some), np.intp)
    counts = [np.bincount(y, w, classes)[None]]
    told, levels, opened = {c: [] for c in ("gain", "feature", "cut", "child")}, [0, 1], np.array([0])
    for level in range(depth + 1):
        size = len(counts[-1])
        kept = {"gain": np.full(size, -1.0), "feature": np.full(size, -1), "cut": np.zeros(size, np.int64), "child": np.full(size, -1)}
        for name, value in kept.items():
            told[name].append(value)
        if level == depth or not len(opened):
            break
        total = counts[-1][opened]
        chosen = rng.random((len(opened), len(sizes))).argsort(axis=1).argsort(axis=1) < wanted
        gain, feature, cut, left = _level(x, y, w, node, total, sizes, chosen)
        splits = np.flatnonzero(gain > 0)
        if not len(splits):
            break
        at = opened[splits]
        kept["gain"][at], kept["feature"][at], kept["cut"][at] = gain[splits], feature[splits], cut[splits]
        kept["child"][at] = levels[-1] + 2 * np.arange(len(splits))
        below = np.empty((2 * len(splits), classes))
        below[::2], below[1::2] = left[splits], total[splits] - left[splits]
        counts.append(below)
        levels.append(levels[-1] + len(below))
        # rows go to the open nodes below; a pure one is a leaf
        impure = (below > 0).sum(axis=1) > 1
        number = np.where(impure, np.cumsum(impure) - 1, -1)
        opened = np.flatnonzero(impure)
        child = np.full((len(gain), 2), -1)
        child[splits] = number.reshape(-1, 2)
        start = np.where(gain > 0, feature, 0) * x.shape[1]
        right = x.ravel().take(start.take(node) + np.arange(x.shape[1])) > cut.take(node)
        node = child.ravel().take(2 * node + right)
        stay = np.flatnonzero(node >= 0)
        if len(stay) < len(node):
            x, y, w, node = x[:, stay], y[stay], w[stay], node[stay]
    return {"counts": np.concatenate(counts), "levels": levels, **{c: np.concatenate(v) for c, v in told.items()}}


def _level(x, y, w, node, total, sizes, chosen):
    """The best splits of a level's nodes, some nodes at a time if their histograms are large."""
    most = max(1, HISTOGRAMS // (max(sizes) * total.shape[1]))
    if len(total) <= most:
        return _best(x, y, w, node, total, sizes, chosen)
    order = np.argsort(node, kind="stable")
    edges = np.searchsorted(node[order], np.arange(0, len(total) + most, most))
    parts = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        some, nodes = order[a:b], slice(i * most, (i + 1) * most)
        parts.append(_best(x[:, some], y[some], w[some], node[some] - i * most, total[nodes], sizes, chosen[nodes]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _rows_of(tree: int, nodes: dict, cuts: list[np.ndarray]) -> pa.RecordBatch:
    """Node rows as Spark saves them: splits whose leaves tell the same class are none, nodes are numbered in preorder."""
    counts, child, levels = nodes["counts"], nodes["child"].copy(), nodes["levels"]
    told, size = counts.argmax(axis=1), np.ones(len(counts), np.int64)
    ranges = list(zip(levels, levels[1:]))
    for a, b in reversed(ranges):
        at = a + np.flatnonzero(child[a:b] >= 0)
        left = child[at]
        none = (child[left] < 0) & (child[left + 1] < 0) & (told[left] == told[left + 1])
        child[at[none]] = -1
        at, left = at[~none], left[~none]
        size[at] += size[left] + size[left + 1]
    number = np.full(len(counts), -1)
    number[0] = 0
    for a, b in ranges:
        at = a + np.flatnonzero((child[a:b] >= 0) & (number[a:b] >= 0))
        left = child[at]
        number[left], number[left + 1] = number[at] + 1, number[at] + 1 + size[left]
    some = np.flatnonzero(number >= 0)
    some = some[number[some].argsort()]
    inner = child[some] >= 0
    f = np.where(inner, nodes["feature"][some], -1)
    cut = np.array([cuts[j][c] if j >= 0 else 0.0 for j, c in zip(f, nodes["cut"][some])])
    left = np.where(inner, number[child[some]], -1)
    right = np.where(inner, number[np.minimum(child[some] + 1, len(number) - 1)], -1)
    n = counts[some].sum(axis=1)
    offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * counts.shape[1])
    arrays = [
        pa.array(np.full(len(some), tree), pa.int32()), pa.array(number[some], pa.int32()), pa.array(told[some].astype(float)),
        pa.array(_gini(counts[some], n)), pa.ListArray.from_arrays(offsets, pa.array(counts[some].ravel())), pa.array(n.astype(np.int64)),
        pa.array(np.where(inner, nodes["gain"][some], -1.0)), pa.array(left, pa.int32()), pa.array(right, pa.int32()),
        pa.array(f, pa.int32()), pa.array(cut),
    ]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in NODES.split(",")])
