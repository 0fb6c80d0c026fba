"""Gradient boosting for any number of classes: softmax loss, one tree a class and round.

Features become bins once (quantile cuts from one mergeable sketch per feature). A round grows the
trees of all classes together, level by level: every task adds its rows' first and second
derivatives into histograms of (class, node, feature, bin), histograms of a block of features meet in one
task, which names the best split of every node in its block, and what reaches the driver is a row
per node and block. Rows keep their bins and scores; a round's trees are added to the scores while
the next round is counted. Kept rows can be rebuilt from the round before, and a checkpoint
cuts that chain every few rounds.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from flowlens.functions.scores import argmax
from flowlens.session import require_checkpoint_dir, ship_package

BLOCK_BYTES = 8 << 20  # of one block's histograms
TASK_BYTES = 256 << 20  # of all histograms of a task; more classes take more passes over the rows
SKETCHED = 100  # features whose cuts come from one pass
CUT_EVERY = 10  # rounds between checkpoints
NONE = -1


def softmax(raw: np.ndarray) -> np.ndarray:
    p = np.exp(raw - raw.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def bin_cuts(df: DataFrame, array: str, width: int, bins: int) -> list[np.ndarray]:
    """Increasing cuts per feature; a value's bin is the number of cuts below it."""
    shares = [i / bins for i in range(1, bins)]
    cuts: list[np.ndarray] = []
    for at in range(0, width, SKETCHED):
        columns = range(at, min(width, at + SKETCHED))
        value = lambda j: F.when(~F.isnan(F.get(array, F.lit(j))), F.get(array, F.lit(j)))
        row = df.agg(
            *[F.percentile_approx(value(j), shares, 20 * bins).alias(f"q{j}") for j in columns],
            *[F.max(value(j)).alias(f"m{j}") for j in columns],
        ).first()
        for j in columns:
            found = np.unique(np.array(row[f"q{j}"] if row[f"q{j}"] is not None else [], float))
            cuts.append(found[found < row[f"m{j}"]] if len(found) else found)
    return cuts


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Rows by features as bins; missing values are above all cuts."""
    out = np.empty(x.shape, np.uint8)
    for j, c in enumerate(cuts):
        out[:, j] = np.where(np.isnan(x[:, j]), len(c), np.searchsorted(c, x[:, j], "left"))
    return out


class _Round:
    """The trees of one round: per class and node a feature, a cut's number and a value.

    Node n has the children 2n + 1 and 2n + 2; a row goes right if its bin is above the cut's. Nodes
    without a feature are leaves.
    """

    def __init__(self, classes: int, depth: int):
        size = (1 << (depth + 1)) - 1
        self.feature = np.full((classes, size), NONE, np.int32)
        self.cut, self.value = np.zeros((classes, size), np.int32), np.zeros((classes, size))

    def node_of(self, columns: np.ndarray, k: int, levels: int) -> np.ndarray:
        """Nodes of rows whose bins are given as features by rows, one after another in memory."""
        n, flat, node = columns.shape[1], columns.reshape(-1), np.arange(self.feature.shape[1])
        leaf = self.feature[k] == NONE
        start = np.where(leaf, 0, self.feature[k]).astype(np.int64) * n
        cut = np.where(leaf, np.iinfo(np.uint8).max, self.cut[k]).astype(np.uint8)  # no bin is above: a row stays
        left = np.where(leaf, node, 2 * node + 1)
        at, rows = np.zeros(n, np.int64), np.arange(n)
        for _ in range(levels):
            at = left.take(at) + (flat.take(start.take(at) + rows) > cut.take(at))
        return at

    def scores(self, columns: np.ndarray, depth: int) -> np.ndarray:
        return np.stack([v[self.node_of(columns, k, depth)] for k, v in enumerate(self.value)], axis=1)


def _column(batch: pa.RecordBatch, name: str, kind, width: int) -> np.ndarray:
    """Fixed-size binary values of a column as rows of numbers."""
    values = batch.column(batch.schema.get_field_index(name)).to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), width)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


class _Trainer:
    def __init__(self, classes: int, width: int, options: dict):
        self.classes, self.width, self.o = classes, width, options
        self.bins = options["bins"]

    def start(self, rows: DataFrame, cuts: list[np.ndarray], prior: np.ndarray) -> DataFrame:
        """(y, bins, raw) of (y, x)."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                raw = np.tile(prior, (batch.num_rows, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), _binary(binned(x, cuts)), _binary(raw)], ["y", "bins", "raw"])

        return rows.mapInArrow(run, "y int, bins binary, raw binary")

    def advanced(self, state: DataFrame, grown: _Round) -> DataFrame:
        classes, width, depth = self.classes, self.width, self.o["depth"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = np.ascontiguousarray(_column(batch, "bins", np.uint8, width).T)
                raw = _column(batch, "raw", float, classes) + grown.scores(columns, depth)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(raw)], ["y", "bins", "raw"])

        return state.mapInArrow(run, "y int, bins binary, raw binary")

    def splits(self, state: DataFrame, grown: _Round, level: int, parallel: int):
        """Per class, node of the level and block: the best split and the sums on its two sides."""
        one = 16 * (1 << level) * self.width * self.bins
        passes = min(self.classes, -(-self.classes * one // TASK_BYTES))
        for some in np.array_split(np.arange(self.classes), passes):
            blocks = min(self.width, max(parallel, -(-len(some) * one // BLOCK_BYTES)))
            yield from self._splits(state, grown, level, some.tolist(), np.array_split(np.arange(self.width), blocks))

    def _splits(self, state: DataFrame, grown: _Round, level: int, some: list[int], parts: list[np.ndarray]):
        classes, width, bins, o = self.classes, self.width, self.bins, self.o
        first, nodes = (1 << level) - 1, 1 << level

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, any_row = np.zeros((2, len(some), nodes, width, bins)), False
            for batch in batches:
                if not batch.num_rows:
                    continue
                any_row = True
                y = batch.column(0).to_numpy()
                columns, p = np.ascontiguousarray(_column(batch, "bins", np.uint8, width).T), softmax(_column(batch, "raw", float, classes))
                for i, k in enumerate(some):
                    node = grown.node_of(columns, k, level) - first
                    live = np.flatnonzero(node >= 0)  # others ended in a leaf above
                    q = p[live, k]
                    g, h, cell = q - (y[live] == k), q * (1 - q), node[live] * bins
                    for j, column in enumerate(columns if len(live) == len(y) else columns[:, live]):
                        at = cell + column  # a feature at a time: its arrays and sums stay in the processor's cache
                        for s, v in zip(sums, (g, h)):
                            s[i, :, j] += np.bincount(at, v, nodes * bins).reshape(nodes, bins)
            if any_row:
                for i, part in enumerate(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([sums[:, :, :, part].tobytes()], pa.binary())], ["block", "sums"])

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, total = None, 0.0
            for batch in batches:
                part = parts[batch.column(0)[0].as_py()]
                for value in batch.column(1):
                    total = total + np.frombuffer(value.as_buffer(), float)
            left = total.reshape(2, len(some), nodes, len(part), bins).cumsum(axis=4)
            whole = left[..., -1:]
            right = whole - left
            worth = lambda s: s[0] ** 2 / (s[1] + o["penalty"])
            gain = worth(left) + worth(right) - worth(whole)
            gain[(left[1] < o["least"]) | (right[1] < o["least"])] = -np.inf
            flat = gain.reshape(len(some), nodes, -1)
            where = flat.argmax(axis=2)
            f, cut = where // bins, where % bins
            k, n = np.indices(where.shape)
            told = [np.array(some)[k], n, part[f], cut, flat.max(axis=2), *(s[i, k, n, f, cut] for s in (left, right) for i in (0, 1))]
            arrays = [pa.array(a.ravel(), pa.int32() if i < 4 else pa.float64()) for i, a in enumerate(told)]
            yield pa.RecordBatch.from_arrays(arrays, ["k", "n", "f", "cut", "gain", "lg", "lh", "rg", "rh"])

        met = state.mapInArrow(count, "block int, sums binary").groupBy("block").applyInArrow(
            best, "k int, n int, f int, cut int, gain double, lg double, lh double, rg double, rh double")
        return met.collect()  # a row per class, node and block

    def grow(self, state: DataFrame, parallel: int, gains: np.ndarray) -> tuple[_Round, bool]:
        o, grown, any_split = self.o, _Round(self.classes, self.o["depth"]), False
        for level in range(o["depth"]):
            first, split = (1 << level) - 1, False
            best: dict[tuple[int, int], tuple] = {}
            for r in self.splits(state, grown, level, parallel):
                key = (r["k"], r["n"])
                if key not in best or (-r["gain"], r["f"]) < (-best[key]["gain"], best[key]["f"]):
                    best[key] = r
            for (k, n), r in sorted(best.items()):
                node = first + n
                if level and grown.feature[k, (node - 1) // 2] == NONE or not r["gain"] > o["gain"]:
                    continue
                split = any_split = True
                grown.feature[k, node], grown.cut[k, node] = r["f"], r["cut"]
                gains[r["f"]] += r["gain"]
                for child, g, h in ((2 * node + 1, r["lg"], r["lh"]), (2 * node + 2, r["rg"], r["rh"])):
                    grown.value[k, child] = -o["rate"] * g / (h + o["penalty"])
            if not split:
                break
        return grown, any_split


class SoftmaxBoosting(Estimator, HasFeaturesCol, HasLabelCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for classes 0 to classes - 1; other labels are refused.

    Defaults are those commonly used: 100 rounds, depth 6, rate 0.3, penalty 1 and least weight 1 of
    second derivatives. ``bins`` is at most 256. Missing values go right. Sums of a task's rows are added in the order
    in which tasks end, so scores of two runs agree to rounding.
    """

    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)
    rounds = Param(Params._dummy(), "rounds", "number of rounds", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "levels of splits", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "share of a tree's values that is added", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a feature", TypeConverters.toInt)
    penalty = Param(Params._dummy(), "penalty", "added to second derivatives", TypeConverters.toFloat)
    least = Param(Params._dummy(), "least", "least second derivatives of a child", TypeConverters.toFloat)
    gain = Param(Params._dummy(), "gain", "a split gains more than this", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, classes=2, rounds=100, depth=6, rate=0.3, bins=32, penalty=1.0, least=1.0, gain=1e-6):
        super().__init__()
        self._setDefault(classes=2, rounds=100, depth=6, rate=0.3, bins=32, penalty=1.0, least=1.0, gain=1e-6)
        self._set(**self._input_kwargs)

    def setFeaturesCol(self, value: str):
        return self._set(featuresCol=value)

    def setLabelCol(self, value: str):
        return self._set(labelCol=value)

    def _options(self) -> dict:
        return {p: self.getOrDefault(p) for p in ("depth", "rate", "bins", "penalty", "least", "gain")}

    def _fit(self, df: DataFrame) -> SoftmaxModel:
        spark, classes, rounds = df.sparkSession, self.getOrDefault("classes"), self.getOrDefault("rounds")
        ship_package(spark)
        require_checkpoint_dir(spark)
        rows = df.select(
            F.col(self.getLabelCol()).cast("int").alias("y"), vector_to_array(self.getFeaturesCol()).alias("x"))
        seen = {r["y"]: (r["n"], r["width"]) for r in rows.groupBy("y").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width")).limit(classes + 1).collect()}
        if not seen or not set(seen) <= set(range(classes)):
            raise ValueError(f"labels must be 0 to {classes - 1}, and there must be rows")
        width = max(w for _, w in seen.values())
        share = np.array([max(seen.get(k, (0, 0))[0], 1e-3) for k in range(classes)], float)
        prior = np.log(share / share.sum())
        cuts = bin_cuts(rows, "x", width, self.getOrDefault("bins"))
        trainer = _Trainer(classes, width, self._options())
        parallel = max(1, min(width, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        state = trainer.start(rows, cuts, prior).persist(StorageLevel.MEMORY_AND_DISK)
        made, gains = [], np.zeros(width)
        try:
            for i in range(rounds):
                grown, any_split = trainer.grow(state, parallel, gains)
                if not any_split:
                    break
                made.append(grown)
                after = trainer.advanced(state, grown)
                if (i + 1) % CUT_EVERY == 0:
                    after = after.checkpoint()
                after = after.persist(StorageLevel.MEMORY_AND_DISK)
                if i + 1 < rounds:
                    after.count()  # written before the round it comes from goes
                state.unpersist()
                state = after
        finally:
            state.unpersist()
        told = {
            "classes": classes, "depth": self.getOrDefault("depth"), "prior": prior.tolist(), "cuts": [c.tolist() for c in cuts],
            "gains": gains.tolist(),
            "rounds": [{"feature": g.feature.tolist(), "cut": g.cut.tolist(), "value": g.value.tolist()} for g in made],
        }
        return SoftmaxModel(trees=json.dumps(told))._set(featuresCol=self.getFeaturesCol())


class SoftmaxModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds rawPrediction, probability and prediction; saved and loaded like any model."""

    trees = Param(Params._dummy(), "trees", "cuts, trees and priors as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, trees=""):
        super().__init__()
        self._set(**self._input_kwargs)

    def _told(self) -> dict:
        return json.loads(self.getOrDefault("trees"))

    @property
    def numRounds(self) -> int:
        return len(self._told()["rounds"])

    @property
    def featureImportances(self):
        """Share of each feature in the gains of all splits."""
        from pyspark.ml.linalg import Vectors

        gains = np.array(self._told()["gains"])
        return Vectors.dense(gains / gains.sum() if gains.sum() else gains)

    def _transform(self, df: DataFrame) -> DataFrame:
        told = self._told()
        prior, depth, cuts = np.array(told["prior"]), told["depth"], [np.array(c) for c in told["cuts"]]
        rounds = []
        for r in told["rounds"]:
            one = _Round(told["classes"], depth)
            one.feature, one.cut, one.value = (np.array(r[k], t) for k, t in (("feature", np.int32), ("cut", np.int32), ("value", float)))
            rounds.append(one)
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((prior, depth, cuts, rounds))

        @F.arrow_udf("array<double>")
        def raw_of(values: pa.Array) -> pa.Array:
            prior, depth, cuts, rounds = shared.value
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), len(cuts))
            columns = np.ascontiguousarray(binned(x, cuts).T)
            raw = np.tile(prior, (len(values), 1))
            for one in rounds:
                raw += one.scores(columns, depth)
            offsets = pa.array(np.arange(0, raw.size + 1, raw.shape[1], dtype=np.int32))
            return pa.ListArray.from_arrays(offsets, pa.array(raw.ravel()))

        raw, p = "__raw", "__p"
        out = df.withColumn(raw, raw_of(vector_to_array(self.getFeaturesCol())))
        top = F.transform(raw, lambda v: F.exp(v - F.array_max(raw)))
        out = out.withColumn(p, top)
        total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
        share = F.transform(p, lambda v: v / total)
        return out.withColumns({
            "rawPrediction": array_to_vector(raw), "probability": array_to_vector(share),
            "prediction": argmax(F.col(raw)).cast("double"),
        }).drop(raw, p)
