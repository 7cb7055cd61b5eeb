"""Gradient boosting of several classes in one model: softmax gradients, histograms summed by partition, growth by leaf.

Features are cut into bins by quantiles once. A round grows a tree a class; a pass over the rows gives, for every open leaf,
the sums of gradients by feature and bin. They are added up within a partition, then by leaf and class in the shuffle,
and the best split of a leaf is found where its sums meet, so a row a leaf comes to the driver. Leaves are split in order of
their gain until the tree has its leaves; their children are the next pass. Rows keep no state between passes: what
earlier trees say of a row is computed anew, so nothing is lost with an executor.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol, HasStepSize
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Added to the sum of second derivatives, and the least gain and rows of a split.
LAMBDA, LEAST_GAIN, LEAST_ROWS = 1.0, 1e-4, 5


class _Columns(HasFeaturesCol, HasLabelCol, HasPredictionCol, HasProbabilityCol, HasRawPredictionCol):
    def setPredictionCol(self, name: str):
        return self._set(predictionCol=name)

    def setProbabilityCol(self, name: str):
        return self._set(probabilityCol=name)

    def setRawPredictionCol(self, name: str):
        return self._set(rawPredictionCol=name)


class Tree:
    """Nodes as lists: feature (-1: a leaf), the last bin that goes left, children, value."""

    def __init__(self):
        self.feature, self.bin, self.left, self.right, self.value, self.depth = [-1], [0], [0], [0], [0.0], [0]

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        new = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.left[node], self.right[node] = feature, at, *new
        for _ in new:
            self.feature.append(-1)
            for x in (self.bin, self.left, self.right):
                x.append(0)
            self.value.append(0.0)
            self.depth.append(self.depth[node] + 1)
        return new

    def leaves(self, goes_left) -> np.ndarray:
        """The node where each row ends; ``goes_left(rows, feature, bin)`` tells which rows go left."""
        return walk(np.array(self.feature), np.array(self.bin), np.array(self.left), np.array(self.right), goes_left)


def walk(feature, at, left, right, goes_left) -> np.ndarray:
    node = goes_left(None, None, None)
    open_ = np.arange(len(node))
    while True:
        open_ = open_[feature[node[open_]] >= 0]
        if not len(open_):
            return node
        here = node[open_]
        node[open_] = np.where(goes_left(open_, feature[here], at[here]), left[here], right[here])


def _on_bins(bins: np.ndarray):
    def goes(rows, feature, at):
        return np.zeros(len(bins), np.int64) if rows is None else bins[rows, feature] <= at

    return goes


class SoftmaxBoost(Estimator, _Columns, HasMaxIter, HasStepSize, DefaultParamsReadable, DefaultParamsWritable):
    """The estimator; labels are 0 to one less than the number of classes."""

    maxDepth = Param(Params._dummy(), "maxDepth", "deepest leaf", TypeConverters.toInt)
    maxLeaves = Param(Params._dummy(), "maxLeaves", "leaves of a tree", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature, at most 256", TypeConverters.toInt)

    def __init__(self, maxIter: int = 20, maxDepth: int = 5, maxLeaves: int = 31, stepSize: float = 0.2, maxBins: int = 64):
        super().__init__()
        self._setDefault(maxIter=20, maxDepth=5, maxLeaves=31, stepSize=0.2, maxBins=64)
        self._set(maxIter=maxIter, maxDepth=maxDepth, maxLeaves=maxLeaves, stepSize=stepSize, maxBins=maxBins)

    def _fit(self, dataset: DataFrame) -> SoftmaxBoostModel:
        bins = self.getOrDefault("maxBins")
        rows = dataset.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("int").alias("y"))
        counts = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}  # a row a class
        classes, total = max(counts) + 1, sum(counts.values())
        shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
        found = rows.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.percentile_approx("v", shares, 10_000).alias("e")).collect()  # a row a feature
        edges = [np.unique(r.e) for r in sorted(found, key=lambda r: r.j)]
        start = np.log(np.array([counts.get(k, 0) + 0.5 for k in range(classes)]) / total)
        data = rows.mapInArrow(lambda batches: _binned(batches, edges), "bins binary, y int").persist()
        trees: list[list[Tree]] = []
        gain = np.zeros(len(edges))
        try:
            for _ in range(self.getMaxIter()):
                trees.append(self._round(data, trees, start, len(edges), bins, classes, gain))
        finally:
            data.unpersist()
        told = {"start": start.tolist(), "step": self.getStepSize(), "gain": gain.tolist(), "edges": [e.tolist() for e in edges], "trees": [[vars(t) for t in r] for r in trees]}
        model = SoftmaxBoostModel(json.dumps(told))
        return self._copyValues(model)

    def _round(self, data: DataFrame, trees: list, start: np.ndarray, features: int, bins: int, classes: int, gain: np.ndarray) -> list[Tree]:
        """A tree a class, grown side by side."""
        step, grown = self.getStepSize(), [Tree() for _ in range(classes)]
        open_ = [[0] for _ in range(classes)]
        while any(open_):
            before, now, wanted = trees, grown, [list(o) for o in open_]

            def sums(batches):
                return _histograms(batches, before, now, wanted, start, step, features, bins)

            def best(table: pa.Table) -> pa.Table:
                return _best_split(table, features, bins)

            hist = data.mapInArrow(sums, "k int, leaf int, hist binary")
            found = hist.groupBy("k", "leaf").applyInArrow(best, "k int, leaf int, gain double, feature int, bin int, g double, h double, gl double, hl double").collect()  # a row a leaf
            open_ = [[] for _ in range(classes)]
            for r in found:  # a leaf that isn't split stays what it is
                grown[r.k].value[r.leaf] = -r.g / (r.h + LAMBDA)
            for r in sorted(found, key=lambda r: -r.gain):
                tree = grown[r.k]
                if r.gain <= LEAST_GAIN or sum(f < 0 for f in tree.feature) >= self.getOrDefault("maxLeaves"):
                    continue
                gain[r.feature] += r.gain
                left, right = tree.split(r.leaf, r.feature, r.bin)
                tree.value[left], tree.value[right] = -r.gl / (r.hl + LAMBDA), -(r.g - r.gl) / (r.h - r.hl + LAMBDA)
                if tree.depth[left] < self.getOrDefault("maxDepth"):
                    open_[r.k] += [left, right]
        return grown


def _binned(batches, edges: list[np.ndarray]):
    for batch in batches:
        if batch.num_rows:
            x = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, len(edges))
            bins = np.column_stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)]).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), batch.column(1)], names=["bins", "y"])


def _histograms(batches, trees, grown, open_, start, step, features: int, bins: int):
    """Sums of first and second derivatives and rows, by open leaf, feature and bin of this partition."""
    place = [np.full(len(t.feature), -1) for t in grown]
    for p, o in zip(place, open_):
        p[o] = np.arange(len(o))
    total = [np.zeros((3, len(o) * features * bins)) for o in open_]
    for batch in batches:
        x = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, features)
        y, score = np.asarray(batch.column(1)), np.tile(start, (len(x), 1))
        for round_ in trees:
            for k, t in enumerate(round_):
                score[:, k] += step * np.array(t.value)[t.leaves(_on_bins(x))]
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        for k, tree in enumerate(grown):
            if not open_[k]:
                continue
            leaf = place[k][tree.leaves(_on_bins(x))]
            own = np.flatnonzero(leaf >= 0)
            at = ((leaf[own, None] * features + np.arange(features)) * bins + x[own]).ravel()
            g, h = p[own, k] - (y[own] == k), p[own, k] * (1 - p[own, k])
            for i, w in enumerate((g, h, np.ones(len(own)))):
                total[k][i] += np.bincount(at, np.repeat(w, features), total[k].shape[1])
    out = [(k, leaf, sums.reshape(3, len(o), -1)[:, i].tobytes()) for k, (o, sums) in enumerate(zip(open_, total)) for i, leaf in enumerate(o)]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["k", "leaf", "hist"])


def _best_split(table: pa.Table, features: int, bins: int) -> pa.Table:
    """The split of a leaf that gains most, from the sums of all partitions."""
    total = sum(np.frombuffer(b, float) for b in table["hist"].to_pylist()).reshape(3, features, bins)
    g, h, n = total[:, 0].sum(axis=1)
    left = total.cumsum(axis=2)
    gl, hl, nl = left
    worth = lambda a, b: a * a / (b + LAMBDA)
    gain = np.where((nl >= LEAST_ROWS) & (n - nl >= LEAST_ROWS), worth(gl, hl) + worth(g - gl, h - hl) - worth(g, h), 0.0)
    j, b = np.unravel_index(int(gain.argmax()), gain.shape)
    row = {"k": table["k"][0].as_py(), "leaf": table["leaf"][0].as_py(), "gain": gain[j, b], "feature": j, "bin": b, "g": g, "h": h, "gl": gl[j, b], "hl": hl[j, b]}
    return pa.table({c: pa.array([v if c in ("k", "leaf") else int(v) if c in ("feature", "bin") else float(v)], pa.int32() if c in ("k", "leaf", "feature", "bin") else pa.float64()) for c, v in row.items()})


class SoftmaxBoostModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Trees of all rounds and classes, kept as a parameter, so the model is saved like any other."""

    trees = Param(Params._dummy(), "trees", "the model as JSON", TypeConverters.toString)

    def __init__(self, trees: str = "{}"):
        super().__init__()
        self._set(trees=trees)

    @property
    def featureImportances(self):
        gain = np.array(json.loads(self.getOrDefault("trees"))["gain"])
        return Vectors.dense(gain / gain.sum() if gain.sum() else gain)

    @property
    def numClasses(self) -> int:
        return len(json.loads(self.getOrDefault("trees"))["start"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        told = json.loads(self.getOrDefault("trees"))
        start, step, edges = np.array(told["start"]), told["step"], [np.array(e) for e in told["edges"]]
        limit = [[np.array([edges[f][min(b, len(edges[f]) - 1)] if f >= 0 and b < len(edges[f]) else np.inf for f, b in zip(t["feature"], t["bin"])]) for t in r] for r in told["trees"]]
        trees = [[{c: np.array(t[c]) for c in ("feature", "left", "right", "value")} for t in r] for r in told["trees"]]

        @F.arrow_udf("array<double>")
        def scores(x: pa.Array) -> pa.Array:
            rows = np.asarray(x.flatten()).reshape(len(x), len(edges))
            score = np.tile(start, (len(rows), 1))
            goes = lambda at, feature, most: np.zeros(len(rows), np.int64) if at is None else rows[at, feature] <= most
            for r, bounds in zip(trees, limit):
                for k, (t, b) in enumerate(zip(r, bounds)):
                    score[:, k] += step * t["value"][walk(t["feature"], b, t["left"], t["right"], goes)]
            return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(start), pa.int32()), pa.array(score.ravel()))

        raw = dataset.withColumn("_raw", scores(vector_to_array(self.getFeaturesCol())))
        top = F.array_max("_raw")
        share = F.transform("_raw", lambda v: F.exp(v - top))
        share = F.transform(share, lambda v: v / F.aggregate(share, F.lit(0.0), lambda a, b: a + b))
        out = raw.withColumns({self.getRawPredictionCol(): array_to_vector("_raw"), self.getProbabilityCol(): array_to_vector(share), self.getPredictionCol(): (F.array_position("_raw", top) - 1).cast("double")})
        return out.drop("_raw")
