"""Forests on long tables whose rows differ little once their columns are in bins.

A tree sees a row by the bins of its values and its label only, so rows that agree in these are one cell with a count, and
nothing is lost by that. Drawing rows with replacement gives each of them a Poisson number of copies with mean 1, and so a
cell of n rows one with mean n: it is drawn for each tree. Trees are fitted one by one on the cells, whose number doesn't
follow that of the rows.
"""

from __future__ import annotations

from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import df_col
from ..sources.shared import checkpointed
from . import registry

#: Bins of a column, as Spark's forests cut it, the quantiles that their bounds are chosen from, and the accuracy of these.
BINS, POINTS, ACCURACY = 32, 10_000, 1e-4
#: Rows up to which a forest takes them as they are, and how many rows a cell must hold on average else.
FEW_ROWS, LEAST_SHARED = 300_000, 8
#: Trees that are fitted at the same time, and cells a partition.
AT_ONCE, PART = 8, 100_000


def cuts(points: list[float]) -> list[float]:
    """Where a column is cut, from evenly spaced quantiles: between all of its values if they are few, else where the rows
    so far are nearest to the next of even shares; as Spark's forests do from a sample of as many rows."""
    values, counts = np.unique(points, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2
    between = np.where(middle > values[:-1], middle, values[1:]).tolist()  # there is nothing between some neighbours
    if len(values) <= BINS:
        return between
    out, share, upto = [], len(points) / BINS, np.cumsum(counts).tolist()
    for at, before, now in zip(between, upto, upto[1:]):
        if abs(before - (len(out) + 1) * share) < abs(now - (len(out) + 1) * share):
            out.append(at)
    return out


def bounds(table: DataFrame, columns: list[str]) -> list[list[float]]:
    """The bounds of each column's bins."""
    points = table.approxQuantile(columns, [(k + 0.5) / POINTS for k in range(POINTS)], ACCURACY)
    return [[-np.inf, *sorted({c for c in cuts(p) if np.isfinite(c)}), np.inf] for p in points]


def cells_of(data: DataFrame, features: list[str], label: str) -> tuple[DataFrame, list[str]] | None:
    """(b0, b1, ..., label, rows), a row a cell, and the columns of the bins; None where the table is short or its rows have
    too little in common."""
    n = data.count()
    if n <= FEW_ROWS:
        return None
    columns = [f"x{i}" for i in range(len(features))]
    table = data.select(*[df_col(c).alias(x) for c, x in zip(features, columns)], df_col(label).alias("label"))
    bins = [f"b{i}" for i in range(len(features))]
    cuts = bounds(table, columns)
    cut = [i for i, c in enumerate(cuts) if len(c) > 2]  # the others have one bin
    if cut:
        table = Bucketizer(splitsArray=[cuts[i] for i in cut], inputCols=[columns[i] for i in cut], outputCols=[bins[i] for i in cut], handleInvalid="keep").transform(table)
    table = table.select(*[(F.col(b) + 0.0 if i in cut else F.lit(0.0)).alias(b) for i, b in enumerate(bins)], "label")  # a sum isn't nominal, as the bucketizer's numbers are: trees keep their order
    if table.agg(F.approx_count_distinct(F.xxhash64(*bins, "label"))).first()[0] * LEAST_SHARED > n:
        return None
    return checkpointed(table.groupBy(*bins, "label").agg(F.count("*").alias("rows"))), bins


def draws(batches, trees: int, seed: int):
    """Cells with ``drawn``: how many rows of each every tree gets. The numbers depend on the seed and the cell's own hash only."""
    for batch in batches:
        hashes, counts = np.asarray(batch.column("hash")).view(np.uint64).tolist(), batch.column("rows").to_pylist()
        drawn = np.array([np.random.default_rng((seed, h)).poisson(n, trees) for h, n in zip(hashes, counts)], np.int64).reshape(-1)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * trees, pa.int32()), pa.array(drawn))
        yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "drawn"])


def forest_importances(data: DataFrame, features: list[str], label: str, task: str, classes: int, params: dict) -> list[tuple[str, float]]:
    """(feature, importance), most important first, of a random forest with ``params``; from cells where the table allows it."""
    found = cells_of(data, features, label) if features else None
    if found is None:
        return registry.importances(registry.fit("randomforest", task, classes, registry.assemble(data, features, label), params), features)
    (cells, bins), trees = found, params["numTrees"]
    hashed = cells.withColumn("hash", F.xxhash64(*bins, "label"))
    schema = hashed.select("*", F.array(F.col("rows")).alias("drawn")).schema
    drawn = registry.assemble(hashed.mapInArrow(lambda batches: draws(batches, trees, registry.SEED), schema), bins, "label", ("drawn",))
    drawn = drawn.repartition(max(1, cells.count() // PART)).persist()
    drawn.count()  # before trees ask for it side by side
    own = params | {"numTrees": 1, "bootstrap": False, "featureSubsetStrategy": "onethird" if task == "regression" else "sqrt", "weightCol": "weight"}  # what a forest does in each node

    def tree(i: int) -> dict[str, float]:
        rows = drawn.select("features", "label", F.col("drawn")[i].cast("double").alias("weight")).where("weight > 0")
        return dict(registry.importances(registry.fit("randomforest", task, classes, rows, own | {"seed": registry.SEED + i}), features))

    tasks = [inheritable_thread_target(data.sparkSession)(partial(tree, i)) for i in range(trees)]  # copies this thread's properties each time: threads that shared one copy would change it under each other
    try:
        with ThreadPool(AT_ONCE) as pool:
            each = pool.map(lambda task: task(), tasks, 1)
    finally:
        drawn.unpersist()
    total = sum(v for one in each for v in one.values()) or 1.0
    return sorted(((c, sum(one[c] for one in each) / total) for c in features), key=lambda x: (-x[1], x[0]))
