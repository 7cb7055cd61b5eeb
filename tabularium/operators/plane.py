"""Mutual information of two continuous variables from nearest neighbours in the plane.

Both variables are taken from their mean and divided by their spread. For each row, the distance to its k-th nearest row (the larger of the two
differences counts) says how wide a neighbourhood is; the numbers of rows that are as near in one variable alone say how
crowded each is: I = psi(N) + psi(k) - <psi(rows near in x)> - <psi(rows near in y)>.

The plane of each feature is cut into strips of x and each strip into cells of y, by quantiles, so cells hold about
``CELL`` points however these are spread. A cell finds the k nearest points within itself, sweeping them in order of x.
Where the box of that distance reaches over the cell's borders, the point asks the other cells that the box touches, and
the nearest of all answers count. A cell with too few points for k neighbours takes the distance to the far corner of
the nearest cell that has enough, which bounds the search as well. Rows nearby in one variable are counted by running sums
in ranges of its order. Points are distinct, with counts, so repeated rows cost nothing; no task holds a column, and no
pairs of cells are tried but those that boxes touch.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import bounds, range_of
from ..functions.stats import digamma
from ..sources.shared import checkpointed

#: Neighbours that make a neighbourhood, and points a cell, about.
NEIGHBOURS, CELL = 3, 1024
#: Distances that a task holds at once.
PAIRS = 1 << 21
#: By this share of its width a neighbourhood is narrowed before rows nearby are counted, and by this share of the value: the row that made the width is outside, whatever was rounded.
NARROW, ROUNDING = 1e-9, 1e-15


def nearest(x: np.ndarray, y: np.ndarray, weight: np.ndarray, at_x: np.ndarray, at_y: np.ndarray, k: int, inside: bool) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances from each asking point to the points (ascending; infinite beyond the last) and the counts there.

    ``inside``: the asking points are the points themselves, and none is its own neighbour.
    """
    n, m = len(x), len(at_x)
    found, count = np.full((m, k), np.inf), np.zeros((m, k), np.int64)
    order, asking = np.argsort(x, kind="stable"), np.argsort(at_x, kind="stable")
    own = np.empty(n, np.int64)
    own[order] = np.arange(n)
    x, y, weight = x[order], y[order], weight[order]
    beside = np.arange(-4 * k, 4 * k + 1)
    for a in range(0, m, 256):
        q = asking[a : a + 256]
        qx, qy = at_x[q][:, None], at_y[q][:, None]
        # points beside it in the order of x bound the distance
        place = own[q] if inside else np.searchsorted(x, at_x[q])
        near = place[:, None] + beside
        valid = (near >= 0) & (near < n)
        if inside:
            valid &= beside != 0
        near = np.clip(near, 0, n - 1)
        d = np.where(valid, np.maximum(np.abs(x[near] - qx), np.abs(y[near] - qy)), np.inf)
        reach = np.partition(d, k - 1, axis=1)[:, k - 1].max()
        lo, hi = (0, n) if np.isinf(reach) else (int(np.searchsorted(x, qx.min() - reach * (1 + NARROW))), int(np.searchsorted(x, qx.max() + reach * (1 + NARROW), "right")))
        take, step = min(k, hi - lo), max(1, PAIRS // max(1, hi - lo))
        for b in range(0, len(q) if take else 0, step):
            d = np.maximum(np.abs(x[lo:hi] - qx[b : b + step]), np.abs(y[lo:hi] - qy[b : b + step]))
            if inside:
                mine = place[b : b + step] - lo
                d[np.arange(len(d)), mine] = np.inf
            best = np.argpartition(d, take - 1, axis=1)[:, :take] if take < hi - lo else np.broadcast_to(np.arange(take), d.shape)
            got = np.take_along_axis(d, best, axis=1)
            sort = np.argsort(got, axis=1, kind="stable")
            rows = q[b : b + step]
            found[rows, :take] = np.take_along_axis(got, sort, axis=1)
            count[rows, :take] = np.where(np.isinf(found[rows, :take]), 0, weight[lo:hi][np.take_along_axis(best, sort, axis=1)])
    return found, count


def _near_column(found: np.ndarray, count: np.ndarray) -> pa.Array:
    """Arrays of (d, n), without the infinite ones."""
    there = np.isfinite(found)
    flat = pa.StructArray.from_arrays([pa.array(found[there]), pa.array(count[there])], names=["d", "n"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(there.sum(axis=1)))), pa.int32()), flat)


def _reach(near: Column, n: Column, want: Column) -> Column:
    """The distance within which ``want`` other rows lie: those of the same point, then those of ``near`` in order; null if too few."""
    start = F.struct((n - 1).alias("have"), F.lit(0.0).alias("reach"))
    step = lambda a, s: F.when(a["have"] >= want, a).otherwise(F.struct((a["have"] + s["n"]).alias("have"), s["d"].alias("reach")))
    last = F.aggregate(F.array_sort(near), start, step)
    return F.when(last["have"] >= want, last["reach"])


def counted(points: DataFrame, value: str, asked: DataFrame, name: str) -> DataFrame:
    """(feature, x, y, ``name``): rows of each asking point's neighbourhood in one variable.

    ``points`` has (feature, ``value``, n); ``asked`` (feature, x, y, lo, hi, open): rows strictly between or, if not
    ``open``, from lo to hi count.
    """
    cells = points.groupBy("feature", F.col(value).alias("at")).agg(F.sum("n").alias("w"))
    parts = max(2, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = checkpointed(bounds(cells, "at", ("feature",), parts))  # a row a feature
    nobody = F.lit(None).cast("double")
    rows = cells.select("feature", "at", F.lit(1).alias("turn"), "w", F.lit(0).alias("sign"), nobody.alias("x"), nobody.alias("y"))
    ask = lambda at, turn, sign: F.struct(F.col(at).alias("at"), turn.alias("turn"), F.lit(0).cast("long").alias("w"), F.lit(sign).alias("sign"), F.col("x"), F.col("y"))
    events = F.array(ask("lo", F.when(F.col("open"), 2).otherwise(0), -1), ask("hi", F.when(F.col("open"), 0).otherwise(2), 1))
    placed = rows.unionByName(asked.select("feature", F.inline(events))).join(F.broadcast(cuts), "feature").withColumn("_range", range_of(F.col("at"), parts)).drop("_bounds")
    totals = rows.join(F.broadcast(cuts), "feature").groupBy("feature", range_of(F.col("at"), parts).alias("_range")).agg(F.sum("w").alias("_total"))
    every = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_range")).join(totals, ["feature", "_range"], "left")
    so_far = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    below = every.select("feature", "_range", F.sum("_total").over(so_far).alias("_ahead"))
    w = Window.partitionBy("feature", "_range").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    upto = placed.join(below, ["feature", "_range"]).withColumn("_upto", F.sum("w").over(w) + F.coalesce("_ahead", F.lit(0)))
    return upto.where("sign <> 0").groupBy("feature", "x", "y").agg(F.sum(F.col("sign") * F.col("_upto")).alias(name))


def neighbourhoods(points: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, x, y, n, reach, want): of distinct points (feature, x, y, n), the distance within which k other rows lie.

    ``want`` is k, or how many others there are, if fewer. Features of one row are left out.
    """
    points = checkpointed(points)
    totals = points.groupBy("feature").agg(F.sum("n").alias("total"), F.count("*").alias("points")).where("total > 1")
    most = points.groupBy("feature").count().agg(F.max("count")).first()[0] or 0
    side = max(1, round((most / CELL) ** 0.5))
    strips = checkpointed(bounds(points, "x", ("feature",), side).withColumnRenamed("_bounds", "xs"))  # a row a feature
    inside = lambda v, b: F.when(F.col(b).isNull(), 0).otherwise(F.size(F.filter(b, lambda e: e <= v)))
    cut = points.join(F.broadcast(totals.drop("points")), "feature").join(F.broadcast(strips), "feature").withColumn("strip", inside(F.col("x"), "xs")).drop("xs")
    cells = checkpointed(bounds(cut, "y", ("feature", "strip"), side).withColumnRenamed("_bounds", "ys"))  # a row a strip
    cut = cut.join(cells, ["feature", "strip"]).withColumn("cell", inside(F.col("y"), "ys")).drop("ys")
    cut = cut.withColumn("want", F.least(F.lit(k), F.col("total") - 1).cast("int"))
    keys = ["feature", "strip", "cell"]

    def own(table: pa.Table) -> pa.Table:
        x, y, n = (np.asarray(table[c]) for c in ("x", "y", "n"))
        return table.append_column("near", _near_column(*nearest(x, y, n, x, y, k, True)))

    shape = "feature string, strip int, cell int, x double, y double, n long, want int"
    first = cut.select("feature", "strip", "cell", "x", "y", "n", "want").groupBy(*keys).applyInArrow(own, shape + ", near array<struct<d:double,n:long>>")
    first = checkpointed(first.withColumn("reach", _reach(F.col("near"), F.col("n"), F.col("want"))))

    # points of thin cells: the far corner of the nearest cell that holds enough rows bounds their search
    boxes = first.groupBy(*keys).agg(*[f(c).alias(f"{name}{c}") for c in ("x", "y") for name, f in (("min_", F.min), ("max_", F.max))], F.sum("n").alias("rows"))
    corner = F.greatest(*[F.abs(F.col(c) - F.col(f"{e}_{c}")) for c in ("x", "y") for e in ("min", "max")])
    full, one = boxes.where(F.col("rows") > k).drop("cell"), ["feature", "x", "y"]
    thin = first.where("reach IS NULL").select("feature", "strip", "x", "y")
    far = thin.join(thin.join(full, ["feature", "strip"]).groupBy(*one).agg(F.min(corner).alias("far")), one, "left").drop("strip")  # in its strip
    rest = far.where("far IS NULL").drop("far").join(full.drop("strip"), "feature").groupBy(*one).agg(F.min(corner).alias("far"))  # of strips without such a cell
    asked = first.join(far.where("far IS NOT NULL").unionByName(rest), one, "left").withColumn("width", F.coalesce("reach", "far", F.lit(float("inf"))) * (1 + NARROW))

    # every cell that a point's box touches, but its own
    span = lambda v, b: F.sequence(inside(v - F.col("width"), b), inside(v + F.col("width"), b))
    asked = asked.where("width > 0").join(F.broadcast(strips), "feature").withColumn("to_strip", F.explode(span(F.col("x"), "xs"))).drop("xs", "near")
    asked = asked.join(cells.withColumnRenamed("strip", "to_strip"), ["feature", "to_strip"]).withColumn("to_cell", F.explode(span(F.col("y"), "ys")))
    asked = asked.where("to_strip <> strip OR to_cell <> cell").select("feature", F.col("to_strip").alias("strip"), F.col("to_cell").alias("cell"), "x", "y", "width")

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y, n = (np.asarray(right[c]) for c in ("x", "y", "n"))
        if not len(x) or not left.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.float64()), _near_column(np.empty((0, k)), np.empty((0, k), np.int64))], names=["feature", "x", "y", "near"])
        d, n = nearest(x, y, n, np.asarray(left["x"]), np.asarray(left["y"]), k, False)
        d[d > np.asarray(left["width"])[:, None]] = np.inf
        return pa.Table.from_arrays([left["feature"], left["x"], left["y"], _near_column(d, n)], names=["feature", "x", "y", "near"])

    here = first.select(*keys, "x", "y", "n")
    asked, here = asked.toDF(*asked.columns), here.toDF(*here.columns)
    answers = asked.groupBy(*keys).cogroup(here.groupBy(*keys)).applyInArrow(others, "feature string, x double, y double, near array<struct<d:double,n:long>>")
    answers = answers.where(F.size("near") > 0).groupBy("feature", "x", "y").agg(F.flatten(F.collect_list("near")).alias("more"))  # k from each cell that the box touches
    every = first.join(answers, ["feature", "x", "y"], "left").withColumn("near", F.concat("near", F.coalesce("more", F.array().cast("array<struct<d:double,n:long>>"))))
    return every.select("feature", "x", "y", "n", _reach(F.col("near"), F.col("n"), F.col("want")).alias("reach"), "want")


def plane_information(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, mutual_info) in nats of rows (feature, x, y) of two continuous variables; never below zero.

    Rows with a null or without a finite value are left out. Where more than k rows are one point, the point itself is the
    neighbourhood, so of variables that are all ties the sum is that of the counts. A variable that doesn't vary gives 0; a
    feature of one row is absent.
    """
    valid = rows.where((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    points = valid.groupBy("feature", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("n"))
    points = checkpointed(points)
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    middle = points.groupBy("feature").agg(mean("x").alias("mx"), mean("y").alias("my"))
    points = points.join(F.broadcast(middle), "feature").select("feature", (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), "n")  # a row a feature
    spread = points.groupBy("feature").agg(*[F.sqrt(F.sum(F.col("n") * F.col(c) * F.col(c)) / F.sum("n")).alias(f"s{c}") for c in ("x", "y")])
    scaled = points.join(F.broadcast(spread), "feature").select("feature", *[F.when(F.col(f"s{c}") > 0, F.col(c) / F.col(f"s{c}")).otherwise(F.lit(0.0)).alias(c) for c in ("x", "y")], "n")
    near = checkpointed(neighbourhoods(scaled, k))
    wide = F.col("reach") > 0
    around = lambda c: F.greatest(F.lit(0.0), F.col("reach") * (1 - NARROW) - F.abs(c) * ROUNDING)
    asked = lambda c: near.select("feature", "x", "y", (F.col(c) - around(c)).alias("lo"), (F.col(c) + around(c)).alias("hi"), (wide & (around(c) > 0)).alias("open"))
    both = near.join(counted(near, "x", asked("x"), "nx"), ["feature", "x", "y"]).join(counted(near, "y", asked("y"), "ny"), ["feature", "x", "y"])
    k_here = F.when(wide, F.col("want")).otherwise(F.col("n"))
    terms = digamma(k_here) - digamma(F.col("nx")) - digamma(F.col("ny"))
    out = both.groupBy("feature").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * terms) / F.sum("n")).alias("mean"))
    return out.select("feature", F.greatest(F.lit(0.0), digamma(F.col("total")) + F.col("mean")).alias("mutual_info"))
