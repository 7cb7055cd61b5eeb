"""Hard negatives: for an anchor and a row like it, the best rows of other labels that score nearly as high, but not higher.

Scores are inner products of whole numbers, and are made a distance by one more component: a row gets the square root of
what its squared norm lacks to the largest one, an anchor gets 0; then the nearest rows are those of the highest product.
All rows are assigned to the nearest of at most ``PIVOTS`` pivots (a sample by hash), and their distance to it is kept.
Anchors of neighbouring cells form blocks of about ``ANCHORS``; a crowded cell is cut into several.

A row goes only to blocks that it might serve, by the triangle inequality on its cell's pivot: a block's reach from a
pivot is known from its anchors' own distances to it. For likes (the first rows of the anchor's label) the reach is an
upper bound of the distance of the last one wanted, from cells that hold enough rows of the label. For negatives it is the
ring between the lowest and the highest score that the anchor's likes ask for, known by then. What a block gets is cut by
hash into pieces of about ``CANDIDATES`` rows, each joined exactly with the block's anchors by products of matrices, so
a task holds one piece and one block; each gives the first rows of each anchor, and these are merged by a window over
few rows an anchor. On vectors without clusters, bounds exclude little: then every block gets nearly all rows.

Scores are exact: in doubles while whole numbers below 2**53 hold them, in Python's integers beyond (kept within 64 bits).

Defined cases: rows with a null label, a null vector or a null or non-finite component take no part; rows alike in key,
label and vector count once; rows that share a key only are separate, each an anchor of its own; a row with a null key is
never an anchor, and comes last in ties; shorter vectors count as filled up with zeros, an empty one is all zeros;
components beyond 64 bits stop there; an anchor without likes, or a like without negatives, gives no rows; a negative
product is nobody's hard positive (nothing lies between it and a part of it); an empty table gives no rows; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_rows, checkpointed, quoted

PIVOTS, ANCHORS, CANDIDATES = 64, 512, 20_000
#: Most rows of routes (32 bytes each) that are broadcast.
BROADCAST_ROUTES = 100_000
#: What distances may be off by rounding, as a share of the largest norm.
SLACK = 1e-5
LONG = 2**63 - 1


def usable(rows: DataFrame, key: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(rid, id, label, v, norm2) of the rows that take part: whole numbers floor(scale * x), numbered and written."""
    x = quoted(vector)
    plain = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))  # NaN is above all numbers
    v = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    own = rows.where(plain).select(quoted(key).cast("long").alias("id"), label.alias("label"), v.alias("v")).where("label IS NOT NULL").distinct()
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return checkpointed(own.select(F.monotonically_increasing_id().alias("rid"), "id", "label", "v", norm2.alias("norm2")))


def matrix(vectors, size: int) -> np.ndarray:
    """A row a vector, filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, length = np.asarray(vectors.flatten()), np.diff(np.asarray(vectors.offsets))
    if len(length) and (length == size).all():
        return flat.reshape(len(length), size)
    out = np.zeros((len(length), size), flat.dtype)
    out[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray, exact_in_double: bool) -> np.ndarray:
    """Inner products of all rows of both, exact, as 64-bit integers."""
    if exact_in_double:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, -LONG, LONG).astype(np.int64)


class Pivots:
    """Distances to the pivots in the space with one more component."""

    def __init__(self, vectors: np.ndarray, largest: float):
        self.size, self.largest = vectors.shape[1], largest
        self.points = self.raised(vectors.astype(float))

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Rows with the component that brings each to the largest norm."""
        return np.column_stack([x, np.sqrt(np.maximum(0.0, self.largest - (x * x).sum(axis=1)))])

    def distances(self, x: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1)[:, None] + (self.points * self.points).sum(axis=1) - 2 * x @ self.points.T
        return np.sqrt(np.maximum(0.0, square))

    def cells(self, vectors) -> pa.Array:
        """(cell, far) of rows."""
        d = self.distances(self.raised(matrix(vectors, self.size).astype(float)))
        cell = d.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], names=["cell", "far"])

    def from_anchors(self, vectors) -> pa.Array:
        """Each anchor's distance to every pivot."""
        x = matrix(vectors, self.size).astype(float)
        d = self.distances(np.column_stack([x, np.zeros(len(x))]))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32()), pa.array(d.ravel()))


def first_by(df: DataFrame, by: list[str], order: list, n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, with their place."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def blocks(anchors: DataFrame) -> DataFrame:
    """``anchors`` with ``block``: neighbouring cells together up to ``ANCHORS`` anchors, a larger cell cut by hash."""
    counts = {r["home"]: r["count"] for r in anchors.groupBy("home").count().collect()}  # at most a row a pivot
    base, parts, at, held = {}, {}, 0, 0
    for cell in range(max(counts, default=0) + 1):
        n = counts.get(cell, 0)
        if held and held + n > ANCHORS:
            at, held = at + 1, 0
        base[cell], parts[cell] = at, max(1, -(-n // ANCHORS))
        at, held = (at + parts[cell], 0) if parts[cell] > 1 else (at, held + n)
    pick = lambda table: F.element_at(F.array(*[F.lit(table[c]) for c in sorted(table)]), F.col("home") + 1)
    return anchors.withColumn("block", pick(base) + F.pmod(F.xxhash64("rid"), pick(parts)).cast("int"))


def joined(anchors: DataFrame, rows: DataFrame, routes: DataFrame, on: list[str], share: Callable, schema: str, small: bool) -> DataFrame:
    """What ``share(anchors, candidates)`` gives for each block and piece of the rows routed to it.

    ``on`` names the columns besides ``block`` by which anchors and rows belong together. Routes have (*on, cell, block,
    lo, hi, pieces); rows go where their distance from the cell's pivot lies between ``lo`` and ``hi``.
    """
    between = (F.col("far") >= F.col("lo")) & (F.col("far") <= F.col("hi"))
    if routes.count() <= BROADCAST_ROUTES:
        routed = rows.join(F.broadcast(routes), [*on, "cell"]).where(between)
    else:  # rows of a cell are dealt to many tasks, and its routes to each of them
        salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        spread = routes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        routed = rows.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(salts)).cast("int")).join(spread, [*on, "cell", "salt"]).where(between)
    v = F.col("v").cast("array<smallint>") if small else F.col("v")
    keys = [*on, "block", "piece"]
    right = routed.select(*on, "block", F.pmod(F.xxhash64("rid"), "pieces").cast("int").alias("piece"), "rid", "id", *(["label"] if "label" not in on else []), v.alias("v"))
    pieces = routes.groupBy(*on, "block").agg(F.max("pieces").alias("pieces"))
    left = anchors.withColumn("v", v).join(pieces, [*on, "block"]).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both come from the same table: columns of their own
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(share, schema)


def mine(spark: SparkSession, rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: Column | None = None, every: int = 100, likes: int = 5, negatives: int = 5, low: int = 80, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor (key divisible by
    ``every``) and each of its first ``likes`` rows of the same label, the first ``negatives`` rows of other labels that
    score no more than the like and at least ``low`` percent of it."""
    rows = usable(rows, key, vector, quoted("label") if label is None else label, scale)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    most = F.array_max(F.transform("v", lambda c: F.abs(c.cast("double"))))
    n, largest, size, peak = rows.agg(F.count("*"), F.max("norm2"), F.max(F.size("v")), F.max(most)).first()
    if not n:
        return spark.createDataFrame([], schema)
    size, peak = max(1, size), peak or 0.0
    in_double, small = size * peak * peak < 2**53, peak < 2**15
    picked = rows.groupBy(F.pmod(F.xxhash64("rid"), F.lit(PIVOTS))).agg(F.min_by("v", F.xxhash64("rid", F.lit(1))).alias("v")).collect()
    pivots = Pivots(matrix(pa.array([r.v for r in picked], pa.list_(pa.int64())), size), largest)
    held = spark.sparkContext.broadcast(pivots)  # at most PIVOTS vectors
    slack = SLACK * largest**0.5 + 1e-9 if size * peak * peak < 2**63 else float("inf")  # scores that stop at 64 bits follow no distance

    home = by_rows("cell int, far double", lambda v: held.value.cells(v))(F.col("v"))
    rows = checkpointed(rows.withColumn("at", home).select("rid", "id", "label", "v", "norm2", "at.cell", "at.far"))
    anchors = rows.where(F.col("id") % every == 0).drop("cell", "far").withColumn("d", by_rows("array<double>", lambda v: held.value.from_anchors(v))(F.col("v")))
    anchors = checkpointed(blocks(anchors.withColumn("home", (F.array_position("d", F.array_min("d")) - 1).cast("int"))))

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda count, groups: F.greatest(F.ceil(count / F.lit(float(CANDIDATES))), F.lit(-(-2 * tasks // max(1, groups)))).cast("int")  # noqa: E731  at least two pieces of work a task

    # likes: an anchor's reach is the least bound, over the cells that hold enough rows of its label, of the last one wanted
    enough = first_by(first_by(rows.select("label", "cell", "far", F.pmod("rid", F.lit(64)).alias("salt")), ["label", "cell", "salt"], ["far"], likes + 1), ["label", "cell"], ["far"], likes + 1)
    enough = enough.where(F.col("rank") == likes + 1).select("label", "cell", "far")
    legs = anchors.select("rid", "label", "block", F.posexplode("d").alias("cell", "d"))
    reach = legs.join(enough, ["label", "cell"]).groupBy("rid").agg(F.min(F.col("d") + F.col("far")).alias("reach"))
    legs = legs.join(reach, "rid", "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    routes = legs.groupBy("label", "cell", "block").agg((F.min(F.col("d") - F.col("reach")) - slack).alias("lo"), (F.max(F.col("d") + F.col("reach")) + slack).alias("hi"))
    by_label = rows.groupBy("label").agg(F.count("*").alias("n"))
    groups = anchors.select("label", "block").distinct().count()
    routes = checkpointed(routes.join(by_label, "label").select("label", "cell", "block", "lo", "hi", spread(F.col("n"), groups).alias("pieces")))

    def own_label(left: pa.Table, right: pa.Table) -> pa.Table:
        return _likes(left, right, size, in_double, likes)

    found = joined(anchors.select("label", "block", "rid", "v"), rows, routes, ["label"], own_label, "rid long, score long, id long, other long", small)
    found = first_by(found, ["rid"], [F.desc("score"), F.asc_nulls_last("id"), "other"], likes)
    found = found.where("score >= 0").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("likes"))
    anchors = checkpointed(anchors.join(found, "rid"))

    # negatives: rows in the ring between the highest and the lowest score asked for
    score = lambda f: f(F.transform("likes", lambda x: x["score"].cast("double")))
    ring = lambda s: F.sqrt(F.greatest(F.lit(0.0), F.col("norm2") + F.lit(float(largest)) - 2.0 * s))
    legs = anchors.select("block", ring(score(F.array_min) * (low / 100.0)).alias("outer"), ring(score(F.array_max)).alias("inner"), F.posexplode("d").alias("cell", "d"))
    lo = F.greatest(F.col("d") - F.col("outer"), F.col("inner") - F.col("d"))
    routes = legs.groupBy("cell", "block").agg((F.min(lo) - slack).alias("lo"), (F.max(F.col("d") + F.col("outer")) + slack).alias("hi"))
    routes = checkpointed(routes.withColumn("pieces", spread(F.lit(float(n)), anchors.select("block").distinct().count())))

    def others(left: pa.Table, right: pa.Table) -> pa.Table:
        return _negatives(left, right, size, in_double, negatives, low)

    payload = anchors.select("block", "rid", F.col("id").alias("anchor_id"), "label", "v", "likes")
    found = joined(payload, rows, routes, [], others, "anchor long, anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long, other long", small)
    found = first_by(found, ["anchor", "nth"], [F.desc("negative_score"), F.asc_nulls_last("negative_id"), "other"], negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _candidates(right: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, and keys with a mark for null ones."""
    null = np.asarray(right["id"].is_null())
    return np.asarray(right["rid"]), np.asarray(right["id"].fill_null(0)), null


def _likes(left: pa.Table, right: pa.Table, size: int, in_double: bool, likes: int) -> pa.Table:
    """The first rows of this piece for each anchor of the block."""
    rid, key, null = _candidates(right)
    out = []
    if len(rid) and left.num_rows:
        score = products(matrix(left["v"], size), matrix(right["v"], size), in_double)
        for a, s in zip(left["rid"].to_pylist(), score):
            at = np.flatnonzero(rid != a)
            if len(at) > likes:
                at = at[s[at] >= np.partition(s[at], len(at) - likes)[len(at) - likes]]
            at = at[np.lexsort((rid[at], key[at], null[at], -s[at]))][:likes]
            out += [(a, int(s[i]), None if null[i] else int(key[i]), int(rid[i])) for i in at.tolist()]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["rid", "score", "id", "other"])


def _negatives(left: pa.Table, right: pa.Table, size: int, in_double: bool, negatives: int, low: int) -> pa.Table:
    """The first rows of this piece for each anchor of the block and each of its likes."""
    rid, key, null = _candidates(right)
    out = []
    if len(rid) and left.num_rows:
        codes, code = np.unique(np.asarray(right["label"].cast(pa.string())), return_inverse=True)
        number = {x: i for i, x in enumerate(codes.tolist())}
        score = products(matrix(left["v"], size), matrix(right["v"], size), in_double)
        for a, name, own, wanted, s in zip(left["rid"].to_pylist(), left["anchor_id"].to_pylist(), left["label"].cast(pa.string()).to_pylist(), left["likes"].to_pylist(), score):
            floors = [-(-low * p["score"] // 100) for p in wanted]  # the least whole score that still counts
            at = np.flatnonzero((s >= min(floors)) & (s <= max(p["score"] for p in wanted)) & (code != number.get(own, -1)))
            at = at[np.lexsort((rid[at], key[at], null[at], -s[at]))]
            down = -s[at]
            for p, floor in zip(wanted, floors):
                first = int(np.searchsorted(down, -p["score"], "left"))
                for i in at[first : first + negatives].tolist():
                    if s[i] < floor:
                        break
                    out.append((a, name, p["rank"], p["id"], p["score"], None if null[i] else int(key[i]), int(s[i]), int(rid[i])))
    names = ["anchor", "anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score", "other"]
    return pa.Table.from_arrays([pa.array([r[i] for r in out], pa.int32() if c == "nth" else pa.int64()) for i, c in enumerate(names)], names=names)


ORACLE_SQL = """with numbered as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x::double))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as alike, list_inner_product(a.v, b.v)::bigint as score from numbered a, numbered b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
likes as (select anchor_id, other_id as positive_id, score as positive_score from scored where alike qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over w::int as rank, other_id as negative_id, positive_score, score as negative_score
from likes join scored using (anchor_id) where not alike and 80 * positive_score <= 100 * score and score <= positive_score
window w as (partition by anchor_id, positive_id order by score desc, other_id) qualify row_number() over w <= 5"""
