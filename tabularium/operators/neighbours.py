"""Mutual information of a continuous and a discrete variable from nearest neighbours.

For each row, the distance to the k-th nearest value of its own level says how wide a neighbourhood is, and the number of
rows of any level inside it how crowded: I = psi(N) + <psi(k)> - <psi(rows of the level)> - <psi(rows nearby)>. Both are
found range by range of the value's order, from one row a distinct value and level; no pairs of rows are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import bounds, range_of
from ..functions.stats import digamma
from ..sources.shared import checkpointed
from .association import mutual_information
from .plane import plane_information
from .profile import unpivot

#: Neighbours that make a neighbourhood.
NEIGHBOURS = 3


def neighbour_information(rows: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(feature, mutual_info) in nats of rows (feature, value, level): ``value`` is continuous, ``level`` discrete.

    Rows with a null or without a finite value are left out, and so are levels of one row, which has no neighbour. Where
    more than k equal values are in a level, the neighbourhood is the value itself, so of variables that are all ties the
    sum is that of the counts. Never below zero; features without a level of two rows are absent.
    """
    valid = rows.where(F.col("level").isNotNull() & (F.abs("value") < float("inf")))
    parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = checkpointed(valid.groupBy("feature", "level", "value").agg(F.count("*").alias("n")))  # the only pass over the rows
    cuts = checkpointed(bounds(counts, "value", ("feature",), parts))  # a row a feature
    keys, place = ["feature", "level", "_range"], ["feature", "_range"]
    ranged = lambda table, at: table.join(F.broadcast(cuts), "feature").withColumn("_range", range_of(F.col(at), parts)).drop("_bounds")  # noqa: E731  joined by a shuffle, a feature's rows would stay in one task
    cells = ranged(counts, "value")

    # the values beside each, within its range
    w = Window.partitionBy(*keys).orderBy("value")
    beside = [F.struct(f("value", i).over(w).alias("value"), f("n", i).over(w).alias("n")) for f in (F.lag, F.lead) for i in range(1, k + 1)]
    cells = cells.withColumn("_beside", F.array(*beside))
    # a row a range of a level: its first and last k values, from which the ranges beside it get theirs
    edge = F.struct("value", "n")
    ends = cells.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        *[F.collect_list(F.when(F.get("_beside", F.lit(at + k - 1))["value"].isNull(), edge)).alias(name) for name, at in (("_first", 0), ("_last", k))],
    )
    over = Window.partitionBy("feature", "level").orderBy("_range")
    ends = ends.select(
        *keys, "_n", F.sum("_n").over(Window.partitionBy("feature", "level")).alias("size"),
        F.flatten(F.concat(F.collect_list("_last").over(over.rowsBetween(-k, -1)), F.collect_list("_first").over(over.rowsBetween(1, k)))).alias("_outside"),
    ).where("size > 1")
    own = cells.join(ends.drop("_n"), keys).withColumn("_want", F.least(F.lit(k), F.col("size") - 1))
    near = F.array_sort(F.transform(F.filter(F.concat("_beside", "_outside"), lambda s: s["value"].isNotNull()), lambda s: F.struct(F.abs(s["value"] - F.col("value")).alias("d"), s["n"].alias("n"))))
    start = F.struct((F.col("n") - 1).alias("have"), F.lit(0.0).alias("reach"))
    step = lambda a, s: F.when(a["have"] >= F.col("_want"), a).otherwise(F.struct((a["have"] + s["n"]).alias("have"), s["d"].alias("reach")))
    own = own.withColumn("reach", F.aggregate(near, start, step)["reach"])
    own = own.select("feature", "level", "value", "n", "size", "reach", F.when(F.col("reach") > 0, F.col("_want")).otherwise(F.col("n")).alias("near"))

    # each cell asks for the rows below either end of its neighbourhood; equal values come before or after the question
    inside = F.col("reach") > 0
    ask = lambda at, turn, sign: F.struct(at.alias("at"), turn.alias("turn"), F.lit(0).cast("long").alias("w"), F.lit(sign).alias("sign"))
    events = F.array(
        F.struct(F.col("value").alias("at"), F.lit(1).alias("turn"), F.col("n").alias("w"), F.lit(0).alias("sign")),
        ask(F.col("value") - F.col("reach"), F.when(inside, 2).otherwise(0), -1),
        ask(F.col("value") + F.col("reach"), F.when(inside, 0).otherwise(2), 1),
    )
    asked = own.select("feature", "level", "value", "n", "size", "near", F.inline(events))
    asked = ranged(asked, "at")
    totals = cuts.select("feature", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_range")).join(ends.groupBy(*place).agg(F.sum("_n").alias("_total")), place, "left")
    so_far = Window.partitionBy("feature").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    below = totals.select(*place, F.sum("_total").over(so_far).alias("_ahead"))
    w = Window.partitionBy(*place).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    upto = asked.join(below, place).withColumn("_upto", F.sum("w").over(w) + F.coalesce("_ahead", F.lit(0)))
    counted = upto.where("sign <> 0").groupBy("feature", "level", "value", "n", "size", "near").agg(F.sum(F.col("sign") * F.col("_upto")).alias("m"))
    terms = digamma(F.col("near")) - digamma(F.col("size")) - digamma(F.col("m"))
    out = counted.groupBy("feature").agg(F.sum("n").alias("_all"), (F.sum(F.col("n") * terms) / F.sum("n")).alias("_mean"))
    return out.select("feature", F.greatest(F.lit(0.0), digamma(F.col("_all")) + F.col("_mean")).alias("mutual_info"))


def information(df: DataFrame, features: list[str], target: str, continuous: list[str]) -> DataFrame:
    """(feature, mutual_info): by counts of two discrete columns, by neighbours of a continuous and a discrete one, and by
    neighbours in the plane of two continuous ones."""
    mixed = [c for c in features if (c in continuous) != (target in continuous)]
    plane = [c for c in features if c in continuous and target in continuous]
    counts = [c for c in features if c not in mixed and c not in plane]
    rows, tables = df.withColumn("_y", F.col(target)), []
    if counts:
        tables.append(mutual_information(df, counts, target))
    if mixed:
        value, level = ("_y", "value") if target in continuous else ("value", "_y")
        own = unpivot(rows, mixed, "string" if target in continuous else "double", keep=("_y",))
        tables.append(neighbour_information(own.select("feature", F.col(value).cast("double").alias("value"), F.col(level).cast("string").alias("level"))))
    if plane:
        tables.append(plane_information(unpivot(rows, plane, "double", keep=("_y",)).select("feature", F.col("value").alias("x"), F.col("_y").cast("double").alias("y"))))
    return reduce(DataFrame.unionByName, tables) if tables else df.sparkSession.createDataFrame([], "feature string, mutual_info double")
