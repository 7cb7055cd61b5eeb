"""Aggregates and running values of groups, whatever their size.

A group's median, mode or number of values needs its distinct values, and a running value its rows in order. Groups of up to
``CROWDED`` rows are one task's work; the rows of larger ones are counted by value, or scanned range by range, so a group
that holds a third of a table is spread like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import primitives as P
from .ordered import df_col, quantiles, running

#: Rows of a group that one task works on.
CROWDED = 1_000_000
#: Aggregates that hold a group's distinct values.
BY_VALUES = ("median", "num_unique", "mode")


def split_crowded(df: DataFrame, by: str) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of no more than ``CROWDED`` rows, and the others, if there are any."""
    sizes = df.groupBy(df_col(by).alias("_key")).agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED).select("_key")
    if not sizes.limit(1).count():
        return df, None
    on = df_col(by).eqNullSafe(F.col("_key"))
    return df.join(sizes, on, "left_anti"), df.join(sizes, on, "left_semi")


def aggregates(df: DataFrame, by: str, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """(``by``, a column for each (name, aggregate, column) of ``wanted``): a row a group."""
    plain = lambda rows, some: rows.groupBy(df_col(by).alias(by)).agg(*[P.AGGREGATES[p].make(df_col(c)).alias(name) for name, p, c in some])
    if not any(p in BY_VALUES for _, p, _ in wanted):
        return plain(df, wanted)
    small, large = split_crowded(df, by)
    if large is None:
        return plain(small, wanted)
    key = F.struct(df_col(by).alias("k")).alias("_key")  # never null itself
    tables = [large.groupBy(key).agg(F.count("*").alias("_rows"), *[P.AGGREGATES[p].make(df_col(c)).alias(name) for name, p, c in wanted if p not in BY_VALUES]).drop("_rows")]
    for c in dict.fromkeys(c for _, p, c in wanted if p in BY_VALUES):
        own = [(name, p) for name, p, x in wanted if x == c and p in BY_VALUES]
        cells = large.where(df_col(c).isNotNull()).groupBy(key, df_col(c).alias("_value")).agg(F.count("*").alias("n"))
        made = {"num_unique": F.count("*"), "mode": F.min_by("_value", F.struct(-F.col("n"), F.col("_value")))}
        if simple := [made[p].alias(name) for name, p in own if p != "median"]:
            tables.append(cells.groupBy("_key").agg(*simple))
        for name in [name for name, p in own if p == "median"]:
            tables.append(quantiles(cells, "_value", (0.5,), ("_key",)).select("_key", F.col("q0").cast("double").alias(name)))
    found = reduce(lambda a, b: a.join(b, "_key", "left"), tables)  # a row a crowded group
    found = found.fillna(0, [name for name, p, _ in wanted if p == "num_unique"]).select(F.col("_key.k").alias(by), *[df_col(name) for name, _, _ in wanted])
    return plain(small, wanted).unionByName(found)


def running_by(df: DataFrame, by: str, order: str, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` with a column for each (name, primitive, column) of ``wanted``, running within each group in the order of
    ``order``, whose values are distinct there; rows without a key are a group."""
    small, large = split_crowded(df, by)
    made = small.select("*", *[P.WINDOWS[p].make(df_col(c), [df_col(order)], [df_col(by)]).alias(name) for name, p, c in wanted])
    if large is None:
        return made
    key = "_group"
    cut = large.withColumn(key, F.struct(df_col(by).alias("k")))  # never null itself
    return made.unionByName(running(cut, order, wanted, by=(key,), few=True).drop(key))
