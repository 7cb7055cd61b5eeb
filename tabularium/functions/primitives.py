"""Feature primitives: aggregates of a group and transforms of a row, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import running_sum
from .stats import adjusted_skewness


@dataclass(frozen=True)
class Primitive:
    name: str
    kind: str  # "aggregate", "transform" or "window"
    takes: str  # "numeric", "any", "boolean", "datetime", "text" or "latlong"
    make: Callable
    level: int = 1
    returns: str = "numeric"


def trend(v: Column, t: Column) -> Column:
    """Slope of v by days of t."""
    return F.regr_slope(v, F.unix_micros(t.cast("timestamp")) / F.lit(86_400_000_000.0))


def seconds_between(late: Column, early: Column) -> Column:
    return (F.unix_micros(late.cast("timestamp")) - F.unix_micros(early.cast("timestamp"))) / F.lit(1_000_000.0)


AGGREGATES: dict[str, Primitive] = {
    p.name: p
    for p in (
        Primitive("count", "aggregate", "any", lambda c: F.count("*")),
        Primitive("sum", "aggregate", "numeric", F.sum),
        Primitive("mean", "aggregate", "numeric", F.avg),
        Primitive("min", "aggregate", "numeric", F.min),
        Primitive("max", "aggregate", "numeric", F.max),
        Primitive("median", "aggregate", "numeric", F.median, 2),
        Primitive("std", "aggregate", "numeric", F.stddev_samp, 2),
        Primitive("num_unique", "aggregate", "any", F.count_distinct, 2),
        Primitive("mode", "aggregate", "any", lambda c: F.mode(c, True), 2, "any"),
        Primitive("skew", "aggregate", "numeric", adjusted_skewness, 3),
        Primitive("percent_true", "aggregate", "boolean", lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int")), 3),
        Primitive("num_true", "aggregate", "boolean", F.count_if, 3),
    )
}
#: Aggregates that need more than their column: a time column, a cutoff, an order or a second step.
SPECIAL = ("time_since_last", "time_since_first", "trend", "entropy", "n_most_common", "first", "last")

TRANSFORMS: dict[str, Primitive] = {
    p.name: p
    for p in (
        Primitive("year", "transform", "datetime", F.year),
        Primitive("month", "transform", "datetime", F.month),
        Primitive("day", "transform", "datetime", F.dayofmonth),
        Primitive("weekday", "transform", "datetime", F.weekday),
        Primitive("hour", "transform", "datetime", F.hour, 2),
        Primitive("minute", "transform", "datetime", F.minute, 3),
        Primitive("is_weekend", "transform", "datetime", lambda c: F.weekday(c) > 4, 2, "boolean"),
        Primitive("week", "transform", "datetime", F.weekofyear, 2),
        Primitive("quarter", "transform", "datetime", F.quarter, 2),
        Primitive("absolute", "transform", "numeric", F.abs),
        Primitive("negate", "transform", "numeric", lambda c: -c, 3),
        Primitive("num_characters", "transform", "text", F.char_length),
        Primitive("num_words", "transform", "text", lambda c: F.regexp_count(c, F.lit(r"\S+"))),
        Primitive("is_null", "transform", "any", F.isnull, 1, "boolean"),
        Primitive("not", "transform", "boolean", lambda c: ~c, 3, "boolean"),
        Primitive("latitude", "transform", "latlong", lambda c: c.getField("lat"), 3),
        Primitive("longitude", "transform", "latlong", lambda c: c.getField("lon"), 3),
    )
}


def _running(f: Callable) -> Callable:
    def make(c: Column, order: list, by: list) -> Column:
        w = Window.partitionBy(*by).orderBy(*order)
        return f(c).over(w.rowsBetween(Window.unboundedPreceding, 0))

    return make


WINDOWS: dict[str, Primitive] = {
    p.name: p
    for p in (
        Primitive("cum_sum", "window", "numeric", _running(F.sum), 3),
        Primitive("cum_mean", "window", "numeric", _running(F.avg), 3),
        Primitive("cum_min", "window", "numeric", _running(F.min), 3),
        Primitive("cum_max", "window", "numeric", _running(F.max), 3),
        Primitive("diff", "window", "numeric", lambda c, order, by: c - F.lag(c, 1).over(Window.partitionBy(*by).orderBy(*order)), 3),
    )
}


def by_category(takes: str) -> list[str]:
    """Names of the primitives that take a kind of column."""
    return sorted(p.name for d in (AGGREGATES, TRANSFORMS, WINDOWS) for p in d.values() if p.takes == takes)


def list_all() -> list[str]:
    return sorted({*AGGREGATES, *TRANSFORMS, *WINDOWS, *SPECIAL, "percentile"})


def register_primitive(p: Primitive) -> None:
    """Add a primitive of one's own."""
    {"aggregate": AGGREGATES, "transform": TRANSFORMS, "window": WINDOWS}[p.kind][p.name] = p


def for_level(level: int, has_datetime: bool = False, has_text: bool = False) -> tuple[list[str], list[str]]:
    """(aggregates, transforms) that a depth asks for: those of its level and below."""
    level = min(level, 3)
    aggregates = [p.name for p in AGGREGATES.values() if p.level <= level] + (["entropy"] if level >= 3 else [])
    transforms = ["is_null", "absolute"] + (["percentile"] if level >= 2 else []) + (["cum_sum", "cum_mean", "diff"] if level >= 3 else [])
    if has_datetime:
        transforms += [p.name for p in TRANSFORMS.values() if p.takes == "datetime" and p.level <= level]
        aggregates += (["time_since_last", "first", "last"] if level >= 2 else []) + (["trend"] if level >= 3 else [])
    if has_text:
        transforms += ["num_characters", "num_words"]
    return aggregates, transforms


def percentile(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average rank as a share of the values that aren't null, by way of the distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    below = running_sum(counts, column, F.col("_n"), "_below")
    share = (F.col("_below") - (F.col("_n") - 1) / 2) / F.lit(df.agg(F.count(column)).first()[0])
    return df.join(below.select(column, share.alias(name)), column, "left").select(*df.columns, name)


def entropy(df: DataFrame, by: str, column: str) -> DataFrame:
    """(by, entropy) in nats of a column's values in each group, in two steps of partial counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").cast("double").alias("n"))
    # -sum p ln p = ln N - sum n ln n / N
    return counts.groupBy(by).agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("entropy"))


def n_most_common(df: DataFrame, by: str, column: str, n: int = 3) -> DataFrame:
    """(by, most_common_1..n): the most frequent values of each group, ties by value; null where there are fewer."""
    counts = df.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), column))
    top = counts.withColumn("r", rank).where(F.col("r") <= n)
    return top.groupBy(by).agg(*[F.max(F.when(F.col("r") == i, F.col(column))).alias(f"most_common_{i}") for i in range(1, n + 1)])


def time_aggregates(df: DataFrame, by: str, value: str, time: str, tie: str, asof: Column) -> DataFrame:
    """Per group: first and last value in time, seconds since the last and first time up to ``asof``, and trend."""
    order = F.struct(time, tie)
    return df.groupBy(by).agg(
        F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"),
        seconds_between(asof, F.max(time)).alias("time_since_last"), seconds_between(asof, F.min(time)).alias("time_since_first"),
        trend(F.col(value), F.col(time)).alias("trend"),
    )
