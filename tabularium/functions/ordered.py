"""Running values in the order of a column over a whole table, without a window that puts every row into one task.

Rows are cut into ranges of the column, each range is scanned on its own, and what the ranges before it come to is
joined from one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most values that the bounds of the ranges are chosen from, where a sketch can't choose them.
SAMPLE = 4096
#: Relative accuracy of the sketch (one over it).
ACCURACY = 1000


def bounds(df: DataFrame, column: str, by: tuple[str, ...], parts: int) -> DataFrame:
    """(*by, _bounds): about evenly spaced values of ``column`` in each group, from a mergeable sketch or a hash sample."""
    rows, kind = df.where(F.col(column).isNotNull()), df.schema[column].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
        return rows.groupBy(*by).agg(F.percentile_approx(column, shares, ACCURACY).alias("_bounds"))
    h = F.xxhash64(column)
    picked = rows.groupBy(*by, F.pmod(h, F.lit(SAMPLE)).alias("_b")).agg(F.min_by(column, h).alias("_v"))
    values = picked.groupBy(*by).agg(F.sort_array(F.collect_list("_v")).alias("_v"))  # at most SAMPLE a group
    at = F.sequence(F.lit(1), F.lit(parts - 1))
    return values.select(*by, F.transform(at, lambda k: F.try_element_at(F.col("_v"), F.greatest(F.lit(1), F.floor(F.size("_v") * k / parts).cast("int")))).alias("_bounds"))


def ranges(df: DataFrame, column: str, parts: int | None = None, by: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """``df`` with ``_range``: a number that grows with ``column`` within ``by``, the same for equal values; nulls are in range 0.

    Each group has bounds of its own, so one of small values doesn't fall into one range beside one of large values. The
    bounds decide how even the ranges are, never a result. ``few`` says that groups are few, as features are, so that their
    bounds are broadcast; else rows are dealt by range after the join, which would leave those of a group in one task.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return df.withColumn("_range", F.lit(0))
    found = bounds(df, column, by, parts)
    joined = df.join(F.broadcast(found) if few else found, list(by), "left") if by else df.crossJoin(F.broadcast(found))  # one row
    out = joined.select(*[df_col(c) for c in df.columns], range_of(F.col(column), parts).alias("_range"))
    return out.repartition(*[df_col(c) for c in by], "_range") if by and not few else out


def range_of(value: Column, parts: int) -> Column:
    """The range of a value beside the ``_bounds`` of its group, at most ``parts`` - 1 in order: how many aren't above it, by bisection."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, (parts - 1).bit_length())))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get("_bounds", at + step - 1) <= value, at + step).otherwise(at))


def df_col(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def ahead(cut: DataFrame, total: Column, combine, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, _range, _ahead): ``combine`` (F.sum, F.max) of the ``total`` aggregates of the ranges before each; null for the first."""
    totals = cut.groupBy(*by, "_range").agg(total.alias("_total"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    return totals.select(*by, "_range", combine("_total").over(before).alias("_ahead"))


def running_sums(df: DataFrame, column: str, values: dict[str, Column], by: tuple[str, ...] = (), parts: int | None = None, few: bool = False) -> DataFrame:
    """``df`` with a column for each of ``values``: its sum up to and with each row of the same ``by``, in the order of ``column``.

    The values of ``column`` are distinct within ``by``; ``by`` has no nulls. ``few``: see ``ranges``.
    """
    own = {name: f"_value{i}" for i, name in enumerate(values)}
    cut = ranges(df.withColumns({own[name]: v for name, v in values.items()}), column, parts, by, few)
    totals = cut.groupBy(*by, "_range").agg(*[F.sum(c).alias(c) for c in own.values()])
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = totals.select(*by, "_range", *[F.sum(c).over(before).alias(f"_ahead{c}") for c in own.values()])
    within = Window.partitionBy(*by, "_range").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(F.broadcast(totals) if few else totals, [*by, "_range"])
    return joined.select(*df.columns, *[(F.sum(c).over(within) + F.coalesce(f"_ahead{c}", F.lit(0))).alias(name) for name, c in own.items()])


def running_sum(df: DataFrame, column: str, value: Column, name: str, by: tuple[str, ...] = (), parts: int | None = None, few: bool = False) -> DataFrame:
    """``df`` with ``name``: one running sum."""
    return running_sums(df, column, {name: value}, by, parts, few)


#: Running primitives: of the values so far in the range (w), of those of the ranges before, and both together.
RUNNING = ("cum_sum", "cum_mean", "cum_min", "cum_max", "diff")


def running(df: DataFrame, order: str, wanted: list[tuple[str, str, str]], parts: int | None = None, by: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """``df`` with a column for each (name, primitive, column) of ``wanted``, in the order of ``order``, whose values are distinct
    within ``by``, which has no nulls.

    Primitives are those of ``RUNNING``. Nulls are passed over by the running ones; ``diff`` is null beside them. ``few``: see ``ranges``.
    """
    columns = list(dict.fromkeys(c for _, _, c in wanted))
    cut = ranges(df, order, parts, by, few)
    own, i = [], {c: str(k) for k, c in enumerate(columns)}
    for c in columns:
        v, k = df_col(c), i[c]
        own += [F.sum(v).alias(f"_sum{k}"), F.count(v).alias(f"_count{k}"), F.min(v).alias(f"_min{k}"), F.max(v).alias(f"_max{k}"), F.max_by(F.struct(v.alias("v")), order).alias(f"_last{k}")]
    totals = cut.groupBy(*by, "_range").agg(*own)
    so_far = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = []
    for k in i.values():
        before += [F.sum(f"_sum{k}").over(so_far).alias(f"_sum{k}"), F.sum(f"_count{k}").over(so_far).alias(f"_count{k}"), F.min(f"_min{k}").over(so_far).alias(f"_min{k}"), F.max(f"_max{k}").over(so_far).alias(f"_max{k}"), F.last(f"_last{k}").over(so_far).alias(f"_last{k}")]
    totals = totals.select(*by, "_range", *before)
    joined = cut.join(F.broadcast(totals) if few else totals, [*by, "_range"])
    own_window = Window.partitionBy(*by, "_range").orderBy(order)
    w = own_window.rowsBetween(Window.unboundedPreceding, 0)
    out = []
    for name, primitive, c in wanted:
        v, k = df_col(c), i[c]
        total = F.when(F.coalesce(F.sum(v).over(w), F.col(f"_sum{k}")).isNotNull(), F.coalesce(F.sum(v).over(w), F.lit(0)) + F.coalesce(F.col(f"_sum{k}"), F.lit(0)))
        made = {
            "cum_sum": lambda: total,
            "cum_mean": lambda: total / (F.count(v).over(w) + F.coalesce(F.col(f"_count{k}"), F.lit(0))),
            "cum_min": lambda: F.least(F.min(v).over(w), F.col(f"_min{k}")),
            "cum_max": lambda: F.greatest(F.max(v).over(w), F.col(f"_max{k}")),
            "diff": lambda: v - F.when(F.row_number().over(own_window) == 1, F.col(f"_last{k}.v")).otherwise(F.lag(v, 1).over(own_window)),
        }
        out.append(made[primitive]().alias(name))
    return joined.select(*[df_col(c) for c in df.columns], *out)


def quantiles(counts: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, q0, q1, ...): exact quantiles with linear interpolation from (*by, value, n), a row a distinct value; groups are few.

    The running number of values finds the two neighbours of each quantile, so no task holds all values of a group.
    """
    rows = running_sum(counts.select(*by, F.col(value).alias("_v"), "n"), "_v", F.col("n"), "_upto", by, few=True)
    total = counts.groupBy(*by).agg(F.sum("n").alias("_all"))
    rows = rows.join(F.broadcast(total), list(by)) if by else rows.crossJoin(F.broadcast(total))
    picked = []
    for i, q in enumerate(shares):
        at = F.lit(float(q)) * (F.col("_all") - 1)
        for name, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            inside = (F.col("_upto") - F.col("n") <= place) & (place < F.col("_upto"))
            picked.append(F.max(F.when(inside, F.col("_v"))).alias(f"{name}{i}"))
    found = rows.groupBy(*by).agg(F.first("_all").alias("_all"), *picked)
    share = lambda q: F.lit(float(q)) * (F.col("_all") - 1) - F.floor(F.lit(float(q)) * (F.col("_all") - 1))
    return found.select(*by, *[(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * share(q)).alias(f"q{i}") for i, q in enumerate(shares)])
