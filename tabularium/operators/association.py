"""How strongly features depend on the target."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running, running_sum, running_sums
from ..sources.shared import checkpointed
from .profile import is_numeric, medians, normalize_nulls, unpivot, with_nulls


#: Most levels or target values that are put in order by one window or broadcast, and most bytes of their strings.
FEW_LEVELS, FEW_BYTES = 10_000, 8 << 20


def _codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): the distinct values of a column as strings, numbered from 0 in their order; broadcast if they are few."""
    levels = checkpointed(df.select(F.coalesce(F.col(column).cast("string"), F.lit("missing")).alias("value")).distinct())
    n, size = levels.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("value")), F.lit(0))).first()
    if n <= FEW_LEVELS and size <= FEW_BYTES:
        return F.broadcast(levels.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("double").alias("code")))
    return checkpointed(running_sum(levels, "value", F.lit(1), "_number").select("value", (F.col("_number") - 1).cast("double").alias("code")))


def prepare(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """All features as doubles: numbers with the median for nulls, other kinds as codes of their strings in order."""
    df = normalize_nulls(df).where(F.col(target).isNotNull())
    numbers = [c for c in features if is_numeric(df.schema[c].dataType)]
    found = medians(df, with_nulls(df, numbers))
    y = F.col(target).cast("double") if is_numeric(df.schema[target].dataType) else None
    out = df
    for c in [*(c for c in features if c not in numbers), *([target] if y is None else [])]:
        codes = _codes(df, c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"_c_{c}"))
        out = out.join(codes, F.coalesce(F.col(c).cast("string"), F.lit("missing")) == F.col(f"_v_{c}"))
    return out.select(*[F.coalesce(F.col(c).cast("double"), F.lit(found.get(c)).cast("double"), F.lit(0.0)).alias(c) if c in numbers else F.col(f"_c_{c}").alias(c) for c in features], (y if y is not None else F.col(f"_c_{target}")).alias("_y"))


def pearson(x: Column, y: Column) -> Column:
    """Pearson's r over rows where both are there; null where either doesn't vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def pearson_scores(prepared: DataFrame, features: list[str]) -> DataFrame:
    """(feature, pearson): one pass for all features."""
    return unpivot(prepared, features, "double", keep=("_y",)).groupBy("feature").agg(pearson(F.col("value"), F.col("_y")).alias("pearson"))


def average_ranks(df: DataFrame, column: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with ``_rank``: the average rank of ``column`` (ties share it), by way of its distinct values.

    Ranks come from counts of distinct values, so a row a value is ordered, not a row a record, range by range.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    below = running_sum(counts, column, F.col("_n"), "_below", by)
    ranks = below.select(*by, column, (F.col("_below") - (F.col("_n") - 1) / 2).alias("_rank"))
    return df.join(ranks, [*by, column], "left")


def cells_of(prepared: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, _y, n): rows counted by their values; a null target counts as one."""
    return unpivot(prepared, features, "double", keep=("_y",)).where("value IS NOT NULL").groupBy("feature", "value", "_y").agg(F.count("*").alias("n"))


def _running(counts: DataFrame, levels: int, column: str, value: str, name: str) -> DataFrame:
    """``counts``, a row a level, with ``name``: the running sum of ``value``; by one window if the levels are few."""
    if levels <= FEW_LEVELS:
        return counts.withColumn(name, F.sum(value).over(Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)))
    return running_sum(counts, column, F.col(value), name)


def spearman_scores(prepared: DataFrame, features: list[str]) -> DataFrame:
    """(feature, spearman): Pearson's r of average ranks.

    Ranks depend on distinct values only, so rows are summed up by value first. Few target ranks are broadcast to the rows;
    where they are many, rows are counted by value and target value before ranks are joined. Ranks are taken from their
    middle, which keeps the sums small.
    """
    counts = checkpointed(prepared.where("_y IS NOT NULL").groupBy("_y").agg(F.count("*").alias("k")))
    levels, total = counts.agg(F.count("*"), F.sum("k")).first()
    ranks = _running(counts, levels, "_y", "k", "_upto")
    ranks = ranks.select(F.col("_y").alias("_of"), (F.col("_upto") - (F.col("k") - 1) / 2.0 - ((total or 0) + 1) / 2.0).alias("_yr"))
    same = F.col("_y") == F.col("_of")
    if levels <= FEW_LEVELS:
        rows = unpivot(prepared.join(F.broadcast(ranks), same, "left"), features, "double", keep=("_yr",)).where("value IS NOT NULL").withColumn("n", F.lit(1).cast("long"))
    else:
        rows = cells_of(prepared, features).join(ranks, same, "left")
    n, r = F.col("n"), F.col("_yr")
    cells = checkpointed(rows.groupBy("feature", "value").agg(F.sum("n").alias("n"), F.sum(F.when(r.isNotNull(), n).otherwise(0)).alias("m"), F.sum(n * r).alias("s"), F.sum(n * r * r).alias("s2")))
    total = cells.groupBy("feature").agg(((F.sum("n") + 1) / 2.0).alias("_mid"))
    ranked = running_sum(cells, "value", F.col("n"), "_upto", ("feature",), few=True).join(F.broadcast(total), "feature")  # a row a feature
    r, m = F.col("_upto") - (F.col("n") - 1) / 2.0 - F.col("_mid"), F.col("m")
    sums = ranked.groupBy("feature").agg(F.sum(m).cast("double").alias("n"), F.sum(m * r).alias("x"), F.sum(m * r * r).alias("xx"), F.sum("s").alias("y"), F.sum("s2").alias("yy"), F.sum(r * F.col("s")).alias("xy"))
    spread = (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))
    return sums.select("feature", F.when(spread > 0, (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread)).alias("spearman"))


#: Levels of the split tree that are dealt with range by range; a group below them holds at most 2 ** (1 - TOP_LEVELS) of the rows.
TOP_LEVELS = 6
#: Most features whose tops of the tree, up to 63 groups each, are few groups.
FEW_TREES = 100


def split_codes(rows: DataFrame, weight: str | None = None) -> tuple[DataFrame, int]:
    """(_y, code, depth) of the target's values, and the bits of a code; the column ``weight`` tells how many rows one stands for.

    A value's code is the place of its middle row in the order, in half rows: codes grow with the values, and those that
    share their first l bits lie within 2 ** -l of all rows. So two or more values that do hold at most twice that share,
    however the rows are spread. ``depth`` is how many bits tell a value from both of its neighbours. Few values are
    broadcast.
    """
    counts = checkpointed(rows.where("_y IS NOT NULL").groupBy("_y").agg(F.sum(weight or F.lit(1)).alias("w")))
    n, total = counts.agg(F.count("*"), F.sum("w")).first()
    bits = max(1, (2 * (total or 0)).bit_length())
    codes = _running(counts, n, "_y", "w", "_upto").select("_y", (2 * F.col("_upto") - F.col("w")).alias("code"))
    if n <= FEW_LEVELS:
        order = Window.orderBy("_y")
        codes = codes.withColumn("_up", F.col("code") - F.lag("code").over(order)).withColumn("_down", F.col("code") - F.lead("code").over(order))
    else:
        codes = checkpointed(codes.withColumn("_back", -F.col("_y")))
        codes = running(running(codes, "_y", [("_up", "diff", "code")]), "_back", [("_down", "diff", "code")])
    same = lambda step: F.when(F.col(step).isNull(), 0).otherwise(bits + 1 - F.length(F.bin(F.col("code").bitwiseXOR(F.col("code") - F.col(step)))))  # noqa: E731  bits up to the first that differs
    codes = codes.select("_y", "code", F.greatest(same("_up"), same("_down")).cast("int").alias("depth"))
    return F.broadcast(codes) if n <= FEW_LEVELS else codes, bits


def kendall_scores(prepared: DataFrame, features: list[str]) -> DataFrame:
    """(feature, kendall): tau-b, exact, for any number of target values and any shares of them.

    Two codes of target values (``split_codes``) differ first at some bit: so pairs are counted bit by bit, among rows that
    agree in all higher bits, as zeros before ones less ones before zeros in the order of the feature. That is one running
    sum for each bit over counts by value, and no pairs are made. A value leaves the tree once it is alone, so one that
    nearly all rows share is in few levels.
    """
    cells = checkpointed(cells_of(prepared, features).where("_y IS NOT NULL"))  # the only pass over the rows
    codes, bits = split_codes(cells, "n")
    cells = cells.join(codes, "_y").select("feature", "value", "code", "depth", F.col("n").cast("double").alias("n"))
    split = cells.where("depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth") - 1)))  # 0 is the highest bit
    bit = F.expr(f"shiftright(code, {bits - 1} - level) & 1")
    split = split.select("feature", "value", "level", F.expr(f"shiftright(code, {bits} - level)").alias("prefix"), F.when(bit == 0, F.col("n")).otherwise(0.0).alias("zeros"), F.when(bit == 1, F.col("n")).otherwise(0.0).alias("ones"))
    counts = checkpointed(split.groupBy("feature", "level", "prefix", "value").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")))
    by = ("feature", "level", "prefix")
    top = running_sums(counts.where(F.col("level") < TOP_LEVELS), "value", {"_zeros": F.col("zeros"), "_ones": F.col("ones")}, by, few=len(features) <= FEW_TREES)
    if bits > TOP_LEVELS:
        w = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        low = counts.where(F.col("level") >= TOP_LEVELS)
        top = top.unionByName(low.withColumn("_zeros", F.sum("zeros").over(w)).withColumn("_ones", F.sum("ones").over(w)))
    s = top.groupBy("feature").agg(F.sum(F.col("ones") * (F.col("_zeros") - F.col("zeros")) - F.col("zeros") * (F.col("_ones") - F.col("ones"))).alias("s"))
    tie = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    tx = cells.groupBy("feature", "value").agg(F.sum("n").alias("n")).groupBy("feature").agg(tie("n").alias("tx"), F.sum("n").alias("total"))
    ty = cells.groupBy("feature", "code").agg(F.sum("n").alias("n")).groupBy("feature").agg(tie("n").alias("ty"))
    n0 = F.col("total") * (F.col("total") - 1) / 2
    down = F.sqrt((n0 - F.col("tx")) * (n0 - F.col("ty")))
    return tx.join(ty, "feature").join(s, "feature", "left").select("feature", F.when(down > 0, F.coalesce("s", F.lit(0.0)) / down).alias("kendall"))


def joint_counts(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, value, _y, n): rows of discrete columns counted by their values and the target's, as text, where both are there."""
    rows = unpivot(df.withColumn("_y", F.col(target).cast("string")), features, keep=("_y",)).where("value IS NOT NULL AND _y IS NOT NULL")
    return rows.groupBy("feature", "value", "_y").agg(F.count("*").alias("n"))


def mutual_information(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, mutual_info) in nats of discrete columns, from joint counts."""
    joint = joint_counts(df, features, target)
    x = joint.groupBy("feature", "value").agg(F.sum("n").alias("nx"))
    y = joint.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("total"))
    every = joint.join(x, ["feature", "value"]).join(y, ["feature", "_y"]).join(F.broadcast(total), "feature")
    n, t = F.col("n").cast("double"), F.col("total").cast("double")
    return every.groupBy("feature").agg(F.sum(n / t * F.ln(n * t / (F.col("nx").cast("double") * F.col("ny")))).alias("mutual_info"))


def binned(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Numeric columns as numbers of equal-width bins (null stays null): the discrete form of float columns for phi-k and MI."""
    if not columns:
        return df
    found = df.agg(*[f(F.col(c).cast("double")).alias(f"{p}{c}") for c in columns for f, p in ((F.min, "a_"), (F.max, "b_"))]).first()
    return df.withColumns({c: F.least(F.floor((F.col(c) - found[f"a_{c}"]) / max((found[f"b_{c}"] or 0) - (found[f"a_{c}"] or 0), 1e-300) * bins), F.lit(bins - 1)).cast("int") for c in columns})


def chi_square(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, chi2, dof, cramers_v) of discrete columns: what phi-k starts from."""
    return chi_square_of(joint_counts(df, features, target)).drop("total")


def chi_square_of(joint: DataFrame) -> DataFrame:
    """(feature, total, chi2, dof, cramers_v) from joint counts."""
    x, y = joint.groupBy("feature", "value").agg(F.sum("n").alias("nx")), joint.groupBy("feature", "_y").agg(F.sum("n").alias("ny"))
    total = joint.groupBy("feature").agg(F.sum("n").alias("total"), F.countDistinct("value").alias("kx"), F.countDistinct("_y").alias("ky"))
    every = joint.join(x, ["feature", "value"]).join(y, ["feature", "_y"]).join(F.broadcast(total), "feature")
    n, t = F.col("n").cast("double"), F.col("total").cast("double")  # products of counts outgrow a long from millions of rows on
    stat = every.groupBy("feature", "total", "kx", "ky").agg((F.sum(n * n * t / (F.col("nx").cast("double") * F.col("ny"))) - F.first("total")).alias("chi2"))
    k = F.least("kx", "ky") - 1
    return stat.select("feature", "total", "chi2", ((F.col("kx") - 1) * (F.col("ky") - 1)).alias("dof"), F.when(k > 0, F.sqrt(F.greatest(F.col("chi2"), F.lit(0.0)) / (F.col("total") * k))).alias("cramers_v"))


#: Terms of the series for shares of a bivariate normal: to 1e-6 up to a correlation of 0.97, to about 2e-3 at 0.99.
TERMS = 600


def phi_k(df: DataFrame, features: list[str], target: str, terms: int = TERMS) -> DataFrame:
    """(feature, phik): the correlation of a bivariate normal that, cut as the table is, would have its chi-square (less what
    noise would give), for any number of levels; null without a row that has both.

    A normal's share of a cell, less the product of the cell's marginal shares, is a sum over k of r ** k times a factor of
    its row and one of its column (differences of Hermite functions between the level's bounds). So chi-square is a power
    series in r whose terms come from a matrix of either axis, summed up over blocks of levels in tasks; no table of levels
    is made. It grows with r and is inverted by bisection, in a task a feature. The rows are passed over once, to be counted.
    """
    joint = checkpointed(joint_counts(df, features, target))
    axes = _axis(joint, "value").withColumn("axis", F.lit(0)).unionByName(_axis(joint, "_y").withColumn("axis", F.lit(1)))
    axes = checkpointed(axes)
    facts = chi_square_of(joint).withColumnRenamed("feature", "of")  # a row a feature
    with_facts = lambda table: table.join(F.broadcast(facts), F.col("feature") == F.col("of")).drop("of")
    counts = {r[0]: r[1] for r in axes.groupBy("feature", "axis").agg(F.count("*").alias("k")).groupBy("feature").agg(F.max("k")).collect()}
    few, many = ([c for c, k in counts.items() if (k > TASK_LEVELS) == more] for more in (False, True))

    def at_once(table: pa.Table) -> pa.Table:
        axis, share, below = (np.asarray(table[c]) for c in ("axis", "share", "below"))
        both = [_level_products(share[axis == a], below[axis == a], terms) for a in (0, 1)]
        return pa.table({"feature": table["feature"].slice(0, 1), "phik": pa.array([_normal_correlation(both, table, terms)], pa.float64())})

    def from_sums(table: pa.Table) -> pa.Table:
        axis, at, both = np.asarray(table["axis"]), np.asarray(table["at"]), []
        for a in (0, 1):
            own = np.flatnonzero(axis == a)
            own = own[np.argsort(at[own])]
            both.append(np.asarray(table["sums"].combine_chunks().take(pa.array(own)).flatten())[: terms * (terms + 1) // 2])
        return pa.table({"feature": table["feature"].slice(0, 1), "phik": pa.array([_normal_correlation(both, table, terms)], pa.float64())})

    schema, found = "feature string, phik double", []
    if few:
        found.append(with_facts(axes.where(F.col("feature").isin(few))).groupBy("feature").applyInArrow(at_once, schema))
    if many:
        sums = axes.where(F.col("feature").isin(many)).mapInArrow(lambda batches: _stripes(batches, terms), "feature string, axis int, at int, sums array<double>")
        sums = sums.groupBy("feature", "axis", "at").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(STRIPE)]).alias("sums"))
        found.append(with_facts(sums).groupBy("feature").applyInArrow(from_sums, schema))
    absent = df.sparkSession.createDataFrame([(c, None) for c in features if c not in counts], schema)
    return reduce(DataFrame.unionByName, [absent, *found])


#: Levels of an axis that one task takes as they are.
TASK_LEVELS = 1000
#: Entries of a matrix's upper triangle that are one row while it is summed up.
STRIPE = 100


def _axis(joint: DataFrame, column: str) -> DataFrame:
    """(feature, share, below): the share of each level and of those before it, numbers in their order, other levels as text."""
    levels = joint.groupBy("feature", column).agg(F.sum("n").alias("n"))
    levels = levels.select("feature", F.struct(F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)).alias("number"), F.col(column).alias("text")).alias("place"), "n")
    total = levels.groupBy("feature").agg(F.sum("n").alias("total"))
    upto = running_sum(levels, "place", F.col("n"), "upto", ("feature",), few=True).join(F.broadcast(total), "feature")  # a row a feature
    return upto.select("feature", (F.col("n") / F.col("total")).alias("share"), ((F.col("upto") - F.col("n")) / F.col("total")).alias("below"))


def hermite_functions(z: np.ndarray, terms: int) -> np.ndarray:
    """For k from 1: He_(k-1)(z) times the normal density over the root of k!, a column a k; zero at both infinities."""
    out = np.zeros((len(z), terms))
    finite = np.isfinite(z)
    x = z[finite]
    g = np.empty((len(x), terms))
    before, now = np.zeros(len(x)), np.exp(-x * x / 2) / (2 * np.pi) ** 0.5  # He_j times the density over the root of j!
    for k in range(1, terms + 1):
        g[:, k - 1] = now / k**0.5
        before, now = now, (x * now - (k - 1) ** 0.5 * before) / k**0.5
    out[finite] = g
    return out


def quantile_of(shares: np.ndarray) -> np.ndarray:
    """The normal's quantiles; infinite at 0 and 1."""
    from statistics import NormalDist

    inverse = NormalDist().inv_cdf
    return np.array([-np.inf if s <= 0 else np.inf if s >= 1 else inverse(s) for s in shares.tolist()])


def _level_products(share: np.ndarray, below: np.ndarray, terms: int) -> np.ndarray:
    """The sum over levels of products of their factors over their share: the upper triangle."""
    total = np.zeros((terms, terms))
    for at in range(0, len(share), 512):
        begin, width = below[at : at + 512], share[at : at + 512]
        end = np.where(begin + width > 1 - 1e-12, 1.0, begin + width)
        factor = (hermite_functions(quantile_of(begin), terms) - hermite_functions(quantile_of(end), terms)) / np.sqrt(width)[:, None]
        total += factor.T @ factor
    return total[np.triu_indices(terms)]


def _stripes(batches, terms: int):
    """Of each feature and axis in a batch: the products of its levels, in rows of ``STRIPE``."""
    for batch in batches:
        names, axis = np.asarray(batch.column("feature").to_pylist(), object), np.asarray(batch.column("axis"))
        share, below = np.asarray(batch.column("share")), np.asarray(batch.column("below"))
        for name, a in sorted(set(zip(names.tolist(), axis.tolist()))):
            own = (names == name) & (axis == a)
            flat = _level_products(share[own], below[own], terms)
            flat = np.concatenate((flat, np.zeros(-len(flat) % STRIPE)))
            n = len(flat) // STRIPE
            sums = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * STRIPE, pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([a] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), sums], names=["feature", "axis", "at", "sums"])


def _normal_correlation(both: list[np.ndarray], table: pa.Table, terms: int) -> float:
    """The root of the series: the correlation at which chi-square is what was found."""
    want, n = float(table["chi2"][0].as_py()) - float(table["dof"][0].as_py()), float(table["total"][0].as_py())
    if want <= 0:
        return 0.0
    i, j = np.triu_indices(terms)
    powers = np.bincount(i + j + 2, both[0] * both[1] * np.where(i == j, 1.0, 2.0), 2 * terms + 1)
    chi_of = lambda r: n * float(powers @ r ** np.arange(2 * terms + 1.0))
    if chi_of(1.0) <= want:
        return 1.0
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_of(mid) < want else (lo, mid)
    return hi


#: Steps of about as many rows that either axis is cut into before grids are searched (equal values stay together), and superclumps a column.
STEPS, SUPERCLUMPS = 1024, 15


def mic(df: DataFrame, features: list[str], target: str, steps: int = STEPS, exponent: float = 0.6) -> DataFrame:
    """(feature, mic): the largest normalised mutual information over grids of at most n ** ``exponent`` cells (at least 4).

    One axis is cut evenly into each possible number of rows. Places of the other axis between which all rows are in one
    row of the grid are a clump, and clumps are merged into ``SUPERCLUMPS`` times as many superclumps as columns may be; the
    best columns are unions of these, found by dynamic programming; then the axes change places. An axis of up to ``steps``
    distinct values isn't cut before. A task sees a feature's joint counts of steps, never its rows, and either
    direction is a task of its own; rows of the grid end at the number of steps, and columns where more of them can't
    beat the best grid so far, so the time doesn't follow the number of rows.
    """
    rows = unpivot(df.withColumn("_y", F.col(target).cast("double")), features, "double", keep=("_y",)).where("value IS NOT NULL AND _y IS NOT NULL")
    cells = rows.groupBy("feature", "value", "_y").agg(F.count("*").alias("n"))

    def places(column: str, name: str) -> DataFrame:
        counts = cells.groupBy("feature", column).agg(F.sum("n").alias("n"))
        total = counts.groupBy("feature").agg(F.sum("n").alias("_all"), F.count("*").alias("_values"))
        upto = running_sums(counts, column, {"_upto": F.col("n"), "_nth": F.lit(1)}, ("feature",), few=True).join(F.broadcast(total), "feature")  # a row a feature
        even = F.floor((F.col("_upto") - F.col("n") / 2.0) * steps / F.col("_all"))
        return upto.select("feature", column, F.when(F.col("_values") <= steps, F.col("_nth") - 1).otherwise(even).cast("int").alias(name))

    table = cells.join(places("value", "i"), ["feature", "value"]).join(places("_y", "j"), ["feature", "_y"]).groupBy("feature", "i", "j").agg(F.sum("n").alias("n"))
    turned = table.select("feature", F.lit(0).alias("turn"), "i", "j", "n").union(table.select("feature", F.lit(1), "j", "i", "n"))

    def best(found: pa.Table) -> pa.Table:
        i, j = (np.unique(np.asarray(found[c]), return_inverse=True)[1] for c in ("i", "j"))
        counts = np.zeros((i.max() + 1, j.max() + 1))
        counts[i, j] = np.asarray(found["n"])
        return pa.table({"feature": found["feature"].slice(0, 1), "value": pa.array([max(_best_columns(counts, max(4.0, counts.sum() ** exponent)), default=0.0)])})

    one = turned.groupBy("feature", "turn").applyInArrow(best, "feature string, value double")
    return one.groupBy("feature").agg(F.max("value").alias("mic"))


def grid_information(counts: np.ndarray, exponent: float = 0.6) -> float:
    """The largest normalised mutual information over grids on a table of counts."""
    most = max(4.0, counts.sum() ** exponent)
    return max((v for table in (counts, counts.T) for v in _best_columns(table, most)), default=0.0)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.where(x > 0, x, 1.0))


def _superclumps(part: np.ndarray, most: int) -> np.ndarray:
    """Counts by clump and row: neighbouring places of one row joined, and then merged evenly to at most ``most``."""
    pure, row = (part > 0).sum(axis=1) == 1, part.argmax(axis=1)
    new = np.append(True, ~(pure[1:] & pure[:-1] & (row[1:] == row[:-1])))
    part = np.add.reduceat(part, np.flatnonzero(new), axis=0)
    if len(part) > most:
        size = part.sum(axis=1)
        of = np.minimum((np.cumsum(size) - size / 2) * most / size.sum(), most - 1).astype(int)
        part = np.add.reduceat(part, np.flatnonzero(np.append(True, of[1:] != of[:-1])), axis=0)
    return part


def _best_columns(counts: np.ndarray, most: float):
    """Ever better normalised information, over all numbers of even rows (second axis) and of columns within ``most`` cells."""
    n, found = counts.sum(), 0.0
    size = counts.sum(axis=0)
    middle, seen = np.cumsum(size) - size / 2, set()
    for rows in range(2, min(int(most // 2), counts.shape[1]) + 1):  # more rows than steps are none
        row = np.minimum(middle * rows / n, rows - 1).astype(int)
        row = np.cumsum(np.append(0, row[1:] != row[:-1]))
        made = int(row[-1]) + 1
        if made < 2 or row.tobytes() in seen:
            continue
        seen.add(row.tobytes())
        columns = int(most // made)
        part = _superclumps(np.add.reduceat(counts, np.flatnonzero(np.append(True, row[1:] != row[:-1])), axis=1), SUPERCLUMPS * columns)
        k, own = len(part), part.sum(axis=0)
        entropy = (_xlogx(n) - _xlogx(own).sum()) / n
        all_columns = entropy - (_xlogx(part.sum(axis=1)).sum() - _xlogx(part).sum()) / n  # no grid of these rows tells more
        if k < 2 or all_columns / np.log(2) <= found:
            continue
        upto = np.vstack((np.zeros(made), np.cumsum(part, axis=0)))
        cost = _xlogx(np.maximum(upto.sum(axis=1)[None, :] - upto.sum(axis=1)[:, None], 0.0))
        for r in range(made):  # superclumps s..t as one column: what isn't known of the row there
            cost -= _xlogx(np.maximum(upto[None, :, r] - upto[:, None, r], 0.0))
        cost[np.tril_indices(k + 1)] = np.inf
        cost = np.ascontiguousarray(cost.T)
        reached = cost[:, 0]
        for c in range(2, min(k, columns) + 1):
            if all_columns / np.log(min(c, made)) <= found:
                break
            reached = (cost + reached).min(axis=1)
            if np.isfinite(reached[-1]) and (value := float((entropy - reached[-1] / n) / np.log(min(c, made)))) > found:
                found = value
                yield found


def combined_score(scores: DataFrame, metrics: list[str]) -> DataFrame:
    """Each metric's magnitude over its largest, averaged over those that are there; best first."""
    every = Window.partitionBy()
    scaled = [F.abs(m) / (F.max(F.abs(m)).over(every) + F.lit(1e-9)) for m in metrics]
    number = reduce(lambda a, b: a + b, [F.col(m).isNotNull().cast("int") for m in metrics])
    total = reduce(lambda a, b: a + b, [F.coalesce(s, F.lit(0.0)) for s in scaled])
    return scores.withColumn("combined_score", F.when(number > 0, total / number)).orderBy(F.desc("combined_score"), "feature")


#: The weights of the metrics in the ranking.
WEIGHTS = {"pearson": 0.20, "spearman": 0.20, "kendall": 0.15, "mutual_info": 0.25, "mic": 0.10, "phik": 0.10}


def top_features(scores: DataFrame, n: int = 10, unique_frac: str | None = None) -> DataFrame:
    """(feature, weighted_score): min-max scaled metrics by weight, signs as they are; a tenth for features that look like ids."""
    every = Window.partitionBy()
    total = F.lit(0.0)
    for m, w in WEIGHTS.items():
        if m in scores.columns:
            v = F.coalesce(m, F.lit(0.0))
            lo, hi = F.min(v).over(every), F.max(v).over(every)
            total = total + F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0) * w
    id_like = F.lower("feature").rlike("id|code")
    if unique_frac:
        id_like = id_like | (F.col(unique_frac) >= 0.9)
    return scores.select("feature", (total * F.when(id_like, 0.1).otherwise(1.0)).alias("weighted_score")).orderBy(F.desc("weighted_score"), "feature").limit(n)


def heat_map(scores: DataFrame) -> DataFrame:
    """(feature, metric, value) of the metrics that a table of scores has: a cell each."""
    return unpivot(scores, [m for m in WEIGHTS if m in scores.columns], "double", keep=("feature",), name="metric")


def leakage(df: DataFrame, target: str, threshold: float = 0.97) -> DataFrame:
    """(feature, correlation) of numeric features that all but give the target away."""
    df = normalize_nulls(df)
    features = [f.name for f in df.schema.fields if f.name != target and is_numeric(f.dataType)]
    rows = unpivot(df.withColumn("_y", F.col(target).cast("double")), features, "double", keep=("_y",))
    r = rows.groupBy("feature").agg(pearson(F.col("value"), F.col("_y")).alias("correlation"))
    return r.where(F.abs("correlation") >= threshold)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, correlation), a before b: all pairs, each over the rows that have both.

    Each partition is summed up batch by batch as products of matrices (a row a pair leaves it), so the plan doesn't grow
    with the number of pairs.
    """
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, correlation double")
    df = normalize_nulls(df).select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    shift = [x or 0.0 for x in df.agg(*[F.avg(c) for c in df.columns]).first()]  # keeps the sums small
    upper = np.triu_indices(len(columns), 1)

    def sums(batches):
        total = None
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(columns))]).astype(float) - shift
            there = np.isfinite(x).astype(float)
            x = np.where(there > 0, x, 0.0)
            own = np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, there.T @ (x * x), x.T @ x])
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *(pa.array(t[upper]) for t in total)], names=["i", "j", *SUMS])

    s = df.mapInArrow(sums, "i int, j int, " + ", ".join(f"{c} double" for c in SUMS)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])
    spread = (F.col("xx") - F.col("x") * F.col("x") / F.col("n")) * (F.col("yy") - F.col("y") * F.col("y") / F.col("n"))
    name = lambda c: F.element_at(F.array(*[F.lit(n) for n in columns]), F.col(c) + 1)
    r = F.when((F.col("n") > 0) & (spread > 0), (F.col("xy") - F.col("x") * F.col("y") / F.col("n")) / F.sqrt(spread))
    return s.select(name("i").alias("a"), name("j").alias("b"), r.alias("correlation"))


SUMS = ("n", "x", "y", "xx", "yy", "xy")


def strength(value: Column) -> Column:
    """Band of a correlation for display."""
    return F.when(F.abs(value) > 0.5, "strong").when(F.abs(value) > 0.2, "moderate").otherwise("weak")


def insight_tier(profile: DataFrame, scores: DataFrame) -> DataFrame:
    """(feature, tier): high, medium or low value of each feature, from flags and correlation with the target."""
    rows = profile.join(scores, "feature", "left")
    c, has = F.coalesce(F.abs("pearson"), F.lit(0.0)), lambda x: F.array_contains("flags", x)
    tier = F.when(has("ID_LIKE") | has("CONSTANT"), "low").when(c >= 0.3, "high").when(c >= 0.1, "medium").when(has("HIGH_CARDINALITY") | (F.col("missing_rate") > 0.5), "low").otherwise("medium")
    return rows.select("feature", tier.alias("tier"), c.alias("strength"))


