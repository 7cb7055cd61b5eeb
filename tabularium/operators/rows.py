"""Operations on rows and columns: encoding, imputing, splitting, deduplicating, joining, monitoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordered import ahead, ranges, running_sum
from ..sources.shared import checkpointed
from .profile import is_numeric, medians, normalize_nulls, with_nulls

# --- columns -------------------------------------------------------------------------------------------------------


def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def unique_columns(first: DataFrame, second: DataFrame, target: str) -> DataFrame:
    """Of ``second``: the columns that only one of the two tables has, and the target."""
    either = {*first.columns} ^ {*second.columns}
    return second.select(*sorted(c for c in second.columns if c in either and c != target), *([target] if target in second.columns else []))


def align(df: DataFrame, columns: list[str], fill=0) -> DataFrame:
    """Exactly ``columns`` in that order; absent ones are filled, others dropped."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def trim_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[str(c).strip() for c in df.columns])


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("Unnamed:")])


def null_ratios(df: DataFrame) -> DataFrame:
    """(feature, null_ratio) from one aggregate."""
    df = normalize_nulls(df)
    return df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.avg(F.col(c).isNull().cast("int")), F.lit(0.0)).alias("null_ratio")) for c in df.columns]).alias("r")).select(F.inline("r"))


def usable_columns(df: DataFrame, most_null: float = 0.5, strict: bool = False, constant: bool = True) -> list[str]:
    """Columns whose null ratio isn't over the limit (``strict``: is under it) and that have more than one value."""
    ratios = {r.feature: r.null_ratio for r in null_ratios(df).collect()}
    kept = [c for c in df.columns if (ratios[c] < most_null if strict else ratios[c] <= most_null)]
    if constant and kept:
        n = df.agg(*[(F.max(c) != F.min(c)).alias(c) for c in kept if not isinstance(df.schema[c].dataType, (T.MapType,))]).first()
        kept = [c for c in kept if n[c]]
    return kept


# --- encoding and imputing -----------------------------------------------------------------------------------------


def level_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct values as strings in order, numbered from 0."""
    levels = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("value")).distinct()
    return running_sum(levels, "value", F.lit(1), "_number").select("value", (F.col("_number") - 1).cast("long").alias("code"))


def encode(df: DataFrame, column: str, codes: DataFrame, name: str, unknown: int = -1) -> DataFrame:
    """``df`` with the code of a column's value; values that aren't among the codes, and nulls, get ``unknown``."""
    c = codes.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(c, F.col(column).cast("string") == F.col("_value"), "left").withColumn(name, F.coalesce("_code", F.lit(unknown))).drop("_value", "_code")


def fit_encode(train: DataFrame, test: DataFrame | None, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Categories as the training table has them, in both tables; numbers as doubles without infinities."""
    for c in columns:
        codes = level_codes(train, c)
        train, test = (encode(x, c, codes, c) if x is not None else None for x in (train, test))
    clean = lambda df: df.select(*[finite(F.col(f.name).cast("double")).alias(f.name) if is_numeric(f.dataType) else F.col(f.name) for f in df.schema.fields])
    return clean(train), clean(test) if test is not None else None


def finite(c: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exact medians for nulls; 0 in a column without values."""
    df = normalize_nulls(df)
    m = medians(df, with_nulls(df, columns))
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m.get(c)).cast("double"), F.lit(0.0)) for c in columns})


def impute_text(df: DataFrame, columns: list[str], mark: str = "MISSING") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(mark)) for c in columns})


def looks_like_dates(df: DataFrame, column: str) -> bool:
    """Whether every value of a text column is a time."""
    r = df.where(F.col(column).isNotNull()).agg(F.count("*").alias("n"), F.count(F.try_to_timestamp(F.col(column).cast("string"))).alias("t")).first()
    return r.n > 0 and r.n == r.t


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean, unit population deviation."""
    s = df.agg(*[f(c).alias(f"{p}{c}") for c in columns for f, p in ((F.avg, "m_"), (F.stddev_pop, "s_"))]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in columns})


# --- order, samples, splits ----------------------------------------------------------------------------------------


def hash_order(key: str, seed: int = 42) -> Column:
    """A fixed shuffle of the rows: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same at every run."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def _chunked_position(df: DataFrame, by: list[str], key: str, seed: int, digits: int = 2) -> DataFrame:
    """``_position`` from 1 in each ``by`` group in hash order: counts of hash prefixes before, plus the place in the prefix.

    Only a prefix's rows (one in 256 of a group) meet in a window, so a group with most of the rows is spread.
    """
    rows = df.withColumn("_h", hash_order(key, seed)).withColumn("_p", F.substring("_h", 1, digits))
    counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(*by))
    counts = counts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col("_p").alias("_kp"), before.alias("_before"), total.alias("_total"))
    on = F.col("_p") == F.col("_kp")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    place = F.row_number().over(Window.partitionBy(*by, "_p").orderBy("_h", key))
    return rows.withColumn("_place", place).join(counts, on).withColumn("_position", F.col("_before") + F.col("_place")).drop(*[f"_k{i}" for i in range(len(by))], "_kp", "_before", "_place", "_h", "_p")


def split(df: DataFrame, key: str, target: str | None = None, test: float = 0.2, seed: int = 42) -> DataFrame:
    """``df`` with ``split`` (train or test); of each class of ``target`` its share, if one is given."""
    rows = _chunked_position(df, [target] if target else [], key, seed)
    return rows.withColumn("split", F.when(F.col("_position") <= F.ceil(F.col("_total") * test), "test").otherwise("train")).drop("_position", "_total")


def can_stratify(df: DataFrame, target: str) -> bool:
    """More than one class, none null, each with two rows at least."""
    r = df.groupBy(target).count().agg(F.count("*").alias("k"), F.min("count").alias("least"), F.count_if(F.col(target).isNull()).alias("nulls")).first()
    return r.k > 1 and r.least >= 2 and r.nulls == 0


def folds(df: DataFrame, key: str, k: int = 5, target: str | None = None, seed: int = 42) -> DataFrame:
    """``df`` with ``fold`` 0..k-1, dealt in turn in each class."""
    rows = _chunked_position(df, [target] if target else [], key, seed)
    return rows.withColumn("fold", F.pmod(F.col("_position") - 1, F.lit(k)).cast("int")).drop("_position", "_total")


# --- union and dedup -----------------------------------------------------------------------------------------------


def union_tables(tables: list[DataFrame]) -> DataFrame:
    """Rows of all tables by column name; they must have a column in common."""
    if not tables or not set.intersection(*[{*t.columns} for t in tables]):
        raise ValueError("the tables have no column in common")
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def distinct_first(df: DataFrame, order: str) -> DataFrame:
    """One row of each set of equal rows: the first by ``order``. Null equals null."""
    return df.groupBy(*[c for c in df.columns if c != order]).agg(F.min(order).alias(order)).select(*df.columns)


def drop_dominated(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct rows that no other, fuller row agrees with on every cell they have.

    Cells are compared as trimmed strings, empty ones as missing; rows without a cell go. A fuller row has a row's rarest
    cell too: so rows are looked up by that cell in an inverted index of the cells asked for, and what is found there is
    verified. Where a pattern's rows (those that have the same columns) have only common cells, so that the lookup would
    find more than there are rows with these columns, every fuller row gives its cells on that pattern instead, and these
    are joined by equality. Which patterns lie in which is found in the same way, by their rarest column.
    """
    # one expression over one array: the optimizer's work doubles with each column that is named apart
    given = F.transform(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]), lambda x: F.when(F.trim(x) != "", F.trim(x)))
    text = df.select(given.alias("_cells")).distinct()
    text = text.withColumn("_has", F.array_join(F.transform("_cells", lambda x: F.when(x.isNull(), "0").otherwise("1")), "")).where(F.contains("_has", F.lit("1")))
    text = checkpointed(text.withColumn("_row", F.monotonically_increasing_id()).withColumn("_filled", F.size(F.filter("_cells", lambda x: x.isNotNull()))))
    long = text.select("_row", "_has", F.posexplode("_cells").alias("_at", "_value")).where("_value IS NOT NULL")
    often = checkpointed(long.groupBy("_at", "_value").agg(F.count("*").alias("_n")))
    rarest = long.join(often, ["_at", "_value"]).groupBy("_row", "_has").agg(F.min(F.struct("_n", "_at", "_value")).alias("_cell"))
    rarest = checkpointed(rarest.where("_cell._n > 1"))  # a cell that no other row has: nothing agrees with it
    by_column = often.groupBy("_at").agg(F.sum("_n").alias("_rows"))
    asked = rarest.groupBy("_has").agg(F.sum("_cell._n").alias("_found"))
    bits = lambda has: F.filter(F.sequence(F.lit(0), F.length(has) - 1), lambda i: F.substring(has, i + 1, F.lit(1)) == "1")
    wide = asked.select("_has", "_found", F.explode(bits(F.col("_has"))).alias("_at")).join(F.broadcast(by_column), "_at")  # a row a column
    plan = checkpointed(wide.groupBy("_has", "_found").agg(F.min(F.struct("_rows", "_at")).alias("_least")).select("_has", (F.col("_found") > F.col("_least._rows")).alias("_common"), F.col("_least._at").alias("_at")))

    # by the rarest cell
    probes = rarest.join(plan.where("NOT _common").select("_has"), "_has", "left_semi").select("_row", F.col("_cell._at").alias("_at"), F.col("_cell._value").alias("_value"))
    probes = probes.join(text.select("_row", F.col("_cells").alias("_own"), F.col("_filled").alias("_size")), "_row").withColumnRenamed("_row", "_asking")
    index = text.select("_cells", "_filled", F.posexplode("_cells").alias("_at", "_value")).where("_value IS NOT NULL").join(probes.select("_at", "_value").distinct(), ["_at", "_value"], "left_semi")
    agrees = F.forall(F.arrays_zip("_own", "_cells"), lambda z: z["_own"].isNull() | z["_own"].eqNullSafe(z["_cells"]))
    gone = probes.join(index, ["_at", "_value"]).where((F.col("_filled") > F.col("_size")) & agrees).select(F.col("_asking").alias("_row")).distinct()

    # by the whole pattern
    smaller = plan.where("_common").select(F.col("_has").alias("_of"), "_at")
    holds = F.forall(bits(F.col("_of")), lambda i: F.substring(F.col("_has"), i + 1, F.lit(1)) == "1")
    larger = text.select("_has").distinct().withColumn("_at", F.explode(bits(F.col("_has"))))
    pairs = larger.join(smaller, "_at").where((F.col("_of") != F.col("_has")) & holds).select("_has", "_of")
    on_those = F.transform("_cells", lambda x, i: F.when(F.substring(F.col("_of"), i + 1, F.lit(1)) == "1", x))
    covered = text.join(pairs, "_has").select(F.col("_of").alias("_has"), F.to_json(on_those).alias("_json")).distinct()
    own = text.join(gone, "_row", "left_anti").withColumn("_json", F.to_json("_cells")).join(covered, ["_has", "_json"], "left_anti")
    return own.select(*[F.get("_cells", F.lit(i)).alias(c) for i, c in enumerate(columns)])


# --- joins ---------------------------------------------------------------------------------------------------------


def join_scores(tables: list[DataFrame], key: str = "feature") -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key)
    return out


def group_feature(df: DataFrame, key: str, value: str, make, name: str) -> DataFrame:
    """An aggregate of each group, copied to its rows; rows without a key get null.

    The aggregate is joined, not computed in a window: partial sums shrink the shuffle, and a hot key isn't one task's.
    """
    table = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(make(F.col(value)).alias(name))
    return df.join(table, F.col(key) == F.col("_key"), "left").drop("_key")


def group_columns(df: DataFrame, candidates: list[str], least_size: float = 5, most: int = 5, groups: tuple[int, int] = (2, 50)) -> DataFrame:
    """(feature, n_groups, avg_size) of columns fit to group by, the largest groups first."""
    from .profile import value_counts

    g = value_counts(df, candidates).groupBy("feature").agg(F.count("*").alias("n_groups"), F.avg("count").alias("avg_size"))
    return g.where(F.col("n_groups").between(*groups) & (F.col("avg_size") >= least_size)).orderBy(F.desc("avg_size"), "feature").limit(most)


def upsert_annotations(report: DataFrame, notes: DataFrame, least: float = 0.6) -> DataFrame:
    """The report's rows with annotations of enough confidence (none given counts as 1), and annotations of names it lacks.

    All other columns of the report stay, null where the name is new."""
    sure = notes.where(F.coalesce("confidence", F.lit(1.0)) >= least).select("name", F.col("note").alias("_note"))
    return report.join(sure, "name", "full").select(*[F.coalesce("_note", "note").alias("note") if c == "note" else F.col(f"`{c}`") for c in report.columns])


# --- the log of a search -------------------------------------------------------------------------------------------


def running_best(log: DataFrame, order: str = "sample_order", score: str = "score") -> DataFrame:
    """``best_so_far``, ``delta`` to the best before, and ``is_best``."""
    cut = ranges(log, order)
    w = Window.partitionBy("_range").orderBy(order)
    before = F.greatest("_ahead", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    best_now = F.greatest("_ahead", F.max(score).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    delta = F.when(F.col(score).isNull(), 0.0).otherwise(F.col(score) - F.coalesce(before, F.lit(0.0)))
    best = F.coalesce(F.col(score).isNotNull() & (before.isNull() | (F.col(score) > before)), F.lit(False))
    joined = cut.join(ahead(cut, F.max(score), F.max), "_range")
    return joined.select(*[joined[c] for c in log.columns], best_now.alias("best_so_far"), delta.alias("delta"), best.alias("is_best"))


def progress(log: DataFrame, order: str = "sample_order", score: str = "score") -> DataFrame:
    """One row: samples in all, valid, failed, best, best's order, last order, success rate and spread of scores."""
    n, ok = F.count("*"), F.count(score)
    return log.agg(n.alias("total"), ok.alias("valid"), (n - ok).alias("failed"), F.max(score).alias("best"), F.min_by(order, F.when(F.col(score).isNotNull(), F.struct(-F.col(score), F.col(order)))).alias("best_order"), F.max(order).alias("last_order"), F.when(n > 0, 100.0 * ok / n).otherwise(0.0).alias("success_rate"), F.avg(score).alias("mean_score"), F.stddev_pop(score).alias("std_score"))


def valid_samples(log: DataFrame, score: str = "score") -> DataFrame:
    return log.where(F.col(score).isNotNull())


def failed_samples(log: DataFrame, score: str = "score") -> DataFrame:
    return log.where(F.col(score).isNull())


def score_histogram(log: DataFrame, score: str = "score") -> DataFrame:
    """(score, n): how often each score was reached, in order."""
    return valid_samples(log, score).groupBy(score).agg(F.count("*").alias("n")).orderBy(score)


def last_n(log: DataFrame, n: int = 15, order: str = "sample_order") -> DataFrame:
    """The last rows, newest first."""
    return log.orderBy(F.desc(order)).limit(n)


def top_n(df: DataFrame, by: str, n: int = 10, tie: str | None = None) -> DataFrame:
    return df.orderBy(F.desc(by), *([tie] if tie else [])).limit(n)


def best_row(df: DataFrame, group: str, score: str, key: str) -> DataFrame:
    """(group, key): of each group the key of the best score, the least of equals."""
    ranked = F.min_by(key, F.when(F.col(score).isNotNull(), F.struct(-F.col(score), F.col(key))))
    return df.groupBy(group).agg(ranked.alias(key))


def leaderboard(df: DataFrame, score: str, key: str, name: str = "rank") -> DataFrame:
    """(key, name): places from 1, best first, ties by key. Counted range by range of the score, and by key among equals."""
    counts = df.where(F.col(score).isNotNull()).groupBy(score).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    worse = running_sum(counts, score, F.col("_n"), "_upto").crossJoin(F.broadcast(total)).select(F.col(score).alias("_score"), (F.col("_all") - F.col("_upto")).alias("_before"))  # one row
    among = F.row_number().over(Window.partitionBy(score).orderBy(key))
    return df.withColumn("_among", among).join(worse, F.col(score) == F.col("_score")).select(key, (F.col("_before") + F.col("_among")).alias(name))


def to_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what doesn't parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def with_row_id(df: DataFrame, name: str = "_row_id") -> DataFrame:
    """``df`` with a number for each row that depends on the row's values alone, so splits and folds can be repeated;
    equal rows are told apart by their number among themselves."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    among = F.row_number().over(Window.partitionBy("_h", "_m").orderBy(F.lit(1)))
    rows = df.withColumn("_h", h).withColumn("_m", F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    return rows.withColumn(name, F.concat_ws("-", F.hex("_h"), "_m", among.cast("string"))).drop("_h", "_m")
