"""Profile of a table: what each column is, how it is filled and distributed.

Everything comes from three families of jobs, each one pass for all columns: null counts (one row), value frequencies
(``groupBy(feature, value)`` over the unpivoted columns) and numeric or text summaries (``groupBy(feature)``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ProfileConfig
from ..functions import ordered

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
DEFAULT = ProfileConfig()


def medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """The exact median of each numeric column that has values."""
    if not columns:
        return {}
    counts = unpivot(df, columns, "double").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    return {r.feature: r.q0 for r in ordered.quantiles(counts, "value", (0.5,), ("feature",)).collect()}  # a row a column


def with_nulls(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that have nulls."""
    if not columns:
        return []
    missing = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    return [c for c, n in zip(columns, missing) if n]


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, NUMERIC)


def features_of(df: DataFrame, targets: list[str] | None = None, features: list[str] | None = None) -> list[str]:
    """The columns to work on, in the table's order; absent ones are an error."""
    missing = [c for c in [*(targets or []), *(features or [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns that the table lacks: {missing}")
    return [c for c in (features or df.columns) if c not in (targets or [])]


def normalize_nulls(df: DataFrame) -> DataFrame:
    """NaN becomes null in all float columns, so later steps know one kind of missing value."""
    return df.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema.fields])


def unpivot(df: DataFrame, columns: list[str], kind: str = "string", keep: tuple[str, ...] = (), name: str = "feature") -> DataFrame:
    """(feature, value) of the named columns, a row each; numbers that don't parse become null."""
    pairs = [F.struct(F.lit(c).alias(name), F.col(f"`{c}`").try_cast(kind).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*pairs)))


def dataset_profile(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and their share, duplicate rows (by two 64-bit hashes of a row), columns by kind."""
    n_cols = len(df.columns)
    kinds = [f.dataType for f in df.schema.fields]
    cells = sum((F.col(c).isNull().cast("long") for c in df.columns), F.lit(0).cast("long"))
    told = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]  # hashes pass over nulls
    alike = [F.xxhash64(F.lit(seed), *told).alias(f"_h{seed}") for seed in (1, 2)]  # 128 bits a row are shuffled, not its texts
    counts = df.select(cells.alias("_missing"), *alike).groupBy("_h1", "_h2").agg(F.count("*").alias("_n"), F.sum("_missing").alias("_m"))
    out = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_cells"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))
    return out.select(
        "n_rows",
        F.lit(n_cols).cast("long").alias("n_columns"),
        "missing_cells",
        F.when(F.col("n_rows") > 0, F.col("missing_cells") / (F.col("n_rows") * n_cols)).otherwise(0.0).alias("missing_ratio"),
        "duplicate_rows",
        F.lit(sum(is_numeric(k) or isinstance(k, T.BooleanType) for k in kinds)).cast("long").alias("n_numeric"),
        F.lit(sum(isinstance(k, T.StringType) for k in kinds)).cast("long").alias("n_categorical"),
        F.lit(sum(isinstance(k, TIME) for k in kinds)).cast("long").alias("n_datetime"),
    )


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, value, count) of all values that aren't null."""
    return unpivot(df, columns).where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("count"))


def _kind_name(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    return "numeric" if is_numeric(kind) else "datetime" if isinstance(kind, TIME) else "string" if isinstance(kind, T.StringType) else "other"


def column_profile(df: DataFrame, targets: list[str] | None = None, config: ProfileConfig = DEFAULT) -> DataFrame:
    """A row a column: nulls, distinct values, role, flags, type, recommendations."""
    df = normalize_nulls(df)
    columns = features_of(df, targets)
    fields = [f for f in df.schema.fields if f.name in columns]
    facts = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(f.name).alias("feature"), F.lit(_kind_name(f.dataType)).alias("kind"), F.count(f.name).alias("n_non_null"), F.count("*").alias("n_rows")) for i, f in enumerate(fields)])
    nulls = df.agg(facts.alias("facts")).select(F.inline("facts"))
    levels = value_counts(df, columns).groupBy("feature").agg(F.count("*").alias("n_unique"), F.bool_and(F.lower("value").isin("0", "1", "0.0", "1.0", "true", "false")).alias("two_valued"))
    rows = nulls.join(levels, "feature", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    rows = rows.withColumn("n_missing", F.col("n_rows") - F.col("n_non_null"))
    rows = rows.withColumn("missing_rate", F.when(F.col("n_rows") > 0, F.col("n_missing") / F.col("n_rows")).otherwise(0.0))
    rows = rows.withColumn("unique_ratio", F.col("n_unique") / F.greatest(F.col("n_rows"), F.lit(1)))
    rows = rows.withColumn("role", role(config))
    rows = rows.withColumn("flags", flags(config))
    return rows.select("ordinal", "feature", "kind", "role", "n_non_null", "n_missing", "missing_rate", "n_unique", "unique_ratio", "flags", inferred_type(config).alias("inferred_type"), recommendations(config).alias("recommendations"))


def role(config: ProfileConfig = DEFAULT) -> Column:
    """Semantic role of a profile row; the first rule that holds."""
    kind = F.col("kind")
    two = (kind == "boolean") | ((kind != "string") & F.coalesce("two_valued", F.lit(False)) & (F.col("n_unique") > 0) & (kind == "numeric"))
    return (
        F.when((kind == "numeric") & ~two, "numeric").when(kind == "datetime", "datetime").when(two, "boolean")
        .when((kind == "string") & (F.col("n_unique") > config.max_low_cardinality) & (F.col("unique_ratio") > config.text_unique_ratio), "text")
        .when(kind == "string", "categorical").otherwise("unknown")
    )


def flags(config: ProfileConfig = DEFAULT) -> Column:
    """CONSTANT, ID_LIKE and HIGH_CARDINALITY, as far as they apply. Strict ids ask for whole name parts."""
    named = F.lower("feature").rlike("(^|_)(id|uuid|guid)($|_)" if config.strict_ids else "id|uuid|guid")
    return F.array_compact(F.array(
        F.when(F.col("n_unique") <= 1, "CONSTANT"),
        F.when(named | (F.col("unique_ratio") > config.id_unique_ratio), "ID_LIKE"),
        F.when((F.col("role") == "categorical") & (F.col("n_unique") > config.high_cardinality), "HIGH_CARDINALITY"),
    ))


def inferred_type(config: ProfileConfig = DEFAULT) -> Column:
    has = lambda x: F.array_contains("flags", x)
    return (
        F.when(has("CONSTANT"), "constant").when(has("ID_LIKE"), "id_like").when(F.col("role") == "numeric", "numeric").when(F.col("role") == "boolean", "bool")
        .when(F.col("role").isin("datetime", "text"), F.col("role"))
        .when(F.col("role") == "categorical", F.when(F.col("n_unique") <= config.max_low_cardinality, "categorical_low").otherwise("categorical_high")).otherwise("unknown")
    )


def recommendations(config: ProfileConfig = DEFAULT) -> Column:
    """Modelling hints by role and flags."""
    r, has = F.col("role"), lambda x: F.array_contains("flags", x)
    return F.array_compact(F.array(
        F.when(has("CONSTANT"), "drop_constant_feature"),
        F.when(has("ID_LIKE"), "do_not_use_as_raw_feature"),
        F.when(F.col("n_missing") > 0, F.when(r == "numeric", "impute_median").otherwise("impute_most_frequent_or_category")),
        F.when(F.col("missing_rate") > config.high_missing, "high_missing_rate"),
        F.when(r == "numeric", "candidate_for_scaling"),
        F.when(r == "categorical", F.when(has("HIGH_CARDINALITY"), "use_target_encoding_or_hashing").otherwise("candidate_for_one_hot")),
        F.when(r == "text", "use_text_embeddings"),
        F.when(r == "text", "tfidf_or_ngram_features"),
        F.when(r == "datetime", "extract_datetime_features"),
        F.when(r == "boolean", "binary_feature"),
        F.when(r == "unknown", "check_semantics"),
    ))


def warnings(profile: DataFrame) -> DataFrame:
    """(feature, warning) of a column profile, in the order id, constant, high cardinality."""
    rank = F.create_map(*[x for k, v in (("ID_LIKE", 0), ("CONSTANT", 1), ("HIGH_CARDINALITY", 2)) for x in (F.lit(k), F.lit(v))])
    return profile.select("ordinal", "feature", F.explode("flags").alias("warning")).orderBy("ordinal", rank["warning"]).select("feature", "warning")


def numeric_stats(df: DataFrame, columns: list[str], quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, std, extremes, exact quantiles (linear), adjusted skewness G1 and excess kurtosis G2 of each column."""
    v = unpivot(normalize_nulls(df), columns, "double")
    out = v.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    counts = v.where("value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"))
    out = out.join(ordered.quantiles(counts, "value", quantiles, ("feature",)), "feature", "left")
    n = F.col("n").cast("double")
    skew = F.when((n > 2) & (F.col("std") > 0), F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"))
    kurt = F.when((n > 3) & (F.col("std") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return out.select("feature", F.col("n").alias("count"), "mean", "std", "min", *[F.col(f"q{i}").alias(f"p{round(100 * q):02d}") for i, q in enumerate(quantiles)], "max", skew.alias("skew"), kurt.alias("kurtosis"))


def categorical_stats(df: DataFrame, columns: list[str], config: ProfileConfig = DEFAULT, top: int = 10) -> DataFrame:
    """(feature, rank, value, count, freq, n_unique, n_rare): the most frequent levels; freq is of all rows, nulls included."""
    total = df.agg(F.count("*").alias("n_rows"))
    counts = value_counts(df, columns).crossJoin(F.broadcast(total))  # one row
    by = Window.partitionBy("feature")
    counts = counts.withColumn("freq", F.col("count") / F.col("n_rows"))
    summary = counts.groupBy("feature").agg(F.count("*").alias("n_unique"), F.count_if(F.col("freq") < config.rare_level).alias("n_rare"))
    ranked = counts.withColumn("rank", F.row_number().over(by.orderBy(F.desc("count"), "value"))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(summary), "feature").select("feature", F.col("rank").cast("long").alias("rank"), "value", "count", "freq", "n_unique", "n_rare")


def text_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lengths in characters and mean number of whitespace-separated tokens."""
    v = unpivot(df, columns).where("value IS NOT NULL")
    size = F.char_length("value")
    return v.groupBy("feature").agg(F.avg(size).alias("avg_chars"), F.min(size).cast("long").alias("min_chars"), F.max(size).cast("long").alias("max_chars"), F.avg(F.regexp_count("value", F.lit(r"\S+"))).alias("avg_tokens"))


def example_values(df: DataFrame, columns: list[str], order: str, n: int = 5) -> DataFrame:
    """(feature, rank, value): the first n distinct values of each column in the order of ``order``."""
    first = unpivot(df, columns, keep=(order,)).where("value IS NOT NULL").groupBy("feature", "value").agg(F.min(order).alias("at"))
    w = Window.partitionBy("feature").orderBy("at", "value")
    return first.select("feature", F.row_number().over(w).cast("long").alias("rank"), "value").where(F.col("rank") <= n)


def target_profile(df: DataFrame, target: str, config: ProfileConfig = DEFAULT) -> DataFrame:
    """One row: problem type, number of classes, imbalance, positive class."""
    numeric = is_numeric(df.schema[target].dataType) or isinstance(df.schema[target].dataType, T.BooleanType)
    counts = normalize_nulls(df).groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("n"))
    own = F.col("class").isNotNull()
    one = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(~own, F.col("n"))), F.lit(0)).alias("n_missing"), F.count(F.when(own, 1)).alias("n_unique"),
        F.max(F.when(own, F.col("n"))).alias("most"), F.min(F.when(own, F.col("n"))).alias("least"), F.min_by("class", F.when(own, F.struct(-F.col("n"), F.col("class")))).alias("top"),
    )
    few, ratio = F.col("n_unique") <= config.max_classes, F.col("n_unique") / F.greatest(F.col("n_rows"), F.lit(1))
    kind = F.when(F.col("n_unique") <= 2, "binary").when(few & (ratio < 0.2) if numeric else few, "multiclass").otherwise("regression" if numeric else "high_cardinality_classification")
    classes = kind != "regression"
    imbalance = F.when(classes & (F.col("n_unique") >= 2), F.col("most") / F.col("least"))
    return one.select(F.lit(target).alias("target"), kind.alias("problem_type"), "n_rows", "n_missing", "n_unique", imbalance.alias("imbalance_ratio"), F.coalesce(imbalance > config.imbalance, F.lit(False)).alias("is_imbalanced"), F.when(kind == "binary", F.col("top")).alias("positive_class"))


def class_distribution(df: DataFrame, target: str, top: int = 30) -> DataFrame:
    """(class, count, proportion) with nulls as a class, most frequent first."""
    counts = df.groupBy(F.col(target).cast("string").alias("class")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select("class", "count", (F.col("count") / F.col("_all")).alias("proportion")).orderBy(F.desc("count"), "class").limit(top)  # one row


def class_counts(df: DataFrame, target: str, top: int = 10) -> DataFrame:
    """(class, count, proportion) of the most frequent classes among rows that have one."""
    return class_distribution(normalize_nulls(df).where(F.col(target).isNotNull()), target, top)


#: Shares from which one class is called dominant.
DOMINANT, VERY_DOMINANT = 0.80, 0.90


def target_notes(df: DataFrame, target: str, config: ProfileConfig = DEFAULT) -> DataFrame:
    """(target, note): what to mind about a target."""
    one = target_profile(df, target, config)
    top = class_distribution(df, target, 1).select(F.col("proportion").alias("_top"))
    share, classes = F.col("_top"), F.col("problem_type") != "regression"
    notes = F.array_compact(F.array(
        F.when(classes & (share > VERY_DOMINANT), "very_dominant_class").when(classes & (share > DOMINANT), "dominant_class"),
        F.when(F.col("is_imbalanced"), "imbalanced_classes"),
        F.when(F.col("n_missing") > 0, "missing_target_values"),
        F.when(F.col("n_unique") <= 1, "constant_target"),
    ))
    return one.join(F.broadcast(top), F.lit(True), "left").select("target", F.explode(notes).alias("note"))  # one row


def targets_profile(df: DataFrame, targets: list[str], config: ProfileConfig = DEFAULT) -> DataFrame:
    """A row a target."""
    return reduce(DataFrame.unionByName, [target_profile(df, t, config) for t in targets])


#: Fixed value: a skewness beyond which a transformation is suggested.
SKEWED = 1.0


def skew_hints(stats: DataFrame) -> DataFrame:
    """(feature, recommendation) of numeric statistics: features skewed enough to be transformed."""
    return stats.where(F.abs("skew") > SKEWED).select("feature", F.lit("consider_non_linear_transform").alias("recommendation"))


def is_categorical(df: DataFrame, column: str) -> bool:
    """Whether a column counts as categorical: any that isn't a number, and numbers of just 0 and 1."""
    kind = df.schema[column].dataType
    if not is_numeric(kind):
        return True
    return sorted(r[0] for r in df.where(F.col(column).isNotNull()).select(F.col(column).cast("double")).distinct().limit(3).collect()) == [0.0, 1.0]


def memory_mb(df: DataFrame) -> float:
    """The optimizer's estimate of the table's size."""
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1e6


def valid_groups(df: DataFrame, columns: list[str], least_size: int = 5, least_groups: int = 2) -> DataFrame:
    """(feature, n_groups) of the columns with enough levels of enough rows each."""
    counts = value_counts(df, columns).where(F.col("count") >= least_size)
    return counts.groupBy("feature").agg(F.count("*").alias("n_groups")).where(F.col("n_groups") >= least_groups)


def group_sizes(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"))
