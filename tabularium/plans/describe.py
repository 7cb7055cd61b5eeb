"""What is known of each feature, and lines of text about it for a prompt."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import association, profile

#: Marks by type and flag, headings by tier, and remarks on features of little value.
TYPE_MARKS = {"numeric": "[NUM]", "categorical_low": "[CAT]", "categorical_high": "[CAT]", "text": "[TEXT]", "datetime": "[DATE]"}
FLAG_MARKS = {"ID_LIKE": "[ID]", "CONSTANT": "[CONST]", "HIGH_CARDINALITY": "[HIGH_CARD]", "SKEWED": "[SKEWED]"}
HEADINGS = {"high": "### High-Value Features (strong predictors):", "medium": "### Medium-Value Features:", "low": "### Low-Value Features (consider dropping):"}
STRONG, MODERATE = 0.3, 0.1
FORMATS = ("basic", "tags", "hierarchical")


def insights(df: DataFrame, target: str | None = None, descriptions: dict[str, str] | None = None, scores: DataFrame | None = None, top: int = 10) -> DataFrame:
    """A row a feature: its profile, range, levels (most frequent first), correlation with the target, combined score, description and tier.

    ``scores`` is a table of association (feature, pearson, combined_score); without it a target's Pearson correlation is computed.
    """
    columns = profile.column_profile(df, [target] if target else None)
    features = profile.features_of(df, [target] if target else None)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if profile.is_numeric(kinds[c])]
    strings = [c for c in features if kinds[c].typeName() == "string"]
    empty = df.sparkSession.createDataFrame
    v = profile.unpivot(profile.normalize_nulls(df), numeric, "double")
    spread = v.groupBy("feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("skew")) if numeric else empty([], "feature string, min double, max double, skew double")
    if strings:
        ranked = profile.categorical_stats(df, strings, top=top)
        levels = ranked.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("levels"))  # at most ``top`` a feature
    else:
        levels = empty([], "feature string, levels array<string>")
    if scores is None:
        scores = association.pearson_scores(association.prepare(df, features, target), features) if target and features else empty([], "feature string, pearson double")
    for c in ("pearson", "combined_score"):
        if c not in scores.columns:
            scores = scores.withColumn(c, F.lit(None).cast("double"))
    told = empty([(k, x) for k, x in (descriptions or {}).items()], "feature string, description string")
    tables = [columns, spread, levels, scores.select("feature", F.col("pearson").alias("correlation"), "combined_score"), told]
    out = reduce(lambda a, b: a.join(b, "feature", "left"), tables)  # a row a feature each
    flags = F.when(F.abs("skew") > profile.SKEWED, F.array_append("flags", F.lit("SKEWED"))).otherwise(F.col("flags"))
    out = out.withColumn("flags", flags).withColumn("description", F.coalesce("description", F.replace("feature", F.lit("_"), F.lit(" "))))
    return out.withColumn("tier", tier()).drop("skew")


def tier() -> Column:
    """high, medium or low: ids and constants are low, then correlation decides, then how a feature is filled."""
    r, has = F.abs("correlation"), lambda x: F.array_contains("flags", x)
    return F.when(has("ID_LIKE") | has("CONSTANT"), "low").when(r >= STRONG, "high").when(r >= MODERATE, "medium").when(has("HIGH_CARDINALITY") | (F.col("missing_rate") > 0.5), "low").otherwise("medium")


def importance() -> Column:
    return F.coalesce(F.abs("combined_score"), F.abs("correlation"), F.lit(0.0))


def by_importance(table: DataFrame) -> DataFrame:
    return table.orderBy(importance().desc(), "ordinal")


def high_value(table: DataFrame, least: float = STRONG) -> DataFrame:
    return table.where(F.abs("correlation") >= least).orderBy("ordinal")


def low_value(table: DataFrame) -> DataFrame:
    return table.where(F.arrays_overlap("flags", F.array(F.lit("ID_LIKE"), F.lit("CONSTANT")))).orderBy("ordinal")


def feature(table: DataFrame, name: str) -> DataFrame:
    return table.where(F.col("feature") == name)


def _percent() -> Column:
    return F.floor(F.col("missing_rate") * 100).cast("string")


def _levels(n: int, mark: str, more) -> Column:
    shown = F.array_join(F.slice(F.coalesce("levels", F.array().cast("array<string>")), 1, n), mark)
    return F.when(F.size("levels") > n, F.concat(shown, more)).otherwise(shown)


def _values(numbers: Column, names: Column) -> Column:
    known = F.col("min").isNotNull() & F.col("max").isNotNull()
    return F.when((F.col("inferred_type") == "numeric") & known, numbers).when(F.col("inferred_type").isin("categorical_low", "categorical_high"), F.concat(F.lit("("), names, F.lit(")")))


def basic() -> Column:
    kind = F.col("inferred_type")
    known = F.col("min").isNotNull() & F.col("max").isNotNull()
    about = (
        F.when((kind == "numeric") & known, F.concat(F.lit("numerical variable within range ["), F.col("min").cast("string"), F.lit(", "), F.col("max").cast("string"), F.lit("]"))).when(kind == "numeric", "numerical variable")
        .when(kind.isin("categorical_low", "categorical_high"), F.concat(F.lit("categorical variable with categories ["), _levels(5, ", ", F.lit(", ...")), F.lit("]"))).when(kind == "text", "text variable").otherwise("feature")
    )
    return F.concat(F.lit("- "), "feature", F.lit(": "), "description", F.lit(" ("), about, F.lit(")"))


def tags() -> Column:
    mark = lambda table, c: F.coalesce(*[F.when(c == k, v) for k, v in table.items()])
    marks = F.array_compact(F.concat(
        F.array(mark(TYPE_MARKS, F.col("inferred_type")), F.when(F.col("missing_rate") > 0, F.concat(F.lit("["), _percent(), F.lit("% NaN]"))), F.when(F.abs("correlation") >= STRONG, "[HIGH_PRED]"), F.format_string("[CORR:%.2f]", "correlation")),
        F.transform("flags", lambda f: mark(FLAG_MARKS, f)),
    ))
    marks = F.filter(marks, lambda m: m != "[CORR:null]")
    values = _values(F.format_string("(%.2f to %.2f)", "min", "max"), _levels(4, ", ", F.concat(F.lit(", +"), (F.col("n_unique") - 4).cast("string"), F.lit(" more"))))
    return F.concat_ws(" ", F.concat(F.lit("- "), "feature", F.lit(":")), "description", F.nullif(F.array_join(marks, " "), F.lit("")), values)


def hierarchical() -> Column:
    has = lambda x: F.array_contains("flags", x)
    remark = F.when(F.col("tier") == "low", F.when(has("ID_LIKE"), "ID - no predictive value").when(has("CONSTANT"), "constant - no variance").when(has("HIGH_CARDINALITY"), F.concat(F.lit("high cardinality: "), F.col("n_unique").cast("string"), F.lit(" unique"))))
    notes = F.array_compact(F.array(F.when(F.col("correlation").isNotNull(), F.format_string("CORR: %.2f", "correlation")), F.when(F.col("missing_rate") > 0, F.concat(_percent(), F.lit("% missing"))), remark))
    values = _values(F.format_string("(%.1f-%.1f)", "min", "max"), _levels(3, "/", F.lit("/...")))
    return F.concat_ws(" ", F.concat(F.lit("- "), "feature", F.lit(":")), "description", F.when(F.size(notes) > 0, F.concat(F.lit("["), F.array_join(notes, ", "), F.lit("]"))), values)


def lines(table: DataFrame, form: str = "basic") -> DataFrame:
    """(section, place, line) of the insights in a format: basic, tags or hierarchical (sections high, medium, low)."""
    if form not in FORMATS:
        raise ValueError(f"no format {form}; there are {', '.join(FORMATS)}")
    if form != "hierarchical":
        return table.select(F.lit("all").alias("section"), F.col("ordinal").cast("double").alias("place"), (basic() if form == "basic" else tags()).alias("line"))
    place = F.when(F.col("tier") == "low", F.col("ordinal").cast("double")).otherwise(-F.coalesce(F.abs("correlation"), F.lit(0.0)))
    return table.select(F.col("tier").alias("section"), place.alias("place"), "ordinal", hierarchical().alias("line")).drop("ordinal")


def prompt_text(table: DataFrame, form: str = "basic") -> str:
    """The lines in order, with headings where there are sections."""
    found = sorted(lines(table, form).collect(), key=lambda r: (r.place, r.line))  # a row a feature
    if form != "hierarchical":
        return "\n".join(r.line for r in found)
    blocks = [[HEADINGS[s], *(r.line for r in found if r.section == s)] for s in HEADINGS]
    return "\n\n".join("\n".join(b) for b in blocks if len(b) > 1)
