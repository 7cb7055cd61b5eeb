"""Text and JSON cleaning as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What stands for "missing" in label columns.
MISSING = ("", "nan", "none", "null", "na", "n/a", "-", "--")


def clean_labels(df: DataFrame, column: str, order: str) -> DataFrame:
    """(label, at): distinct trimmed labels without missing marks, with the order of their first row."""
    label = F.trim(F.col(column).cast("string"))
    rows = df.where(F.col(column).isNotNull()).select(label.alias("label"), F.col(order).alias("at"))
    return rows.where(~F.lower("label").isin(*MISSING)).groupBy("label").agg(F.min("at").alias("at"))


def normalize_space(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\s+", " ")


def salvage_json(c: Column) -> Column:
    """The text if it is JSON, else its outermost braces, else the text."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.get_json_object(c, "$").isNotNull(), c).when(inner != "", inner).otherwise(c)


#: How an answer that isn't JSON says that it is the final one.
FINAL = r'"?mode"?\s*[:=]\s*"?final'


def final_mode(c: Column) -> Column:
    """Whether an answer says that it is the final one."""
    mode = F.lower(F.coalesce(F.get_json_object(salvage_json(c), "$.Mode"), F.get_json_object(salvage_json(c), "$.mode")))
    return F.coalesce(mode == "final", F.lit(False)) | F.coalesce(F.lower(c).rlike(FINAL), F.lit(False))


#: What a user says to skip a question, and to end the session.
SKIP = ("skip", "passe", "suivant", "next")
DONE = ("done", "fin", "stop", "terminer", "fini", "terminé")
#: Words of our own with the same meaning.
MORE_SKIP, MORE_DONE = ("pass",), ("quit", "exit", "end", "arrête")
#: What each word asks for.
COMMANDS = dict.fromkeys((*SKIP, *MORE_SKIP), "skip") | dict.fromkeys((*DONE, *MORE_DONE), "done")


def command(c: Column) -> Column:
    """skip, done or null: what a user's line asks for."""
    return F.create_map(*[F.lit(x) for kv in COMMANDS.items() for x in kv])[F.lower(F.trim(c))]


def row_text(columns: list[str], target: str) -> Column:
    """A row as a sentence: ``If a is 1, b is 2, Then y is z.``"""
    value = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("null")), r"['\".]", "")
    return F.concat(F.lit("If "), F.concat_ws(", ", *[F.concat(F.lit(f"{c} is "), value(c)) for c in columns]), F.lit(f", Then {target} is "), value(target), F.lit("."))


#: Names that a metric goes by.
METRIC_ALIASES = {
    "roc_auc": "auc", "rocauc": "auc", "roc-auc": "auc", "auroc": "auc",
    "f1-score": "f1", "f1score": "f1", "f1-macro": "f1_macro", "f1-micro": "f1_micro", "f1_weighted": "f1",
    "mean_squared_error": "mse", "root_mean_squared_error": "rmse", "mean_absolute_error": "mae", "r_squared": "r2", "r-squared": "r2",
    "": "auto",
}
#: Names of our own.
MORE_ALIASES = {"f1_score": "f1", "acc": "accuracy", "log_loss": "logloss"}


def metric_name(c: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    pairs = F.create_map(*[F.lit(x) for kv in (METRIC_ALIASES | MORE_ALIASES).items() for x in kv])
    return F.coalesce(pairs[word], word)


def truncate_history(df: DataFrame, conv: str = "conv_id", turn: str = "turn", last: int = 20) -> DataFrame:
    """System messages, the first message and the last ``last`` of each conversation."""
    up, down = F.row_number().over(Window.partitionBy(conv).orderBy(turn)), F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    return df.withColumn("_u", up).withColumn("_d", down).where((F.col("role") == "system") | (F.col("_u") == 1) | (F.col("_d") <= last)).drop("_u", "_d")
