"""The history of a search for features: what each program created and dropped, and what became of its score."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import progress, running_best
from ..sources.writers import write_features

#: Columns of the history, in order.
COLUMNS = ("sample_order", "score", "score_delta", "is_best", "sample_time", "evaluate_time", "n_features_created", "n_features_dropped", "features_created", "features_dropped", "has_error", "timestamp")


def _names(program: Column, pattern: str) -> Column:
    rows = F.filter(F.transform(F.split(F.coalesce(program, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, "#.*", ""))), lambda x: x.rlike(pattern))
    return F.array_distinct(F.transform(rows, lambda x: F.regexp_extract(x, pattern, 1)))


def changes(log: DataFrame, columns: list[str], program: str = "function") -> DataFrame:
    """``log`` with the names that each program creates, transforms (columns there already) and drops, as arrays."""
    made = _names(F.col(program), r"^([A-Za-z_]\w*)\s*=(?!=)")
    known = F.array(*[F.lit(c) for c in columns]).cast("array<string>")
    return log.withColumns({"created": F.array_except(made, known), "transformed": F.array_intersect(made, known), "dropped": _names(F.col(program), r"^drop\s+(\S.*)$")})


def evolution(log: DataFrame, columns: list[str]) -> DataFrame:
    """A row a sample, with the columns of ``COLUMNS``; ``log`` has sample_order, function, score and may have the times and an error."""
    for c, kind in (("sample_time", "double"), ("evaluate_time", "double"), ("timestamp", "string"), ("error", "string")):
        if c not in log.columns:
            log = log.withColumn(c, F.lit(None).cast(kind))
    rows = changes(running_best(log).withColumnRenamed("delta", "score_delta"), columns)
    return rows.select(
        "sample_order", "score", "score_delta", "is_best", "sample_time", "evaluate_time", F.size("created").alias("n_features_created"), F.size("dropped").alias("n_features_dropped"),
        F.array_join("created", ",").alias("features_created"), F.array_join("dropped", ",").alias("features_dropped"), (F.col("error").isNotNull() | F.col("score").isNull()).alias("has_error"), "timestamp",
    )


def timeline(log: DataFrame, columns: list[str]) -> DataFrame:
    """(sample_order, score, created, dropped, transformed, total_features): how many features a sample's table has."""
    rows = changes(log, columns)
    return rows.select("sample_order", "score", "created", "dropped", "transformed", (F.lit(len(columns)) + F.size("created") - F.size("dropped")).alias("total_features"))


def most_changed(log: DataFrame, columns: list[str], what: str = "created", top: int = 10) -> DataFrame:
    """(feature, n): the names most often created or dropped."""
    return changes(log, columns).select(F.explode(what).alias("feature")).groupBy("feature").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature").limit(top)


def convergence(log: DataFrame) -> DataFrame:
    """(sample_order): the last sample that bettered the best so far."""
    return running_best(log).where("is_best").agg(F.max("sample_order").alias("sample_order"))


def report(log: DataFrame, columns: list[str], target: str) -> dict:
    """The history as plain data: run, statistics, scores, features and timeline (a search's log is small)."""
    p = progress(log).first().asDict()
    first = log.where("score IS NOT NULL").agg(F.min_by("score", "sample_order")).first()[0]
    names = lambda what: {r.feature: r.n for r in most_changed(log, columns, what).collect()}
    return {
        "run": {"original_features": columns, "target": target},
        "statistics": {"total": p["total"], "valid": p["valid"], "failed": p["failed"], "success_rate": p["success_rate"]},
        "scores": {"best": p["best"], "best_order": p["best_order"], "mean": p["mean_score"], "improvement": None if first is None else p["best"] - first},
        "features": {"most_created": names("created"), "most_dropped": names("dropped")},
        "timeline": [r.asDict() for r in timeline(log, columns).orderBy("sample_order").collect()],
    }


def write(log: DataFrame, columns: list[str], target: str, path: str) -> str:
    """``<path>/history.parquet`` with a row a sample, and ``<path>/report`` with the report as JSON."""
    write_features(evolution(log, columns), f"{path}/history.parquet")
    text = json.dumps(report(log, columns, target), default=str)
    log.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    return path
