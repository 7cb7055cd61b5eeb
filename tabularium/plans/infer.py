"""Task, metric, format and budgets from a profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def infer(facts: DataFrame) -> DataFrame:
    """One row a dataset: (task, metric, complexity, feature_format, max_samples, time_budget).

    ``facts`` has problem_type, is_imbalanced, n_rows, n_features, n_text, missing_ratio.
    """
    task = F.when(F.lower("problem_type").contains("regression"), "regression").otherwise("classification")
    metric = F.when(task == "regression", "rmse").when((F.col("problem_type") == "binary") & ~F.col("is_imbalanced"), "accuracy").when(F.col("problem_type") == "binary", "f1").otherwise("f1_macro")
    n = F.col("n_features")
    complexity = F.when(n > 50, 0.4).when(n > 20, 0.2).otherwise(0.0) + F.when(F.col("n_text") > 0, 0.2).otherwise(0.0) + F.when(F.col("missing_ratio") > 0.3, 0.2).otherwise(0.0)
    form = F.when(n <= 5, "basic").when(complexity > 0.5, "hierarchical").otherwise("tags")
    samples = F.when(n <= 10, 10).when(n > 30, 25).otherwise(15)
    budget = F.when(F.col("n_rows") < 1000, 60).when(F.col("n_rows") > 50_000, 300).otherwise(120)
    return facts.select("*", task.alias("task"), metric.alias("metric"), complexity.alias("complexity"), form.alias("feature_format"), samples.alias("max_samples"), budget.alias("time_budget"))
