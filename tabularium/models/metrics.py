"""Metrics of predictions as aggregates; each knows whether more is better."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordered import running_sum

#: 1 where more is better, -1 where less is.
SIGN = {"accuracy": 1, "f1": 1, "f1_macro": 1, "f1_micro": 1, "precision": 1, "recall": 1, "auc": 1, "r2": 1, "logloss": -1, "rmse": -1, "mse": -1, "mae": -1, "mape": -1}
CLASSIFICATION = ("accuracy", "f1", "precision", "recall", "f1_macro", "f1_micro", "auc", "logloss")
REGRESSION = ("rmse", "mse", "mae", "r2", "mape")
#: Those that need probabilities.
PROBABILITY = ("auc", "logloss")


def default_metric(task: str) -> str:
    return "rmse" if task == "regression" else "f1"


def check(name: str) -> str:
    if name not in SIGN:
        raise ValueError(f"no metric {name}; there are {', '.join(SIGN)}")
    return name


def list_metrics(task: str | None = None) -> list[str]:
    return [*CLASSIFICATION] if task == "classification" else [*REGRESSION] if task == "regression" else [*CLASSIFICATION, *REGRESSION]


def needs_probability(name: str) -> bool:
    return check(name) in PROBABILITY


def better(name: str, a: float | None, b: float | None) -> bool:
    """Whether a beats b."""
    return a is not None and (b is None or SIGN[check(name)] * a > SIGN[name] * b)


def confusion(df: DataFrame, y: str = "label", p: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(y).alias("actual"), F.col(p).alias("predicted")).agg(F.count("*").alias("n"))


def classification(df: DataFrame, y: str = "label", p: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """accuracy, weighted f1/precision/recall, f1_macro, f1_micro; a class never predicted, or never there, counts as 0."""
    cells = confusion(df, y, p, by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    actual = cells.groupBy(*by, F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    called = cells.groupBy(*by, F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    per = actual.join(called, [*by, "class"], "full").na.fill(0, ["support", "tp", "called"])
    prec = F.when(F.col("called") > 0, F.col("tp") / F.col("called")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    n, w = F.sum("support"), F.col("support")
    acc = F.sum("tp") / n
    return per.groupBy(*by).agg(acc.alias("accuracy"), (F.sum(f1 * w) / n).alias("f1"), (F.sum(prec * w) / n).alias("precision"), (F.sum(rec * w) / n).alias("recall"), F.avg(f1).alias("f1_macro"), acc.alias("f1_micro"))


def auc(df: DataFrame, y: str = "label", score: str = "probability", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, auc) of a 0/1 label by rank sums with average ranks: exact, from a row a distinct score; 0.5 with one class."""
    cells = df.groupBy(*by, score).agg(F.count_if(F.col(y) == 1).cast("double").alias("pos"), F.count_if(F.col(y) != 1).cast("double").alias("neg"))
    below = running_sum(cells, score, F.col("neg"), "_upto", by, few=True)
    won = below.withColumn("won", F.col("pos") * (F.col("_upto") - F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return won.groupBy(*by).agg(F.when(pairs > 0, F.sum("won") / pairs).otherwise(0.5).alias("auc"))


def logloss(df: DataFrame, y: str = "label", score: str = "probability", by: tuple[str, ...] = (), eps: float = 1e-15) -> DataFrame:
    p = F.when(F.col(y) == 1, F.col(score)).otherwise(1 - F.col(score))
    return df.groupBy(*by).agg(F.avg(-F.ln(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))).alias("logloss"))


def multiclass_auc(df: DataFrame, y: str = "label", scores: str = "probabilities", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, auc): each class against the rest by its own probability, weighted by how frequent it is. ``scores`` is an array by class."""
    rows = df.select(*by, F.col(y).cast("int").alias("_y"), F.posexplode(scores).alias("_class", "_score"))
    rows = rows.withColumn("_hit", (F.col("_y") == F.col("_class")).cast("int"))
    each = auc(rows, "_hit", "_score", (*by, "_class"))
    support = rows.groupBy(*by, "_class").agg(F.sum("_hit").alias("_n")).where("_n > 0")
    both = each.join(support, [*by, "_class"])
    return both.groupBy(*by).agg((F.sum(F.col("auc") * F.col("_n")) / F.sum("_n")).alias("auc"))


def multiclass_logloss(df: DataFrame, y: str = "label", scores: str = "probabilities", by: tuple[str, ...] = (), eps: float = 1e-15) -> DataFrame:
    """(by, logloss) from the probability that each row gives its own class, of all it gives; a class without one counts as ``eps``."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x)
    p = F.coalesce(F.try_divide(F.get(scores, F.col(y).cast("int")), total), F.lit(eps))
    return df.groupBy(*by).agg(F.avg(-F.ln(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))).alias("logloss"))


def regression(df: DataFrame, y: str = "label", p: str = "prediction", by: tuple[str, ...] = ()) -> DataFrame:
    """rmse, mse, mae, r2 (1 - residual / total), mape in percent over rows whose target isn't 0 (infinite if there are none)."""
    e = F.col(p) - F.col(y)
    mape = F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))) * 100
    return df.groupBy(*by).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"), F.coalesce(mape, F.lit(float("inf"))).alias("mape"))


def fold_summary(scores: DataFrame, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, mean, std, min, max, median) of scores, a row a fold or model; the deviation is that of the population."""
    return scores.groupBy(*by).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"), F.min(score).alias("min"), F.max(score).alias("max"), F.median(score).alias("median"))


def weighted(scores: dict[str, float], weights: dict[str, float]) -> float:
    """Sum of weighted metrics, each by its sign; weights must total 1 to within 0.01."""
    if abs(sum(weights.values()) - 1) > 0.01 + 1e-9:
        raise ValueError(f"weights total {sum(weights.values())}, not 1")
    return sum(w * SIGN[check(m)] * scores[m] for m, w in weights.items())


def main_metric(weights: dict[str, float]) -> str:
    """The metric of the largest weight, the first of equals."""
    return max(weights, key=lambda m: weights[m])
