"""Scores of a table's features: one call from raw columns to cross-validated metrics, quick looks, and parameter search."""

from __future__ import annotations

import itertools
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import association, rows
from ..operators.profile import is_numeric
from . import metrics, registry
from .limits import OutOfTime


@dataclass(frozen=True)
class Preset:
    """What an evaluation runs; times are in seconds."""

    models: tuple[str, ...] = ("xgboost", "lightgbm", "randomforest")
    metric: str = "auto"
    folds: int = 5
    seed: int = 42
    sample: int | None = None
    trials: int = 0
    seconds_a_model: float | None = None
    seconds: float | None = None


#: Presets by name.
PRESETS = {
    "screening": Preset(models=("decisiontree", "logistic"), folds=3, seconds_a_model=60),
    "default": Preset(seconds_a_model=300),
    "hpo": Preset(models=("xgboost", "lightgbm"), trials=50, seconds=3600),
    "llmfe": Preset(folds=4),
    "landmarking": Preset(models=("decisiontree", "logistic"), folds=2, sample=1000),
}


def preset(name: str = "default") -> Preset:
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {', '.join(PRESETS)}")
    return PRESETS[name]


def metric_of(metric: str, task: str) -> str:
    return metrics.check(metrics.default_metric(task) if metric == "auto" else metric)


def metric_for(df: DataFrame, target: str, task: str, metric: str | None = None) -> str:
    """The metric that is asked for, or the one that suits the target: f1 of two classes, macro f1 of more, the task's own else."""
    if metric not in (None, "auto"):
        return metrics.check(metric)
    if task != "classification":
        return metrics.default_metric(task)
    several = df.where(F.col(f"`{target}`").isNotNull()).select(f"`{target}`").distinct().limit(3).count() > 2
    return "f1_macro" if several else "f1"


def model_table(df: DataFrame, target: str, key: str) -> tuple[DataFrame, list[str]]:
    """The table as models take it, and its features: codes for strings, infinities and nulls filled by the median (0 without
    any value), columns of no more than one value dropped. Rows without a target go."""
    clean = df.select(*[rows.finite(F.col(f"`{f.name}`").cast("double")).alias(f.name) if f.dataType.typeName() in ("float", "double") and f.name not in (target, key) else F.col(f"`{f.name}`") for f in df.schema.fields])
    features = rows.usable_columns(clean.drop(target, key), 1.0)
    if not features:
        raise ValueError("no feature has more than one value")
    if not is_numeric(clean.schema[key].dataType):
        clean = clean.withColumn(key, F.xxhash64(key))
    made = association.prepare(clean, [*features, key], target).withColumnRenamed("_y", target)
    return made, features


def _scores(df: DataFrame, target: str, key: str, task: str, chosen: Preset, errors: dict[str, str] | None = None) -> dict[str, registry.CVResult]:
    """Of each model that ends within the preset's time; all of them overrun is an error."""
    errors = {} if errors is None else errors
    table, features = model_table(df, target, key)
    if chosen.sample:
        table = rows.sample_exact(table, key, chosen.sample, chosen.seed)
    found = registry.cross_validate(table, features, target, key, task=task, models=list(chosen.models), k=chosen.folds, seed=chosen.seed, seconds=chosen.seconds_a_model, errors=errors)
    if not found:
        raise OutOfTime("; ".join(f"{m}: {e}" for m, e in errors.items()))
    return found


def evaluate_features(df: DataFrame, target: str, key: str, *, task: str = "classification", metric: str = "auto", using: Preset | str = "llmfe") -> float:
    """The mean over models and folds; more is always better (errors and losses come negated)."""
    name = metric_of(metric, task)
    found = _scores(df, target, key, task, preset(using) if isinstance(using, str) else using)
    return metrics.SIGN[name] * sum(r.mean(name) for r in found.values()) / len(found)


def evaluate_features_detailed(df: DataFrame, target: str, key: str, *, task: str = "classification", metric: str = "auto", using: Preset | str = "llmfe") -> dict:
    """Of each model mean, deviation and folds of the metric as it is, the aggregates over models, the best model, and what became of models that overran."""
    name, errors = metric_of(metric, task), {}
    found = _scores(df, target, key, task, preset(using) if isinstance(using, str) else using, errors)
    by_model = {m: {"mean": r.mean(name), "std": r.std(name), "folds": [f[name] for f in r.folds]} for m, r in found.items()}
    means = sorted(v["mean"] for v in by_model.values())
    middle = len(means) // 2
    median = means[middle] if len(means) % 2 else (means[middle - 1] + means[middle]) / 2
    return {"metric": name, "higher_is_better": metrics.SIGN[name] > 0, "models": by_model, "mean": sum(means) / len(means), "min": means[0], "max": means[-1], "median": median, "best_model": registry.best_model(found, name), "errors": errors}


def evaluate_features_weighted(df: DataFrame, target: str, key: str, weights: dict[str, float], *, task: str = "classification", using: Preset | str = "llmfe") -> dict:
    """Several metrics at once, by weight: of each model and over all models, from one set of predictions a model."""
    found = _scores(df, target, key, task, preset(using) if isinstance(using, str) else using)
    by_model = {m: {n: r.mean(n) for n in weights} for m, r in found.items()}
    scores = {m: metrics.weighted(v, weights) for m, v in by_model.items()}
    return {"score": sum(scores.values()) / len(scores), "models": scores, "metrics": by_model, "main_metric": metrics.main_metric(weights), "best_model": max(sorted(scores), key=lambda m: scores[m])}


def evaluate_with(df: DataFrame, target: str, key: str, model: str = "xgboost", *, task: str = "classification", metric: str = "auto", folds: int = 5) -> float:
    """The signed mean of one model."""
    return evaluate_features(df, target, key, task=task, metric=metric, using=Preset(models=(model,), folds=folds))


def quick_evaluate(df: DataFrame, target: str, key: str, model: str = "decisiontree", *, task: str = "classification", metric: str = "auto", sample: int | None = None, seed: int = 42) -> float:
    """The metric, as it is, of the first of two folds, on a sample if one is asked for: a first look."""
    name = metric_of(metric, task)
    table, features = model_table(df, target, key)
    if sample:
        table = rows.sample_exact(table, key, sample, seed)
    halves = rows.folds(table, key, 2, target if task != "regression" else None, seed)
    data = registry.assemble(halves, features, target, ("fold",))
    classes = registry.classes_of(data) if task != "regression" else 0
    fitted = registry.get_model(model, task, classes).fit(data.where("fold <> 0"))
    return registry.evaluate(registry.predict(fitted, data.where("fold = 0").drop("fold")), task, classes).first()[name]


@dataclass
class Tuned:
    model: str
    params: dict
    score: float
    trials: list[tuple[dict, float]] = field(default_factory=list)


def tune(df: DataFrame, target: str, key: str, model: str, *, task: str = "classification", metric: str = "auto", trials: int | None = None, folds: int = 3, seconds: float | None = None, space: dict | None = None, using: Preset | str = "hpo") -> Tuned:
    """The best parameters of a model's grid by cross-validation, in the metric's own direction. A grid of more points than
    ``trials`` is walked at even steps. Trials and seconds are the preset's unless given; a trial that the time doesn't
    suffice for is cut off and the best so far counts, but the first one may take it all."""
    name, chosen = metric_of(metric, task), preset(using) if isinstance(using, str) else using
    trials, seconds = trials or chosen.trials or 1, seconds if seconds is not None else chosen.seconds
    space = space or registry.SPACES[registry.ALIASES.get(model, model)]
    points = [dict(zip(space, p)) for p in itertools.product(*space.values())]
    if len(points) > trials:
        points = [points[len(points) * i // trials] for i in range(trials)]
    table, features = model_table(df, target, key)
    table, began, out = table.persist(), time.time(), None
    try:
        for params in points:
            left = None if seconds is None else seconds - (time.time() - began)
            if out and left is not None and left <= 0:
                break
            try:
                found = registry.cross_validate(table, features, target, key, task=task, models=[model], k=folds, params=params, seconds=left)
            except OutOfTime:
                if out is None:
                    raise
                break
            score = found[model].mean(name)
            out = out or Tuned(model, params, score)
            out.trials.append((params, score))
            if metrics.better(name, score, out.score):
                out.params, out.score = params, score
    finally:
        table.unpersist()
    return out
