"""Models by name, on pyspark.ml."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rows import folds
from . import metrics as M
from .boosting import SoftmaxBoost
from .limits import OutOfTime, within

SEED = 42


def _gbt(task: str, classes: int, depth: int, rounds: int) -> Estimator:
    if task == "regression":
        return GBTRegressor(maxDepth=depth, maxIter=rounds, seed=SEED)
    return GBTClassifier(maxDepth=depth, maxIter=rounds, seed=SEED) if classes <= 2 else SoftmaxBoost(maxDepth=depth, maxIter=rounds)


_MAKE: dict[str, Callable[[str, int], Estimator]] = {
    "gbt": lambda task, k: _gbt(task, k, 5, 20),
    "gbt_shallow": lambda task, k: _gbt(task, k, 3, 30),
    "randomforest": lambda task, k: (RandomForestRegressor if task == "regression" else RandomForestClassifier)(numTrees=50, maxDepth=8, seed=SEED),
    "decisiontree": lambda task, k: (DecisionTreeRegressor if task == "regression" else DecisionTreeClassifier)(maxDepth=8, seed=SEED),
    "logistic": lambda task, k: LinearRegression(regParam=1.0) if task == "regression" else LogisticRegression(regParam=0.01),
}
#: Names that lead to one of the above.
ALIASES = {"xgboost": "gbt", "lightgbm": "gbt_shallow", "catboost": "gbt", "ridge": "logistic", "rf": "randomforest"}
GROUPS = {"fast": ["decisiontree", "logistic"], "default": ["gbt", "randomforest", "logistic"], "all_tree": ["gbt", "gbt_shallow", "randomforest", "decisiontree"]}
#: Grids that a search may walk.
SPACES = {"gbt": {"maxDepth": [3, 5, 7], "maxIter": [10, 20, 40]}, "randomforest": {"numTrees": [20, 50, 100], "maxDepth": [5, 8, 12]}, "decisiontree": {"maxDepth": [4, 8, 12]}, "logistic": {"regParam": [0.001, 0.01, 0.1, 1.0]}}


def register_model(name: str, make: Callable[[str, int], Estimator]) -> None:
    """Add a model: (task, number of classes) to an estimator."""
    _MAKE[name] = make


def is_available(name: str) -> bool:
    return ALIASES.get(name, name) in _MAKE


def get_model(name: str, task: str, classes: int = 2) -> Estimator:
    if not is_available(name):
        raise ValueError(f"no model {name}; there are {', '.join(sorted({*_MAKE, *ALIASES}))}")
    return _MAKE[ALIASES.get(name, name)](task, classes)


def all_models() -> list[str]:
    return sorted(_MAKE)


def assemble(df: DataFrame, features: list[str], target: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """features (vector), label and the columns to keep; nulls must be gone."""
    return VectorAssembler(inputCols=features, outputCol="features").transform(df.select(*features, F.col(target).cast("double").alias("label"), *keep)).select("features", "label", *keep)


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance), most important first; coefficients' magnitudes where a model has no importances."""
    if isinstance(model, PipelineModel):  # an ensemble: importances of its members, each by what it is given
        from .stacking import members

        total = dict.fromkeys(features, 0.0)
        for share, m in members(model):
            own = importances(m, features)
            size = sum(v for _, v in own) or 1.0
            for f, v in own:
                total[f] += share * v / size
        return sorted(total.items(), key=lambda x: (-x[1], x[0]))
    if hasattr(model, "featureImportances"):
        v = model.featureImportances.toArray().tolist()
    elif hasattr(model, "coefficientMatrix"):
        v = abs(model.coefficientMatrix.toArray()).mean(axis=0).tolist()
    elif hasattr(model, "coefficients"):
        v = abs(model.coefficients.toArray()).tolist()
    elif hasattr(model, "models"):
        each = [m.featureImportances.toArray() for m in model.models]
        v = (sum(each) / len(each)).tolist()
    else:
        v = [0.0] * len(features)
    return sorted(zip(features, v), key=lambda x: (-x[1], x[0]))


def save(model, path: str) -> None:
    (model if isinstance(model, PipelineModel) else PipelineModel(stages=[model])).write().overwrite().save(path)


def load(path: str):
    return PipelineModel.load(path)


@dataclass
class CVResult:
    """Scores by metric of each fold."""

    model: str
    folds: list[dict[str, float]] = field(default_factory=list)

    def mean(self, metric: str) -> float:
        return sum(f[metric] for f in self.folds) / len(self.folds)

    def std(self, metric: str) -> float:
        m = self.mean(metric)
        return (sum((f[metric] - m) ** 2 for f in self.folds) / len(self.folds)) ** 0.5


def predict(model, df: DataFrame) -> DataFrame:
    """label, prediction, probability of class 1, and the probabilities of all classes where the model gives any."""
    out = model.transform(df)
    kept = [c for c in df.columns if c not in ("features", "label")]
    label = ["label"] if "label" in df.columns else []
    if "probability" in out.columns:
        each = vector_to_array("probability")
    elif "rawPrediction" in out.columns:  # one model a class: margins, brought to between 0 and 1
        each = F.transform(vector_to_array("rawPrediction"), lambda x: 1 / (1 + F.exp(-x)))
    else:
        return out.select(*kept, *label, "prediction", F.col("prediction").alias("probability"))
    return out.select(*kept, *label, "prediction", F.get(each, F.lit(1)).alias("probability"), each.alias("probabilities"))


def classes_of(data: DataFrame) -> int:
    return int(data.agg(F.max("label")).first()[0] or 0) + 1


def evaluate(predictions: DataFrame, task: str, classes: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """All metrics from one set of predictions."""
    if task == "regression":
        return M.regression(predictions, by=by)
    out = M.classification(predictions, by=by)
    if classes <= 2:
        parts = [M.auc(predictions, by=by), M.logloss(predictions, by=by)]
    elif "probabilities" in predictions.columns:
        parts = [M.multiclass_auc(predictions, by=by), M.multiclass_logloss(predictions, by=by)]
    else:
        parts = []
    return reduce(lambda a, b: a.join(b, list(by)) if by else a.crossJoin(b), parts, out)  # one row each without ``by``


def cross_validate(
    df: DataFrame, features: list[str], target: str, key: str, *, task: str, models: list[str], k: int = 5, seed: int = SEED, stratify: bool | None = None, params: dict | None = None,
    seconds: float | None = None, errors: dict[str, str] | None = None, fitted: dict[str, list] | None = None,
) -> dict[str, CVResult]:
    """Every model (with ``params``, if given) on every fold; all metrics come from one set of predictions a model.

    A model that takes longer than ``seconds`` is cut off: it is named in ``errors``, or raises where there is no such
    dict. ``fitted`` gets the models of all folds by name.
    """
    stratify = task != "regression" if stratify is None else stratify
    data = folded(df, features, target, key, k, target if stratify else None, seed).persist()
    classes = 0 if task == "regression" else classes_of(data)
    out = {}

    def one(name: str) -> tuple[CVResult, list]:
        own = [fit(name, task, classes, data.where(F.col("fold") != i), params) for i in range(k)]
        made = [predict(m, data.where(F.col("fold") == i)) for i, m in enumerate(own)]
        predictions = reduce(DataFrame.unionByName, made).persist()  # every metric reads them; lost blocks are computed again
        try:
            scores = evaluate(predictions, task, classes, ("fold",)).orderBy("fold").collect()  # a row a fold
        finally:
            predictions.unpersist()
        return CVResult(name, [{m: v for m, v in r.asDict().items() if m != "fold"} for r in scores]), own

    try:
        for name in models:
            try:
                out[name], own = within(seconds, lambda: one(name), df.sparkSession)
            except OutOfTime as e:
                if errors is None:
                    raise
                errors[name] = f"{type(e).__name__}: {e}"
                continue
            if fitted is not None:
                fitted[name] = own
    finally:
        data.unpersist()
    return out


def folded(df: DataFrame, features: list[str], target: str, key: str, k: int, stratify: str | None, seed: int = SEED) -> DataFrame:
    """(features, label, fold): the rows that cross-validation takes, in their folds."""
    return assemble(folds(df, key, k, stratify, seed), features, target, ("fold",))


def fit(name: str, task: str, classes: int, data: DataFrame, params: dict | None = None):
    """A fitted model; ``params`` replace the defaults of those that it has (of each class's model where there is one a class)."""
    estimator = get_model(name, task, classes)
    inner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    if params:
        inner = inner.copy({inner.getParam(p): v for p, v in params.items()})
    return (estimator.copy({estimator.classifier: inner}) if isinstance(estimator, OneVsRest) else inner).fit(data)


def best_model(results: dict[str, CVResult], metric: str) -> str:
    """The model whose mean is best in the metric's own direction; the first of equals."""
    best = None
    for name, r in results.items():
        if best is None or M.better(metric, r.mean(metric), results[best].mean(metric)):
            best = name
    return best


def score_table(spark, results: dict[str, CVResult]) -> DataFrame:
    """(model, metric, mean, std, min, max, rank): a leaderboard for each metric."""
    rows = [(n, m, r.mean(m), r.std(m), min(f[m] for f in r.folds), max(f[m] for f in r.folds), float(M.SIGN[m])) for n, r in results.items() for m in r.folds[0]]
    from pyspark.sql import Window

    df = spark.createDataFrame(rows, "model string, metric string, mean double, std double, min double, max double, sign double")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("metric").orderBy(F.desc(F.col("mean") * F.col("sign")), "model"))).drop("sign")
