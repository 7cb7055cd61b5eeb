"""Stacked ensembles: a model over the out-of-fold predictions of others.

The table of out-of-fold predictions has each row once, predicted by base models that were fitted without its fold. The
meta-learner is fitted on it, and scored by folds as well: a row is never scored by a meta-learner or a base model that
saw it. The ensemble itself is a plain pipeline of base models fitted on all rows, a vector of what they predict, and the
meta-learner, so it is saved and loaded like any model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import checkpointed
from . import registry

REGULARISATION = 1e-3


def _base(model, i: int, task: str, classes: int):
    """Stages by which a fitted model leaves its predictions in the vector column ``s<i>``."""
    named = model.copy()
    named.setPredictionCol(f"p{i}")
    if task == "regression":
        return [named, VectorAssembler(inputCols=[f"p{i}"], outputCol=f"s{i}")]
    if not named.hasParam("probabilityCol"):
        named.setRawPredictionCol(f"s{i}")
        return [named]
    named.setRawPredictionCol(f"r{i}").setProbabilityCol(f"q{i}")
    return [named, VectorSlicer(inputCol=f"q{i}", outputCol=f"s{i}", indices=list(range(1, max(2, classes))))]  # the first class is what is left


def _predicted(models: list, data: DataFrame, task: str, classes: int) -> DataFrame:
    """``data`` with the vector ``stacked`` of all models' predictions in place of its features."""
    kept = [c for c in data.columns if c != "features"]
    for i, m in enumerate(models):
        for stage in _base(m, i, task, classes):
            data = stage.transform(data)
    out = VectorAssembler(inputCols=[f"s{i}" for i in range(len(models))], outputCol="stacked").transform(data)
    return out.select(*kept, "stacked")


def out_of_fold(data: DataFrame, fitted: dict[str, list], task: str, classes: int) -> DataFrame:
    """Each row of ``data`` (features, label, fold, ...) with the predictions of the base models that were fitted without its
    fold: ``fitted`` has of each base the model of every fold. Written, as it is used several times."""
    k = len(next(iter(fitted.values())))
    parts = [_predicted([models[i] for models in fitted.values()], data.where(F.col("fold") == i), task, classes) for i in range(k)]
    return checkpointed(reduce(DataFrame.unionByName, parts))


def fit_meta(table: DataFrame, task: str, classes: int):
    """The meta-learner of a table of predictions. For two classes, weights aren't negative."""
    if task == "regression":
        return LinearRegression(featuresCol="stacked", regParam=REGULARISATION).fit(table)
    learner = LogisticRegression(featuresCol="stacked", regParam=REGULARISATION)
    if classes <= 2:
        width = len(table.first()["stacked"])
        learner = learner.setLowerBoundsOnCoefficients(DenseMatrix(1, width, [0.0] * width))
    return learner.fit(table)


def cross_validate(table: DataFrame, task: str, classes: int) -> registry.CVResult:
    """Scores of the meta-learner on each fold of a table of out-of-fold predictions, fitted on the others."""
    k = [r[0] for r in table.select("fold").distinct().orderBy("fold").collect()]
    made = [registry.predict(fit_meta(table.where(F.col("fold") != i), task, classes), table.where(F.col("fold") == i).select("stacked", "label", "fold")) for i in k]
    made = [m.drop("stacked") for m in made]
    scores = registry.evaluate(reduce(DataFrame.unionByName, made), task, classes, ("fold",)).orderBy("fold").collect()  # a row a fold
    return registry.CVResult("stacked", [{m: v for m, v in r.asDict().items() if m != "fold"} for r in scores])


def ensemble(bases: dict[str, object], meta, task: str, classes: int) -> PipelineModel:
    """One model of base models fitted on all rows and the meta-learner over them."""
    stages = [s for i, m in enumerate(bases.values()) for s in _base(m, i, task, classes)]
    return PipelineModel([*stages, VectorAssembler(inputCols=[f"s{i}" for i in range(len(bases))], outputCol="stacked"), meta])


def weights(bases: list[str], meta) -> dict[str, float]:
    """What the meta-learner gives each base: the size of its coefficients, as a share."""
    each = abs(meta.coefficientMatrix.toArray()).mean(axis=0) if hasattr(meta, "coefficientMatrix") else abs(meta.coefficients.toArray())
    own = each.reshape(len(bases), -1).sum(axis=1) if len(each) % len(bases) == 0 else each[: len(bases)]
    total = float(own.sum()) or 1.0
    return {b: float(w) / total for b, w in zip(bases, own.tolist())}


def members(model: PipelineModel) -> list[tuple[float, object]]:
    """The base models of an ensemble, each with its share of the meta-learner's weights."""
    bases = [s for s in model.stages[:-1] if hasattr(s, "getPredictionCol")]
    return list(zip(weights([str(i) for i in range(len(bases))], model.stages[-1]).values(), bases))
