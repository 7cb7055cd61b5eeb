"""Boosting of several classes in one model, against plain computation and one model a class."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest

from tabularium.models import boosting, registry


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4)).round(2)
    y = np.digitize(x[:, 0] + (x[:, 1] > 0) * 1.5 + 0.3 * rng.normal(size=900), [-0.3, 0.6, 1.6])
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(y=y)).repartition(3)
    return registry.assemble(df, list("abcd"), "y"), x, y


def losses(model, data):
    return registry.evaluate(registry.predict(model, data), "classification", 4).first()


def test_better_than_one_model_a_class(spark, table, tmp_path):
    data, *_ = table
    train, test = data.randomSplit([0.7, 0.3], seed=1)
    model = registry.fit("gbt", "classification", 4, train)
    assert isinstance(model, boosting.SoftmaxBoostModel) and model.numClasses == 4
    other = OneVsRest(classifier=GBTClassifier(maxDepth=5, maxIter=20, seed=42)).fit(train)
    mine, theirs = losses(model, test), losses(other, test)
    assert mine.logloss <= theirs.logloss and mine.accuracy >= theirs.accuracy - 0.03 and mine.accuracy > 0.75
    named = registry.importances(model, list("abcd"))
    assert {f for f, _ in named[:2]} == {"a", "b"} and sum(v for _, v in named) == pytest.approx(1.0)
    registry.save(model, str(tmp_path / "m"))
    again = losses(registry.load(str(tmp_path / "m")), test)
    assert again.logloss == pytest.approx(mine.logloss)


def test_trees_by_plain_computation(spark, table):
    """The first round's trees split where a search through all rows does; later scores add up."""
    data, x, y = table
    model = boosting.SoftmaxBoost(maxIter=1, maxDepth=1, maxBins=256).fit(data)
    import json

    told = json.loads(model.getOrDefault("trees"))
    p = np.exp(told["start"]) / np.exp(told["start"]).sum()
    for k, tree in enumerate(told["trees"][0]):
        g, h = p[k] - (y == k), np.full(len(y), p[k] * (1 - p[k]))
        worth = lambda m: g[m].sum() ** 2 / (h[m].sum() + boosting.LAMBDA)
        best = max((worth(x[:, j] <= e) + worth(x[:, j] > e), j, e) for j, edges in enumerate(told["edges"]) for e in edges if 5 <= (x[:, j] <= e).sum() <= len(y) - 5)
        j, e = tree["feature"][0], told["edges"][tree["feature"][0]][tree["bin"][0]]
        assert worth(x[:, j] <= e) + worth(x[:, j] > e) == pytest.approx(best[0])
        left = x[:, j] <= e
        assert tree["value"][1] == pytest.approx(-g[left].sum() / (h[left].sum() + boosting.LAMBDA)) and tree["value"][2] == pytest.approx(-g[~left].sum() / (h[~left].sum() + boosting.LAMBDA))
    got = registry.predict(model, data).collect()
    assert all(sum(r.probabilities) == pytest.approx(1.0) and r.prediction == int(np.argmax(r.probabilities)) for r in got)


def test_limits_of_growth_and_single_values(spark, table):
    data, *_ = table
    import json

    told = json.loads(boosting.SoftmaxBoost(maxIter=2, maxDepth=6, maxLeaves=4).fit(data).getOrDefault("trees"))
    assert all(sum(f < 0 for f in t["feature"]) <= 4 and max(t["depth"]) <= 6 for r in told["trees"] for t in r)
    flat = registry.assemble(spark.createDataFrame([(1.0, float(i % 3)) for i in range(30)], "a double, y double"), ["a"], "y")
    same = registry.predict(boosting.SoftmaxBoost(maxIter=2).fit(flat), flat).first()
    assert same.probabilities == pytest.approx([1 / 3] * 3, abs=0.02)
    params = registry.fit("gbt", "classification", 4, data, {"maxIter": 1, "maxDepth": 2})
    assert len(json.loads(params.getOrDefault("trees"))["trees"]) == 1
