"""Aggregates and running values of groups of any size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.functions import grouped, language
from tabularium.functions import primitives as P


@pytest.fixture(scope="module")
def table(spark):
    """One key on two thirds of the rows, one without a key, small ones, nulls among the values."""
    rng = np.random.default_rng(4)
    n = 900
    key = np.where(rng.random(n) < 0.66, "hot", rng.choice(["a", "b", "c"], n)).astype(object)
    key[rng.random(n) < 0.05] = None
    v = rng.integers(0, 40, n).astype(float)
    v[rng.random(n) < 0.1] = None
    df = pd.DataFrame({"id": np.arange(n), "k": key, "v": v, "w": rng.normal(size=n)})
    return spark.createDataFrame(df.astype(object).where(df.notna(), None), "id long, k string, v double, w double").repartition(3)


WANTED = [("n", "count", "v"), ("m", "median", "v"), ("u", "num_unique", "v"), ("o", "mode", "v"), ("s", "sum", "v"), ("mw", "median", "w")]


@pytest.mark.parametrize("most", [10**6, 100, 1])
def test_aggregates_of_crowded_groups(table, monkeypatch, most):
    plain = table.groupBy("k").agg(*[P.AGGREGATES[p].make(F.col(c)).alias(n) for n, p, c in WANTED])
    monkeypatch.setattr(grouped, "CROWDED", most)
    got = grouped.aggregates(table, "k", WANTED)
    assert got.columns == ["k", *[n for n, _, _ in WANTED]]
    rounded = lambda df: sorted(str([None if x is None else round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert rounded(got) == rounded(plain)
    assert grouped.aggregates(table.limit(0), "k", WANTED).collect() == []


@pytest.mark.parametrize("most", [10**6, 100, 1])
def test_running_values_of_crowded_groups(table, monkeypatch, most):
    wanted = [(p, p, "v") for p in ("cum_sum", "cum_mean", "cum_min", "cum_max", "diff")]
    plain = table.select("id", *[P.WINDOWS[p].make(F.col("v"), [F.col("id")], [F.col("k")]).alias(p) for p, *_ in wanted])
    monkeypatch.setattr(grouped, "CROWDED", most)
    got = grouped.running_by(table, "k", "id", wanted).select("id", *[p for p, *_ in wanted])
    rounded = lambda df: sorted(str([None if x is None else round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    assert rounded(got) == rounded(plain)


def test_medians_in_the_feature_language(table, monkeypatch):
    program = "m = group_median(k, v)\nu = group_nunique(k, v)"
    plain = sorted(map(str, language.apply(table, program).collect()))
    monkeypatch.setattr(grouped, "CROWDED", 50)
    assert sorted(map(str, language.apply(table, program).collect())) == plain
