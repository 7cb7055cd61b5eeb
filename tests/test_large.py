"""Steps that gave way on tables of millions of rows: products of counts, and rows that met in a task a feature."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabularium.functions import ordered
from tabularium.models import counted, registry
from tabularium.operators import association, neighbours
from tabularium.plans import selection


def _halves(spark):
    """So many rows that the product of three counts is beyond a long: ``same`` tells the target, ``other`` nothing of it."""
    return spark.range(4_400_000).select((F.col("id") % 2).alias("same"), (F.floor(F.col("id") / 2) % 2).alias("other"), (F.col("id") % 2).alias("_t"))


def test_chi_square_of_large_counts(spark):
    got = {r.feature: r for r in association.chi_square(_halves(spark), ["same", "other"], "_t").collect()}
    assert (got["same"].chi2, got["same"].dof, got["same"].cramers_v) == (pytest.approx(4_400_000), 1, pytest.approx(1))
    assert (got["other"].chi2, got["other"].dof, got["other"].cramers_v) == (pytest.approx(0, abs=1e-6), 1, pytest.approx(0, abs=1e-6))


def test_phi_k_of_large_counts(spark):
    got = {r.feature: r.phik for r in association.phi_k(_halves(spark), ["same", "other"], "_t").collect()}
    assert got["same"] > 0.99 and got["other"] == 0


def test_phi_k_counts_the_rows_once(spark):
    """All that it needs comes from one count of the rows by their values; it used to pass over them seven times."""
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.range(1000).select((F.col("id") % 2).alias("same"), (F.col("id") % 5).alias("other"), (F.col("id") % 2).alias("_t")).mapInArrow(seen, "same long, other long, _t long")
    got = {r.feature: r.phik for r in association.phi_k(df, ["same", "other"], "_t").collect()}
    assert read.value == 1000
    assert got["same"] > 0.99 and got["other"] == 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def large(spark):
    """Small tables are planned like large ones."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k in settings:
        spark.conf.unset(k)


def test_neighbours_dont_meet_by_feature(spark, large):
    """The ranges of a feature are broadcast: joined by a shuffle they kept all of its rows in one task."""
    rows = spark.range(2000).select(F.concat(F.lit("x"), F.col("id") % 2).alias("feature"), (F.col("id") % 50).cast("double").alias("value"), (F.col("id") % 3).cast("string").alias("level"))
    out = neighbours.neighbour_information(rows)
    assert not re.search(r"(SortMergeJoin|ShuffledHashJoin) \[feature#\d+L?\]", _plan(out))
    assert len(out.collect()) == 2


@pytest.mark.parametrize("few", [True, False])
def test_running_sums_dont_meet_by_group(spark, large, few):
    """Rows get their ranges where they are, or are dealt by range; they used to stay in the task of the join with their group's bounds."""
    df = spark.range(4000).select(F.concat(F.lit("x"), F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    placed = ordered.ranges(df, "v", 8, ("g",), few).withColumn("task", F.spark_partition_id()).select("task", "_range").collect()  # without _range there is no join
    assert len({r.task for r in placed}) > 2
    got = ordered.running_sum(df, "v", F.lit(1), "upto", ("g",), 8, few).toPandas().sort_values(["g", "v"])
    assert (got.groupby("g").cumcount() + 1 == got.upto).all()


def test_range_of_bisects(spark):
    bounds = [1.0, 2.0, 2.0, 5.0, 7.0]
    df = spark.createDataFrame([(v, b) for v in (0.5, 1.0, 2.0, 4.9, 5.0, 9.0, float("nan"), None) for b in (bounds, bounds[:1], [], None)], "v double, _bounds array<double>")
    got = df.select("v", "_bounds", ordered.range_of(F.col("v"), 6).alias("r"), F.coalesce(F.size(F.filter("_bounds", lambda b: b <= F.col("v"))), F.lit(0)).alias("w")).collect()
    assert all(r.r == max(r.w, 0) for r in got)


@pytest.fixture
def selectable(spark):
    """The target goes by ``n`` and a little by ``x``; ``noise`` tells nothing."""
    h = lambda seed, k: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(k))
    df = spark.range(60_000).select(h(1, 9).cast("double").alias("n"), h(2, 40).cast("double").alias("x"), (h(3, 3) / 10).alias("noise"), h(4, 100).alias("u"))
    return df.select("n", "x", "noise", (F.col("u") < 5 + 9 * F.col("n") + F.col("x") / 4).cast("int").alias("target"))


def test_selection_takes_cells(spark, selectable, monkeypatch):
    """A long table's forest is fitted on its cells, not on its rows, and ranks the features as that of the rows does."""
    monkeypatch.setattr(selection, "FOREST", {"numTrees": 24, "maxDepth": 5})
    rows, fit = [], registry.fit
    monkeypatch.setattr(registry, "fit", lambda name, task, classes, data, params=None: rows.append(data.count()) or fit(name, task, classes, data, params))
    plain = selection.select_features(selectable, "target")
    assert rows == [60_000]
    monkeypatch.setattr(counted, "FEW_ROWS", 10_000, raising=False)
    got = [selection.select_features(selectable, "target") for _ in range(2)]
    assert len(rows) == 49 and max(rows[1:]) <= 9 * 32 * 3 * 2
    assert got[0].selected == plain.selected == ["n", "x"] and got[0].dropped == plain.dropped == ["noise"]
    assert got[0].scores == pytest.approx(plain.scores, abs=0.1)
    assert got[0].scores == pytest.approx(got[1].scores, abs=1e-9)  # reruns agree


def test_selection_takes_rows_without_much_in_common(spark, monkeypatch):
    df = spark.range(3000).select(F.rand(1).alias("a"), F.rand(2).alias("b"), F.rand(3).alias("c"), F.rand(4).alias("y"))
    monkeypatch.setattr(counted, "FEW_ROWS", 100)
    assert counted.cells_of(df, ["a", "b", "c"], "y") is None
    cells, bins = counted.cells_of(df.withColumn("y", F.lit(1.0)), ["a"], "y")
    assert cells.agg(F.sum("rows")).first()[0] == 3000 and cells.count() == 32 and bins == ["b0"]


def test_cells_are_drawn_like_rows():
    batch = pa.RecordBatch.from_pydict({"rows": [1, 50, 10**12], "hash": pa.array([-5, 7, 9], pa.int64())})
    drawn = next(counted.draws([batch], 4000, 42)).column("drawn").to_pylist()
    for n, d in zip((1, 50, 10**12), drawn):
        assert abs(np.mean(d) - n) < 5 * (n / 4000) ** 0.5 and abs(np.var(d) / n - 1) < 0.15
    assert next(counted.draws([batch.slice(1, 1)], 4000, 42)).column("drawn").to_pylist() == drawn[1:2]


def test_cuts():
    assert counted.cuts([]) == counted.cuts([3.0, 3.0]) == []
    assert counted.cuts([1.0, 1.0, 2.0, 4.0]) == [1.5, 3.0]
    above = np.nextafter(1.0, 2)
    assert counted.cuts([1.0, above]) == [above]
    many = counted.cuts([float(k) for k in range(6400)])
    assert len(many) == 31 and many[0] == 199.5
    heavy = counted.cuts([0.0] * 5000 + [float(k) for k in range(5000)])
    assert heavy[0] == 0.5 and len(heavy) <= 31
