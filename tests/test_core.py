"""The library's operators on small tables; queries against their SQL run in test_queries."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tabularium import queries
from tabularium.functions import ordered
from tabularium.functions import language
from tabularium.functions import primitives as P
from tabularium.models import metrics, registry
from tabularium.operators import association, profile, rows
from tabularium.plans import runs, search, selection, synthesis
from tabularium.sources import readers, writers
from tabularium.streaming import monitor


@pytest.fixture(scope="module")
def people(spark):
    data = [(i, float(i % 7) if i % 5 else None, "abc"[i % 3], i % 2 == 0, i % 2, float("nan") if i == 3 else i * 1.5) for i in range(60)]
    return spark.createDataFrame(data, "row_id long, num double, cat string, flag boolean, target int, wide double")


def test_roles_and_flags(people):
    got = {r.feature: r for r in profile.column_profile(people, ["target"]).collect()}
    assert got["num"].role == "numeric" and got["cat"].role == "categorical" and got["flag"].role == "boolean"
    assert got["num"].n_missing == 12 and got["wide"].n_missing == 1  # NaN is missing
    assert "ID_LIKE" in got["wide"].flags and "ID_LIKE" in got["row_id"].flags
    strict = {r.feature: r.flags for r in profile.column_profile(people.withColumn("width", F.col("num")), ["target"], profile.ProfileConfig(strict_ids=True)).collect()}
    assert "ID_LIKE" not in strict["width"]


def test_profile_of_empty_and_null_tables(spark):
    empty = spark.createDataFrame([], "a double, b string, y int")
    assert profile.dataset_profile(empty).first().n_rows == 0
    assert [r.n_unique for r in profile.column_profile(empty).collect()] == [0, 0, 0]
    nulls = spark.createDataFrame([(None, None, 1)] * 3, "a double, b string, y int")
    got = {r.feature: r for r in profile.column_profile(nulls, ["y"]).collect()}
    assert got["b"].role == "categorical" and "CONSTANT" in got["b"].flags
    s = profile.numeric_stats(nulls, ["a"]).first()
    assert s["count"] == 0 and s["mean"] is None


def test_missing_column_is_an_error(people):
    with pytest.raises(ValueError):
        runs.profile_dataset(people, ["absent"])
    with pytest.raises(ValueError):
        runs.profile_dataset(people, [])


def test_target_boundaries(spark):
    one = spark.createDataFrame([(0,)] * 10 + [(1,)] * 2, "y int")
    r = profile.target_profile(one, "y").first()
    assert r.problem_type == "binary" and r.imbalance_ratio == 5.0 and not r.is_imbalanced and r.positive_class == "0"
    assert profile.target_profile(spark.range(100).select((F.col("id") / 3).alias("y")), "y").first().problem_type == "regression"


def test_kendall_against_pairs(spark):
    xs = [(float(i % 5), (i * 7) % 3) for i in range(40)]
    df = spark.createDataFrame(xs, "x double, _y int").withColumn("_y", F.col("_y").cast("double"))
    c = sum((a[0] > b[0]) - (a[0] < b[0]) if a[1] > b[1] else (b[0] > a[0]) - (b[0] < a[0]) if a[1] < b[1] else 0 for i, a in enumerate(xs) for b in xs[:i])
    n0 = 40 * 39 / 2
    tie = lambda k: sum(v * (v - 1) / 2 for v in [sum(x[k] == u for x in xs) for u in {x[k] for x in xs}])
    assert association.kendall_scores(df, ["x"]).first().kendall == pytest.approx(c / math.sqrt((n0 - tie(0)) * (n0 - tie(1))))


def test_dominated_rows(spark):
    df = spark.createDataFrame([("a", None, " "), ("a", "b", None), ("a", "b", None), (None, "c", "d"), (None, None, None), (None, "b", "")], "x string, y string, z string")
    assert sorted(map(str, rows.drop_dominated(df, ["x", "y", "z"]).collect())) == sorted(map(str, spark.createDataFrame([("a", "b", None), (None, "c", "d")], "x string, y string, z string").collect()))


def test_union_needs_a_common_column(spark):
    with pytest.raises(ValueError):
        rows.union_tables([spark.range(1).toDF("a"), spark.range(1).toDF("b")])


def test_encoding_unseen_and_null(spark):
    train = spark.createDataFrame([("b", 1.0), ("a", float("inf")), (None, 2.0)], "c string, v double")
    test = spark.createDataFrame([("z", 1.0), ("a", 2.0)], "c string, v double")
    tr, te = rows.fit_encode(train, test, ["c"])
    assert sorted(r.c for r in tr.collect()) == [-1, 0, 1] and sorted(r.c for r in te.collect()) == [-1, 0]
    assert tr.where("v is null").count() == 1


def test_splits(people):
    s = rows.split(people, "row_id", "target").groupBy("target", "split").count().collect()
    assert {(r.target, r.split): r["count"] for r in s} == {(0, "test"): 6, (0, "train"): 24, (1, "test"): 6, (1, "train"): 24}
    assert rows.can_stratify(people, "target") and not rows.can_stratify(people.limit(1), "target")
    assert [r["count"] for r in rows.folds(people, "row_id", 3).groupBy("fold").count().collect()] == [20, 20, 20]
    assert rows.sample_exact(people, "row_id", 7).count() == 7


def test_running_best(spark):
    log = spark.createDataFrame([(1, None), (2, 0.5), (3, 0.4), (4, None), (5, 0.9)], "sample_order int, score double")
    got = [(r.best_so_far, round(r.delta, 6), r.is_best) for r in rows.running_best(log).orderBy("sample_order").collect()]
    assert got == [(None, 0.0, False), (0.5, 0.5, True), (0.5, -0.1, False), (0.5, 0.0, False), (0.9, 0.4, True)]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_running_values_in_ranges(spark, parts):
    data = [(g, (i * 37) % 101, i % 5 if i % 7 else None) for g in "ab" for i in range(101)]
    df = spark.createDataFrame(data, "g string, k int, v int")
    got = {(r.g, r.k): r.s for r in ordered.running_sum(df, "k", F.coalesce("v", F.lit(0)), "s", ("g",), parts).collect()}
    want, total = {}, {}
    for g, k, v in sorted(data, key=lambda r: (r[0], r[1])):
        total[g] = total.get(g, 0) + (v or 0)
        want[g, k] = total[g]
    assert got == want
    assert ordered.running_sum(df.where("g = 'c'"), "k", F.lit(1), "s", ("g",), parts).count() == 0
    text = df.where("g = 'a'").select(F.concat(F.lit("é"), F.col("k").cast("string")).alias("t"))
    numbered = [r.t for r in ordered.running_sum(text, "t", F.lit(1), "s", (), parts).orderBy("s").collect()]
    assert numbered == sorted(numbered) and len(numbered) == 101


def test_language_is_closed(people):
    for bad in ("x = __import__('os')", "x = open('f')", "x = nothing", "import os", "x = num.real", "x = [1]", "target = num", "drop target"):
        with pytest.raises(language.ProgramError):
            language.apply(people, bad, ("target",))
    out = language.apply(people, "x = num / (num - num)\ndrop cat", ("target",))
    assert out.where("x is not null").count() == 0 and "cat" not in out.columns
    assert language.operations("x = num + 1\nnum = 2\ndrop cat", people.columns) == {"created": ["x"], "transformed": ["num"], "dropped": ["cat"], "sources": ["num"]}
    assert language.signature("x = 1+num") == language.signature("x  =  1 + num")


def test_metrics(spark):
    with pytest.raises(ValueError):
        metrics.check("nothing")
    assert metrics.better("rmse", 1.0, 2.0) and metrics.better("f1", 0.9, 0.8) and not metrics.better("mae", None, 1.0)
    assert metrics.weighted({"f1": 0.5, "accuracy": 1.0}, {"f1": 0.5, "accuracy": 0.51}) == pytest.approx(0.76)
    with pytest.raises(ValueError):
        metrics.weighted({"f1": 1.0}, {"f1": 1.02})
    zero = spark.createDataFrame([(0.0, 1.0)], "label double, prediction double")
    assert metrics.regression(zero).first().mape == float("inf")
    assert metrics.auc(spark.createDataFrame([(1, 0.5)], "label int, probability double")).first().auc == 0.5
    assert metrics.main_metric({"f1": 0.4, "auc": 0.4, "accuracy": 0.2}) == "f1"


def test_selection_ties_and_priority(spark):
    pairs = spark.createDataFrame([("a", "b", 0.99), ("b", "c", 0.2)], "a string, b string, correlation double")
    same = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.1)], "feature string, pearson double")
    assert [r[0] for r in selection.redundant(pairs, same, 0.95).collect()] == ["a"]
    assert [r[0] for r in selection.priority_redundant(pairs, ["a"], 0.95).collect()] == ["b"]
    assert selection.SelectionResult(["x"], n_original=4).reduction_pct == 75


def test_synthesis(people):
    out = synthesis.synthesize(people, "target", "row_id", synthesis.SynthesisConfig(max_depth=3, groups=("cat",), select=None))
    names = [d.name for d in out.definitions]
    assert "cat_groups.MEAN(main.num)" in names and "PERCENTILE(num)" in names and out.table.count() == 60
    assert P.by_category("datetime") and "entropy" in P.list_all()


def test_search_logs_failures(people):
    result = search.evolve(people.drop("flag", "wide"), "target", "row_id", search.StubLLM(["x = num * 2", "y = nonsense(", "z = frequency(cat)"]), samples=3, k=2)
    assert [s.score is None for s in result.samples] == [False, True, False] and result.best_score is not None
    tries = []

    class Failing:
        def complete(self, prompt):
            tries.append(1)
            raise ConnectionError

    waits = []
    with pytest.raises(RuntimeError):
        search.RetryingLLM(Failing(), wait=waits.append).complete("x")
    assert len(tries) == 3 and waits == [2.0, 4.0]


def test_engineering_without_search(people):
    table, report = runs.engineer(people.drop("flag"), "target", "row_id", None)
    assert "selected" in report and table.count() == 60


def test_pipeline_and_cli(people, tmp_path):
    r = runs.run_pipeline("p", people.drop("flag"), "target", "row_id", root=str(tmp_path), models=["decisiontree"])
    assert r.automl.best == "decisiontree" and r.params["task"] == "classification"
    text = runs.summary_text(r.report)
    assert "60 rows" in text
    assert json.dumps(runs.make_json_safe(r.report))
    assert runs.prune({"a": None, "b": [], "c": 0, "d": None}, keep=("d",)) == {"c": 0, "d": None}


def test_csv_sources(spark, tmp_path):
    for name, text in (("my_Train.csv", "a; b\n1;2\n"), ("test.csv", "a,b\n3,4\n")):
        (tmp_path / name).write_text(text)
    train, test = readers.read_train_test(spark, str(tmp_path))
    assert train.columns == ["a", "b"] and test.first().a == 3
    with pytest.raises(FileNotFoundError):
        readers.read_train_test(spark, str(tmp_path / "none"))
    (tmp_path / "train2.csv").write_text("a\n1\n")
    with pytest.raises(ValueError):
        readers.read_train_test(spark, str(tmp_path))
    path = writers.write_csv(spark.createDataFrame([([1, 2], None)], "l array<int>, n string"), str(tmp_path / "o"), single=True)
    assert spark.read.option("header", True).csv(path).first().l == "1,2"


def test_log_stream(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    for i, s in enumerate([0.1, None, 0.7]):
        (folder / f"sample_{i}.json").write_text(json.dumps({"sample_order": i, "function": "f", "score": s, "timestamp": None}))
    (folder / "sample_9.json").write_text('{"sample_order": 9, "fun')
    assert readers.read_samples(spark, str(folder)).count() == 3
    q = monitor.live_progress(spark, str(folder), "live")
    q.processAllAvailable()
    q.stop()
    assert spark.table("live").first().best == 0.7
    q = monitor.log_to_table(spark, str(folder), str(tmp_path / "t"), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    p, best = monitor.state_of(spark, str(tmp_path / "t"))
    assert p.first().valid == 2 and best.count() == 3


def test_models(spark):
    d = readers.example(spark, "moons", 80)
    with pytest.raises(ValueError):
        registry.get_model("nothing", "classification")
    r = registry.cross_validate(d, ["x0", "x1"], "target", "row_id", task="classification", models=["decisiontree"], k=2)
    assert r["decisiontree"].mean("accuracy") > 0.8 and registry.best_model(r, "accuracy") == "decisiontree"
    bad = runs.automl(d, "target", "row_id", models=["decisiontree", "nothing"], k=2)
    assert bad.best == "decisiontree" and "nothing" in bad.errors


def test_model_queries_take_all_orders(spark):
    """More orders than the 2000 that were once drawn."""
    lines = spark.range(5000).select((F.col("id") % 2500).alias("l_orderkey"), (F.col("id") % 50).cast("double").alias("l_quantity"), F.lit(0.1).alias("l_discount"), F.when(F.col("id") % 2 == 0, "R").otherwise("N").alias("l_returnflag"))
    assert queries._model_table(lambda t: lines).count() == 2500
