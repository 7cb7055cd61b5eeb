"""Time limits, stacked ensembles, live bests and searches that go on."""

import hashlib
import json
import threading
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from tabularium.config import Layout
from tabularium.models import evaluation, limits, registry, stacking
from tabularium.operators import rows
from tabularium.plans import runs, search
from tabularium.sources import readers
from tabularium.streaming import monitor


@pytest.fixture(scope="module")
def curve(spark):
    """Two parts of a target: one straight, one a step, which one family each sees."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + 1.5 * ((x[:, 1] > -0.5) & (x[:, 1] < 0.5)) + 0.3 * rng.normal(size=600) > 0.5).astype(int)
    return spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, many=np.digitize(x[:, 0] + x[:, 1] ** 2, [0.2, 1.0, 2.0]), id=range(600)))


def running(spark):
    return spark.sparkContext.statusTracker().getActiveJobsIds()


def test_work_is_cut_off_and_other_work_goes_on(spark):
    other = []
    beside = threading.Thread(target=lambda: other.append(spark.range(3).select(F.udf(lambda i: time.sleep(2) or i, "long")("id").alias("i")).agg(F.sum("i")).first()[0]))
    beside.start()
    began = time.time()
    with pytest.raises(limits.OutOfTime):
        limits.within(1.5, lambda: spark.range(64, numPartitions=64).select(F.udf(lambda i: time.sleep(1) or i, "long")("id").alias("i")).agg(F.sum("i")).collect(), spark)
    assert time.time() - began < 20
    beside.join()
    assert other == [3]
    for _ in range(50):
        if not running(spark):
            break
        time.sleep(0.1)
    assert not running(spark) and not spark.sparkContext.getJobTags()
    assert limits.within(60, lambda: 5, spark) == 5 and limits.within(None, lambda: 6, spark) == 6
    with pytest.raises(ValueError, match="own"):
        limits.within(60, lambda: (_ for _ in ()).throw(ValueError("own")), spark)


class Slow(DecisionTreeClassifier):
    """A model whose fitting takes many seconds of Spark's time."""

    def fit(self, data):
        data.sparkSession.range(400, numPartitions=400).select(F.udf(lambda i: time.sleep(1) or i, "long")("id").alias("i")).agg(F.sum("i")).collect()
        return super().fit(data)


@pytest.fixture
def slow():
    registry.register_model("slow", lambda task, k: Slow())
    yield
    registry._MAKE.pop("slow")


def test_presets_limit_models(spark, curve, slow):
    chosen = evaluation.Preset(models=("slow",), folds=2, seconds_a_model=2)
    with pytest.raises(limits.OutOfTime):
        evaluation.evaluate_features(curve.drop("many"), "y", "id", using=chosen)
    errors = {}
    data = curve.drop("many")
    found = registry.cross_validate(data, ["a", "b", "c"], "y", "id", task="classification", models=["slow"], k=2, seconds=2, errors=errors)
    assert found == {} and "OutOfTime" in errors["slow"]


def test_automl_cuts_off_a_family(spark, curve, slow):
    r = runs.automl(curve.drop("many"), "y", "id", models=["decisiontree", "slow", "logistic"], k=2, time_budget=20)
    assert "OutOfTime" in r.errors["slow"] and [n for n, _ in r.leaderboard] == ["decisiontree"] and "not begun" in r.errors["logistic"]


def test_tuning_ends_with_its_time(spark, curve, slow):
    registry.SPACES["slow"] = {"maxDepth": [2, 3]}
    try:
        with pytest.raises(limits.OutOfTime):
            evaluation.tune(curve.drop("many"), "y", "id", "slow", seconds=3)
    finally:
        registry.SPACES.pop("slow")
    assert len(evaluation.tune(curve.drop("many"), "y", "id", "decisiontree", folds=2).trials) == 3  # the preset's trials


def test_stacked_ensemble(spark, curve, tmp_path):
    train, test = curve.drop("many").where("id < 500"), curve.drop("many").where("id >= 500")
    r = runs.automl(train, "y", "id", models=["decisiontree", "logistic"], metric="auc", k=3, test=test, output=str(tmp_path), stack=True, time_budget=600)
    scores = dict(r.leaderboard)
    assert r.best == "stacked" and scores["stacked"] >= max(scores["decisiontree"], scores["logistic"]) and r.errors == {}
    assert sum(r.stack.values()) == pytest.approx(1.0) and all(w > 0.05 for w in r.stack.values())
    assert r.test_scores["auc"] > 0.85 and {f for f, _ in r.importances[:2]} == {"a", "b"}
    again = runs.reload(spark, str(tmp_path))
    given = registry.assemble(test.withColumns({c: F.col(c).cast("double") for c in "abc"}), ["a", "b", "c"], "y", ("id",))
    assert registry.evaluate(registry.predict(again, given), "classification").first()["auc"] == pytest.approx(r.test_scores["auc"])


@pytest.mark.parametrize("task,target", [("classification", "many"), ("regression", "c")])
def test_out_of_fold_predictions_never_saw_their_fold(spark, curve, task, target):
    features = ["a", "b"]
    models = ["decisiontree", "logistic"]
    fitted = {}
    data = curve.select("a", "b", target, "id")
    registry.cross_validate(data, features, target, "id", task=task, models=models, k=3, fitted=fitted)
    given = registry.folded(data, features, target, "id", 3, target if task != "regression" else None)
    classes = 0 if task == "regression" else registry.classes_of(given)
    table = stacking.out_of_fold(given, fitted, task, classes)
    assert table.count() == 600
    width = 2 * max(1, classes - 1)
    assert {len(r.stacked) for r in table.collect()} == {width}
    if task == "regression":
        return
    # a target that only some rows of one fold know by heart: their own labels, shuffled, can't be predicted
    noise = data.withColumn(target, F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    fitted = {}
    registry.cross_validate(noise, features, target, "id", task="classification", models=models, k=3, fitted=fitted)
    given = registry.folded(noise, features, target, "id", 3, target)
    found = stacking.cross_validate(stacking.out_of_fold(given, fitted, "classification", 2), "classification", 2)
    assert 0.4 < found.mean("auc") < 0.6


def test_metric_for_the_classes(spark, curve):
    assert evaluation.metric_for(curve, "y", "classification") == "f1" and evaluation.metric_for(curve, "many", "classification") == "f1_macro"
    assert evaluation.metric_for(curve, "a", "regression") == "rmse" and evaluation.metric_for(curve, "many", "classification", "accuracy") == "accuracy"


# --- live bests and searches that go on -----------------------------------------------------------------------------


def told(folder, name, rows):
    for order, score in rows:
        (folder / f"sample_{name}_{order}.json").write_text(json.dumps({"sample_order": order, "function": "x", "score": score}))


def test_live_bests_equal_those_of_the_finished_log(spark, tmp_path):
    """Late samples, repeats, failures, several blocks, and a query that is started again each time."""
    rng = np.random.default_rng(9)
    scores = [None if rng.random() < 0.2 else round(float(rng.normal()), 1) for _ in range(60)]
    folder, table, checkpoint = tmp_path / "log", str(tmp_path / "t"), str(tmp_path / "c")
    folder.mkdir()
    orders = rng.permutation(60).tolist()
    for i, part in enumerate([orders[:25], orders[25:30], [], orders[20:45], orders[45:]]):
        told(folder, i, [(o, scores[o]) for o in part])
        q = monitor.live_best(readers.stream_samples(spark, str(folder)), table, checkpoint, block=16, availableNow=True)
        q.awaitTermination()
        seen = sorted({o for p in [orders[:25], orders[25:30], [], orders[20:45], orders[45:]][: i + 1] for o in p})
        log = spark.createDataFrame([(o, scores[o]) for o in seen], "sample_order long, score double")
        want = rows.running_best(log).select("sample_order", "score", "best_so_far", "delta", "is_best")
        got = monitor.bests(spark.read.parquet(table))
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), i
    written = spark.read.parquet(table)
    assert written.count() > 60 and written.where("revision > 1").count()  # late samples made some rows again


class Hashing:
    """Answers that depend on the prompt and the place in the round alone."""

    def __init__(self, breaks_at=None):
        self.asked, self.breaks_at = 0, breaks_at

    def complete(self, prompt):
        self.asked += 1
        if self.asked == self.breaks_at:
            raise KeyboardInterrupt
        h = int(hashlib.md5(f"{prompt}{self.asked % 2}".encode()).hexdigest(), 16)  # two answers a prompt, as many as a round asks for
        return [f"p{h % 7} = a * {h % 5}", f"q = square(b) + {h % 3}", "r = nonsense(", f"s = a / (b + {h % 4})", f"t{h % 3} = b * c"][h % 5]


def test_a_search_goes_on_where_it_was_broken_off(spark, curve, tmp_path):
    df = curve.drop("many").where("id < 150")
    how = dict(samples=8, n_islands=3, per_prompt=2, k=2, reset_every=4)
    whole = search.evolve(df, "y", "id", Hashing(), **how, path=str(tmp_path / "whole"))
    path = str(tmp_path / "broken")
    for stop in (3, 5, None):
        try:
            parts = search.evolve(df, "y", "id", Hashing(stop), **how, path=path)
        except KeyboardInterrupt:
            continue
    assert parts.samples == whole.samples and (parts.best, parts.best_score, parts.baseline) == (whole.best, whole.best_score, whole.baseline)
    assert len({s.function for s in whole.samples}) > 2 and len({s.score for s in whole.samples}) > 1
    short = search.evolve(df, "y", "id", Hashing(), **{**how, "samples": 3}, path=str(tmp_path / "short"))
    assert short.samples == whole.samples[:3]
    kept, again = search.Population(3), search.read_population(spark, path, 3)
    kept.take(again.rows)
    assert [(i.clusters, i.count) for i in kept.islands] == [(i.clusters, i.count) for i in again.islands] and kept.epochs == again.epochs and max(again.epochs) > 0


def test_slow_candidates_have_no_score(spark, curve, slow):
    found = search.evolve(curve.drop("many").where("id < 100"), "y", "id", search.StubLLM(["x = a * 2"]), samples=1, k=2, seconds_a_sample=0.01)
    assert found.samples[0].score is None and "OutOfTime" in found.samples[0].error


def test_metadata_and_log_of_a_run(spark, tmp_path):
    layout = Layout("p", str(tmp_path))
    layout.log(spark, "features", {"step": 1})
    layout.save_metadata(spark, "features", {"rows": 5})
    assert layout.metadata(spark, "features")["rows"] == 5 and layout.metadata(spark, "features")["project"] == "p"
    assert [json.loads(r.event) for r in layout.events(spark, "features").collect()] == [{"step": 1}, {"saved": layout.paths("features")["metadata"]}]
    assert Layout.of(layout.path("features")) == (layout, "features")


def test_a_report_is_made_small_by_section(spark):
    df = spark.createDataFrame([(i, f"n{i % 4}", float(i) / 3 if i % 5 else None, i % 2) for i in range(40)], "row_id int, kind string, x double, y int")
    report = runs.profile_dataset(df, ["y"]).to_dict()
    small = runs.compact(report)
    assert set(small) <= set(report) - {"target_notes", "hints"} and set(small["dataset"][0]) == {"n_rows", "n_columns", "missing_ratio"}
    columns = {c["feature"]: c for c in small["columns"]}
    assert columns["x"]["missing_rate"] == 0.2 and "missing_rate" not in columns["kind"] and "role" not in columns["x"] and columns["x"]["recommendations"]
    assert len(small["categorical"]) == 3 and set(small["numeric"][0]) >= {"mean", "std", "min", "max", "skew"} and "p50" not in small["numeric"][0]
    assert all(len(str(v).split(".")[-1]) <= 4 for v in small["numeric"][-1].values() if isinstance(v, float))
    rows_ = [{"feature": "a", "inferred_type": "categorical_low", "flags": [], "example_values": ["u", "u", "v", "w", "x"]}, {"feature": "b", "inferred_type": "numeric", "example_values": ["1"]}, {"feature": "c", "inferred_type": "text", "flags": ["ID_LIKE"], "example_values": ["z"], "recommendations": ["r"]}]
    plain = runs.compact({"columns": [dict(r) for r in rows_], "hints": [{"feature": "a"}]}, engineering=False)
    assert plain == {"columns": [{"feature": "a", "inferred_type": "categorical_low", "example_values": ["u", "v", "w"]}, {"feature": "b", "inferred_type": "numeric"}, {"feature": "c", "inferred_type": "text", "flags": ["ID_LIKE"]}]}


def test_features_that_are_left_out_are_named(spark, curve):
    from tabularium.plans import synthesis

    df = curve.drop("many")
    few = synthesis.synthesize(df, "y", "id", synthesis.SynthesisConfig(max_depth=1, max_features=2, select=None))
    every = synthesis.synthesize(df, "y", "id", synthesis.SynthesisConfig(max_depth=1, select=None))
    assert [d.name for d in few.definitions] + few.report["left_out"] == [d.name for d in every.definitions] and every.report["left_out"] == []


def test_duplicates_are_told_from_rows_with_nulls_elsewhere(spark):
    from tabularium.operators import profile

    df = spark.createDataFrame([(None, "a"), ("a", None), (None, None), (None, None), ("a", "a")], "x string, y string")
    r = profile.dataset_profile(df).first()
    assert (r.n_rows, r.duplicate_rows, r.missing_cells) == (5, 1, 6)
