"""Statistics against brute force, edge cases of the ordered plans, and the runs that hold them together."""

import itertools
import json
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabularium.functions import language, ordered
from tabularium.models import evaluation, metrics, registry
from tabularium.operators import association, neighbours, profile, rows
from tabularium.plans import describe, dialogue, history, runs, synthesis
from tabularium.plans.search import RetryingLLM
from tabularium.sources import readers, writers


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    n = 240
    x = rng.normal(size=n)
    d = pd.DataFrame({"id": range(n), "x": x, "z": rng.integers(0, 5, n), "city": rng.choice(["a", "b", "c"], n), "y": (x + 0.3 * rng.normal(size=n) > 0).astype(int), "k": (x > 0.5).astype(int) + (x > -0.5)})
    return spark.createDataFrame(d).repartition(4)


def test_quantiles_and_ranges_by_group(spark):
    """Groups of values far apart, of one value, and with ties."""
    rng = random.Random(0)
    data = {"big": [rng.choice([1e6, 2e6, rng.random() * 1e6]) for _ in range(150)], "small": [rng.random() for _ in range(151)], "one": [7.0], "same": [3.0] * 9}
    df = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = {r.g: r for r in ordered.quantiles(counts, "v", (0.0, 0.1, 0.5, 0.99, 1.0), ("g",)).collect()}
    for g, vs in data.items():
        assert [got[g][f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(vs, [0, 0.1, 0.5, 0.99, 1]).tolist())
    cut = ordered.ranges(df, "v", 8, ("g",)).groupBy("g").agg(F.countDistinct("_range").alias("k"))
    assert {r.g: r.k for r in cut.collect()}["small"] > 4  # not one range, although beside large values
    assert ordered.quantiles(counts.limit(0), "v", (0.5,), ("g",)).count() == 0


def test_running_over_a_table(spark, table):
    got = ordered.running(table.select("id", F.when(F.col("id") % 7 != 0, F.col("x")).alias("x")), "id", [(p, p, "x") for p in ordered.RUNNING], 6).toPandas().sort_values("id")
    v = got["x"]
    assert np.allclose(got["cum_sum"], v.cumsum().ffill(), equal_nan=True) and np.allclose(got["cum_mean"], v.expanding().mean(), equal_nan=True)
    assert np.allclose(got["cum_min"], v.cummin().ffill(), equal_nan=True) and np.allclose(got["cum_max"], v.cummax().ffill(), equal_nan=True) and np.allclose(got["diff"], v.diff(), equal_nan=True)


@pytest.mark.parametrize("levels", [2, 5, 90])
def test_kendall_and_spearman_by_pairs(spark, levels):
    rng = np.random.default_rng(levels)
    n = 90
    a, b, y = rng.integers(0, 12, n).astype(float), rng.normal(size=n), rng.integers(0, levels, n).astype(float) if levels < 90 else rng.permutation(n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "_y": y}))
    got = {r.feature: r.kendall for r in association.kendall_scores(df, ["a", "b"]).collect()}
    ranks = {r.feature: r.spearman for r in association.spearman_scores(df, ["a", "b"]).collect()}
    for name, v in (("a", a), ("b", b)):
        s = sum(np.sign(v[i] - v[j]) * np.sign(y[i] - y[j]) for i, j in itertools.combinations(range(n), 2))
        ties = lambda c: sum(k * (k - 1) / 2 for k in np.unique(c, return_counts=True)[1])
        n0 = n * (n - 1) / 2
        assert got[name] == pytest.approx(s / math.sqrt((n0 - ties(v)) * (n0 - ties(y))))
        assert ranks[name] == pytest.approx(pd.Series(v).rank().corr(pd.Series(y).rank()))


def test_matrix_over_pairs_that_are_there(spark):
    d = pd.DataFrame(np.random.default_rng(0).normal(size=(60, 5)) * 1000 + 1e6, columns=list("abcde"))
    d.loc[d.index % 4 == 0, "b"] = np.nan
    d["e"] = 3.0
    got = {(r.a, r.b): r.correlation for r in association.correlation_matrix(spark.createDataFrame(d).repartition(3), list("abcde")).collect()}
    want = d.corr()
    for p, q in itertools.combinations("abcde", 2):
        assert got[p, q] is None if "e" in (p, q) else got[p, q] == pytest.approx(want.loc[p, q])


def test_grid_information_by_enumeration():
    """All ways to cut the columns, for even rows, on small tables; independent and functional tables."""
    rng = np.random.default_rng(2)
    for _ in range(5):
        counts = rng.integers(0, 9, (5, 2)).astype(float) + 1
        n, most = counts.sum(), 8.0
        share = counts.sum(axis=0) / n
        entropy = -(share * np.log(share)).sum()
        best = 0.0
        for k in range(2, 5):
            for cut in itertools.combinations(range(1, 5), k - 1):
                cells = np.add.reduceat(counts, [0, *cut], axis=0) / n
                mi = entropy + (cells * np.log(cells / cells.sum(axis=1, keepdims=True))).sum()
                best = max(best, mi / np.log(2))
        assert max(association._best_columns(counts, most)) == pytest.approx(best)
    assert association.grid_information(np.eye(16) * 40) == pytest.approx(1.0)
    assert association.grid_information(np.full((8, 8), 50.0)) == pytest.approx(0.0, abs=1e-9)


def test_mic_and_phi_k(spark, table):
    made = table.select("x", (F.col("x") * F.col("x")).alias("square"), F.rand(5).alias("noise"))
    got = {r.feature: r.mic for r in association.mic(made, ["square", "noise"], "x").collect()}
    assert got["square"] > 0.7 > 0.4 > got["noise"]  # a parabola that Pearson doesn't see
    rng = np.random.default_rng(3)
    a = rng.normal(size=20_000)
    b = 0.6 * a + 0.8 * rng.normal(size=20_000)
    cut = lambda v: np.searchsorted([-1.5, -0.5, 0.5, 1.5], v)
    df = spark.createDataFrame(pd.DataFrame({"a": cut(a), "id": range(20_000), "y": cut(b)}))
    got = {r.feature: r.phik for r in association.phi_k(df, ["a", "id"], "y").collect()}
    assert got["a"] == pytest.approx(0.6, abs=0.03) and got["id"] < 0.05  # 20,000 levels that tell nothing


def test_associate_takes_discrete_columns_as_they_are(spark):
    """A string of many levels isn't put into bins of the alphabet; a failing method leaves its column null."""
    df = spark.createDataFrame([(f"level{i % 40:02d}", i * 1.0, (i % 40) % 2) for i in range(400)], "s string, f double, y int")
    got = {r.feature: r for r in runs.associate(df, ["s", "f"], "y", ("mutual_info", "pearson")).collect()}
    assert got["s"].mutual_info == pytest.approx(math.log(2))
    with pytest.raises(ValueError):
        runs.associate(df, ["s"], "y", ("cosine",))


def test_multiclass_metrics(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 3, 60), rng.random((60, 3)).round(1) + 0.05
    df = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, p)], "label int, probabilities array<double>")

    def one(c):
        pos, neg = p[y == c, c], p[y != c, c]
        return (np.sign(pos[:, None] - neg[None, :]) + 1).mean() / 2

    assert metrics.multiclass_auc(df).first()[0] == pytest.approx(sum(one(c) * (y == c).mean() for c in range(3)))
    assert metrics.multiclass_logloss(df).first()[0] == pytest.approx(-np.log(p[range(60), y] / p.sum(axis=1)).mean())


def test_evaluation_facade(spark, table):
    df = table.drop("k").withColumn("odd", F.when(F.col("id") % 9 == 0, float("inf")).otherwise(F.col("x"))).withColumn("gap", F.when(F.col("id") % 5 != 0, F.col("z"))).withColumn("const", F.lit(1))
    using = evaluation.Preset(models=("decisiontree", "logistic"), folds=2)
    assert evaluation.evaluate_features(df, "y", "id", metric="accuracy", using=using) > 0.7
    found = evaluation.evaluate_features_detailed(df, "y", "id", metric="logloss", using=using)
    assert not found["higher_is_better"] and found["min"] <= found["median"] <= found["max"] and found["models"][found["best_model"]]["mean"] == found["min"]
    both = evaluation.evaluate_features_weighted(df, "y", "id", {"auc": 0.6, "logloss": 0.4}, using=using)
    assert both["main_metric"] == "auc" and set(both["models"]) == {"decisiontree", "logistic"}
    assert evaluation.evaluate_features(df.withColumn("y", F.col("x") * 3), "y", "id", task="regression", using=using) < 0  # an error, negated
    assert 0 <= evaluation.quick_evaluate(df, "y", "id", sample=100, metric="auc") <= 1
    tuned = evaluation.tune(df, "y", "id", "decisiontree", metric="accuracy", trials=2, folds=2)
    assert len(tuned.trials) == 2 and tuned.score == max(s for _, s in tuned.trials)
    assert evaluation.preset("landmarking").sample == 1000
    with pytest.raises(ValueError):
        evaluation.preset("none")


def test_automl_with_a_test_table(spark, table, tmp_path):
    train, test = table.where("id % 4 <> 0").drop("y"), table.where("id % 4 = 0").drop("y").withColumn("city", F.when(F.col("id") % 8 == 0, "new").otherwise(F.col("city")))
    out = f"{tmp_path}/run-1"
    r = runs.automl(train, "k", "id", metric="auc", models=["decisiontree", "logistic", "absent"], k=2, test=test, output=out)
    assert r.best and r.score == r.test_scores["auc"] > 0.7 and "absent" in r.errors
    assert spark.read.csv(r.paths["predictions"], header=True).count() == test.count()
    cands = {c.model_id: c for c in runs.candidates(spark, r).collect()}
    assert cands["absent"].error and cands[r.best].leaderboard_rank == 1 and cands[r.best].original_features == ["x", "z", "city"]
    assert runs.reload(spark, str(tmp_path)).stages and runs.reload(spark, out, r.paths["model"]).stages
    plain = runs.automl(train, "k", "id", models=["decisiontree"], k=2, test=test.drop("k"))
    assert plain.test_scores is None and plain.score == plain.leaderboard[0][1]


def test_pipeline_uses_the_test_table(spark, table, tmp_path):
    r = runs.run_pipeline("p", table.where("id % 4 <> 0").drop("k"), "y", "id", root=str(tmp_path), test=table.where("id % 4 = 0").drop("k"), models=["decisiontree"], associations=())
    assert r.automl.test_scores and r.automl.best == "decisiontree" and "predictions" in r.paths


def test_synthesis_by_name_and_depth(spark, table):
    df = table.select("id", "x", "city", F.timestamp_seconds(F.col("id") * 100).alias("at"), F.col("y"))
    with pytest.raises(ValueError, match="nothing"):
        synthesis.synthesize(df, "y", "id", synthesis.SynthesisConfig(aggregates=("nothing",), select=None))
    with pytest.raises(ValueError, match="time column"):
        synthesis.synthesize(df, "y", "id", synthesis.SynthesisConfig(aggregates=("trend",), groups=("city",), select=None))
    config = synthesis.SynthesisConfig(max_depth=4, aggregates=("mean", "trend", "first", "time_since_first", "n_most_common", "entropy"), transforms=("absolute", "diff", "hour"), groups=("city",), time="at", select=None)
    got = synthesis.synthesize(df.withColumn("n", F.length("city") + F.col("id").cast("int") % 3), "y", "id", config)
    depths = {d.name: d.depth for d in got.definitions}
    assert depths["ABSOLUTE(x)"] == 1 and depths["city_groups.TREND(main.x)"] == 2 and depths["ABSOLUTE(city_groups.MEAN(main.x))"] == 3 and depths["ABSOLUTE(city_groups.MEAN(main.ABSOLUTE(x)))"] == 4
    pdf = got.table.toPandas()
    want = pdf.groupby("city")["ABSOLUTE(x)"].transform("mean")
    assert np.allclose(pdf["ABSOLUTE(city_groups.MEAN(main.ABSOLUTE(x)))"], want)
    assert pdf["city_groups.N_MOST_COMMON(main.n)[1]"].notna().all() and pdf["city_groups.TIME_SINCE_FIRST(main)"].min() >= 0


def test_group_operators_within_expressions(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 3.0), (3, None, 5.0), (4, "b", None), (5, "a", 3.0)], "id int, g string, v double")
    got = {r.id: r for r in language.apply(df, "d = v - group_mean(g, v)\nr = group_rank(g, v)\nf = frequency(g) + 1\nn = group_max(g, group_nunique(g, v))\ns = where(contains(g, '#'), 1, 0)  # none").collect()}
    assert got[2].d == pytest.approx(3 - 7 / 3) and got[2].r == 2.5 and got[1].f == pytest.approx(1.6) and got[1].n == 2 and got[3].d is None and got[4].r is None and got[1].s == 0
    with pytest.raises(language.ProgramError):
        language.apply(df, "x = group_mean(v)")


def test_descriptions(spark, table):
    t = describe.insights(table.drop("k").withColumn("gone", F.when(F.col("id") % 3 == 0, F.col("z") * 1.5)).withColumn("one", F.lit("same")), "y", {"x": "A length"})
    tags = describe.prompt_text(t, "tags")
    assert "- x: A length [NUM] [HIGH_PRED] [CORR:0." not in tags  # x has as many values as rows: an id
    levels = ", ".join(r.city for r in table.groupBy("city").count().orderBy(F.desc("count"), "city").collect())
    assert "- city: city [CAT]" in tags and f"({levels})" in tags and "[66% NaN]" in tags and "[CONST]" in tags
    text = describe.prompt_text(t, "hierarchical")
    assert text.index("### Medium") < text.index("### Low") and "constant - no variance" in text and "ID - no predictive value" in text
    assert "one: one (feature)" in describe.prompt_text(t) and {r.feature for r in describe.low_value(t).collect()} >= {"id", "x", "one"}
    assert describe.by_importance(t).first().feature == "x" and describe.feature(t, "z").count() == 1
    with pytest.raises(ValueError):
        describe.lines(t, "poem")


def test_history(spark, tmp_path):
    log = spark.createDataFrame([(1, "a = x\ndrop z", 0.5, None), (2, "b = ", None, "bad"), (3, "a = x * 2\nx = 1\nc = a == 2", 0.7, None)], "sample_order int, function string, score double, error string")
    e = {r.sample_order: r for r in history.evolution(log, ["x", "z"]).collect()}
    assert list(e[1].asDict()) == list(history.COLUMNS) and e[1].features_created == "a" and e[1].features_dropped == "z" and e[2].has_error and e[3].is_best and e[3].features_created == "a,c"
    assert {r.sample_order: r.total_features for r in history.timeline(log, ["x", "z"]).collect()} == {1: 2, 2: 3, 3: 4}
    assert history.most_changed(log, ["x", "z"]).first().feature == "a" and history.convergence(log).first()[0] == 3
    history.write(log, ["x", "z"], "y", str(tmp_path / "h"))
    found = json.loads(spark.read.text(str(tmp_path / "h" / "report")).first()[0])
    assert found["scores"]["improvement"] == pytest.approx(0.2) and found["features"]["most_dropped"] == {"z": 1}


class Scripted:
    def __init__(self, *answers):
        self.answers, self.prompts = list(answers), []

    def complete(self, prompt):
        self.prompts.append(prompt)
        a = self.answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a


def test_dialogue(spark, table):
    final = 'Done: {"Mode": "final", "columns": [{"name": "x", "note": "length"}, {"name": "z", "note": "?", "confidence": 0.2}, {"name": "new", "note": "n", "confidence": 0.9}]}'
    client = Scripted("What is x?", "And z?", final)
    said = iter(["a length", "passe"])
    out = dialogue.analyse(table.drop("k"), "y", client, answer=lambda question: next(said))
    assert out["notes"] == {"x": "length", "new": "n"} and [m["role"] for m in out["messages"]] == ["system", "user", "assistant", "user", "assistant", "user", "assistant"]
    assert dialogue.SKIPPED in out["messages"][5]["content"] and dialogue.conversation_table(spark, out["messages"]).count() == 7
    assert dialogue.clarify({}, Scripted(final)).notes[0]["name"] == "x"  # not interactive
    broken = dialogue.clarify({}, RetryingLLM(Scripted(*[ConnectionError("no")] * 3), wait=lambda s: None))
    assert broken.notes == [] and "RuntimeError" in broken.error
    assert dialogue.command(" Terminé ") == "done" and dialogue.command("SKIP") == "skip" and dialogue.command("x") is None
    assert dialogue.analyse(table.drop("k"), "y")["notes"] is None


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id;v,w;t\n1;2,5;x\n2;3,5;y\n")
    df = readers.read_csv(spark, f"{tmp_path}/a.csv", index=0)
    assert df.columns == ["_row_id", "v,w", "t"] and df.count() == 2
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, f"{tmp_path}/absent.csv", sep=",")
    assert len(writers.write_pair(df, df.limit(1), f"{tmp_path}/pair")) == 2 and len(writers.write_pair(df, None, f"{tmp_path}/pair", "csv")) == 1
    assert spark.read.parquet(f"{tmp_path}/pair/test.parquet").count() == 1


def test_row_ids_depend_on_values(spark, table):
    both = [{r.x: r["_row_id"] for r in rows.with_row_id(t.select("x", "city")).collect()} for t in (table, table.repartition(7))]
    assert both[0] == both[1] and len(set(both[0].values())) == table.count()
    twins = rows.with_row_id(spark.createDataFrame([(1,), (1,), (None,)], "a int"))
    assert twins.select("_row_id").distinct().count() == 3


def test_profile_of_several_targets(spark, table):
    found = runs.profile_dataset(table, ["y", "k"], associations=("pearson",)).to_dict()
    assert [t["target"] for t in found["target"]] == ["y", "k"] and found["association"][0]["feature"] == "x"
    assert profile.memory_mb(table) > 0 and registry.ALIASES["xgboost"] == "gbt"


def test_dominated_rows_of_many_columns(spark):
    """More columns than a long has bits, against all pairs."""
    rng = random.Random(6)
    columns = [f"c{i}" for i in range(70)]
    base = [[rng.choice("ab") for _ in columns] for _ in range(3)]
    data = [[v if rng.random() < 0.97 else None for v in rng.choice(base)] for _ in range(60)] + [[None] * 70, base[0], [" "] + base[1][1:]]
    cells = {tuple(None if v is None or not v.strip() else v.strip() for v in r) for r in data}
    want = {a for a in cells if any(a) and not any(b != a and all(x is None or x == y for x, y in zip(a, b)) for b in cells)}
    got = rows.drop_dominated(spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns)), columns).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_completions_over_http(spark, tmp_path):
    import threading

    server = dialogue.completion_server(Scripted("one", "two", RuntimeError("no")))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    import urllib.error
    import urllib.request

    def post(body):
        with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}/completions", json.dumps(body).encode()), timeout=10) as r:
            return json.load(r)

    assert post({"prompt": "x", "repeat_prompt": 2}) == {"content": ["one", "two"]}
    for body, status in (({"prompt": "x"}, 502), ({}, 400)):
        with pytest.raises(urllib.error.HTTPError) as e:
            post(body)
        assert e.value.code == status
    client = dialogue.HttpLLM(url=f"http://127.0.0.1:{server.server_port}/completions")
    with pytest.raises(ValueError):
        client.complete("x")  # the server knows no messages: refused, not tried again
    server.shutdown()
    with pytest.raises(ValueError):
        dialogue.make_client("none")


def test_selection_and_synthesis_scores(spark, table):
    from tabularium.plans.selection import select_features

    df = table.select("x", (F.col("x") * 2).alias("twice"), "z", "y")
    assert set(select_features(df, "y").selected) <= {"x", "twice", "z"} and select_features(df, "y", method="rfe", top_k=1).scores in ({"x": 1.0}, {"twice": 1.0})
    got = synthesis.synthesize(table.select("id", "x", "z", "y"), "y", "id", synthesis.SynthesisConfig(max_depth=1, select=None))
    found = synthesis.evaluate(table.select("id", "x", "z", "y"), got, "y", "id", using=evaluation.Preset(models=("decisiontree",), folds=2))
    assert 0 < found["before"] <= 1 and 0 < found["after"] <= 1
    assert profile.is_categorical(table, "city") and profile.is_categorical(table, "y") and not profile.is_categorical(table, "x")


def test_mutual_information_by_neighbours(spark):
    """Against all pairs: values with and without ties, a level of one row, values that aren't there, more ranges than a level has values."""
    rng = np.random.default_rng(8)
    psi = lambda n: -0.5772156649015329 + sum(1 / i for i in range(1, int(n)))
    rows = [("smooth", float(v), f"g{i % 3}") for i, v in enumerate(rng.normal(size=90) + np.arange(90) % 3)]
    rows += [("tied", float(v), f"g{v % 2}" if i % 4 else "g2") for i, v in enumerate(rng.integers(0, 5, 80))]
    rows += [("few", 1.0, "a"), ("few", 2.0, "a"), ("few", 9.0, "b"), ("none", 1.0, "a")]

    def plain(name):
        x = [(v, y) for f, v, y in rows if f == name]
        x = [(v, y) for v, y in x if sum(z == y for _, z in x) > 1]
        total = 0.0
        for i, (v, y) in enumerate(x):
            own = sorted(abs(v - a) for j, (a, z) in enumerate(x) if z == y and j != i)
            k = min(3, len(own))
            r = own[k - 1]
            near = k if r > 0 else sum(d == 0 for d in own) + 1
            m = sum(v - r < a < v + r for a, _ in x) if r > 0 else sum(a == v for a, _ in x)
            total += psi(near) - psi(len(own) + 1) - psi(m)
        return max(0.0, psi(len(x)) + total / len(x))

    gaps = [("smooth", None, "g0"), ("smooth", float("nan"), "g0"), ("smooth", float("inf"), "g1"), ("smooth", 0.0, None)]
    df = spark.createDataFrame(rows + gaps, "feature string, value double, level string")
    got = {r.feature: r.mutual_info for r in neighbours.neighbour_information(df).collect()}
    assert got == {n: pytest.approx(plain(n), abs=1e-9) for n in ("smooth", "tied", "few")}
    assert neighbours.neighbour_information(df.limit(0)).collect() == []
