"""Whole runs: report, model comparison, hybrid engineering, pipeline."""

from __future__ import annotations

import json
import re
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, is_dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Layout, ProfileConfig
from ..functions import language
from ..functions.primitives import TRANSFORMS
from ..models import evaluation, metrics, registry, stacking
from ..models.limits import within
from ..operators import association, neighbours, profile, rows
from ..sources.readers import list_files
from ..sources.writers import write_csv, write_predictions
from . import search
from .infer import infer
from .selection import select_features
from .synthesis import SynthesisConfig, compute, synthesize


@dataclass
class Report:
    """The tables of a profile; ``to_dict`` collects them (rows by columns and classes, never by records)."""

    dataset: DataFrame
    columns: DataFrame
    target: DataFrame | None = None
    classes: DataFrame | None = None
    numeric: DataFrame | None = None
    categorical: DataFrame | None = None
    text: DataFrame | None = None
    leakage: DataFrame | None = None
    association: DataFrame | None = None
    target_notes: DataFrame | None = None
    hints: DataFrame | None = None

    def to_dict(self) -> dict:
        tables = {k: v for k, v in self.__dict__.items() if v is not None}
        return dict(zip(tables, at_once([lambda v=v: [r.asDict(recursive=True) for r in v.collect()] for v in tables.values()])))


def at_once(jobs: list) -> list:
    """Results of independent jobs, begun together: small tables wait for scheduling more than for work."""
    with ThreadPoolExecutor(max_workers=max(1, min(8, len(jobs)))) as pool:
        return list(pool.map(inheritable_thread_target(SparkSession.active())(lambda job: job()), jobs))


def profile_dataset(df: DataFrame, targets: list[str] | None = None, config: ProfileConfig = profile.DEFAULT, *, associations: tuple[str, ...] = (), task: str = "classification") -> Report:
    """Every column, the target, the leakage risk and, if asked for, the association of features with the target."""
    features = profile.features_of(df, targets)
    if targets == []:
        raise ValueError("no target is named")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c in features if profile.is_numeric(kinds[c])]
    strings = [c for c in features if kinds[c].typeName() == "string"]
    out = Report(profile.dataset_profile(df), profile.column_profile(df, targets, config))
    if numeric:
        out.numeric = profile.numeric_stats(df, numeric)
        out.hints = profile.skew_hints(out.numeric)
    if strings:
        out.categorical, out.text = profile.categorical_stats(df, strings, config), profile.text_stats(df, strings)
    if targets:
        t = targets[0]
        out.target = profile.targets_profile(df, targets, config)
        out.target_notes = reduce(DataFrame.unionByName, [profile.target_notes(df, x, config) for x in targets])
        out.classes = profile.class_distribution(df, t)
        out.leakage = association.leakage(df.select(*features, t), t, config.strong_correlation) if profile.is_numeric(kinds[t]) and numeric else None
        if associations:
            out.association = associate(df, features, t, associations)
    return out


METHODS = ("pearson", "spearman", "kendall", "mutual_info", "mic", "phik")


def associate(df: DataFrame, features: list[str], target: str, methods: tuple[str, ...] = ("pearson", "spearman", "kendall", "mutual_info"), errors: dict[str, str] | None = None) -> DataFrame:
    """(feature, one column a method, combined_score), best first; only the methods asked for are computed.

    Mutual information of a float column and one of another kind is found by nearest neighbours; phi-k cuts float columns
    into bins, as mutual information does where feature and target are floats; all others count as they are, level by level.
    A method that fails leaves its column null and its message in ``errors``.
    """
    if unknown := [m for m in methods if m not in METHODS]:
        raise ValueError(f"no method {unknown}; there are {', '.join(METHODS)}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    data = association.prepare(df, features, target).persist()  # lost blocks are computed again
    floats = [c for c in [*features, target] if kinds[c].typeName() in ("float", "double") or kinds[c].typeName().startswith("decimal")]
    discrete = association.binned(data, ["_y" if c == target else c for c in floats])
    made = {
        "pearson": lambda: association.pearson_scores(data, features),
        "spearman": lambda: association.spearman_scores(data, features),
        "kendall": lambda: association.kendall_scores(data, features),
        "mutual_info": lambda: neighbours.information(data, features, "_y", ["_y" if c == target else c for c in floats]),
        "mic": lambda: association.mic(data, features, "_y"),
        "phik": lambda: association.phi_k(discrete, features, "_y"),
    }
    def scores(method: str) -> dict[str, float]:
        try:
            return {r[0]: r[1] for r in made[method]().collect()}  # a row a feature
        except Exception as e:
            if errors is None:
                raise
            errors[method] = f"{type(e).__name__}: {str(e)[:300]}"
            return {}

    try:
        data.count()
        found = at_once([lambda m=m: scores(m) for m in methods])
    finally:
        data.unpersist()
    rows = [(c, *[t.get(c) for t in found]) for c in features]
    out = df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"{m} double" for m in methods))
    return association.combined_score(out, list(methods))


@dataclass
class AutoResult:
    leaderboard: list[tuple[str, float]]
    best: str | None
    metric: str
    errors: dict[str, str] = field(default_factory=dict)
    results: dict[str, registry.CVResult] = field(default_factory=dict)
    test_scores: dict[str, float] | None = None  # of the best model on the test table; without one its cross-validated score counts
    paths: dict[str, str] = field(default_factory=dict)
    importances: list[tuple[str, float]] = field(default_factory=list)
    features: list[str] = field(default_factory=list)
    stack: dict[str, float] = field(default_factory=dict)  # base models of the ensemble and their weights

    @property
    def score(self) -> float | None:
        """Of the best model: on the test table where there is a target in it, else by cross-validation."""
        if self.test_scores:
            return self.test_scores[self.metric]
        return self.leaderboard[0][1] if self.leaderboard else None


def automl(df: DataFrame, target: str, key: str, *, task: str = "classification", metric: str | None = None, models: list[str] | None = None, time_budget: float = 120, k: int = 3, test: DataFrame | None = None, output: str | None = None, stack: bool = False) -> AutoResult:
    """Compare model families by cross-validation within a time budget; a family's failure is recorded, not raised.

    Each family has what is left of the budget, and is cut off at its end. Without a metric, f1 counts for two classes, macro
    f1 for more, and the root of the squared error for numbers. ``stack`` adds an ensemble over the families that
    ended (``stacked`` on the leaderboard; its base models and their weights are in ``stack``). With a ``test`` table or an
    ``output`` folder the best is fitted on all rows; the test table's predictions, and its scores if it has the target,
    follow. In ``output`` are then the model, the predictions, the leaderboard and the candidates.
    """
    metric = evaluation.metric_for(df, target, task, metric)
    features = [c for c in df.columns if c not in (target, key)]
    if test is not None:  # one preparation for both, so that codes and medians agree; the test rows have no part in either
        coded, test = both_tables(df, test, target, key, features)
    else:
        coded = association.prepare(df, [*features, key], target).withColumnRenamed("_y", target)
    data = coded.persist()
    out, began, fitted = AutoResult([], None, metric, features=features), time.time(), {}
    left = lambda: time_budget - (time.time() - began)

    def note(name: str, e: Exception) -> None:
        out.errors[name] = f"{type(e).__name__}: {str(e)[:300]}"

    try:
        data.count()
        for name in models or registry.GROUPS["default"]:
            if left() <= 0:
                out.errors[name] = "not begun within the time budget"
                continue
            try:
                found = registry.cross_validate(data, features, target, key, task=task, models=[name], k=k, seconds=left(), fitted=fitted)
                if any(metric not in f for f in found[name].folds):
                    raise ValueError(f"{name} gives no {metric} for this target")
                out.results |= found
            except Exception as e:
                note(name, e)
        classes = registry.classes_of(registry.assemble(data, features, target)) if task != "regression" else 0
        bases, meta = {n: fitted[n] for n in out.results}, None
        if stack and len(bases) > 1 and left() > 0:
            try:
                def stacked():
                    rows_in = registry.folded(data, features, target, key, k, target if task != "regression" else None)
                    table = stacking.out_of_fold(rows_in, bases, task, classes)
                    return stacking.fit_meta(table, task, classes), stacking.cross_validate(table, task, classes)

                meta, out.results["stacked"] = within(left(), stacked, df.sparkSession)
                out.stack = stacking.weights(list(bases), meta)
            except Exception as e:
                note("stacked", e)
        out.leaderboard = sorted(((n, r.mean(metric)) for n, r in out.results.items()), key=lambda x: (-metrics.SIGN[metric] * x[1], x[0]))
        out.best = out.leaderboard[0][0] if out.leaderboard else None
        if out.best and (test is not None or output):
            rows_in = registry.assemble(data, features, target)
            if out.best == "stacked":
                model = stacking.ensemble({n: registry.fit(n, task, classes, rows_in) for n in bases}, meta, task, classes)
            else:
                model = registry.fit(out.best, task, classes, rows_in)
            out.importances = registry.importances(model, features)
            if output:
                out.paths |= export(df.sparkSession, out, model, output)
            if test is not None:
                rows_in = registry.assemble(test, features, target, (key,))
                made = registry.predict(model, rows_in)
                if rows_in.where("label IS NOT NULL").limit(1).count():
                    r = registry.evaluate(made.where("label IS NOT NULL"), task, classes).first()
                    out.test_scores = r.asDict()
                if output:
                    out.paths["predictions"] = write_predictions(made.drop("probabilities", "label"), f"{output}/predictions")
    finally:
        data.unpersist()
    return out


def both_tables(train: DataFrame, test: DataFrame, target: str, key: str, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Train and test as models take them: levels, medians and the target's codes are those of the training table; a level that it
    lacks is -1, a missing value its median, a target that is absent or unknown null."""
    kinds = {f.name: f.dataType for f in train.schema.fields}
    text = [c for c in features if not profile.is_numeric(kinds[c])]
    numbers = [c for c in features if c not in text]
    aligned = test if target in test.columns else test.withColumn(target, F.lit(None).cast(kinds[target]))
    a, b = profile.normalize_nulls(train).where(F.col(target).isNotNull()), profile.normalize_nulls(aligned.select(*[F.col(f"`{c}`") for c in train.columns if c in aligned.columns]))
    for c in text:
        codes = rows.level_codes(a, c)
        a, b = rows.encode(a, c, codes, c), rows.encode(b, c, codes, c)
    if not profile.is_numeric(kinds[target]):
        codes = rows.level_codes(a, target)
        a, b = (rows.encode(x, target, codes, target) for x in (a, b))
        b = b.withColumn(target, F.when(F.col(target) >= 0, F.col(target)))
    middle = profile.medians(a, numbers)
    fill = lambda df: df.select(*[F.coalesce(rows.finite(F.col(f"`{c}`").cast("double")), F.lit(middle.get(c)).cast("double"), F.lit(0.0)).alias(c) for c in features], F.col(f"`{key}`"), F.col(f"`{target}`").cast("double").alias(target))
    return fill(a), fill(b)


def candidates(spark: SparkSession, result: AutoResult) -> DataFrame:
    """A row a candidate: its place, algorithm, score and spread, features, or the error that it ended with."""
    order = {n: i + 1 for i, (n, _) in enumerate(result.leaderboard)}
    done = [(n, registry.ALIASES.get(n, n), order[n], r.mean(result.metric), r.std(result.metric), result.features, [f for f, v in result.importances if n == result.best and v > 0], None) for n, r in result.results.items()]
    failed = [(n, registry.ALIASES.get(n, n), None, None, None, result.features, [], e) for n, e in result.errors.items()]
    return spark.createDataFrame(done + failed, "model_id string, algorithm string, leaderboard_rank int, score double, score_std double, original_features array<string>, used_features array<string>, error string")


def export(spark: SparkSession, result: AutoResult, model, output: str) -> dict[str, str]:
    """The fitted leader, the leaderboard, variable importances and all candidates below ``output``."""
    paths = {"model": f"{output}/model-{result.best}", "candidates": f"{output}/candidates", "importances": f"{output}/importances"}
    registry.save(model, paths["model"])
    paths["candidates"] = write_csv(candidates(spark, result), paths["candidates"], single=True)
    paths["importances"] = write_csv(spark.createDataFrame(result.importances or [("", 0.0)], "feature string, importance double"), paths["importances"], single=True)
    paths["leaderboard"] = write_csv(spark.createDataFrame([(n, float(v)) for n, v in result.leaderboard], "model string, score double"), f"{output}/leaderboard", single=True)
    return paths


def reload(spark: SparkSession, root: str, path: str | None = None):
    """A saved leader: that of ``path``, else of the folder that comes last by name below ``root`` (run ids sort by time)."""
    if path is None:
        models = [f for f in list_files(spark, root, "") if f.rstrip("/").rsplit("/", 1)[-1].startswith("model-")]
        runs_below = [] if models else [f for d in list_files(spark, root, "") for f in list_files(spark, d, "") if f.rstrip("/").rsplit("/", 1)[-1].startswith("model-")]
        if not (models or runs_below):
            raise FileNotFoundError(f"no model below {root}")
        path = sorted(models or runs_below)[-1]
    return registry.load(path)


def engineer(df: DataFrame, target: str, key: str, client: search.LLMClient | None = None, *, task: str = "classification", samples: int = 6, config: SynthesisConfig | str = "fast", most: int = 100, path: str | None = None) -> tuple[DataFrame, dict]:
    """Searched and synthesized features together, selected with searched ones preferred; without a client, or if the search fails, synthesized ones alone."""
    preferred: list[str] = []
    report: dict = {"program": ""}
    made = df
    if client is not None:
        try:
            found = search.evolve(df, target, key, client, task=task, samples=samples, path=path)
            made = found.table
            preferred = [c for c in made.columns if c not in df.columns]
            report["program"] = found.best
            report["search"] = {"best": found.best, "score": found.best_score, "baseline": found.baseline}
        except Exception as e:
            report["search_error"] = f"{type(e).__name__}: {str(e)[:300]}"
            made = df
    extra = synthesize(made, target, key, SynthesisConfig(select=None) if config == "default" else config, task=task)
    table = extra.table
    picked = select_features(table.drop(key), target, task=task, method="hybrid", preferred=[c for c in preferred if c in table.columns], top_k=most)
    report |= {"selected": picked.selected, "dropped": picked.dropped, "definitions": extra.definitions}
    return table.select(key, *[f"`{c}`" for c in picked.selected], target), report


def make_json_safe(value, most: int = 50):
    """Plain data: dataclasses as dicts, tables as their rows up to ``most`` (else columns and 5 rows), the rest as text."""
    if is_dataclass(value) and not isinstance(value, type):
        return make_json_safe(asdict(value) if not any(isinstance(v, DataFrame) for v in value.__dict__.values()) else value.__dict__, most)
    if isinstance(value, DataFrame):
        head = [r.asDict(recursive=True) for r in value.limit(most + 1).collect()]
        return make_json_safe(head, most) if len(head) <= most else {"columns": value.columns, "head": make_json_safe(head[:5], most)}
    if isinstance(value, dict):
        return {str(k): make_json_safe(v, most) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [make_json_safe(v, most) for v in value]
    if isinstance(value, float):
        return value if value == value and abs(value) != float("inf") else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def prune(value, keep: tuple[str, ...] = ()):
    """Without nulls, empty lists and empty dicts; named keys keep their null."""
    if isinstance(value, dict):
        made = {k: prune(v, keep) for k, v in value.items()}
        return {k: v for k, v in made.items() if k in keep or v not in (None, [], {})}
    return [x for x in (prune(v, keep) for v in value) if x not in (None, [], {})] if isinstance(value, list) else value


#: Of each section of a report, what a prompt doesn't need: it follows from the rest, or tells a model nothing.
NOT_NEEDED = {
    "dataset": ("missing_cells", "duplicate_rows", "n_numeric", "n_categorical", "n_datetime"),
    "columns": ("ordinal", "kind", "role", "n_non_null", "n_missing", "unique_ratio"),
    "target": ("n_rows", "imbalance_ratio", "is_imbalanced"),
    "classes": ("proportion",),
    "numeric": ("count", "p25", "p50", "p75", "kurtosis"),
    "categorical": ("n_rare",),
}
#: Sections that are left out as a whole.
NOTES = ("target_notes", "hints")


def compact(report: dict, digits: int = 4, *, engineering: bool = True, top: int = 3, examples: int = 3) -> dict:
    """A report made small for a prompt: each section without what isn't needed of it, rounded floats, ``top`` values of a
    column, no nulls, no zero rates of missing values. Unless features are to be engineered, hints go too, and of example
    values at most ``examples`` different ones stay, none of numbers and ids."""

    def small(v):
        if isinstance(v, float):
            return round(v, digits)
        if isinstance(v, dict):
            return {k: small(x) for k, x in v.items()}
        return [small(x) for x in v] if isinstance(v, list) else v

    def column(row: dict) -> dict:
        if not engineering:
            row.pop("recommendations", None)
            given = row.pop("example_values", None) or []
            if row.get("inferred_type") != "numeric" and "ID_LIKE" not in (row.get("flags") or []):
                row["example_values"] = list(dict.fromkeys(given))[:examples]
        if not row.get("missing_rate"):
            row.pop("missing_rate", None)
        return row

    out = {}
    for section, rows in report.items():
        if section in NOTES or not isinstance(rows, list):
            continue
        kept = [{k: v for k, v in r.items() if k not in NOT_NEEDED.get(section, ())} if isinstance(r, dict) else r for r in rows]
        kept = [r for r in kept if r["rank"] <= top] if section == "categorical" else kept
        out[section] = [column(r) for r in kept] if section == "columns" else kept
    return prune(small(make_json_safe(out, 10**6)))


def row_program(program: str) -> str:
    """The lines of a program that read nothing but their own row."""
    over_rows = re.compile(r"\b(" + "|".join([*language.TABLE_OPERATORS, "combine_frequency"]) + r")\s*\(")
    return "\n".join(x for x in program.splitlines() if not over_rows.search(x))


@dataclass
class PipelineResult:
    report: dict
    params: dict
    features: DataFrame
    automl: AutoResult | None
    paths: dict[str, str]


def run_pipeline(project: str, df: DataFrame, target: str, key: str, *, client: search.LLMClient | None = None, root: str = "out", test: DataFrame | None = None, engineer_features: bool = True, with_automl: bool = True, associations: tuple[str, ...] = ("pearson",), models: list[str] | None = None, **overrides) -> PipelineResult:
    """Profile, infer parameters, engineer features, compare models; tables and reports go to ``<root>/<project>``."""
    layout, spark = Layout(project, root), df.sparkSession
    layout.log(spark, "reports", {"begun": project, "target": target})
    report = profile_dataset(df.drop(key), [target], associations=associations)
    found = report.to_dict()
    d, t = found["dataset"][0], found["target"][0]
    facts = spark.createDataFrame([(t["problem_type"], t["is_imbalanced"], d["n_rows"], d["n_columns"] - 1, len(found.get("text") or []), float(d["missing_ratio"]))], "problem_type string, is_imbalanced boolean, n_rows long, n_features long, n_text long, missing_ratio double")
    params = infer(facts).first().asDict() | {k: v for k, v in overrides.items() if v is not None}
    table, notes = engineer(df, target, key, client, task=params["task"], samples=int(params["max_samples"]), path=layout.path("features", "population")) if engineer_features else (df, {})
    paths = {"features": layout.path("features", "train.parquet")}
    table.write.mode("overwrite").parquet(paths["features"])
    table = spark.read.parquet(paths["features"])
    given = None
    if test is not None:  # features of single rows are made in it too; what depends on other rows is left out of both tables
        made = language.apply(test, row_program(notes.get("program", "")), protected=(target, key))
        given = compute(made, [x for x in notes.get("definitions", []) if x.depth == 1 and x.primitive in TRANSFORMS], key)
        table = table.select(*[F.col(f"`{c}`") for c in table.columns if c in given.columns or c == target])
    result = automl(table, target, key, task=params["task"], metric=params["metric"], models=models, time_budget=float(params["time_budget"]), test=given, output=layout.path("models")) if with_automl else None
    if result:
        paths |= result.paths
    paths["summary"] = layout.path("reports", "summary")
    text = json.dumps(make_json_safe({"params": params, "engineering": notes, "report": compact(found), "leaderboard": result.leaderboard if result else None}))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(paths["summary"])
    paths["metadata"] = layout.save_metadata(spark, "reports", {"target": target, "key": key, "params": params, "rows": d["n_rows"], "features": [c for c in table.columns if c not in (target, key)], "best": result.best if result else None, "paths": dict(paths)})
    return PipelineResult(found, params, table, result, paths)


def summary_text(report: dict) -> str:
    """A report as lines of text."""
    d = report["dataset"][0]
    lines = [f"{d['n_rows']} rows, {d['n_columns']} columns, {d['missing_cells']} missing cells, {d['duplicate_rows']} duplicate rows"]
    lines += [f"{c['feature']}: {c['role']}, {c['n_unique']} distinct, {100 * c['missing_rate']:.1f} % missing {' '.join(c['flags'])}".rstrip() for c in report["columns"]]
    if report.get("target"):
        t = report["target"][0]
        lines.append(f"target {t['target']}: {t['problem_type']}")
    return "\n".join(lines)

