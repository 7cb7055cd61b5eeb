"""python -m tabularium profile|synthesize|automl|pipeline TABLE --target NAME [--key NAME] [--output DIR]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .config import Settings
from .operators.rows import with_row_id
from .plans import runs
from .plans.dialogue import make_client
from .plans.synthesis import PRESETS, synthesize
from .sources.readers import read_csv
from .sources.writers import write_features


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tabularium", description=__doc__)
    p.add_argument("command", choices=["profile", "synthesize", "automl", "pipeline"])
    p.add_argument("table", help="a CSV file or a Parquet path")
    p.add_argument("--target", required=True)
    p.add_argument("--key", help="unique row key; numbered if there is none")
    p.add_argument("--output", default=Settings().output_dir)
    p.add_argument("--project", default="project")
    p.add_argument("--associations", default="pearson", help="comma-separated: pearson, spearman, kendall, mutual_info, mic, phik")
    p.add_argument("--task", choices=["classification", "regression"])
    p.add_argument("--metric")
    p.add_argument("--models", help="comma-separated names")
    p.add_argument("--preset", default="fast", choices=sorted(PRESETS))
    p.add_argument("--time-budget", type=float)
    p.add_argument("--no-engineering", action="store_true")
    p.add_argument("--no-automl", action="store_true")
    p.add_argument("--search", action="store_true", help="search features with the provider of TABULARIUM_LLM (stub: offline)")
    p.add_argument("--test", help="a table to predict, prepared like the first")
    a, settings = p.parse_args(args), Settings()
    spark = SparkSession.builder.appName("tabularium").getOrCreate()
    place = lambda path: path if "/" in path else f"{settings.data_dir}/{path}"
    load = lambda path: spark.read.parquet(path) if not path.endswith(".csv") else read_csv(spark, path)
    df = load(place(a.table))
    test = load(place(a.test)) if a.test else None
    key = a.key or "_row_id"
    if key not in df.columns:
        df = with_row_id(df, key)
    if test is not None and key not in test.columns:
        test = with_row_id(test, key)
    models = a.models.split(",") if a.models else None
    if a.command == "profile":
        found = runs.profile_dataset(df.drop(key), [a.target], associations=tuple(a.associations.split(","))).to_dict()
        print(runs.summary_text(found))
    elif a.command == "synthesize":
        out = synthesize(df, a.target, key, a.preset, task=a.task or "classification")
        print(write_features(out.table, f"{a.output}/{a.project}/features/train.parquet"))
    elif a.command == "automl":
        r = runs.automl(df, a.target, key, task=a.task or "classification", metric=a.metric, models=models, time_budget=a.time_budget or 120, test=test, output=f"{a.output}/{a.project}/models")
        print(json.dumps(runs.make_json_safe({"leaderboard": r.leaderboard, "best": r.best, "errors": r.errors})))
    else:
        r = runs.run_pipeline(a.project, df, a.target, key, client=make_client(settings.llm_provider) if a.search else None, root=a.output, engineer_features=not a.no_engineering, with_automl=not a.no_automl, associations=tuple(a.associations.split(",")), models=models, task=a.task, metric=a.metric, time_budget=a.time_budget, test=test)
        print(json.dumps(runs.make_json_safe({"params": r.params, "paths": r.paths, "leaderboard": r.automl.leaderboard if r.automl else None})))
    return 0


if __name__ == "__main__":
    sys.exit(main())
