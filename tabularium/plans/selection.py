"""Selecting features: nulls, constants, redundancy, importance."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..models import counted
from ..operators.association import correlation_matrix, pearson, prepare
from ..operators.profile import unpivot
from ..operators.rows import usable_columns


#: Forests that importances are taken from, alone and in repeated elimination.
FOREST, FOREST_RFE = {"numTrees": 100, "maxDepth": 10}, {"numTrees": 50, "maxDepth": 8}


@dataclass
class SelectionResult:
    selected: list[str]
    dropped: list[str] = field(default_factory=list)
    scores: dict[str, float] = field(default_factory=dict)
    n_original: int = 0

    @property
    def reduction_pct(self) -> float:
        return 100.0 * (1 - len(self.selected) / self.n_original) if self.n_original else 0.0


def redundant(pairs: DataFrame, target_corr: DataFrame, threshold: float) -> DataFrame:
    """(feature): of each two features (a before b) correlated beyond the threshold, the one less correlated with the
    target; of equals the earlier. Pairs are judged independently of each other."""
    t = target_corr.select("feature", F.abs("pearson").alias("r"))
    strong = pairs.where(F.abs("correlation") > threshold)
    both = strong.join(t.select(F.col("feature").alias("a"), F.col("r").alias("ra")), "a").join(t.select(F.col("feature").alias("b"), F.col("r").alias("rb")), "b")
    return both.select(F.when(F.coalesce("rb", F.lit(0.0)) < F.coalesce("ra", F.lit(0.0)), F.col("b")).otherwise(F.col("a")).alias("feature")).distinct()


def priority_redundant(pairs: DataFrame, preferred: list[str], threshold: float) -> DataFrame:
    """(feature): as above, but a preferred feature beats another; among alike the later column stays."""
    p = lambda c: F.col(c).isin(preferred) if preferred else F.lit(False)
    return pairs.where(F.abs("correlation") > threshold).select(F.when(p("a") & ~p("b"), F.col("b")).otherwise(F.col("a")).alias("feature")).distinct()


def quota(scores: DataFrame, preferred: list[str], most: int) -> DataFrame:
    """The features to keep: preferred ones first, then by importance, up to ``most``."""
    mine = F.col("feature").isin(preferred) if preferred else F.lit(False)
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(mine), F.desc("importance"), "feature")))  # a row a feature
    return ranked.where(F.col("rank") <= most)


def select_features(df: DataFrame, target: str, *, task: str = "classification", method: str = "hybrid", threshold: float = 0.95, least: float = 0.01, top_k: int | None = None, preferred: list[str] | None = None) -> SelectionResult:
    """Drop unusable columns, then by ``method``: correlation, importance, rfe, or hybrid (the first two in turn)."""
    everything = [c for c in df.columns if c != target]
    features = usable_columns(df.drop(target))
    data = prepare(df, features, target).persist()
    dropped: list[str] = []
    try:
        if method in ("correlation", "hybrid") and len(features) > 1:
            y = unpivot(data, features, "double", keep=("_y",)).groupBy("feature").agg(pearson(F.col("value"), F.col("_y")).alias("pearson"))
            pairs = correlation_matrix(data.select(*features), features)
            gone = priority_redundant(pairs, preferred, threshold) if preferred else redundant(pairs, y, threshold)
            dropped = sorted(r[0] for r in gone.collect())
            features = [c for c in features if c not in dropped]
        scores = {c: 1.0 for c in features}
        if method in ("importance", "hybrid", "rfe"):
            classes = 0 if task == "regression" else 2

            forest = FOREST_RFE if method == "rfe" else FOREST

            def ranked(names: list[str]) -> list[tuple[str, float]]:
                return counted.forest_importances(data, names, "_y", task, classes, forest)

            found = ranked(features)
            if method == "rfe":
                n = top_k or max(10, len(features) // 4)
                while len(found) > n:
                    found = ranked([c for c, _ in found[: max(n, len(found) - max(1, len(everything) // 10))]])
            if method == "rfe":
                scores = {c: 1.0 / (i + 1) for i, (c, _) in enumerate(found)}
            elif method == "hybrid":  # the mean of what either step gives: staying counts as 1
                scores = {c: (scores[c] + v) / 2 for c, v in found}
            else:
                scores = dict(found)
            kept = [c for c, v in found if method == "rfe" or v >= least or c in (preferred or [])]
            dropped += [c for c in features if c not in kept]
            features = [c for c in features if c in kept]
    finally:
        data.unpersist()
    if top_k and len(features) > top_k:
        order = sorted(features, key=lambda c: (c not in (preferred or []), -scores.get(c, 0.0), c))
        dropped += order[top_k:]
        features = [c for c in features if c in order[:top_k]]
    return SelectionResult(features, dropped, {c: scores.get(c, 0.0) for c in features}, len(everything))
