"""Deep feature synthesis: transforms of columns, aggregates of groups given back to their rows, and stacks of both.

A run first lists ``FeatureDef``s, its logical plan, then declares them all in a few selects and one join a group key.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import primitives as P
from ..functions.grouped import aggregates
from ..functions.ordered import running
from ..models import evaluation
from ..operators.profile import TIME, is_numeric
from ..operators.rows import group_columns
from .selection import SelectionResult, select_features


@dataclass(frozen=True)
class FeatureDef:
    name: str
    primitive: str
    base: str
    depth: int
    group: str | None = None


@dataclass(frozen=True)
class SynthesisConfig:
    max_depth: int = 2
    aggregates: tuple[str, ...] | None = None
    transforms: tuple[str, ...] | None = None
    groups: tuple[str, ...] | None = None
    max_groups: int = 3
    max_features: int = 200
    select: str | None = "hybrid"
    top_k: int | None = None
    time: str | None = None  # the column that first, last, trend and times since go by
    asof: str | None = None  # the moment that times since count up to; by default the latest there is


#: Presets by name.
PRESETS = {
    "default": SynthesisConfig(),
    "fast": SynthesisConfig(max_depth=1, max_features=50, select="correlation"),
    "deep": SynthesisConfig(max_depth=3, max_features=500),
    "transforms_only": SynthesisConfig(max_depth=1, max_groups=0),
    "aggregates_only": SynthesisConfig(transforms=(), max_depth=2),
    "exhaustive": SynthesisConfig(max_depth=4, max_groups=5, max_features=1000, select=None),
}


@dataclass
class SynthesisResult:
    table: DataFrame
    definitions: list[FeatureDef]
    selection: SelectionResult | None = None
    report: dict = field(default_factory=dict)


def _takes(p: P.Primitive, kind: T.DataType) -> bool:
    return (
        p.takes == "any" or (p.takes == "numeric" and is_numeric(kind)) or (p.takes == "datetime" and isinstance(kind, TIME))
        or (p.takes == "boolean" and isinstance(kind, T.BooleanType)) or (p.takes == "text" and isinstance(kind, T.StringType)) or (p.takes == "latlong" and isinstance(kind, T.StructType))
    )


#: Special aggregates that need a time column.
BY_TIME = ("time_since_last", "time_since_first", "trend", "first", "last")
#: Of these one is made for each group, of the others one for each column.
ALONE = ("count", "time_since_last", "time_since_first")


def _known(names: list[str], known: set[str], what: str) -> list[str]:
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"no {what} {', '.join(unknown)}; there are {', '.join(sorted(known))}")
    return names


def define(df: DataFrame, target: str, key: str, config: SynthesisConfig, groups: list[str]) -> list[FeatureDef]:
    """The first ``max_features`` of ``all_features``."""
    return all_features(df, target, key, config, groups)[: config.max_features]


def all_features(df: DataFrame, target: str, key: str, config: SynthesisConfig, groups: list[str]) -> list[FeatureDef]:
    """The features of a run in a fixed order; no job is needed for it.

    Depth 1: transforms of columns. 2: aggregates of groups, given back to their rows. 3: transforms of those, and aggregates of
    transforms. 4: transforms of the latter. An unknown primitive is an error, as is one by time without a time column.
    """
    fields = [f for f in df.schema.fields if f.name not in (target, key)]
    has_time, has_text = any(isinstance(f.dataType, TIME) for f in fields), any(isinstance(f.dataType, T.StringType) for f in fields)
    aggregates, transforms = P.for_level(config.max_depth, has_time, has_text)
    if config.aggregates is not None:
        aggregates = _known(list(config.aggregates), {*P.AGGREGATES, *P.SPECIAL}, "aggregate")
        if (timed := [a for a in aggregates if a in BY_TIME]) and not config.time:
            raise ValueError(f"{', '.join(timed)} need the name of a time column")
    elif not config.time:
        aggregates = [a for a in aggregates if a not in BY_TIME]
    if config.transforms is not None:
        transforms = _known(list(config.transforms), {*P.TRANSFORMS, *P.WINDOWS, "percentile"}, "transform")
    transforms = list(dict.fromkeys(transforms))

    def takes(name: str, kind: T.DataType) -> bool:
        if name in P.SPECIAL:
            return isinstance(kind, (T.StringType, T.BooleanType)) or is_numeric(kind) and not isinstance(kind, (T.DoubleType, T.FloatType)) if name in ("entropy", "n_most_common") else is_numeric(kind)
        p = P.AGGREGATES[name]
        return _takes(p, kind) and (is_numeric(kind) or p.takes != "any")

    def transformed(base: str, kind: T.DataType, depth: int, group: str | None = None) -> list[FeatureDef]:
        made = []
        for t in transforms:
            if t == "percentile" and is_numeric(kind) or t in P.WINDOWS and _takes(P.WINDOWS[t], kind) or t in P.TRANSFORMS and _takes(P.TRANSFORMS[t], kind):
                made.append(FeatureDef(f"{t.upper()}({base})", t, base, depth, group))
        return made

    def aggregated(bases: list[tuple[str, T.DataType]], depth: int) -> list[FeatureDef]:
        made = []
        for g in groups:
            for a in aggregates:
                if a in ALONE:
                    made += [FeatureDef(f"{g}_groups.{a.upper()}(main)", a, g, depth, g)] if depth == 2 else []
                else:
                    made += [FeatureDef(f"{g}_groups.{a.upper()}(main.{name})", a, name, depth, g) for name, kind in bases if name != g and takes(a, kind)]
        return made

    out = [d for f in fields for d in transformed(f.name, f.dataType, 1)]
    if config.max_depth >= 2:
        out += aggregated([(f.name, f.dataType) for f in fields], 2)
    if config.max_depth >= 3:
        number = T.DoubleType()
        stack = [d for d in out if d.depth == 2 and d.primitive != "n_most_common" and d.primitive not in ("mode", "first", "last")]
        simple = [d for d in out if d.depth == 1 and d.primitive in P.TRANSFORMS and P.TRANSFORMS[d.primitive].returns == "numeric"]
        out += [x for d in stack for x in transformed(d.name, number, 3) if x.primitive in P.TRANSFORMS and x.primitive != "is_null"]
        deep = [d for d in aggregated([(d.name, number) for d in simple], 3) if d.primitive in P.AGGREGATES]
        out += deep
        if config.max_depth >= 4:
            out += [x for d in deep for x in transformed(d.name, number, 4) if x.primitive in P.TRANSFORMS and x.primitive != "is_null"]
    return out


def _special(df: DataFrame, group: str, own: list[FeatureDef], key: str, time: str | None, asof) -> list[DataFrame]:
    """(_key, features) of a group's special aggregates, a table each."""
    df, out = df.where(F.col(f"`{group}`").isNotNull()), []
    timed: dict[str, list[FeatureDef]] = {}
    for d in own:
        if d.primitive in BY_TIME:
            timed.setdefault(d.base if d.primitive not in ALONE else "", []).append(d)
        elif d.primitive == "entropy":
            out.append(P.entropy(df.select(F.col(f"`{group}`").alias("_key"), F.col(f"`{d.base}`").alias("_value")), "_key", "_value").withColumnRenamed("entropy", d.name))
        elif d.primitive == "n_most_common":
            found = P.n_most_common(df.select(F.col(f"`{group}`").alias("_key"), F.col(f"`{d.base}`").alias("_value")), "_key", "_value")
            out.append(found.select("_key", *[F.col(f"most_common_{i}").alias(f"{d.name}[{i}]") for i in (1, 2, 3)]))
    for base, defs in timed.items():
        rows = df.select(F.col(f"`{group}`").alias("_key"), F.col(f"`{base}`" if base else f"`{key}`").alias("_value"), F.col(f"`{time}`").alias("_time"), F.col(f"`{key}`").alias("_tie"))
        rows = rows if base else rows.withColumn("_value", F.lit(0.0))
        found = P.time_aggregates(rows, "_key", "_value", "_time", "_tie", asof)
        out.append(found.select("_key", *[F.col(d.primitive).alias(d.name) for d in defs]))
    return out


def compute(df: DataFrame, definitions: list[FeatureDef], key: str, time: str | None = None, asof: str | None = None) -> DataFrame:
    """``df`` with the features."""
    out = df
    simple = lambda depth: [(d.name, P.TRANSFORMS[d.primitive].make(F.col(f"`{d.base}`"))) for d in definitions if d.depth == depth and d.primitive in P.TRANSFORMS]
    if first := simple(1):
        out = out.select("*", *[c.alias(n) for n, c in first])
    if windows := [(d.name, d.primitive, d.base) for d in definitions if d.depth == 1 and d.primitive in P.WINDOWS]:
        out = running(out, key, windows)
    for d in definitions:
        if d.primitive == "percentile" and d.depth == 1:
            out = P.percentile(out, d.base, d.name)
    base = out
    moment = None
    if time and any(d.primitive in BY_TIME for d in definitions):
        moment = F.lit(asof).cast("timestamp") if asof else F.lit(df.agg(F.max(F.col(f"`{time}`").cast("timestamp"))).first()[0])
    for g in dict.fromkeys(d.group for d in definitions if d.group):
        own = [d for d in definitions if d.group == g]
        plain = [d for d in own if d.primitive in P.AGGREGATES]
        tables = [aggregates(base.where(F.col(f"`{g}`").isNotNull()), g, [(d.name, d.primitive, d.base) for d in plain]).withColumnRenamed(g, "_key")] if plain else []
        tables += _special(base, g, own, key, time, moment)
        if tables:
            table = reduce(lambda a, b: a.join(b, "_key", "full"), tables)  # a row a group
            out = out.join(table, F.col(f"`{g}`") == F.col("_key"), "left").drop("_key")  # rows without a key stay, without values
    for depth in (3, 4):
        if stacked := simple(depth):
            out = out.select("*", *[c.alias(n) for n, c in stacked])
    return out


def synthesize(df: DataFrame, target: str, key: str, config: SynthesisConfig | str = "default", *, task: str = "classification") -> SynthesisResult:
    """Features of a table, selected by the configured method."""
    config = PRESETS[config] if isinstance(config, str) else config
    if config.groups is not None:
        groups = list(config.groups)
    elif config.max_groups and config.max_depth >= 2:
        fields = [f.name for f in df.schema.fields if f.name not in (target, key) and (isinstance(f.dataType, T.StringType) or is_numeric(f.dataType) and not isinstance(f.dataType, (T.DoubleType, T.FloatType)))]
        groups = [r.feature for r in group_columns(df, fields, most=config.max_groups).collect()]
    else:
        groups = []
    every = all_features(df, target, key, config, groups)
    definitions = every[: config.max_features]
    table = compute(df, definitions, key, config.time, config.asof)
    selection = None
    if config.select:
        selection = select_features(table.drop(key), target, task=task, method=config.select, top_k=config.top_k)
        table = table.select(key, *[f"`{c}`" for c in selection.selected], target)
    return SynthesisResult(table, definitions, selection, {"groups": groups, "n_features": len(definitions), "left_out": [d.name for d in every[config.max_features :]]})


def evaluate(df: DataFrame, result: SynthesisResult, target: str, key: str, *, task: str = "classification", using="llmfe") -> dict[str, float]:
    """The signed score of the table before and after, by the same models and folds, and by how many percent it got better."""
    before, after = (evaluation.evaluate_features(t, target, key, task=task, using=using) for t in (df, result.table))
    return {"before": before, "after": after, "improvement_pct": 100.0 * (after - before) / abs(before) if before else 0.0}
