"""Evolutionary search for features: islands of programs in the feature language, proposed by an adapter and scored by cross-validation."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import language
from ..models import metrics, registry
from ..models.evaluation import metric_for
from ..models.limits import within
from ..operators.association import prepare
from ..sources.readers import list_files
from ..sources.writers import append_history


class LLMClient(Protocol):
    """Anything that completes a prompt."""

    def complete(self, prompt: str) -> str: ...


class StubLLM:
    """Proposes programs from a fixed list, or simple ones from the prompt's columns; needs no network."""

    def __init__(self, programs: list[str] | None = None, seed: int = 42):
        self.programs, self.rng = list(programs or []), random.Random(seed)

    def complete(self, prompt: str) -> str:
        if self.programs:
            return self.programs.pop(0)
        columns = json.loads(prompt.rsplit("COLUMNS ", 1)[1].splitlines()[0])
        numeric = columns["numeric"] or ["1"]
        a, b = self.rng.choice(numeric), self.rng.choice(numeric)
        return self.rng.choice([f"f_{a}_{b} = {a} * {b}", f"f_{a} = square({a})", f"f_{a}_over_{b} = {a} / {b}", f"f_log_{a} = logarithm(absolute({a}) + 1)"])


class RetryingLLM:
    """Tries again, after 2 and then 4 seconds, when a client fails or says nothing."""

    def __init__(self, client: LLMClient, tries: int = 3, wait: Callable[[float], None] | None = None):
        import time

        self.client, self.tries, self.wait = client, tries, wait or time.sleep

    def complete(self, prompt: str) -> str:
        error: Exception | None = None
        for i in range(self.tries):
            try:
                if text := self.client.complete(prompt):
                    return text
                error = RuntimeError("an empty answer")
            except (ConnectionError, TimeoutError, RuntimeError) as e:
                error = e
            if i + 1 < self.tries:
                self.wait(2.0 * (i + 1))
        raise RuntimeError(f"no answer after {self.tries} tries") from error


@dataclass
class Sample:
    sample_order: int
    function: str
    score: float | None
    error: str | None = None
    island: int = 0


@dataclass
class Island:
    """Programs clustered by score; a cluster is drawn by softmax, then a program of it, shorter ones likelier."""

    clusters: dict[float, list[str]] = field(default_factory=dict)
    count: int = 0

    def add(self, program: str, score: float) -> None:
        self.clusters.setdefault(round(score, 8), []).append(program)
        self.count += 1

    def draw(self, rng: random.Random, n: int = 2) -> list[tuple[float, str]]:
        if not self.clusters:
            return []
        heat = max(1e-6, 0.1 * (1 - (self.count % 30_000) / 30_000))
        scores = sorted(self.clusters)
        top = max(scores)
        chosen = rng.choices(scores, [math.exp(max(-700.0, (s - top) / heat)) for s in scores], k=min(n, len(scores)))
        out = []
        for s in chosen:
            programs = self.clusters[s]
            least, spread = min(map(len, programs)), max(1, max(map(len, programs)) - min(map(len, programs)))
            out.append((s, rng.choices(programs, [math.exp(-(len(p) - least) / spread) for p in programs])[0]))
        return sorted(out)

    @property
    def best(self) -> tuple[float, str] | None:
        return max(((s, p[0]) for s, p in self.clusters.items()), default=None)


#: A row of a population's log: proposals (``sample``), the empty program that islands begin with (``baseline``), and those that an island begins anew with (``founder``, with the next epoch of the island). Scores are signed: more is better.
POPULATION = "sample_order int, island int, epoch int, origin string, function string, score double, error string"


@dataclass
class Population:
    """Islands, and the rows that they come from. With a ``path``, every round's rows are appended to a log there."""

    n_islands: int
    spark: SparkSession | None = None
    path: str | None = None
    rows: list[tuple] = field(default_factory=list)
    epochs: list[int] = field(default_factory=list)
    islands: list[Island] = field(default_factory=list)

    def __post_init__(self):
        self.epochs, self.islands = [0] * self.n_islands, [Island() for _ in range(self.n_islands)]

    def take(self, rows: list[tuple]) -> list[tuple]:
        """Take in rows of the log's columns."""
        for order, at, epoch, _, program, score, _ in rows:
            if epoch > self.epochs[at]:
                self.epochs[at], self.islands[at] = epoch, Island()
            if epoch == self.epochs[at] and score is not None:
                self.islands[at].add(program, score)
        self.rows += rows
        return rows

    def write(self, rows: list[tuple]) -> None:
        """Append a round's rows to the log, all of them or none."""
        if self.path:
            append_history(self.spark.createDataFrame(rows, POPULATION).coalesce(1), self.path)

    def samples(self) -> list[tuple]:
        return [r for r in self.rows if r[3] == "sample"]

    def founders(self, rng: random.Random) -> list[tuple]:
        """The weaker half of the islands, begun anew from the best of a surviving one."""
        order = sorted(range(self.n_islands), key=lambda i: self.islands[i].best or (-math.inf, ""))
        half = self.n_islands // 2
        survivors = [self.islands[i].best for i in order[half:] if self.islands[i].best]
        made = []
        for i in order[:half] if survivors else []:
            score, program = rng.choice(survivors)
            made.append((len(self.samples()), i, self.epochs[i] + 1, "founder", program, score, None))
        return made


def read_population(spark: SparkSession, path: str, n_islands: int, upto: int | None = None) -> Population:
    """The population of a log (rows of no later sample than ``upto``), rebuilt by aggregates: of each island the rows of its last
    epoch, in clusters of equal score, with their programs in order."""
    log = spark.read.schema(POPULATION).parquet(path)
    log = log if upto is None else log.where(F.col("sample_order") <= upto)
    out = Population(n_islands, spark, path)
    latest = log.groupBy("island").agg(F.max("epoch").alias("epoch"))
    for r in latest.collect():  # a row an island
        out.epochs[r.island] = r.epoch
    place = F.struct("sample_order", F.when(F.col("origin") == "sample", 0).otherwise(1).alias("after"), "function")
    alive = log.where("score IS NOT NULL").join(F.broadcast(latest), ["island", "epoch"])
    clusters = alive.groupBy("island", F.round("score", 8).alias("key")).agg(F.sort_array(F.collect_list(place)).alias("all"), F.count("*").alias("n"))
    for r in clusters.orderBy("island", F.element_at("all", 1)).collect():  # the programs of a search
        out.islands[r.island].clusters[r.key] = [x.function for x in r["all"]]
        out.islands[r.island].count += r.n
    out.rows = [tuple(r) for r in log.orderBy("sample_order", F.col("origin") != "baseline", F.col("origin") != "sample", "island").collect()]
    return out


@dataclass
class SearchResult:
    best: str
    best_score: float | None
    baseline: float | None
    samples: list[Sample]
    table: DataFrame | None = None


def evolve(
    df: DataFrame, target: str, key: str, client: LLMClient, *, task: str = "classification", metric: str | None = None, samples: int = 10, n_islands: int = 3, per_prompt: int = 2, models: tuple[str, ...] = ("decisiontree",), k: int = 3, seed: int = 42, reset_every: int = 50,
    path: str | None = None, seconds_a_sample: float | None = None,
) -> SearchResult:
    """Search programs that better the cross-validated metric, in its own direction. Programs that aren't in the language, fail, or
    take longer than ``seconds_a_sample`` are logged without a score.

    With a ``path`` every round is appended to a log there, and a search goes on from what the log has: a search that was broken
    off and is begun again makes the samples that it would have made in one go, as far as the client's answers depend on its
    prompts alone. Chance comes from the seed and the number of the sample.
    """
    metric = metric_for(df, target, task, metric)
    spark = df.sparkSession

    def score(program: str) -> float:
        made = language.apply(df, program, protected=(target, key))
        features = [c for c in made.columns if c not in (target, key)]
        data = prepare(made, [*features, key], target).withColumnRenamed("_y", target)
        found = registry.cross_validate(data, features, target, key, task=task, models=list(models), k=k, seed=seed)
        return metrics.SIGN[metric] * sum(r.mean(metric) for r in found.values()) / len(found)

    if path and _begun(spark, path):
        have = read_population(spark, path, n_islands)
    else:
        have = Population(n_islands, spark, path)
        baseline = score("")
        have.write(have.take([(0, i, 0, "baseline", "", baseline, None) for i in range(n_islands)]))
    baseline = have.rows[0][5]
    seen = {language.signature(r[4]): r[5] for r in reversed(have.samples()) if r[5] is not None}
    numeric = [f.name for f in df.schema.fields if f.name not in (target, key) and f.dataType.typeName() in ("double", "float", "integer", "long", "short")]

    def rate(program: str) -> tuple[float | None, str | None]:
        try:
            mark = language.signature(program)
            if mark not in seen:
                seen[mark] = within(seconds_a_sample, lambda: score(program), spark)
            return seen[mark], None
        except Exception as e:  # a proposal may be anything; its failure is a result
            return None, f"{type(e).__name__}: {str(e)[:200]}"

    while (done := len(have.samples())) < samples:
        begin = done - done % per_prompt  # where this round began: it may have been broken off
        then = have if begin == done else read_population(spark, path, n_islands, begin) if path else have
        rng = random.Random(f"{seed}:{begin}")
        at = rng.randrange(n_islands)
        prompt = build_prompt(df, target, numeric, then.islands[at].draw(rng), rng)
        made = []
        for order in range(begin + 1, begin + per_prompt + 1):
            program = client.complete(prompt)
            if done < order <= samples:
                made.append((order, at, have.epochs[at], "sample", program, *rate(program)))
        have.take(made)
        begun_anew = have.take(have.founders(random.Random(f"{seed}:reset:{done + len(made)}"))) if (done + len(made)) // reset_every > done // reset_every else []
        have.write(made + begun_anew)
    sign = metrics.SIGN[metric]
    log = [Sample(r[0], r[4], None if r[5] is None else sign * r[5], r[6], r[1]) for r in have.samples()]
    top = max((i.best for i in have.islands if i.best), key=lambda b: b[0])
    return SearchResult(top[1], sign * top[0], sign * baseline, log, language.apply(df, top[1], protected=(target, key)))


def _begun(spark: SparkSession, path: str) -> bool:
    try:
        return bool(list_files(spark, path, ".parquet"))
    except FileNotFoundError:
        return False


def build_prompt(df: DataFrame, target: str, numeric: list[str], ancestors: list[tuple[float, str]], rng: random.Random) -> str:
    """What a client is asked; the operators are listed one time in three, else the task's domain is stressed."""
    lines = [f"Propose features that help to predict {target}, one 'name = expression' a line."]
    lines.append("Operators: " + ", ".join(sorted({*language.OPERATORS, *language.TABLE_OPERATORS, "combine_frequency"})) if rng.random() < 1 / 3 else "Use what the columns mean in their domain.")
    lines += [f"# score {s:.6f}\n{p}" for s, p in ancestors if p]
    lines.append("COLUMNS " + json.dumps({"numeric": numeric, "all": [c for c in df.columns if c != target]}))
    return "\n".join(lines)


def samples_table(spark, samples: list[Sample]) -> DataFrame:
    return spark.createDataFrame([(s.sample_order, s.function, s.score, s.error, s.island) for s in samples], "sample_order int, function string, score double, error string, island int")
