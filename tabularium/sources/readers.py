"""Readers: CSV in several dialects, train and test pairs, report JSON, evaluation logs, built-in examples."""

from __future__ import annotations

import math
import random
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import trim_names

SAMPLE_SCHEMA = "sample_order int, function string, score double, timestamp string, _corrupt_record string"
SEPARATORS = (",", ";", "\t", "|")


def list_files(spark: SparkSession, folder: str, suffix: str = ".csv") -> list[str]:
    """Names of the files of a folder, in any store that Spark reads; FileNotFoundError if there is no such folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        raise FileNotFoundError(folder)
    return sorted(str(s.getPath()) for s in fs.listStatus(path) if s.getPath().getName().lower().endswith(suffix))


def detect_separator(spark: SparkSession, path: str) -> str:
    """The most frequent of , ; tab | in the first line, the first of equals."""
    first = spark.read.text(path).limit(1).collect()
    counts = [first[0][0].count(s) if first else 0 for s in SEPARATORS]
    return SEPARATORS[counts.index(max(counts))] if max(counts) else ","


def read_csv(spark: SparkSession, path: str, *, sep: str | None = None, encoding: str = "UTF-8", schema: str | None = None, dates: tuple[str, ...] = (), strict: bool = False, index: str | int | None = None) -> DataFrame:
    """One CSV with a header; the separator is looked for if none is given, and where that leaves one column a comma and then a
    semicolon are tried. ``strict``: malformed rows are an error, found when the rows are read. ``index``: a column (name or
    number) that becomes ``_row_id``. A file that isn't there is a FileNotFoundError, one that can't be read as CSV a ValueError."""
    try:
        tried = [sep] if sep else list(dict.fromkeys([detect_separator(spark, path), ",", ";"]))
        for mark in tried:
            reader = spark.read.option("header", True).option("sep", mark).option("encoding", encoding).option("mode", "FAILFAST" if strict else "PERMISSIVE")
            df = trim_names((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))
            if len(df.columns) > 1:
                break
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise ValueError(f"{path} can't be read as CSV: {str(e)[:300]}") from e
    if index is not None:
        name = df.columns[index] if isinstance(index, int) else index
        df = df.withColumnRenamed(name, "_row_id")
    return df.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in dates})


def read_train_test(spark: SparkSession, folder: str, *, train: str = "train", test: str = "test", **options) -> tuple[DataFrame, DataFrame | None]:
    """The CSV files of a folder whose names hold the patterns: one for training, at most one for testing."""
    files = list_files(spark, folder)
    if not files:
        raise FileNotFoundError(f"no CSV in {folder}")
    found = {p: [f for f in files if p.lower() in PurePosixPath(f).stem.lower()] for p in (train, test)}
    if not found[train]:
        raise FileNotFoundError(f"no file named like {train} in {folder}")
    for p, names in found.items():
        if len(names) > 1:
            raise ValueError(f"several files are named like {p}: {names}")
    return read_csv(spark, found[train][0], **options), read_csv(spark, found[test][0], **options) if found[test] else None


def resolve_dataset(spark: SparkSession, folder: str, name: str) -> str:
    """The first of train.csv, <name>.csv and data.csv that is there."""
    files = {PurePosixPath(f).name: f for f in list_files(spark, folder)}
    for candidate in ("train.csv", f"{name}.csv", "data.csv"):
        if candidate in files:
            return files[candidate]
    raise FileNotFoundError(f"no data set in {folder}")


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation log, a JSON file a sample; half-written files are skipped."""
    return spark.read.schema(SAMPLE_SCHEMA).option("mode", "PERMISSIVE").option("multiLine", True).option("pathGlobFilter", "sample_*.json").json(folder).where("_corrupt_record IS NULL AND sample_order IS NOT NULL").drop("_corrupt_record")


def stream_samples(spark: SparkSession, folder: str) -> DataFrame:
    """The same log as a stream of newly appearing files."""
    return spark.readStream.schema(SAMPLE_SCHEMA).option("multiLine", True).option("pathGlobFilter", "sample_*.json").json(folder).where("_corrupt_record IS NULL AND sample_order IS NOT NULL").drop("_corrupt_record")


def example(spark: SparkSession, name: str, rows: int = 150, seed: int = 42) -> DataFrame:
    """Small made-up tables to try things on: ``blobs`` (3 classes), ``moons`` (2 classes), ``line`` (regression), ``digits`` (10 classes)."""
    rng, out = random.Random(seed), []
    for i in range(rows):
        if name == "line":
            x = [rng.gauss(0, 1) for _ in range(4)]
            out.append((i, *x, 3 * x[0] - 2 * x[1] + rng.gauss(0, 0.1)))
            continue
        k = {"blobs": 3, "moons": 2, "digits": 10}.get(name)
        if k is None:
            raise ValueError(f"no example {name}")
        c = i % k
        angle = 2 * math.pi * c / k
        out.append((i, *[3 * f(angle * (1 + j)) + rng.gauss(0, 0.6) for j in range(2) for f in (math.cos, math.sin)], float(c)))
    return spark.createDataFrame(out, "row_id long, x0 double, x1 double, x2 double, x3 double, target double")
