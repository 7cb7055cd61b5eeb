"""Writers: CSV, Parquet features, JSON rows, predictions, leaderboards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODES = {"w": "overwrite", "x": "error", "a": "append"}


def flatten_lists(df: DataFrame) -> DataFrame:
    """List columns as comma-separated text, for formats without lists."""
    return df.select(*[F.array_join(F.transform(f.name, lambda x: x.cast("string")), ",").alias(f.name) if isinstance(f.dataType, T.ArrayType) and not isinstance(f.dataType.elementType, T.StructType) else F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, *, sep: str = ",", mode: str = "w", header: bool = True, null: str = "", single: bool = False) -> str:
    """CSV files below ``path`` (``.csv`` is added). ``single`` makes one file, for small tables only."""
    if not path.endswith(".csv"):
        path += ".csv"
    out = flatten_lists(df)
    (out.coalesce(1) if single else out).write.mode(MODES[mode]).csv(path, sep=sep, header=header, nullValue=null, emptyValue="")
    return path


def write_features(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_pair(train: DataFrame, test: DataFrame | None, folder: str, form: str = "parquet") -> list[str]:
    """The transformed training table, and the test table if there is one: ``<folder>/train.<form>`` and ``test.<form>``."""
    write = write_features if form == "parquet" else write_csv
    return [write(t, f"{folder}/{name}.{form}") for name, t in (("train", train), ("test", test)) if t is not None]


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def write_predictions(predictions: DataFrame, path: str) -> str:
    return write_csv(predictions, path)


def append_history(df: DataFrame, path: str) -> str:
    """An append-only log."""
    df.write.mode("append").parquet(path)
    return path
