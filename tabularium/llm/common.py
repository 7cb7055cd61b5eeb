"""Helpers shared by the corpus operators: bounded samples, shared folders, ranges of an order, and byte-level word scanning in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..sources.shared import checkpointed, remove, shared_dir  # noqa: F401  the operators take them from here

#: Most characters that a batch of texts holds while it is worked on in Python.
BATCH_CHARS = 4_000_000
#: Most characters of a text, and of a sample, that a model is fitted on; of longer texts so many stretches are taken, evenly from begin to end.
SAMPLE_CHARS, SAMPLE_TOTAL, STRETCHES = 200_000, 60_000_000, 20


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: each row's place in the order, from 1 (ties in any order).

    Rows are dealt by ranges of the order and written with their range, as its bounds are sampled anew whenever it is
    computed. Each range is numbered apart, and what the ranges before it hold is added from a row a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    totals = cut.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return cut.withColumn(name, nth).join(F.broadcast(totals), "_part").select(*[quoted(c) for c in df.columns], (F.col(name) + F.col("_before")).cast("long").alias(name))


#: Schemes that Hadoop and pyarrow call by different names.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs"}


def filesystem(uri: str):
    """The pyarrow filesystem of a URI (a plain path counts as local) and the path in it."""
    import pyarrow.fs as pafs

    scheme, mark, rest = uri.partition("://")
    uri = f"{SCHEMES.get(scheme, scheme)}://{rest}" if mark else "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def key_remainder(column: str, modulus: int):
    """crc32 of the key as text, modulo ``modulus`` (null where the key is null)."""
    return F.crc32(quoted(column).cast("string")) % F.lit(modulus)


def picked_rows(df: DataFrame, stratum: str, per_stratum: int, identity: list[str]) -> DataFrame:
    """(s, h): at most ``per_stratum`` row hashes of each value of ``stratum``, the same at every run.

    ``h`` is a hash of the ``identity`` columns. The smallest is kept for each of ``per_stratum`` buckets of hashes of
    a stratum: an ordinary aggregate with partial minima, so one large stratum costs no more than many small ones, and
    the result is bounded by strata x ``per_stratum`` rows.
    """
    h = F.xxhash64(F.lit(7), *[quoted(c) for c in identity])
    rows = df.where(quoted(stratum).isNotNull()).select(quoted(stratum).alias("s"), h.alias("h"))
    return rows.groupBy("s", F.pmod("h", F.lit(per_stratum)).alias("b")).agg(F.min("h").alias("h")).select("s", "h")


def excerpts(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` of a bounded sample with whole texts, or stretches of those above the limit, which is the largest that keeps the
    sample within ``SAMPLE_TOTAL`` characters and no text above ``SAMPLE_CHARS``."""
    rows = checkpointed(rows)
    length = F.coalesce(F.char_length(quoted(text)), F.lit(0))
    sizes = sorted(r[0] for r in rows.select(length).collect())  # a number a picked row
    left, most = SAMPLE_TOTAL, SAMPLE_CHARS
    for i, n in enumerate(sizes):
        if n > left // (len(sizes) - i):
            most = min(most, left // (len(sizes) - i))
            break
        left -= n
    piece = max(1, most // STRETCHES)
    gap = (length - piece) / float(STRETCHES - 1)
    spread = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.substring(quoted(text), F.floor(i * gap).cast("int") + 1, F.lit(piece)))
    return rows.withColumn(text, F.when(length > max(most, STRETCHES), F.array_join(spread, "\n")).otherwise(quoted(text)))


def cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Bounds of slices of a batch that hold about ``most`` bytes and at least one row."""
    part = np.cumsum(sizes + 64) // most
    edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return [(a, b) for a, b in zip(edge, edge[1:]) if b > a]


def _sizes(column) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def slices(batches, columns: tuple[str, ...] = ("doc_id", "text"), chars: int = BATCH_CHARS):
    """Lists of the named columns, cut so that a slice holds about ``chars`` bytes of text and at least one row."""
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)) for c in columns]
        for a, b in cuts(_sizes(cols[columns.index("text")]), chars):
            yield [c.slice(a, b - a).to_pylist() for c in cols]
        pa.default_memory_pool().release_unused()  # workers stay alive between stages


#: Bytes of the batches in which texts go to Python, unless the session has a limit of its own.
ARROW_BYTES = 4_000_000


def bounded_batches(spark: SparkSession) -> None:
    """Cut Arrow batches by bytes: ten thousand rows, Spark's own limit, may be gigabytes of long texts."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if limit not in spark.conf.getAll:
        spark.conf.set(limit, str(ARROW_BYTES))


def by_text(kind: str, work: Callable[[list], pa.Array], chars: int = BATCH_CHARS):
    """A column function of texts (or binaries): ``work`` gets them in lists of about ``chars`` bytes, nulls included, and
    gives an Arrow array of as many values.

    Only the text goes to Python and only the result comes back; the row's other columns stay with Spark.
    """
    bounded_batches(SparkSession.active())
    empty = pa.nulls(0, to_arrow_type(DataType.fromDDL(kind)))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [work(column.slice(a, b - a).to_pylist()) for a, b in cuts(_sizes(column), chars)]
            yield pa.concat_arrays(found) if found else empty
            del found, column
            pa.default_memory_pool().release_unused()  # workers stay alive between stages

    return run


def by_rows(kind: str, work: Callable[[pa.Array], pa.Array]):
    """A column function of any values: ``work`` gets them as Arrow arrays, in batches cut by bytes."""
    bounded_batches(SparkSession.active())

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield work(column)

    return run


# --- words of UTF-8 bytes, found and hashed without a Python loop -------------------------------------------------

#: Bytes that are hashed at once.
HASH_BLOCK = 1 << 19
_R = 0x9E3779B97F4A7C15  # an odd multiplier: invertible modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**0..R**n and their inverses modulo 2**64, kept and grown as needed."""
    if len(_POWERS.get("r", ())) <= n:
        m = 1 << max(20, (n + 1).bit_length())
        inverse = pow(_R, -1, 1 << 64)
        for name, base in (("r", _R), ("i", inverse)):
            out = np.empty(m, np.uint64)
            out[0] = 1
            have, power = 1, base
            while have < m:  # doubling: R**(have + j) = R**have * R**j
                take = min(have, m - have)
                out[have : have + take] = out[:take] * np.uint64(power)
                have += take
                power = power * power % (1 << 64)
            _POWERS[name] = out
    return _POWERS["r"], _POWERS["i"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end] that depends on its bytes alone. Spans are in order and don't overlap.

    The work is done in blocks of spans, so the tables of powers and the sums stay small.
    """
    if len(data) > HASH_BLOCK and len(start) > 1:
        out, i = np.empty(len(start), np.uint64), 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + HASH_BLOCK, "right")))
            a = int(start[i])
            out[i:j] = _hash_block(data[a : int(end[j - 1])], start[i:j] - a, end[i:j] - a)
            i = j
        return out
    return _hash_block(data, start, end)


def _hash_block(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    r, inverse = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * r[: len(data)], out=prefix[1:])
    return _mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[str | None], breaker: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts (null: empty), each followed by ``breaker``, and where each text begins (and the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + len(breaker) for p in parts], out=starts[1:])
    return np.frombuffer(breaker.join(parts) + breaker if parts else b"", np.uint8), starts


#: Byte to byte: A-Z to a-z, all others kept.
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
