"""Document fingerprints by winnowing.

Every run of ``GRAM`` code points is hashed (a polynomial over the code points, from running sums modulo 2**64), and of
each ``WINDOW`` consecutive runs the one with the least hash is picked, the rightmost of equal ones. The picked hashes
with their positions are the fingerprint: two texts that share a passage of ``GRAM + WINDOW - 1`` code points share a
picked hash in it. The likeness of two fingerprints is the share of their distinct hashes that both have.

``with_next`` compares each document with an edit of it (its second half replaced by the beginning of the next document)
and with the next document, in falling order of the key. Documents are dealt by ranges of the key, each range to a task,
so texts are shuffled once; the first document of each range goes to the range before it as a guest, too (that of the
first to the last). Bounds of ranges come from the keys alone. A key with more rows than a range should hold gets ranges
of its own, by the sha256 of the texts; its rows alike in text too are first counted, and followed by one another.

Defined cases: a null text is an empty one, whose fingerprint is empty (alike to another empty one, unlike any other); a
text shorter than a run is one run; one of fewer runs than a window is one window; a long text is winnowed in pieces that
overlap, with the same result; null keys come last; rows that share a key are in order of their texts' sha256, and rows
alike in both follow one another; a single document is followed by itself; an empty table gives no rows; keys may be of
any type that has an order; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import bounds
from .common import bounded_batches, by_text, checkpointed, cuts, quoted, span_hashes

GRAM, WINDOW = 16, 64
#: Code points that are winnowed at once.
BLOCK = 1 << 18
#: Rows of a key from which it may get ranges of its own.
COPIES = 1000
NONE = np.uint64(2**64 - 1)


def _pieces(texts: list[str], gram: int, window: int) -> list[tuple[int, int, str]]:
    """(text, offset, part): long texts cut so that each window is whole in one part."""
    out = []
    for i, t in enumerate(texts):
        last = max(1, len(t) - gram - window + 2)  # windows
        out += [(i, at, t[at : at + min(BLOCK, last - at) + gram + window - 2] if last > 1 else t) for at in range(0, last, BLOCK)]
    return out


def winnow(texts: list[str | None], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, positions) of each text, in order of position."""
    texts = [t or "" for t in texts]
    pieces = _pieces(texts, gram, window)
    found: list[list] = [[] for _ in texts]
    for a, b in cuts(np.array([len(p[2]) for p in pieces], np.int64), BLOCK) if pieces else []:
        for (i, at, _), (h, pos) in zip(pieces[a:b], _winnow_block([p[2] for p in pieces[a:b]], gram, window)):
            found[i].append((h, pos + at))
    out = []
    for parts in found:
        h, pos = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        new = np.append(True, pos[1:] != pos[:-1])[: len(pos)]  # a run picked on both sides of a cut
        out.append((h[new], pos[new]))
    return out


def _winnow_block(texts: list[str], gram: int, window: int) -> list[tuple[np.ndarray, np.ndarray]]:
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + window) - size - window  # each text is followed by a gap as wide as a window
    runs = np.where(size > 0, np.maximum(size - gram + 1, 1), 0)
    codes = np.frombuffer((" " * window).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    text = np.repeat(np.arange(len(texts)), runs)
    place = np.arange(len(text)) - np.repeat(np.cumsum(runs) - runs, runs)
    begin = start[text] + place
    h = span_hashes(codes, begin, begin + np.minimum(size, gram)[text])
    least = np.full(len(codes) + window, NONE)
    least[begin] = (h >> np.uint64(32)) << np.uint64(32) | (np.uint64(2**32 - 1) - place.astype(np.uint64))  # of equal hashes the rightmost is least
    have = 1
    while have < window:  # minima over twice as many runs at a time
        step = min(have, window - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    picked = least[begin[place <= np.maximum(runs - window, 0)[text]]]
    count = np.where(runs > 0, np.maximum(runs - window + 1, 1), 0)
    of = np.repeat(np.arange(len(texts)), count)
    new = np.ones(len(picked), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (of[1:] != of[:-1])
    picked, of = picked[new], of[new]
    edge = np.searchsorted(of, np.arange(len(texts) + 1))
    hashes, positions = (picked >> np.uint64(32)).astype(np.uint32), (2**32 - 1 - (picked & np.uint64(2**32 - 1)).astype(np.int64))
    return [(hashes[a:b], positions[a:b]) for a, b in zip(edge, edge[1:])]


def as_string(hashes: np.ndarray) -> str:
    """Eight hex digits a picked hash, in order of position."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Of the distinct hashes (sorted) of either, the share that both have; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate((a, b)))
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same)


def fingerprint(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """The picked hashes of a text and their positions, as an array of structs."""
    kind = pa.struct([("hash", pa.int64()), ("pos", pa.int64())])

    def work(texts: list) -> pa.Array:
        found = winnow(texts, gram, window)
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([f[i] for f in found]).astype(np.int64)) for i in (0, 1)], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(f[0]) for f in found]]), pa.int32()), flat)

    return by_text("array<struct<hash:long,pos:long>>", work, 1_000_000)(text.cast("string"))


def edited(text: str, following: str) -> str:
    """``text`` with its second half replaced by as much of the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(base: DataFrame, parts: int) -> tuple[Column, int, list]:
    """The range of a row of (doc_id, text, digest) in falling order of the key, the number of ranges, and the keys that have ranges of their own."""
    keys = checkpointed(base.groupBy("doc_id").agg(F.count("*").alias("n")))
    total = keys.agg(F.sum("n")).first()[0] or 0
    share = max(COPIES, -(-total // parts))
    crowded = {r.doc_id: r.n for r in keys.where(F.col("n") > share).collect()}  # fewer than ranges
    found = bounds(keys, "doc_id", (), parts).first() if parts > 1 else None
    known = [k for k in crowded if k is not None]
    edges = sorted({*((found and found["_bounds"]) or []), *known} - {None})
    # slots: 0 for null keys, then, alternately, keys above the edge before and up to this one, and the edge itself if it is crowded
    own = {k: 2 * bisect_left(edges, k) + 2 for k in known}
    width = [0 if i % 2 == 0 and i else 1 for i in range(2 * len(edges) + 3)]
    for k, n in crowded.items():
        width[own[k] if k is not None else 0] = -(-n // share)
    first = [sum(width[i + 1 :]) for i in range(len(width))]
    pick = lambda table, slot: F.element_at(F.array(*[F.lit(x) for x in table]), slot + 1)
    slot = F.lit(1) if not edges else 2 * F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("doc_id"))) + 1
    if known:
        slot = slot + F.when(F.col("doc_id").isin(known), 1).otherwise(0)
    slot = F.when(F.col("doc_id").isNull(), 0).otherwise(slot).cast("int")
    part = pick(first, slot)
    if crowded:  # a crowded key's ranges go by the sha256 of the text
        part = part + F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * pick(width, slot) / F.lit(2.0**32))
    return part.cast("int"), sum(width), list(crowded)


RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, copies long"


def with_next(spark: SparkSession, docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every row."""
    bounded_batches(spark)
    schema = f"doc_id {docs.schema[key].dataType.simpleString()}, {RESULT}"
    base = docs.select(quoted(key).alias("doc_id"), F.coalesce(quoted(text).cast("string"), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    part, n, crowded = _ranges(base, int(spark.conf.get("spark.sql.shuffle.partitions")))
    base = base.withColumn("part", part)

    largest = F.max(F.struct(F.col("doc_id").isNotNull().alias("there"), "doc_id"))
    heads = checkpointed(base.groupBy("part").agg(largest.alias("h")).select("part", F.col("h.doc_id").alias("head")))  # a row a range
    filled = sorted(r.part for r in heads.select("part").collect())
    if not filled:
        return spark.createDataFrame([], schema).drop("copies")
    before = dict(zip(filled, [filled[-1], *filled]))
    follows = F.element_at(F.array(*[F.lit(before.get(p, 0)) for p in range(n)]), F.col("part") + 1)
    heads = heads.withColumnRenamed("part", "in")
    own = base.join(F.broadcast(heads), (F.col("part") == F.col("in")) & F.col("doc_id").eqNullSafe(F.col("head")))
    guests = own.groupBy("part").agg(F.min_by(F.struct("doc_id", "text", "digest"), "digest").alias("g"))
    guests = guests.select("g.doc_id", "g.text", "g.digest", follows.alias("part"), F.lit(0).cast("long").alias("copies"))

    rows = base.withColumn("copies", F.lit(1).cast("long"))
    if crowded:
        held = F.coalesce(F.col("doc_id").isin([k for k in crowded if k is not None]), F.lit(False)) if set(crowded) - {None} else F.lit(False)
        held = held | F.col("doc_id").isNull() if None in crowded else held
        alike = rows.where(held).groupBy("doc_id", "digest", "part").agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
        rows = rows.where(~held).unionByName(alike)
    dealt = rows.unionByName(guests).repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("copies") == 0, F.desc_nulls_last("doc_id"), "digest")
    out = dealt.select("doc_id", "text", "copies").mapInArrow(_compare, schema)
    if crowded:
        out = out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.drop("copies")


def _compare(batches):
    """A range's rows in order, each beside the next: the results of all but guests (which have no copies)."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        if batch.num_rows > 1:
            yield from _compared(batch)
        held = batch.slice(max(0, batch.num_rows - 1))
        pa.default_memory_pool().release_unused()  # workers stay alive between stages


def _compared(batch: pa.RecordBatch):
    texts, copies = batch.column(1).to_pylist(), batch.column(2).to_pylist()
    for a, b in cuts(np.array([len(t) for t in texts[:-1]], np.int64), BLOCK):
        at = [i for i in range(a, b) if copies[i]]
        if not at:
            continue
        picked = [h for h, _ in winnow(texts[a : b + 1])]
        distinct = [np.unique(h) for h in picked]
        pairs = [(i, i, copies[i] - 1) for i in at if copies[i] > 1] + [(i, i + 1, 1) for i in at]
        other = [edited(texts[i], texts[j]) for i, j, _ in pairs]
        changed = [h for h, _ in winnow(other)]
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array([i for i, _, _ in pairs], pa.int64())),
            pa.array([len(texts[i]) for i, _, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in other]),
            pa.array([as_string(picked[i - a]) for i, _, _ in pairs]),
            pa.array([as_string(h) for h in changed]),
            pa.array([likeness(distinct[i - a], np.unique(h)) for (i, _, _), h in zip(pairs, changed)], pa.float64()),
            pa.array([likeness(distinct[i - a], distinct[j - a]) for i, j, _ in pairs], pa.float64()),
            pa.array([n for _, _, n in pairs], pa.int64()),
        ], names=["doc_id", *(c.split()[0] for c in RESULT.split(", "))])
