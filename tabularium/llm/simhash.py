"""SimHash near-dedup: 64-bit fingerprints of 3-word shingles, linked at two or fewer differing bits.

Candidates come from deletion-variant signatures. The fingerprint is cut into two segments of 32 bits, fewer than the
three that would guarantee an equal one; of two linked fingerprints one segment differs by at most one bit. Each
segment is indexed once for each bit position with that bit made a wildcard: two segments differ by at most one bit
exactly if they share such a variant. An equality join of the variants gives candidate pairs, and the full distance is
checked on each.

Buckets of variants that hold more than ``BUCKET`` fingerprints (families of near copies) would make pairs in the
square of their size. The fingerprints in them are joined in the exact way below instead, which sets no cap: each emits
its 65 full-width neighbours (itself and each one-bit change). Two fingerprints differ in at most two bits exactly if
they share a neighbour, and at most 65 fingerprints share one, so a star from the least of them keeps every link's
component, in rows linear in the family's size.

Only distinct fingerprints are indexed; copies follow by a join. Components are found by alternating large-star and
small-star steps, in rows, with a checkpoint after each round.

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer words than three
are one shingle; shingles repeat; all shingles of a long text count, hashed in blocks; repeated rows and repeated keys
stay rows; a null key stays, and is a component's id only if no other key is in it; keys may be of any type that has an
order, ties between keys don't arise (equal keys name the same component); an empty table gives no rows; other columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_ASCII, by_text, checkpointed, quoted

BITS, SEGMENT, SEED, SHINGLE, DISTANCE = 64, 32, 42, 3, 2
#: Fingerprints of a variant's bucket that are still compared pair by pair.
BUCKET = 16
#: Shingles of a text that are hashed at once.
BLOCK = 1 << 14


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return 0
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    n = len(words) - SHINGLE + 1
    del words
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        stop = min(n, at + BLOCK)
        begins = ends[at - 1 : stop - 1].tolist() if at else [0, *ends[: stop - 1].tolist()]
        h = np.array([digest(line[a:b], SEED) for a, b in zip(begins, (ends[at + SHINGLE - 1 : stop + SHINGLE - 1] - 1).tolist())], np.uint64)
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprint_column(texts: list) -> pa.Array:
    return pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long. ``keep`` names columns to carry along."""
    fp = by_text("bigint", _fingerprint_column)(quoted(text).cast("string"))
    return docs.select(quoted(key).alias("doc_id"), fp.alias("fp"), *[quoted(k) for k in keep])


def _variants(fps: DataFrame) -> DataFrame:
    """(segment, bit, key, fp): both segments of each fingerprint with each bit in turn made a wildcard.

    Segment, wildcard position and the other 31 bits are packed into one long. The fingerprints, 8 bytes each, come in
    few partitions; they are dealt out anew before each becomes 64 rows.
    """
    fps = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    mask = F.lit((1 << SEGMENT) - 1)
    parts = [(i, F.expr(f"shiftright(fp, {SEGMENT * i})").bitwiseAND(mask)) for i in range(BITS // SEGMENT)]
    keys = [
        part.bitwiseAND(F.lit(((1 << SEGMENT) - 1) ^ (1 << bit))).bitwiseOR(F.lit((i << 5 | bit) << SEGMENT).cast("long"))
        for i, part in parts
        for bit in range(SEGMENT)
    ]
    return fps.select("fp", F.explode(F.array(*keys)).alias("variant"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b), a < b: links between distinct fingerprints, enough of them to connect every two within the distance.

    ``fps`` holds distinct fingerprints in ``fp``, and is read several times: hand it over checkpointed.
    """
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    size = F.count("*").over(Window.partitionBy("variant"))  # its rows are distinct fingerprints of 8 bytes, and spill; nearly all are alone, so counting them first would move as many
    members = checkpointed(_variants(fps).withColumn("n", size).where("n > 1"))
    few = members.where(F.col("n") <= BUCKET)
    pairs = few.select("variant", F.col("fp").alias("a")).join(few.select("variant", F.col("fp").alias("b")), "variant").where("a < b").select("a", "b").where(close)
    many = members.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")) for b in range(BITS)])
    near = many.select("fp", F.explode(flips).alias("neighbour")).groupBy("neighbour").agg(F.collect_set("fp").alias("fps"))  # at most 65 of them
    stars = near.where(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node that an edge (a, b) touches.

    Large-star and small-star in turn (each points a node's neighbours to the least of them), until nothing changes.
    Both are built of aggregates with partial minima and a join, so no node's neighbours are ever gathered.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())  # v > u
    before = None
    while True:
        both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = checkpointed(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")))  # read anew, the join's inputs are plain exchanges, which can be split where a node is hot
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").distinct()
        large = checkpointed(large)
        down = checkpointed(large.groupBy("v").agg(F.min("u").alias("m")))
        small = large.join(down, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u").union(down.select("v", F.col("m").alias("u"))).distinct()
        edges = checkpointed(small)
        state = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(v, u))").alias("x"), F.sum(F.col("u").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            break
        before = state
    return edges.groupBy("v").agg(F.min("u").alias("root")).withColumnRenamed("v", "node")


def _rooted(classes: DataFrame) -> DataFrame:
    """(fp, least, root): the component of each distinct fingerprint of (fp, least), named by its least fingerprint."""
    root = components(links(classes.select("fp")))
    return checkpointed(classes.join(root, classes.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    rows = checkpointed(fingerprints(docs, key, text))
    named = _rooted(checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least"))))
    smallest = checkpointed(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = named.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_rows(docs: DataFrame, row: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``row``): of each component the row of the least key and, of equal keys, the least ``row``; null keys come last.

    The column ``row`` must tell rows apart whose key or text differ.
    """
    rows = fingerprints(docs, key, text, (row,))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", quoted(row)))
    named = _rooted(checkpointed(rows.groupBy("fp").agg(first.alias("least"))))
    return checkpointed(named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least").getField(row).alias(row)))
