"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's share of the words wanted in all, at most ``most`` times what it has; the excess is
reshared by weight among the others. Every document of a source expects ``rate`` = target / source size copies. Within
the source the expected copies are summed up from document to document, one random offset is added, and a document is
taken once for each integer that its stretch of the sum crosses: floor or ceiling of its rate, never more than ``most``.

Documents are walked in order of size class (an eighth of a doubling wide) and then of a hash of key and text, so every size
has its due share and the words taken come near the target. All documents of a source share one rate, so the sum is
rank x rate, and only a rank is needed. It is summed up in levels, each by a window over a small table: the source's
documents in earlier size classes, those of the class with a lesser first half of the chunk's name, those with a lesser
second half, and the position in the chunk itself. Chunks (a source's size class, cut by hash prefix into pieces of
about ``CHUNK`` rows) are dealt separately, so a source or a size with a third of all rows is spread like any other, and
no window holds more than 65,536 rows of a level.

Targets come from plain aggregates over sources: the share of each by weight; sources whose limit that exceeds are
filled, what is left is shared among the others, and so on until none is above.

Defined cases: a null or blank text has size 0 and may be taken (it adds no words); a long text counts whole; sources
without words get the target 0 and are taken at no rate; a null source is a source, last in order; rows that share a key
are separate, and dealt apart if their texts differ; ties in class and hash are broken by size (of equal sizes it makes no difference which is taken); keys may
be of any type; an empty table gives no rows; reruns agree, as the offset comes from the source's name and the seed;
other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running_sum
from .common import checkpointed, quoted

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Rows a chunk that its rank is counted in, about, and most digits of a chunk's name.
CHUNK, DIGITS = 250, 8
#: Most rows (a source's size classes) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words of a text."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): one row a source.

    Sizes stay whole numbers until the last division.
    """
    total = checkpointed(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    named = total.where("source IS NOT NULL")
    placed = running_sum(named, "source", F.lit(1), "place").unionByName(total.where("source IS NULL").withColumn("place", F.lit(named.count() + 1)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long")
    rows = checkpointed(placed.select("source", "source_size", weight.alias("w"), (F.col("source_size") * most).alias("limit")))
    wanted = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    full, filled = F.lit(False), -1
    while True:  # what is left a weight only grows, so a source once full stays so
        taken, of, n = rows.agg(F.coalesce(F.sum(F.when(full, F.col("limit"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0)), F.count_if(full)).first()
        left = float(wanted - taken)
        if n == filled or not of:
            break
        filled = n
        full = full | (F.lit(left) * F.col("w") >= F.col("limit") * F.lit(float(of)))
    return rows.select("source", "source_size", F.when(full, F.col("limit").cast("double")).otherwise(F.lit(left) * F.col("w") / F.lit(float(of or 1))).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number from 0 to below 1 that depends on the source's name and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("\x00"))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def _before(df: DataFrame, by: list[str], order: str, name: str) -> DataFrame:
    """``df`` with the sum of ``n`` over the earlier rows of the same ``by``."""
    earlier = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source", rows_as: str | None = None) -> DataFrame:
    """Every row's doc_id, size, source_size, target, copies and taken (words). With ``rows_as`` the rows of ``docs`` follow as a struct of that name."""
    group = F.coalesce(F.concat(F.lit("="), quoted(source).cast("string")), F.lit(""))  # never null, so that joins and windows share a partitioning
    name = F.concat(F.coalesce(quoted(key).cast("string"), F.lit("")), F.lit(":"), F.coalesce(quoted(text).cast("string"), F.lit("")))
    sized = docs.select(quoted(key).alias("doc_id"), quoted(source).cast("string").alias("source"), group.alias("grp"), words(quoted(text)).alias("size"), F.md5(name).alias("hash"), *([F.struct(*[quoted(c) for c in docs.columns]).alias("whole")] if rows_as else []))
    step = F.expr("cast(size / power(2, greatest(length(bin(size)) - 4, 0)) as bigint)")
    sized = sized.withColumn("class", (F.length(F.bin("size")) * 16 + step).cast("int"))
    narrow = checkpointed(sized.select("source", "grp", "class", "size", "hash", *([] if rows_as else ["doc_id"])))  # texts are read once for the counts
    classes = checkpointed(narrow.groupBy("source", "grp", "class").agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    depth = F.least(F.lit(DIGITS), F.ceil(F.log(16.0, F.greatest(F.col("n") / F.lit(float(CHUNK)), F.lit(1.0)))).cast("int"))
    shares = targets(classes, weights, share, most).withColumn("grp", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    facts = _before(classes, ["grp"], "class", "before_class").select("grp", F.col("source").alias("src"), "class", "before_class", depth.alias("depth"))
    facts = checkpointed(facts.join(shares.drop("source"), "grp").withColumn("half", F.ceil(F.col("depth") / 2).cast("int")))
    if classes.count() <= BROADCAST_ROWS:
        facts = F.broadcast(facts)
    chunk, high = F.expr("substring(hash, 1, depth)").alias("chunk"), F.expr("substring(hash, 1, half)").alias("high")
    counts = narrow.join(facts, ["grp", "class"]).select("grp", "class", chunk, high).groupBy("grp", "class", "high", "chunk").agg(F.count("*").alias("n"))
    counts = checkpointed(counts)
    halves = _before(counts.groupBy("grp", "class", "high").agg(F.sum("n").alias("n")), ["grp", "class"], "high", "before_high").drop("n")
    chunks = _before(counts, ["grp", "class", "high"], "chunk", "before_chunk").join(halves, ["grp", "class", "high"])
    chunks = checkpointed(chunks.select("grp", "class", "chunk", (F.col("before_high") + F.col("before_chunk")).alias("before_here")))
    rows = (sized if rows_as else narrow).join(facts, ["grp", "class"]).withColumn("chunk", chunk)
    ties = [F.xxhash64(F.col("whole").getField(text))] if rows_as else []
    nth = F.row_number().over(Window.partitionBy("grp", "class", "chunk").orderBy("hash", "size", *ties))
    rows = rows.withColumn("nth", nth).join(chunks, ["grp", "class", "chunk"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank, u = F.col("before_class") + F.col("before_here") + F.col("nth"), offset(F.col("src"), seed)
    copies = F.floor(rank * rate + u) - F.floor((rank - 1) * rate + u)
    rows = rows.withColumn("copies", F.least(copies, F.lit(most)).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *([F.col("whole").alias(rows_as)] if rows_as else []))


ORACLE_SQL = f"""with sized as (select doc_id, text, source, length(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size from documents),
total as (select source, sum(size)::bigint as source_size from sized group by source),
weighted as (select *, [3, 1, 2][((row_number() over (order by source nulls last) - 1) % 3 + 1)]::bigint as w, 2 * source_size as lim from total),
walk as (select *, row_number() over o as k, (sum(source_size) over ())::double * 1.5 - coalesce((sum(lim) over (o rows between unbounded preceding and 1 preceding))::double, 0) as lft,
  (sum(w) over (o rows between current row and unbounded following))::double as w_left from weighted window o as (order by lim / w, source nulls last)),
fullness as (select *, lft * w >= lim * w_left as is_full from walk),
targets as (select source, source_size, case when is_full then lim::double else (select lft from fullness where not is_full order by k limit 1) * w / (select w_left from fullness where not is_full order by k limit 1) end as target from fullness),
ranked as (select doc_id, size, sized.source, source_size, target, row_number() over (partition by sized.source order by length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)::bigint), md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), size) as rank,
  ('0x' || md5('42:' || coalesce(sized.source, chr(0)))[1:8])::bigint / 4294967296.0::double as u, case when source_size > 0 then target / source_size else 0 end::double as rate
  from sized join targets on sized.source is not distinct from targets.source)
select doc_id, size, source_size, target, copies, copies * size as taken from (
  select *, least(floor(rank * rate + u) - floor((rank - 1) * rate + u), 2)::bigint as copies from ranked)"""
