"""Target-distribution importance resampling: documents whose n-grams look like a target's are drawn more often.

Words are laid out in a position table: each text's words are exploded with their positions, and a window's ``lead()``
brings the following words beside each, so that the run of every order from 1 up to ``orders`` begins at its row. Runs are
hashed into buckets (crc32 modulo ``buckets``) and counted by bucket, in the corpus and in the target. A bucket's gain is
the log ratio of the two smoothed shares; gains are joined back to the runs, and a document's weight is the floored mean
of its gains. A Gumbel number from the key's hash is added, and the highest scores are drawn: sampling without
replacement in proportion to the exponent of the weight.

The window is over pieces of at most ``PIECE`` positions of one text (each carries the few words that follow it), so a
very long text is many windows. For runs of single words nothing follows, and no window or shuffle of words is planned.
Counts leave a task as a row a bucket, sums of gains as a row a document. The table of gains has ``buckets`` rows, a
parameter; up to ``BROADCAST_BUCKETS`` it is broadcast, beyond it is joined by a shuffle, to counts by document and bucket.

Scores lie within bounds set by 64-bit counts and 32-bit hashes, so the table of distinct scores has at most some tens of
thousands of rows. The least drawn score is found in it, and only rows at or above it are put in order, range by range.

Defined cases: a null or blank text has no runs and the weight 0; a document of fewer than ``least_words`` words isn't
drawn; a long text counts whole; a null key is hashed as an empty one and comes last among equal scores; rows that share
a key are separate (they share their Gumbel number), of rows alike in key and score any may come first; with an empty
target all gains follow the corpus alone; an empty table gives no rows; other columns are ignored, whatever they are
called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import running_sum
from .common import checkpointed, numbered, quoted

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BUCKETS, SEED, PERCENT, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Positions of a text that one window holds.
PIECE = 4096
#: Most buckets whose gains (16 bytes each) are broadcast.
BROADCAST_BUCKETS = 1_000_000


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def runs(rows: DataFrame, keys: list[str], orders: int = ORDERS) -> DataFrame:
    """(*keys, run): all runs of 1 to ``orders`` consecutive words of the array ``words``; a row with a null run where there is none.

    ``keys`` tell the rows apart.
    """
    if orders == 1:
        return rows.select(*keys, F.posexplode_outer("words").alias("pos", "run")).drop("pos")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("words"), F.lit(1)) - 1) / PIECE).cast("int")), lambda p: F.slice("words", p * PIECE + 1, PIECE + orders - 1))
    cut = rows.select(*keys, F.posexplode(pieces).alias("piece", "part")).select(*keys, "piece", F.posexplode_outer("part").alias("pos", "word"))
    following = Window.partitionBy(*keys, "piece").orderBy("pos")
    cut = cut.select(*keys, "pos", "word", *[F.lead("word", k).over(following).alias(f"w{k}") for k in range(1, orders)])
    made = [F.col("word"), *[F.when(F.col(f"w{k}").isNotNull(), F.concat_ws(" ", "word", *[f"w{i}" for i in range(1, k + 1)])) for k in range(1, orders)]]
    own = cut.where("pos IS NULL OR pos < " + str(PIECE))  # the words behind a piece begin runs of the next
    return own.select(*keys, F.explode_outer(F.filter(F.array(*made), lambda r: r.isNotNull())).alias("run"))


def bucket(run: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int")


def bucket_counts(docs: DataFrame, text: str, orders: int, buckets: int) -> DataFrame:
    """(bucket, n): runs of all texts by bucket."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), words(quoted(text)).alias("words"))
    return runs(rows, ["rid"], orders).where("run IS NOT NULL").groupBy(bucket(F.col("run"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from (bucket, n) of both: the floored thousandfold log ratio of shares, each bucket counted once more."""
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = checkpointed(both)
    total = both.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    number = lambda c: F.col(c).cast("double") + 1.0
    ratio = number("t") * F.lit(float(total["S"] + buckets)) / (number("s") * F.lit(float(total["T"] + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def weights(docs: DataFrame, gain: DataFrame, *, key: str, text: str, orders: int, buckets: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row: the floored mean gain of its runs, 0 without any."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), quoted(key).alias("doc_id"), words(quoted(text)).alias("words"))
    found = runs(rows.withColumn("n_words", F.size("words").cast("long")), ["rid", "doc_id", "n_words"], orders)
    found = found.select("rid", "doc_id", "n_words", bucket(F.col("run"), buckets).alias("bucket"))
    if buckets <= BROADCAST_BUCKETS:
        cells = found.join(F.broadcast(gain), "bucket", "left").select("rid", "doc_id", "n_words", "gain", F.when(F.col("bucket").isNotNull(), 1).otherwise(0).cast("long").alias("n"))
        own = cells.groupBy("rid", "doc_id", "n_words").agg(F.sum("n").alias("n_features"), F.sum("gain").alias("g"))
    else:
        cells = found.groupBy("rid", "doc_id", "n_words", "bucket").agg(F.count("bucket").alias("n")).join(gain, "bucket", "left")
        own = cells.groupBy("rid", "doc_id", "n_words").agg(F.sum("n").alias("n_features"), F.sum(F.col("n") * F.col("gain")).alias("g"))
    mean = F.expr("(g - pmod(g, n_features)) div n_features")
    return own.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, mean).otherwise(F.lit(0)).cast("long").alias("weight"))


def gumbel(key: Column, seed: int) -> Column:
    """A thousandfold Gumbel number, floored, that depends on the key's text and the seed alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def draw(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """``rows`` (doc_id, n_words, score, ...) with ``rank``: the place of those drawn, from 1 by falling score and rising key; null for the others."""
    rows = checkpointed(rows)
    may = F.col("n_words") >= least_words
    scores = checkpointed(rows.where(may).groupBy("score").agg(F.count("*").alias("n")))  # some tens of thousands at most
    wanted = (scores.agg(F.sum("n")).first()[0] or 0) * percent // 100
    if not wanted:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    upto = running_sum(scores.select((-F.col("score")).alias("under"), "n"), "under", F.col("n"), "upto")
    least = -upto.where(F.col("upto") >= wanted).agg(F.min("under")).first()[0]
    first = may & (F.col("score") >= least)
    top = numbered(rows.where(first), [F.desc("score"), F.asc_nulls_last("doc_id")], "rank")
    top = top.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    return top.unionByName(rows.where(~first).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """Every row's doc_id, n_features, weight, score and rank (null unless drawn)."""
    gain = checkpointed(gains(bucket_counts(docs, text, orders, buckets), bucket_counts(target, target_text, orders, buckets), buckets))
    rows = weights(docs, gain, key=key, text=text, orders=orders, buckets=buckets)
    drawn = draw(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), percent, least_words)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


# crc32 by table: its 256 entries are made by the rule, then a word's bytes are folded in
ORACLE_SQL = r"""with recursive steps as (select range as i, range::bigint as c, 0 as k from range(256)
  union all select i, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
tab as (select list(c order by i) as t from steps where k = 8),
dw as (select doc_id, row_number() over () as rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
bw as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
d as (select rid, unnest(w) as f from dw), b as (select unnest(w) as f from bw),
vocabulary as (select f, hex(encode(f)) as x from (select f from d union select f from b)),
hashed as (select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::bigint)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 as bucket from vocabulary, tab),
ds as (select bucket, count(*) as s from d join hashed using (f) group by bucket), bs as (select bucket, count(*) as t from b join hashed using (f) group by bucket),
total as (select (select coalesce(sum(s), 0) from ds)::double as big_s, (select coalesce(sum(t), 0) from bs)::double as big_t),
gains as (select r.range as bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (big_s + 10000) / ((coalesce(s, 0) + 1)::double * (big_t + 10000))))::bigint as gain
  from range(10000) r left join ds on ds.bucket = r.range left join bs on bs.bucket = r.range, total),
sums as (select rid, sum(gain)::bigint as g from d join hashed using (f) join gains using (bucket) group by rid),
weighed as (select doc_id, len(w)::bigint as n_features, case when len(w) > 0 then floor(g::double / len(w))::bigint else 0 end as weight,
  ('0x' || sha256('2024:' || coalesce(doc_id::varchar, ''))[1:8])::bigint as h from dw left join sums using (rid)),
scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::double / 4294967296.0::double)))::bigint as score from weighed),
placed as (select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) as place, count(*) over (partition by n_features >= 20) as n from scored)
select doc_id, n_features, weight, score, case when n_features >= 20 and place <= n * 10 // 100 then place end as rank from placed"""
