"""Watching a log that grows, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rows import progress, running_best
from ..sources.readers import stream_samples


def live_progress(spark, folder: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """A query whose memory table ``name`` holds the current progress row."""
    stream = stream_samples(spark, folder)
    agg = stream.agg(F.count("*").alias("total"), F.count("score").alias("valid"), F.max("score").alias("best"), F.max("sample_order").alias("last_order"))
    out = agg.writeStream.outputMode("complete").format("memory").queryName(name)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def log_to_table(spark, folder: str, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append new samples to a Parquet table, exactly once; running bests, which streams can't keep, are read from it."""
    return stream_samples(spark, folder).writeStream.outputMode("append").format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).start()


def state_of(spark, table_path: str) -> tuple[DataFrame, DataFrame]:
    """(progress, running best) of the table so far."""
    log = spark.read.parquet(table_path)
    return progress(log), running_best(log)


#: Orders that one state holds.
BLOCK = 10_000


def _bests(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best before each score and with it; NaN where there is none."""
    so_far = np.fmax.accumulate(scores) if len(scores) else scores
    return np.concatenate(([np.nan], so_far[:-1])), so_far


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The samples that are new or whose best has changed, with the block's bests as they are now."""
    orders, scores, revision = state.get if state.exists else ([], [], 0)
    orders, scores = np.array(orders, np.int64), np.array(scores, float)
    new = pd.concat(list(batches))
    new = new[~new["sample_order"].isin(orders)].drop_duplicates("sample_order")  # a sample that is told again stays as it was
    if not len(new):
        return
    before = {o: b for o, *b in zip(orders.tolist(), *(x.tolist() for x in _bests(scores)))}
    orders, scores = np.concatenate((orders, new["sample_order"].to_numpy(np.int64))), np.concatenate((scores, new["score"].to_numpy(float)))
    at = np.argsort(orders)
    orders, scores = orders[at], scores[at]
    ahead, best = _bests(scores)
    state.update((orders.tolist(), scores.tolist(), revision + 1))
    changed = [i for i, o in enumerate(orders.tolist()) if o not in before or not np.array_equal(before[o], [ahead[i], best[i]], equal_nan=True)]
    none = lambda v: [None if np.isnan(x) else float(x) for x in v]
    yield pd.DataFrame({"block": key[0], "sample_order": orders[changed], "score": pd.Series(none(scores[changed]), dtype=object), "before": pd.Series(none(ahead[changed]), dtype=object), "best": pd.Series(none(best[changed]), dtype=object), "revision": revision + 1})


def live_best(samples: DataFrame, table_path: str, checkpoint: str, block: int = BLOCK, **trigger) -> StreamingQuery:
    """Append to a Parquet table, for every sample of a stream (sample_order, score), the best so far among the samples of its
    block of orders, and again for those that a late sample changes.

    A state holds a block's orders and scores, so it is bounded and blocks are spread over tasks; states are in the
    checkpoint, and a query that is started again goes on where it ended. ``bests`` reads the table.
    """
    rows = samples.select("sample_order", F.col("score").cast("double").alias("score")).withColumn("block", F.floor(F.col("sample_order") / block).cast("long"))
    made = rows.groupBy("block").applyInPandasWithState(_advance, "block long, sample_order long, score double, before double, best double, revision long", "orders array<long>, scores array<double>, revision long", "append", GroupStateTimeout.NoTimeout)
    out = made.writeStream.outputMode("append").format("parquet").option("path", table_path).option("checkpointLocation", checkpoint)
    return (out.trigger(**trigger) if trigger else out).start()


def bests(table: DataFrame) -> DataFrame:
    """(sample_order, score, best_so_far, delta, is_best) of what ``live_best`` has written: the last word on each sample, and
    the best of the blocks before its own."""
    last = table.groupBy("block", "sample_order").agg(F.max_by(F.struct("score", "before", "best"), "revision").alias("x")).select("block", "sample_order", "x.*")
    ahead = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    blocks = last.groupBy("block").agg(F.max("score").alias("top")).select("block", F.max("top").over(ahead).alias("ahead"))
    before, has = F.greatest("ahead", "before"), F.col("score").isNotNull()
    is_best = F.coalesce(has & (before.isNull() | (F.col("score") > before)), F.lit(False))
    delta = F.when(has, F.col("score") - F.coalesce(before, F.lit(0.0))).otherwise(0.0)
    return last.join(F.broadcast(blocks), "block").select("sample_order", "score", F.greatest("ahead", "best").alias("best_so_far"), delta.alias("delta"), is_best.alias("is_best"))


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of events by time window and key; late rows are taken up to the watermark. For streams and tables."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_t", late)
    return rows.groupBy(F.window("_t", size), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str = "ts", user: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events no further apart than ``gap``."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_t", late)
    s = rows.groupBy(F.session_window("_t", gap), user).agg(F.count("*").alias("n"))
    return s.select(user, F.col("session_window.start").alias("session_start"), "n")
