"""Time limits on work that runs Spark jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Seconds between looks at work that has overrun.
AGAIN = 0.2


class OutOfTime(RuntimeError):
    """Work was cut off at its limit."""


def within(seconds: float | None, work: Callable, spark: SparkSession):
    """What ``work`` gives, if it is done within ``seconds`` (without limit: None).

    Its jobs carry a tag of their own, and threads that it starts with Spark's thread helpers inherit it. Once the time is
    over, all jobs of that tag are cancelled, those that are begun later too, until the work gives up; ``OutOfTime`` is
    raised, and other work goes on. Work that runs no jobs isn't interrupted, but counts as overrun.
    """
    if seconds is None:
        return work()
    sc, tag = spark.sparkContext, f"tabularium-{uuid.uuid4().hex}"
    done, late = threading.Event(), threading.Event()

    def watch():
        if done.wait(max(0.0, seconds)):
            return
        late.set()
        while True:
            sc.cancelJobsWithTag(tag)
            if done.wait(AGAIN):
                return

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        out = work()
    except Exception as e:
        if late.is_set():
            raise OutOfTime(f"out of time after {seconds:g} s") from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)
    if late.is_set():
        raise OutOfTime(f"out of time after {seconds:g} s")
    return out
