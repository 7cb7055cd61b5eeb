"""Folders that driver and executors share, and tables whose lineage ends in one."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share.

    Where that setting is absent and all of Spark is on this machine (tests), a temporary folder takes its place, and
    is made the checkpoint folder of the session. On a cluster its absence is an error: executors don't share local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not root:
        root = sc.getCheckpointDir()
        if not root:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="tabularium-")
            sc.setCheckpointDir(root)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tabularium-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there: lineage ends here, lost executors cost nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, uri: str) -> None:
    """Delete a folder that isn't needed any more, in any store that Spark writes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
