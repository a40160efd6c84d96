"""Cutting lineage, in the folder that the session shares, and bounds of what may go to every task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame

#: Rows of a reviewed store that may go to every task as one.
STORE_ROWS = 100_000
#: Rows that a task holds on average where ``spread`` deals them.
TASK_ROWS = 1 << 19
_own: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in ``spark.checkpoint.dir``; only a local session without one (as in tests) gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not spark.conf.get("spark.checkpoint.dir", None) and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-revlume-"))
    return df.checkpoint()


def spread(rows: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    """``rows``, about n, dealt by their keys so that a task holds TASK_ROWS of them, whatever n is.

    Adaptive execution deals by compressed bytes, of which 64 MB may be a GB of rows to sort. Few rows are left to it.
    """
    parts = -(-n // TASK_ROWS)
    return rows.repartition(parts, *keys) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def shared_root(spark) -> str:
    """The folder that driver and executors share; only a local session without one (as in tests) gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root and not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-revlume-"))
    return (root or _own[0]).rstrip("/")


def shared_folder(spark, name: str) -> str:
    """A new folder's path where the session's checkpoints are."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared folder, and a scan of it: lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    scan = df.sparkSession.read.schema(df.schema).parquet(path)
    scan.written_to = path
    return scan


def discard(*scans: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for scan in scans:
        delete(scan.sparkSession, scan.written_to)


def delete(spark, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
