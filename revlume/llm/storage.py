"""Shared intermediate tables: written through Spark, below the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session without one (as in tests) gets a folder of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not root and not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-revlume-"))
    return (root or _own[0]).rstrip("/")


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` below the shared folder and return a scan of the files.

    Lineage ends at the files, so that a lost executor costs one task and not
    the stages before.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    scan = spark.read.schema(df.schema).parquet(path)
    scan.written_to = path
    return scan


def discard(*scans: DataFrame) -> None:
    """Delete the files of materialized tables that nothing reads any more."""
    for scan in scans:
        spark = scan.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scan.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """128 bits by which a row is known: those of its doc_id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(" "), F.when(F.col(text).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(text))))))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores after it a name that no column of ``df`` has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
