"""Paths, scratch space and lineage cuts, all through the cluster's own file system."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that several jobs read.

    It is the one that ``spark.checkpoint.dir`` names, or else the one given to ``setCheckpointDir``. Where neither is set, a
    local session (a test) gets a temporary folder; on a cluster that is an error, as a folder of one machine would not
    be seen by the others.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="phenoline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the scratch root."""
    return f"{scratch_root(spark).rstrip('/')}/phenoline-{uuid.uuid4().hex}/{name}"


def free_shuffles(spark: SparkSession) -> None:
    """Let the shuffle files of finished jobs go, for use after large tables are written.

    Spark removes them when the driver's collector finds their plans unused, which a driver with memory to spare may not look for until the disks
    are full. What a plan refers to is found by the second look.
    """
    for _ in range(2):
        spark._jvm.java.lang.System.gc()
        time.sleep(1)


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write a table to scratch space and read it back, so later jobs start from files that outlive executors."""
    path = scratch_path(df.sparkSession, "table")
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def input_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files below a folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()


def is_complete(spark: SparkSession, path: str) -> bool:
    """True for a table that a finished job wrote; a half-written one has no success marker."""
    return path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")
