"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Where none is named, a session in one process (master local[..]) gets a temporary folder; on a
    cluster each machine would write to its own, so there it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="newsloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write once and read back: cuts lineage in storage that outlives any executor."""
    spark, path, schema = df.sparkSession, scratch_path(df.sparkSession, tag), df.schema
    df.write.parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out.scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what materialise() wrote for df, once nothing that is still to run reads it."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df.scratch)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
