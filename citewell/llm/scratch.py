"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one of our own only where it is unset."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        known = tempfile.mkdtemp(prefix="citewell-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def write(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    """Writes a frame as Parquet and returns it as read again: lineage ends here and survives executors."""
    path = f"{base(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(frame.schema).parquet(path)
    back.scratch_path = path
    return back


def drop(spark: SparkSession, frame: DataFrame) -> None:
    """Deletes a table made by write(), once nothing lazy depends on it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(frame.scratch_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
