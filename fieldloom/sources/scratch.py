"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession

_MADE: list[tuple[SparkSession, str]] = []


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """The path, which goes when this driver's program ends: results may read it until then."""
    if not _MADE:
        atexit.register(_remove)
    _MADE.append((spark, path))
    return path


def _remove() -> None:
    while _MADE:
        spark, path = _MADE.pop()
        with contextlib.suppress(Exception):  # the JVM may be gone first
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in any file system that Spark reaches."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(jvm.org.apache.hadoop.conf.Configuration() if spark._jsc is None else spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of our own only on a single machine, where it is unset."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    return found or f"/tmp/checkpoints/{os.getuid()}"


class Scratch:
    """Tables of one computation, under a folder of their own. ``drop`` removes them once nothing reads them any more; the end of the program does too."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n = spark, removed_at_exit(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"), 0

    def kept(self, df: DataFrame) -> DataFrame:
        """Written as Parquet and read again: lineage ends here, and a lost executor costs only its own tasks."""
        self.n += 1
        path = f"{self.path}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        remove(self.spark, self.path)
