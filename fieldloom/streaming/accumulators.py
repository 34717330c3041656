"""Accumulators that outlive their stream: what has arrived so far, and the params that follow from it.

Every micro-batch adds its partial histogram as a folder named by the batch, so a batch that runs again after a failure takes its
own place and nothing counts twice. The params are made anew from the sum after each batch, and are read by other
sessions while the stream runs. After ``KEEP`` partial histograms their sum becomes a base that says how far it goes; what it holds
goes one round later, so a reader never misses it. The driver holds no state; a stop or crash anywhere is followed
by a start on the same folder.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Partial histograms between two bases.
KEEP = 16


class StreamingAccumulator:
    """``partial(rows)`` is a histogram with the weight ``w``, a sum over rows; ``params(histogram)`` is made of the total."""

    def __init__(self, spark: SparkSession, root: str, partial: Callable[[DataFrame], DataFrame], params: Callable[[DataFrame], DataFrame] | None = None, keep: int = KEEP) -> None:
        self.spark, self.root, self.partial, self.params, self.every = spark, root.rstrip("/"), partial, params, keep

    def start(self, rows: DataFrame, **trigger) -> StreamingQuery:
        """Go on where the folder's checkpoint ends, with all that has arrived (or as ``trigger`` says)."""
        return rows.writeStream.foreachBatch(self.add).option("checkpointLocation", f"{self.root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def add(self, rows: DataFrame, batch: int) -> None:
        self.partial(rows).write.mode("overwrite").parquet(f"{self.root}/parts/{batch:012d}")
        if self.params is not None:
            self.params(self.total()).write.mode("overwrite").parquet(f"{self.root}/params/{batch:012d}")
        parts, bases = self._numbers("parts"), self._numbers("bases")
        base = max(bases, default=-1)
        if sum(n > base for n in parts) >= self.every:
            self.total().write.mode("overwrite").parquet(f"{self.root}/bases/{batch:012d}")
        # a base and params stay for one round more than they are the newest
        self._drop("parts", [n for n in parts if n <= base])
        self._drop("bases", bases[:-1])
        self._drop("params", self._numbers("params")[:-2])

    def total(self) -> DataFrame | None:
        """The histogram of all that has arrived; None before anything has."""
        bases = self._numbers("bases")
        base = max(bases, default=-1)
        paths = [f"{self.root}/bases/{base:012d}"] * bool(bases) + [f"{self.root}/parts/{n:012d}" for n in self._numbers("parts") if n > base]
        if not paths:
            return None
        rows = self.spark.read.parquet(*paths)
        return rows.groupBy(*[c for c in rows.columns if c != "w"]).agg(F.sum("w").alias("w"))

    def latest(self) -> DataFrame | None:
        """The params after the last batch that is whole."""
        done = self._numbers("params")
        return self.spark.read.parquet(f"{self.root}/params/{max(done):012d}") if done else None

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _numbers(self, kind: str) -> list[int]:
        """Batches of whole folders, in order: those that Spark's writer has marked."""
        store, marks = self._folder(f"{kind}/*/_SUCCESS")
        return sorted(int(re.search(r"/(\d+)/_SUCCESS$", str(f.getPath()))[1]) for f in store.globStatus(marks) or [])

    def _drop(self, kind: str, batches: list[int]) -> None:
        for n in batches:
            store, path = self._folder(f"{kind}/{n:012d}")
            store.delete(path, True)
