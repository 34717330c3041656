"""Accumulators as streams: histograms of arriving rows, kept as aggregation state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def histogram_of(events: DataFrame) -> DataFrame:
    """``(event_type, bin, w)``, the same for a batch and a stream."""
    return events.select("event_type", F.least(F.greatest(F.floor("value"), F.lit(0)), F.lit(255)).cast("int").alias("bin")).groupBy("event_type", "bin").agg(F.count("*").alias("w"))


def stream_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Run a file stream to its end and return the final state; state size follows types x bins, not events."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    sink = f"hist_{uuid.uuid4().hex}"
    run = histogram_of(events).writeStream.outputMode("complete").format("memory").queryName(sink).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.table(sink)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Tumbling event-time counts with a watermark, for append sinks."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))
