"""Event logs as streams: a folder of files is replayed from its start and then followed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """All past events of the folder's files, then new ones (SR20)."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 16).parquet(folder)


def windowed_counts(events: DataFrame, *, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event time; state older than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(
        F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin_ts"), "event_type", "n", F.round("total", 2).alias("total"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into a table; a restart goes on from the checkpoint."""
    spark = stream.sparkSession
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
