"""Windowed counts and deduplication that hold for tables and for streams, in whatever order rows come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(events: DataFrame, size: str = "5 minutes") -> DataFrame:
    """Count and sum of values by type and window of event time.

    A stream has no watermark here, so no row comes too late: its state is a row a window and type, as many as the
    result has. Event time of null has no window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return counts.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "cents")


def first_seen(events: DataFrame) -> DataFrame:
    """Events whose id wasn't seen before. A stream's state holds every id, in the store on disk: none is forgotten, none seen twice."""
    return events.dropDuplicates(["event_id"])


def read_frames(spark, folder: str, schema, files_per_batch: int = 1, name: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder whose names match a pattern, a few files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name).parquet(folder)
