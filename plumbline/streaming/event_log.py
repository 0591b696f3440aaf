"""The event log as a stream: the same lines, counted by window as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.event_log import SCHEMA


def follow(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of the log files of a folder."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(folder)


def windowed(log: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Answers and errors by window and error code; lines later than ``late`` are dropped by the watermark."""
    timed = log.filter("event = 'served_answer'").withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", width), "error").agg(F.count(F.lit(1)).alias("answers"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "error", "answers")
