"""Structured Streaming over announcements: late data by watermark, one count a window and kind, exact repeats once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Announcements, distinct-by-watermark, by window and kind, with the mean of their values."""
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    out = seen.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")
