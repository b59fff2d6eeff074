"""Incremental duplicate detection on a stream of files (an addition; batch audits are the main path)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_of_content(stream: DataFrame, content: str, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Rows whose content has not been seen within the delay. State is bounded by the watermark; digests, not contents, are kept."""
    d = stream.withColumn("sha1", F.sha1(F.col(content).cast("binary")))
    return d.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["sha1"])


def windowed_counts(stream: DataFrame, event_time: str, key: str, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Counts of arrivals for each key and tumbling window, late rows up to the delay included."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
