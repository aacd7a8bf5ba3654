"""Metrics of a run as a stream: an extension beside the batch engine, over append-only event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolled_up(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, stage, n, mean) for each window and kind of event; works on batches and streams.

    In a stream a window is final once the watermark has passed it; rows later than `late` are left out then.
    """
    kind = events.schema["ts"].dataType
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("stage"))
    return grouped.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").cast(kind).alias("start"), "stage", "n", "mean")
