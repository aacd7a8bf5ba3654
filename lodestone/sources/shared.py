"""The folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, which is also where checkpoints go. Where a session of one machine names none, it
    gets one of our own; for any other that is an error, as executors don't see each other's folders."""
    context = spark.sparkContext
    found = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file:///tmp/lodestone-shared"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def fixed(df: DataFrame) -> DataFrame:
    """The rows as they are now, in a checkpoint: what a lost executor held isn't dealt anew."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
