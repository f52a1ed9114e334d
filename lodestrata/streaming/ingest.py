"""Streams become immutable snapshots: buffer a micro-batch, then write a finished folder.

A batch that is tried again writes to the same folder, so each is there once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def ingest(stream: DataFrame, root: str, checkpoint: str, *, keys: list[str] | None = None) -> StreamingQuery:
    """Write each micro-batch as ``snapshot=<epoch>`` below ``root``; with ``keys``, of repeated keys in a batch one row stays."""

    def write(batch: DataFrame, epoch: int) -> None:
        rows = batch.dropDuplicates(keys) if keys else batch
        rows.write.mode("overwrite").parquet(f"{root}/snapshot={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All rows with the snapshot that brought them."""
    return spark.read.option("basePath", root).parquet(f"{root}/snapshot=*")


def windowed_counts(stream: DataFrame, time: str, key: str, *, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Rows by event-time window and key; rows later than the watermark are dropped."""
    at = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, late).groupBy(at.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
