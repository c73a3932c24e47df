"""Streaming forms: a late-data gate, windowed counts, and an idempotent upsert sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """First row of each key within the watermark; state older than it goes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, by: Column, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, size), by.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def write_batches(stream: DataFrame, path: str, checkpoint: str, partition: str):
    """Each micro-batch replaces its own folder, so that a repeated one changes nothing; late files merge by key when read."""

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("epoch", partition).parquet(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
