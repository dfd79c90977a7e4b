"""Streams of edges: weights in windows, and upserts by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable


def windowed_weights(edges: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(window_start, src, dst, weight) of a stream (or table) of edges(ts, src, dst); rows later than ``late`` may be left out."""
    counted = edges.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "src", "dst").agg(F.count("*").alias("weight"))
    return counted.select(F.col("w.start").alias("window_start"), "src", "dst", "weight")


def upsert_sink(root: str, keys: list[str], buckets: int = 64):
    """For ``writeStream.foreachBatch``: each batch is upserted into a bucket table, of which it rewrites the buckets it touches.

    A batch that is run again changes nothing. Read the table with ``BucketTable(spark, root, keys).read()``.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        BucketTable(batch.sparkSession, root, keys, buckets).upsert(batch, batch_id)

    return run
