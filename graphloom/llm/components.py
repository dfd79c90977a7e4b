"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches


def smallest_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node reachable from each of 0..n-1 over the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch, replaced by one edge from each node to the smallest of its group."""
    for batch in batches:
        a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = nodes[smallest_labels(len(nodes), place[: len(a)], place[len(a) :])]
        keep = label != nodes
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(label[keep])], names=["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether distinct edges from larger (a) to smaller nodes (b) are stars: no node has two smaller ones, or one on each side."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    sides = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sides.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` of longs to (node, component): the smallest node reachable, for nodes that have an edge.

    Loops, repeated edges and either direction are fine; edges with a null end are left out. Every step is written
    to the shared folder, until all groups are stars; a node with very many neighbours meets only its smallest one.
    """
    limit_batches(edges.sparkSession, 200_000)
    clean = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = scratch.save(clean.mapInArrow(_forest, "a long, b long").distinct(), f"{name}-0")
    step = 0
    while not _stars(now):
        step += 1
        both = now.union(now.select("b", "a")).toDF("a", "b")
        lows = scratch.save(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low")), f"{name}-{step}-low")
        large = scratch.save(both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), f"{name}-{step}-large")
        # From here on every edge leads from the larger node (a) to a smaller one (b).
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").union(least).distinct()
        now = scratch.save(small.select("a", "b"), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}", f"{name}-{step}-low", f"{name}-{step}-large")
    limit_batches(edges.sparkSession)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
