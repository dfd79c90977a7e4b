"""Incremental plans and upserts by content hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .edges import _sortable


def plan(old: DataFrame, new: DataFrame, key: str = "path", content: str = "content_hash") -> DataFrame:
    """(key, action): parse what is new or changed, unchanged, deleted. A full join on the key; nulls differ from values."""
    before = old.select(F.col(key), F.col(content).alias("_old"), F.lit(True).alias("_was"))
    after = new.select(F.col(key), F.col(content).alias("_new"), F.lit(True).alias("_is"))
    action = F.when(F.col("_is").isNull(), "deleted").when(F.col("_was").isNull(), "parse").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("parse")
    return before.join(after, key, "full").select(key, action.alias("action"))


def needs_run(old_head: str | None, new_head: str) -> str:
    """none for an equal head commit, all without an earlier one, else changed."""
    return "all" if old_head is None else "none" if old_head == new_head else "changed"


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys; rows of ``new`` with a null or empty key are left out."""
    usable = new
    for k in keys:
        usable = usable.where(F.col(k).isNotNull() & (F.trim(F.col(k).cast("string")) != ""))
    # Of rows with equal keys the last in the order of their other columns stays; maps are compared as JSON.
    others = [c for c in usable.columns if c not in keys]
    if others:
        usable = usable.groupBy(*keys).agg(F.max_by(F.struct(*others), _sortable(usable, others)).alias("_last")).select(*(F.col(f"_last.{c}").alias(c) if c in others else F.col(c) for c in usable.columns))
    else:
        usable = usable.distinct()
    return old.join(usable.select(*keys), keys, "left_anti").unionByName(usable, allowMissingColumns=True)


def conflicts(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(key, tx_a, tx_b, kind) of two transactions on a key: write-write, and read-write. ``reads/writes(tx_id, key)``."""
    w1, w2 = writes.select("key", F.col("tx_id").alias("tx_a")).distinct(), writes.select("key", F.col("tx_id").alias("tx_b")).distinct()
    ww = w1.join(w2, "key").where("tx_a < tx_b").withColumn("kind", F.lit("write-write"))
    rw = reads.select("key", F.col("tx_id").alias("tx_a")).distinct().join(w2, "key").where("tx_a <> tx_b").withColumn("kind", F.lit("read-write"))
    return ww.union(rw)


def placement(partitions: DataFrame) -> DataFrame:
    """The active partition that is least used, one row: partition_id, used."""
    used = F.col("current_size_bytes") / F.col("capacity_bytes")
    return partitions.where("status = 'ACTIVE'").select("partition_id", used.alias("used")).orderBy("used", "partition_id").limit(1)


def rebalance(partitions: DataFrame, high: float = 0.8, low: float = 0.4) -> DataFrame:
    """(source, target): each overfull partition with each underfull one; partition lists are small."""
    used = partitions.select("partition_id", (F.col("current_size_bytes") / F.col("capacity_bytes")).alias("used"))
    # Partitions of a store: a table of a few thousand rows.
    over, under = used.where(F.col("used") > high).select(F.col("partition_id").alias("source")), used.where(F.col("used") < low).select(F.col("partition_id").alias("target"))
    return over.join(under)


def evict(entries: DataFrame, need: int, now: float) -> DataFrame:
    """(key) to remove from a cache: expired ones first, then by priority and last use until ``need`` bytes are free.

    Entries are dealt by ranges of that order; each range sums its own sizes behind the total of the ranges before it.
    """
    from pyspark.sql import Window

    from ..scratch import Scratch

    expired = F.col("last_access") + F.col("ttl") < F.lit(now)
    order = ["late", "priority", "last_access", "key"]
    ranked = entries.select("key", "priority", "last_access", "size", F.when(expired, 0).otherwise(1).alias("late"))
    held = Scratch(entries.sparkSession, "evict").save(ranked.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "dealt")
    totals = held.groupBy("part").agg(F.sum("size").alias("total"))  # a row for each range
    earlier = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    here = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = held.withColumn("here", F.coalesce(F.sum("size").over(here), F.lit(0))).join(F.broadcast(earlier), "part")
    return before.where((F.col("late") == 0) | (F.col("here") + F.col("earlier") < F.lit(need))).select("key")
