"""Lookups that hold when very many rows share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a lookup sends to all tasks, at most.
HOT_KEYS = 20_000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], weight: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """``rows`` with the other columns of ``table``, in which each key stands once; nulls where it doesn't.

    ``weight`` is a column of the table, how many rows hold the key; where it isn't given it is counted in ``among``, a saved
    table with the same keys, or else in the rows themselves, whose plan then stands more than once in the result. Keys that at
    least one in HOT_KEYS of the counted rows hold, so HOT_KEYS of them at most, are joined in place; their rows, and
    those with a null in the key, go through the shuffled join of the others scattered over its tasks.
    """
    values = [c for c in table.columns if c not in keys]
    if weight is None:
        counted = rows if among is None else among
        total = counted.count()
        hot = counted.groupBy(*keys).agg(F.count("*").alias("_weight")).where(F.col("_weight") * HOT_KEYS >= total).select(*keys)
        near, rest = table.join(F.broadcast(hot), keys, "left_semi"), table
    else:
        total = table.agg(F.sum(weight)).first()[0] or 0
        near, rest = table.where(F.col(weight) * HOT_KEYS >= total), table.where(F.col(weight) * HOT_KEYS < total)
    near = near.select(*keys, *(F.col(c).alias(f"_hot_{c}") for c in values), F.lit(True).alias("_hot"))
    rest = rest.select(*keys, *values, F.lit(0).cast("long").alias("_scatter"))
    loose = F.col("_hot")
    for k in keys:
        loose = loose | F.col(k).isNull()
    placed = rows.join(F.broadcast(near), keys, "left").withColumn("_scatter", F.when(loose, 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)).cast("long"))
    joined = placed.join(rest, [*keys, "_scatter"], "left")
    return joined.select(*rows.columns, *(F.when(F.col("_hot"), F.col(f"_hot_{c}")).otherwise(F.col(c)).alias(c) for c in values))
