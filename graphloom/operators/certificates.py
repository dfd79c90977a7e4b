"""Checks of results that don't repeat the search: each is a few joins of the result with the edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _said(df: DataFrame, code: str, node: str = "node", other: str | None = None) -> DataFrame:
    kind = df.schema[node].dataType
    return df.select(F.lit(code).alias("code"), F.col(node).alias("node"), (F.lit(None).cast(kind) if other is None else F.col(other)).alias("other"))


def walk_certificate(steps: DataFrame, found: DataFrame, start, max_depth: int | None = None) -> DataFrame:
    """(code, node, other): what shows that ``found(node, depth, parent)`` is not the breadth-first search from ``start``.

    ``steps(at, to)`` are the steps that the search may take. No rows mean that it is right: every node has its least depth,
    and nothing within ``max_depth`` is missing. Codes: START (the start is missing, or not at depth 0 without a parent),
    TWICE (a node with several rows), PARENT (a parent that was not found, or none below depth 0), DEPTH (not its
    parent's plus one), EDGE (no step from its parent), DEEP (beyond the limit), SHORTCUT (a step that leads on more
    than one level), MISSED (a step from a node above the limit to one that was not found).
    """
    pairs = steps.select("at", "to").distinct()
    ends = found.groupBy("node").agg(F.min("depth").alias("depth"))  # of repeated rows the nearest counts
    first = F.lit(start).cast(found.schema["node"].dataType)
    begin = found.agg(F.max(F.when(F.col("node") == first, (F.col("depth") == 0) & F.col("parent").isNull())).alias("ok"))
    out = [begin.where(~F.coalesce("ok", F.lit(False))).select(first.alias("node")).transform(_said, "START")]
    out.append(_said(found.groupBy("node").count().where("count > 1"), "TWICE"))
    inner = found.where((F.col("node") != first) | (F.col("depth") != 0))
    linked = inner.join(ends.select(F.col("node").alias("parent"), F.col("depth").alias("above")), "parent", "left")
    out.append(_said(linked.where("above is null"), "PARENT", "node", "parent"))
    out.append(_said(linked.where("above is not null and depth <> above + 1"), "DEPTH", "node", "parent"))
    claimed = inner.where("parent is not null").select("node", F.col("parent").alias("at"), F.col("node").alias("to"))
    out.append(_said(claimed.join(pairs, ["at", "to"], "left_anti"), "EDGE", "node", "at"))
    if max_depth is not None:
        out.append(_said(found.where(F.col("depth") > max_depth), "DEEP"))
    left = pairs.join(ends.select(F.col("node").alias("at"), F.col("depth").alias("from_depth")), "at")
    both = left.join(ends.select(F.col("node").alias("to"), F.col("depth").alias("to_depth")), "to", "left")
    out.append(_said(both.where("to_depth > from_depth + 1"), "SHORTCUT", "at", "to"))
    within = both if max_depth is None else both.where(F.col("from_depth") < max_depth)
    out.append(_said(within.where("to_depth is null"), "MISSED", "at", "to"))
    return reduce(DataFrame.union, out)


def components_certificate(edges: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(code, node, other): what shows that ``found(node, component)`` does not label each node by the smallest it is connected with.

    TWICE and MISSED as above; SPLIT (an edge between two components), NAME (a component that is not its own smallest node).
    That a component is connected follows from a search tree, which a label does not carry, and is not checked.
    """
    out = [_said(found.groupBy("node").count().where("count > 1"), "TWICE"), _said(nodes.select(F.col("id").alias("node")).distinct().join(found.select("node"), "node", "left_anti"), "MISSED")]
    a, b = found.select(F.col("node").alias("src"), F.col("component").alias("_a")), found.select(F.col("node").alias("dst"), F.col("component").alias("_b"))
    out.append(_said(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("_a <> _b"), "SPLIT", "src", "dst"))
    least = found.groupBy("component").agg(F.min("node").alias("node"))
    out.append(_said(least.where("node <> component"), "NAME", "node", "component"))
    return reduce(DataFrame.union, out)


def levels_certificate(edges: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(code, node, other): what shows that ``found(node, level, blocked)`` is not the order of ``topological_from``.

    ORDER (an edge that does not lead to a higher level), GAP (a level that is not the highest predecessor's plus one, or 0
    without any), BEHIND (a free node with a blocked predecessor), FREE (a blocked node without a blocked predecessor),
    TWICE and MISSED as above.
    """
    out = [_said(found.groupBy("node").count().where("count > 1"), "TWICE"), _said(nodes.select("node").distinct().join(found.select("node"), "node", "left_anti"), "MISSED")]
    a = found.select(F.col("node").alias("src"), F.col("level").alias("_a"), F.col("blocked").alias("_ba"))
    b = found.select(F.col("node").alias("dst"), F.col("level").alias("_b"), F.col("blocked").alias("_bb"))
    both = edges.select("src", "dst").distinct().join(a, "src").join(b, "dst")
    out.append(_said(both.where("not _ba and not _bb and _b <= _a"), "ORDER", "dst", "src"))
    out.append(_said(both.where("_ba and not _bb"), "BEHIND", "dst", "src"))
    above = both.groupBy(F.col("dst").alias("node")).agg(F.max(F.when(~F.col("_ba"), F.col("_a"))).alias("top"), F.max("_ba").alias("stopped"))
    joined = found.join(above, "node", "left")
    out.append(_said(joined.where("not blocked and level <> coalesce(top + 1, 0)"), "GAP"))
    out.append(_said(joined.where("blocked and not coalesce(stopped, false)"), "FREE"))
    return reduce(DataFrame.union, out)
