"""Integrity checks of a graph: one row for each violation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph


def _rows(df: DataFrame, code: str, severity: str, column: str) -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col(column).cast("string").alias("id"))


def duplicate_ids(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).count().where("count > 1")


def dangling(graph: Graph, end: str) -> DataFrame:
    """Edges whose source or target (``end``) is no node."""
    return graph.edges.join(graph.nodes.select(F.col("id").alias(end)), end, "left_anti")


def orphans(graph: Graph) -> DataFrame:
    """Nodes without any edge."""
    ends = graph.edges.select(F.col("src").alias("id")).union(graph.edges.select("dst")).distinct()
    return graph.nodes.join(ends, "id", "left_anti")


def violations(graph: Graph, id_pattern: str | None = None) -> DataFrame:
    """(code, severity, id) of empty and duplicate node ids, missing ends, malformed ids, empty files and orphans."""
    nodes = graph.nodes
    empty = F.col("id").isNull() | (F.trim(F.col("id").cast("string")) == "")
    parts = [
        _rows(nodes.where(empty), "EMPTY_NODE_ID", "error", "id"),
        _rows(duplicate_ids(nodes, "id"), "DUPLICATE_NODE_ID", "error", "id"),
        _rows(dangling(graph, "src"), "DANGLING_SOURCE", "error", "src"),
        _rows(dangling(graph, "dst"), "UNRESOLVED_TARGET", "warning", "dst"),
        _rows(orphans(graph), "ORPHAN_NODE", "warning", "id"),
    ]
    if "edge_id" in graph.edges.columns:
        parts.append(_rows(duplicate_ids(graph.edges, "edge_id"), "DUPLICATE_EDGE_ID", "error", "edge_id"))
    if "file" in nodes.columns:
        parts.append(_rows(nodes.where("file is null or trim(file) = ''"), "EMPTY_PATH", "warning", "id"))
    if id_pattern:
        parts.append(_rows(nodes.where(~F.col("id").cast("string").rlike(id_pattern)), "MALFORMED_ID", "error", "id"))
    if "weight" in graph.edges.columns:
        parts.append(_rows(graph.edges.where("weight < 1"), "BAD_WEIGHT", "error", "src"))
    return reduce(DataFrame.unionAll, parts)


def health(graph: Graph, id_pattern: str | None = None) -> DataFrame:
    """(code, severity, n) of all violations."""
    return violations(graph, id_pattern).groupBy("code", "severity").agg(F.count("*").alias("n"))
