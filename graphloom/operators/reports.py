"""Overviews of a graph and its files, as small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import folder_depth, posix_path
from ..graph import Graph

FRONTEND_LANGUAGES = ("javascript", "typescript", "html", "css")


def overview(nodes: DataFrame) -> DataFrame:
    """(node_type, frontend, n): nodes by type and by whether their language is one of a browser."""
    front = F.coalesce(F.lower("language").isin(*FRONTEND_LANGUAGES), F.lit(False))
    return nodes.groupBy("node_type", front.alias("frontend")).agg(F.count("*").alias("n"))


def repository_stats(graph: Graph) -> DataFrame:
    """(section, key, n): node and edge counts by type, and totals."""
    part = lambda df, section, key: df.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "key", "n")
    total = lambda df, key: df.agg(F.count("*").alias("n")).select(F.lit("total").alias("section"), F.lit(key).alias("key"), "n")
    return part(graph.nodes, "node_type", "node_type").union(part(graph.edges, "edge_type", "type")).union(total(graph.nodes, "nodes")).union(total(graph.edges, "edges"))


def file_tree(files: DataFrame, column: str = "path") -> DataFrame:
    """(path, kind, depth, parent) of files and all their folders; folders first, then names without regard to case,
    is the order of (parent, kind_rank, name)."""
    path = F.trim(posix_path(F.col(column)), F.lit("/"))
    parts = F.split(path, "/")
    every = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k < F.size(parts)).alias("folder")))).alias("p"))
    found = every.groupBy("p.path").agg(F.max("p.folder").alias("folder"))
    parent = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    return found.select("path", F.when(F.col("folder"), "folder").otherwise("file").alias("kind"), folder_depth(F.col("path")).cast("long").alias("depth"), parent.alias("parent"), F.when(F.col("folder"), 0).otherwise(1).alias("kind_rank"), F.lower(F.regexp_extract("path", "([^/]*)$", 1)).alias("name"))


def page(df: DataFrame, number: int, size: int, *order) -> DataFrame:
    """A page of an ordered table, with the total and whether more rows follow beside each row."""
    total = F.broadcast(df.agg(F.count("*").alias("total")))  # one row
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(total).withColumn("has_more", F.lit(number * size) < F.col("total"))


def mermaid(graph: Graph, limit: int = 200) -> str:
    """The first edges as a flowchart in text."""
    rows = graph.edges.orderBy("src", "dst", "type").limit(limit).collect()
    return "\n".join(["flowchart LR", *(f"  {r.src} -->|{r.type}| {r.dst}" for r in rows)])


def components_detail(graph: Graph, node_type: str, limit: int = 500) -> DataFrame:
    """(id, name, calls, called_by) of nodes of a type with the sorted names around them; a report of ``limit`` rows."""
    names = graph.nodes.select("id", F.col("name").alias("other"))
    own = graph.nodes.where(F.col("node_type") == node_type).orderBy("id").limit(limit).select("id", "name")
    out = graph.edges.join(own.select(F.col("id").alias("src")), "src", "left_semi").join(names.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_set("other")).alias("calls"))
    into = graph.edges.join(own.select(F.col("id").alias("dst")), "dst", "left_semi").join(names.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sort_array(F.collect_set("other")).alias("called_by"))
    empty = F.array().cast("array<string>")
    return own.join(out, "id", "left").join(into, "id", "left").select("id", "name", F.coalesce("calls", empty).alias("calls"), F.coalesce("called_by", empty).alias("called_by"))
