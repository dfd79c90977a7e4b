"""What the lookup, adjacency and semantic indexes answer, as filters and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph

HIERARCHY, REFERENCES = ("INHERITS",), ("REFERENCES", "CALLS", "USES")


def grouped(nodes: DataFrame, column: str, missing: str) -> DataFrame:
    """(key, node_ids, n) of nodes by file, package, namespace, language; blank and null count as ``missing``."""
    key = F.coalesce(F.when(F.trim(F.col(column)) != "", F.col(column)), F.lit(missing))
    return nodes.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list("id")).alias("node_ids"), F.count("*").alias("n"))


def unique_lookup(nodes: DataFrame, column: str, allow_duplicates: bool = False, order: str = "id") -> DataFrame:
    """(key, id) of a unique column, blanks skipped; duplicates raise, or the last in order wins."""
    rows = nodes.where(F.trim(F.col(column)) != "")
    if not allow_duplicates:
        twice = rows.groupBy(column).count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"duplicate {column}: {twice[0][0]}")
        return rows.select(F.col(column).alias("key"), "id")
    return rows.groupBy(F.col(column).alias("key")).agg(F.max_by("id", order).alias("id"))


def adjacency(graph: Graph, reverse: bool = False, check: bool = True) -> DataFrame:
    """(node, neighbors sorted, degree) for every node; an edge whose end is no node raises."""
    at, to = ("dst", "src") if reverse else ("src", "dst")
    if check:
        known = graph.nodes.select(F.col("id").alias("end"))
        ends = graph.edges.select(F.col("src").alias("end")).union(graph.edges.select("dst"))
        if not ends.join(known, "end", "left_anti").isEmpty():
            raise ValueError("an edge ends at no node")
    lists = graph.edges.groupBy(F.col(at).alias("node")).agg(F.sort_array(F.collect_list(to)).alias("neighbors"), F.count("*").alias("degree"))
    every = graph.nodes.select(F.col("id").alias("node"))
    empty = F.array().cast(lists.schema["neighbors"].dataType)
    return every.join(lists, "node", "left").select("node", F.coalesce("neighbors", empty).alias("neighbors"), F.coalesce("degree", F.lit(0)).alias("degree"))


def compressed_rows(graph: Graph) -> DataFrame:
    """(node, start, stop): slices of the target list that is ordered by source and target.

    Nodes are dealt out in ranges; each range sums its own degrees, and gets the sum of those before it.
    """
    from pyspark.sql import Window

    from ..scratch import Scratch

    degrees = adjacency(graph, check=False).select("node", "degree").repartitionByRange("node").withColumn("part", F.spark_partition_id())
    degrees = Scratch(graph.edges.sparkSession, "offsets").save(degrees, "degrees")
    totals = degrees.groupBy("part").agg(F.sum("degree").alias("total"))  # a row for each range
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    stop = F.sum("degree").over(Window.partitionBy("part").orderBy("node")) + F.col("before")
    return degrees.join(F.broadcast(before), "part").select("node", (stop - F.col("degree")).alias("start"), stop.alias("stop"))


def edge_by_id(edges: DataFrame, edge_id) -> DataFrame:
    return edges.where(F.col("edge_id") == edge_id)


def outgoing(edges: DataFrame, node) -> DataFrame:
    """The edges out of a node, parallel ones too."""
    return edges.where(F.col("src") == node)


def incoming(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node)


def node_relations(edges: DataFrame, node) -> DataFrame:
    """Every edge at a node once, a loop too."""
    return edges.where((F.col("src") == node) | (F.col("dst") == node))


def of_type(edges: DataFrame, kind: str) -> DataFrame:
    return edges.where(F.upper("type") == kind.upper())


def edge_lists(graph: Graph, reverse: bool = False) -> DataFrame:
    """(node, edge_ids sorted, n) for every node: the ids of the edges out of it, or into it."""
    at = "dst" if reverse else "src"
    lists = graph.edges.groupBy(F.col(at).alias("node")).agg(F.sort_array(F.collect_list("edge_id")).alias("edge_ids"), F.count("*").alias("n"))
    every = graph.nodes.select(F.col("id").alias("node"))
    return every.join(lists, "node", "left").select("node", F.coalesce("edge_ids", F.array().cast("array<string>")).alias("edge_ids"), F.coalesce("n", F.lit(0)).alias("n"))


def reference_lists(edges: DataFrame) -> DataFrame:
    """(definition, referrers sorted) over reference, call and use edges."""
    return edges.where(F.col("type").isin(*REFERENCES)).groupBy(F.col("dst").alias("definition")).agg(F.sort_array(F.collect_set("src")).alias("referrers"))


def incident(graph: Graph) -> DataFrame:
    """(node, n_edges) with a loop counted once; nodes without edges have 0."""
    ends = graph.edges.select(F.col("src").alias("node")).union(graph.edges.where("src <> dst").select("dst"))
    counts = ends.groupBy("node").agg(F.count("*").alias("n_edges"))
    return graph.nodes.select(F.col("id").alias("node")).join(counts, "node", "left").fillna(0, ["n_edges"])


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst")


def by_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def hierarchy(edges: DataFrame, kinds: tuple[str, ...] = HIERARCHY) -> DataFrame:
    """(child, parent) of the inheritance edges."""
    return edges.where(F.col("type").isin(*kinds)).select(F.col("src").alias("child"), F.col("dst").alias("parent")).distinct()


def inheritance_kind(node_type: Column) -> Column:
    """interface, abstract, trait or mixin by the first of these that the type's name contains; else null."""
    out = F.lit(None).cast("string")
    for word in ("mixin", "trait", "abstract", "interface"):
        out = F.when(F.lower(node_type).contains(word), word).otherwise(out)
    return out


def implementations(edges: DataFrame) -> DataFrame:
    return edges.where("type = 'IMPLEMENTS'").select(F.col("dst").alias("interface"), F.col("src").alias("implementation"))


def route_key(method: Column, path: Column) -> Column:
    return F.concat(F.upper(method), F.lit(":"), path)


def routes(nodes: DataFrame, allow_duplicates: bool = False) -> DataFrame:
    """(key, id) of interfaces by ``METHOD:path``; two of one key raise, or the last by id wins. Nodes without both are left out."""
    keyed = nodes.where("http_method is not null and route_path is not null").withColumn("_route", route_key(F.col("http_method"), F.col("route_path")))
    return unique_lookup(keyed, "_route", allow_duplicates)


def referrers(edges: DataFrame) -> DataFrame:
    """(definition, n_referrers) over reference, call and use edges."""
    return edges.where(F.col("type").isin(*REFERENCES)).groupBy(F.col("dst").alias("definition")).agg(F.countDistinct("src").alias("n_referrers"))


def file_imports(graph: Graph) -> DataFrame:
    """(file, imported): nodes that the nodes of a file import."""
    sources = graph.nodes.select(F.col("id").alias("src"), "file")
    return graph.edges.where("type = 'IMPORTS'").join(sources, "src").select("file", F.col("dst").alias("imported")).distinct()


def package_importers(graph: Graph) -> DataFrame:
    """(package, file): files that import something of a package."""
    targets = graph.nodes.select(F.col("id").alias("imported"), "package")
    return file_imports(graph).join(targets, "imported").select("package", "file").distinct()


def annotations(nodes: DataFrame, column: str = "decorators") -> DataFrame:
    """(annotation, node_ids, n), names normalised to one leading @."""
    rows = nodes.select("id", F.explode(column).alias("name")).where("name is not null")
    name = F.concat(F.lit("@"), F.regexp_replace(F.trim("name"), "^@+", ""))
    return rows.groupBy(name.alias("annotation")).agg(F.sort_array(F.collect_set("id")).alias("node_ids"), F.countDistinct("id").alias("n"))


def attribute_groups(nodes: DataFrame) -> DataFrame:
    """(attribute, n) of visibility (public where missing), async, static and test nodes; ``attributes`` is a map."""
    a = lambda k: F.lower(F.col("attributes")[k])
    name = F.lower("name")
    flags = F.array_compact(
        F.array(
            F.concat(F.lit("visibility:"), F.coalesce(a("visibility"), F.lit("public"))),
            F.when((a("is_async") == "true") | name.contains("async"), "async"),
            F.when(a("is_static") == "true", "static"),
            F.when((a("is_test") == "true") | name.contains("test"), "test"),
        )
    )
    return nodes.select("id", F.explode(flags).alias("attribute")).groupBy("attribute").agg(F.count("*").alias("n"))
