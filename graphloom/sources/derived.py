"""Graphs derived from the order, part and event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import Scratch

NODE_TYPES = ("function", "class", "api_route", "service", "database_table")
EDGE_TYPES = ("CALLS", "IMPORTS", "USES", "INHERITS")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, NODE_TYPES)), F.col("p_size") % 5 + 1)
    p = table(spark, sf_dir, "part")
    qualified = F.concat_ws(".", "p_brand", "p_name", F.col("p_partkey").cast("string"))
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), qualified.alias("qualified_name"), kind.alias("node_type"), F.col("p_brand").alias("file"), F.col("p_type").alias("package"), F.col("p_size").cast("long").alias("size"), F.col("p_retailprice").alias("price"))


def _followers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, l_orderkey, n, dst): the parts of following lines of one order, over all orders; without loops."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = l.select("l_orderkey", (F.col("l_linenumber") + 1).alias("n"), F.col("l_partkey").alias("src"))
    b = l.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "n"]).where("src <> dst")


def _typed(edges: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, EDGE_TYPES)), ((F.col("src") + F.col("dst")) % 4 + 1).cast("int"))
    return edges.select("src", "dst").distinct().withColumn("type", kind)


def _kept(spark: SparkSession, sf_dir: str, edges: DataFrame, name: str) -> Graph:
    """The edges are written once, as every traversal reads them again and again."""
    return Graph(part_nodes(spark, sf_dir), Scratch(spark, name).save(edges, "edges"))


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Each part with all parts that follow it in an order. Dense, for what takes one pass over the edges."""
    return _kept(spark, sf_dir, _typed(_followers(spark, sf_dir)), "order-graph")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Each part with the part that follows it in its first order, and with that in its last one, over all orders.

    Cyclic, and sparse enough for what looks at pairs or paths: at most two edges lead out of a part.
    """
    place = F.struct("l_orderkey", "n", "dst")
    ends = _followers(spark, sf_dir).groupBy("src").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    both = ends.select("src", F.explode(F.array("first.dst", "last.dst")).alias("dst"))
    return _kept(spark, sf_dir, _typed(both), "part-graph")


def part_dag(spark: SparkSession, sf_dir: str) -> Graph:
    g = part_graph(spark, sf_dir)
    return Graph(g.nodes, g.edges.where("src < dst"))


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A layered graph: region, nation, customer, order, part and supplier, with ids that carry their kind."""
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    n, c, o, s, l = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "supplier", "lineitem"))
    parts = [
        n.select(key("N:", "n_nationkey").alias("src"), key("R:", "n_regionkey").alias("dst")),
        c.select(key("C:", "c_custkey").alias("src"), key("N:", "c_nationkey").alias("dst")),
        o.select(key("O:", "o_orderkey").alias("src"), key("C:", "o_custkey").alias("dst")),
        s.select(key("S:", "s_suppkey").alias("src"), key("N:", "s_nationkey").alias("dst")),
        l.select(key("P:", "l_partkey").alias("src"), key("O:", "l_orderkey").alias("dst")).distinct(),
    ]
    edges = reduce(DataFrame.union, parts).withColumn("type", F.lit("DEPENDS_ON"))
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return Graph(nodes.withColumn("node_type", F.substring("id", 1, 1)), edges)


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) for consecutive events of a user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("dst", F.lead("event_type").over(order))
    return e.where("dst is not null").select(F.col("event_type").alias("src"), "dst")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, target) of every link of every page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target"))


def node_metrics(spark: SparkSession, sf_dir: str, graph: Graph | None = None) -> DataFrame:
    """Degrees of the part graph with made-up reach counts, as input of the scores."""
    from ..operators.analytics import degrees

    g = graph or order_graph(spark, sf_dir)
    rows = degrees(g).join(g.nodes.select("id", "size", "node_type", "name"), "id")
    return rows.select("id", "name", "node_type", "fan_in", "fan_out", (F.col("size") % 4).alias("wf"), (F.col("size") % 3).alias("svc"), (F.col("id") % 3).alias("cp"), (F.col("id") % 5).alias("api"), (F.col("id") % 2).alias("jr"), (F.col("size") % 7).alias("tbl"))
