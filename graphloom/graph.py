"""The typed property graph: a table of nodes and a table of edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OUTGOING, INCOMING, BOTH = "OUTGOING", "INCOMING", "BOTH"
RELATIONSHIPS = ("CALLS", "INHERITS", "IMPORTS", "USES", "CONTAINS", "DEPENDS_ON", "OVERRIDES", "IMPLEMENTS", "DEFINES", "REFERENCES")


@dataclass(frozen=True)
class Graph:
    """``nodes`` has id and any attributes; ``edges`` has src, dst, type and, where order counts, ordinal."""

    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_lists(cls, spark: SparkSession, adjacency: dict[str, list]) -> Graph:
        """From {node: [target, or (target, type), ...]}; the place in the list is the ordinal."""
        edges = []
        for src, targets in adjacency.items():
            for k, t in enumerate(targets):
                dst, kind = (t[0], t[1]) if isinstance(t, (tuple, list)) else (t, "USES")
                edges.append((src, dst, kind, k))
        names = {*adjacency, *(e[1] for e in edges)}
        nodes = spark.createDataFrame([(n, n) for n in sorted(names)], "id string, name string")
        return cls(nodes, spark.createDataFrame(edges, "src string, dst string, type string, ordinal int"))

    def directed(self, direction: str = OUTGOING, types: list[str] | None = None) -> DataFrame:
        """Steps (at, to, type, ordinal) in a direction. BOTH takes out-edges and in-edges, a loop only once."""
        edges = self.edges if types is None else self.edges.where(F.col("type").isin(types))
        ordinal = F.col("ordinal") if "ordinal" in edges.columns else F.lit(0)
        forth = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "type", ordinal.alias("ordinal"))
        back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), "type", ordinal.alias("ordinal"))
        if direction == OUTGOING:
            return forth
        if direction == INCOMING:
            return back
        if direction in (BOTH, "UNDIRECTED"):
            return forth.union(back.where("at <> to"))
        raise ValueError(f"unknown direction: {direction}")

    def subgraph(self, ids: DataFrame) -> Graph:
        """The graph induced by ``ids(id)``: edges with both ends in it."""
        src, dst = ids.select(F.col("id").alias("src")), ids.select(F.col("id").alias("dst"))
        return Graph(self.nodes.join(ids, "id", "left_semi"), self.edges.join(src, "src", "left_semi").join(dst, "dst", "left_semi"))

    def statistics(self) -> DataFrame:
        """One row: node_count, edge_count, density (0 for fewer than two nodes)."""
        n = self.nodes.agg(F.count("*").alias("node_count"))
        e = self.edges.agg(F.count("*").alias("edge_count"))
        density = F.when(F.col("node_count") > 1, F.col("edge_count") / (F.col("node_count") * (F.col("node_count") - 1))).otherwise(F.lit(0.0))
        return n.crossJoin(e).withColumn("density", density)  # one row each
