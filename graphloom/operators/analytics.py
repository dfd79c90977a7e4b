"""Scores of nodes and of the whole graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores as S
from ..graph import Graph
from . import traversal


def degrees(graph: Graph) -> DataFrame:
    """(id, fan_in, fan_out) of every node, 0 without edges: one pass that counts both ends."""
    ends = graph.edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    counts = ends.groupBy("id").agg(F.sum("into").alias("fan_in"), F.sum(1 - F.col("into")).alias("fan_out"))
    return graph.nodes.select("id").join(counts, "id", "left").fillna(0, ["fan_in", "fan_out"])


def coupling(graph: Graph) -> DataFrame:
    return degrees(graph).withColumn("coupling", S.coupling(F.col("fan_in"), F.col("fan_out")))


def blast_radius(graph: Graph, max_depth: int = 8) -> DataFrame:
    """(id, blast_radius): how many nodes reach each node in up to ``max_depth`` steps."""
    counts = traversal.reverse_counts(graph.edges, max_depth).select(F.col("target").alias("id"), F.col("n").alias("blast_radius"))
    return graph.nodes.select("id").join(counts, "id", "left").fillna(0, ["blast_radius"])


def scored(graph: Graph, max_depth: int = 8) -> DataFrame:
    """(id, fan_in, fan_out, coupling, blast_radius, risk_level) of every node."""
    both = coupling(graph).join(blast_radius(graph, max_depth), "id")
    return both.withColumn("risk_level", S.risk_level(F.col("fan_in"), F.col("blast_radius")))


def score_summary(rows: DataFrame) -> DataFrame:
    """One row: nodes by risk level, largest blast radius and fan-in."""
    level = lambda x: F.sum(F.when(F.col("risk_level") == x, 1).otherwise(0)).cast("long").alias(x)
    return rows.agg(F.count("*").alias("total"), *map(level, ("critical", "high", "medium", "low")), F.max("blast_radius").alias("max_blast"), F.max("fan_in").alias("max_fan_in"))


def node_impact(graph: Graph, target, max_depth: int = 8, limit: int = 200) -> DataFrame:
    """(node, depth, node_type) of what reaches a node, nearest first; a report of ``limit`` rows."""
    found = traversal.ancestors(graph, target, max_depth)
    types = graph.nodes.select(F.col("id").alias("node"), "node_type")
    return found.join(types, "node").orderBy("depth", "node").limit(limit)


def with_maxima(rows: DataFrame) -> DataFrame:
    """max_in and max_out beside every row; the maxima are one row."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max("fan_in").alias("max_in"), F.max("fan_out").alias("max_out"))))


def subgraph_centrality(graph: Graph) -> DataFrame:
    """(id, centrality): degree by the largest degree, three digits."""
    total = degrees(graph).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    most = F.broadcast(total.agg(F.greatest(F.max("degree"), F.lit(1)).alias("most")))
    return total.crossJoin(most).select("id", F.round(F.col("degree") / F.col("most"), 3).alias("centrality"))


def graph_health(graph: Graph) -> DataFrame:
    """One row: types, nodes, edges, density (edges by nodes), score."""
    n = graph.nodes.agg(F.count("*").alias("nodes"))
    e = graph.edges.agg(F.count("*").alias("edges"), F.countDistinct("type").alias("types"))
    both = n.crossJoin(e)
    density = F.when(F.col("nodes") > 0, F.round(F.col("edges") / F.col("nodes"), 2)).otherwise(0.0)
    return both.select("types", "nodes", "edges", density.alias("density"), S.graph_health(F.col("types"), F.col("nodes"), F.col("edges")).alias("score"))


def architecture_health(graph: Graph, imports: str | None = None) -> DataFrame:
    """One row: complexity, coupling, maintainability, risk and overall score with its band; 100s for no nodes."""
    rows = degrees(graph)
    if imports is not None:
        rows = rows.join(graph.nodes.select("id", F.coalesce(F.size(imports), F.lit(0)).alias("n_imports")), "id")
    else:
        rows = rows.withColumn("n_imports", F.lit(0))
    between = F.col("fan_in") * F.col("fan_out")
    agg = rows.agg(F.count("*").alias("n"), F.avg("n_imports").alias("imports"), F.sum((F.col("fan_out") > 10).cast("int")).alias("wide"), F.avg(between).alias("between"), F.sum((between > 50).cast("int")).alias("tight"))
    apis = graph.nodes.agg(F.sum((F.col("node_type") == "api_route").cast("int")).alias("apis"))
    edges = graph.edges.agg(F.count("*").alias("m"))
    n, m = F.col("n"), F.col("m")
    d, density = F.try_divide(m, n), F.when(n > 1, F.try_divide(m, n * (n - 1))).otherwise(0.0)
    to_score = lambda raw: F.coalesce(S.clamp(F.floor(100 - raw + 1e-9), 0, 100), F.lit(100)).cast("long")
    out = agg.crossJoin(apis).crossJoin(edges).select(
        to_score(10 * d + F.try_divide(20 * F.col("apis"), n)).alias("complexity_score"),
        to_score(5 * F.col("imports") + 5 * d).alias("coupling_score"),
        to_score(1000 * density + F.try_divide(500 * F.col("wide"), n)).alias("maintainability_score"),
        to_score(2 * F.col("between") + F.try_divide(200 * F.col("tight"), n)).alias("risk_score"),
    )
    overall = F.floor((F.col("complexity_score") + F.col("coupling_score") + F.col("maintainability_score") + F.col("risk_score")) / 4).cast("long")
    return out.withColumn("overall_score", overall).withColumn("health", S.health_band(F.col("overall_score")))


def hotspots(graph: Graph, limit: int = 15) -> DataFrame:
    """(id, level) of the most entangled nodes, most severe first, then by id; a report of ``limit`` rows."""
    rows = degrees(graph).withColumn("level", S.hotspot(F.col("fan_in"), F.col("fan_out"))).where("level is not null")
    return rows.orderBy(S.severity(F.col("level")).desc(), "id").limit(limit).select("id", "level")


def risk_history(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, old_score, new_score) where the score is new or has changed."""
    before = old.select("id", F.col("risk_score").alias("old_score"))
    return new.select("id", F.col("risk_score").alias("new_score")).join(before, "id", "left").where(~F.col("old_score").eqNullSafe(F.col("new_score"))).select("id", "old_score", "new_score")


def critical_paths_hit(paths: DataFrame, impacted: DataFrame) -> DataFrame:
    """(path_id, n_hit) of those paths(path_id, nodes) that hold an impacted node."""
    steps = paths.select("path_id", F.explode("nodes").alias("id")).distinct()
    return steps.join(impacted.select("id").distinct(), "id", "left_semi").groupBy("path_id").agg(F.count("*").alias("n_hit"))


def related_workflows(members: DataFrame, edges: DataFrame, workflow, limit: int = 8) -> DataFrame:
    """(workflow) names that share a node with the given one, or are joined to it by an edge; at most ``limit``, sorted."""
    own = members.where(F.col("workflow") == workflow).select("id")
    across = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    both = across.union(across.select("b", "a"))
    near = own.union(both.join(own, both["a"] == own["id"], "left_semi").select(F.col("b").alias("id"))).distinct()
    return members.join(near, "id", "left_semi").where(F.col("workflow") != workflow).select("workflow").distinct().orderBy("workflow").limit(limit)


#: Journeys that are high whenever they are hit.
SEVERE_JOURNEYS = ("user_login", "repo_onboarding")


def journeys_hit(journeys: DataFrame, workflows: DataFrame) -> DataFrame:
    """(journey, n_hit, severity): journeys(journey, workflow) by the impacted workflows(workflow); high from two on, and for SEVERE_JOURNEYS."""
    hit = journeys.join(workflows.select("workflow").distinct(), "workflow", "left_semi").groupBy("journey").agg(F.countDistinct("workflow").alias("n_hit"))
    return hit.withColumn("severity", F.when((F.col("n_hit") >= 2) | F.col("journey").isin(*SEVERE_JOURNEYS), "high").otherwise("medium"))
