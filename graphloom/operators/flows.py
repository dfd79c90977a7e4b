"""Flows, clusters and evidence: bounded neighbourhoods with a meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..graph import BOTH, INCOMING, OUTGOING, Graph
from ..scratch import Scratch
from . import analytics, traversal

#: Edge types by what they say, and for each flow those that it follows, in which direction and order.
CALL_EDGES = ("calls", "api_calls")
SERVICE_EDGES = ("uses_service",)
TABLE_EDGES = ("reads_table", "writes_table", "updates_table", "deletes_table")
DEPENDENCY_EDGES = ("imports", "dependency_injection", "inherits")
AUTH_EDGES = ("auth_dependency", "middleware_dependency")
EXTERNAL_EDGES = ("external_api",)
CRITICAL_TYPES = ("api_route", "service", "database_table", "external_api")
FLOWS = {
    "api_request": (CALL_EDGES + SERVICE_EDGES + TABLE_EDGES + EXTERNAL_EDGES, OUTGOING, "bfs"),
    "authentication": (AUTH_EDGES + CALL_EDGES + TABLE_EDGES, OUTGOING, "bfs"),
    "repo_analysis": (CALL_EDGES + SERVICE_EDGES + TABLE_EDGES + EXTERNAL_EDGES, OUTGOING, "bfs"),
    "db_interaction": (TABLE_EDGES + CALL_EDGES, INCOMING, "bfs"),
    "service_dependency": (SERVICE_EDGES + CALL_EDGES + DEPENDENCY_EDGES, OUTGOING, "dfs"),
}


def named_flow(graph: Graph, root, kind: str, **bounds) -> tuple[DataFrame, DataFrame]:
    """Nodes and steps of one of FLOWS."""
    types, direction, order = FLOWS[kind]
    return flow(graph, root, list(types), direction, order=order, **bounds)


def flow(graph: Graph, root, types: list[str], direction: str = OUTGOING, max_depth: int = 6, max_nodes: int = 60, max_edges: int = 120, order: str = "bfs") -> tuple[DataFrame, DataFrame]:
    """Nodes (node, depth, in_degree, out_degree, critical) and steps (src, dst, type, ordinal) of one flow.

    A flow is a report: ``max_nodes`` nearest nodes (with ``order`` dfs: the first of a depth-first search) and ``max_edges`` first steps. Steps are the allowed edges between
    its nodes, by the smaller depth, the larger depth, the ids and the type. Critical are the root, interfaces and
    services, and nodes with two steps in or three out.
    """
    scratch = Scratch(graph.edges.sparkSession, "flow")
    if order == "dfs":
        inner = Graph(graph.nodes, graph.edges.where(F.col("type").isin(types)))
        near = traversal.depth_first(inner, root, direction, max_depth).orderBy("preorder").limit(max_nodes)
    else:
        near = traversal.bfs(graph, root, direction, max_depth, types).orderBy("depth", "node").limit(max_nodes)
    near = scratch.save(near.select(F.col("node").alias("id"), "depth"), "nodes")
    allowed = graph.edges.where(F.col("type").isin(types)).select("src", "dst", "type").distinct()
    a, b = near.select(F.col("id").alias("src"), F.col("depth").alias("da")), near.select(F.col("id").alias("dst"), F.col("depth").alias("db"))
    by_depth = [F.least("da", "db"), F.greatest("da", "db"), "src", "dst", "type"]
    steps = allowed.join(a, "src").join(b, "dst").orderBy(*by_depth).limit(max_edges)
    steps = scratch.save(steps.withColumn("ordinal", F.row_number().over(Window.orderBy(*by_depth))).select("src", "dst", "type", "ordinal"), "steps")
    degree = analytics.degrees(Graph(near, steps))
    kinds = graph.nodes.select("id", "node_type")
    nodes = near.join(degree, "id").join(kinds, "id", "left")
    critical = (F.col("id") == F.lit(root)) | F.coalesce(F.col("node_type").isin(*CRITICAL_TYPES), F.lit(False)) | (F.col("fan_in") >= 2) | (F.col("fan_out") >= 3)
    return nodes.select(F.col("id").alias("node"), "depth", F.col("fan_in").alias("in_degree"), F.col("fan_out").alias("out_degree"), critical.alias("critical")), steps


def cluster(graph: Graph, seeds: DataFrame, pattern: str, hops: int = 3) -> DataFrame:
    """(id) within ``hops`` undirected steps of ``seeds(id)``, through nodes whose name matches."""
    inner = graph.nodes.where(F.col("name").rlike(pattern)).select("id").union(seeds.select("id")).distinct()
    near = graph.subgraph(inner)
    one = seeds.select(F.lit(0).alias("source"), F.col("id").alias("node"))
    return traversal.walk(near.directed(BOTH), one, hops).select(F.col("node").alias("id")).distinct()


def folder_clusters(nodes: DataFrame, least: int = 3) -> DataFrame:
    """(folder, n) of folders with at least so many nodes."""
    folder = F.regexp_replace("file", "/[^/]*$", "")
    return nodes.groupBy(folder.alias("folder")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def confidence(graph: Graph, members: DataFrame, pattern: str) -> DataFrame:
    """One row: confidence that ``members(id)`` are a workflow."""
    own = graph.subgraph(members.select("id").distinct())
    folder = F.regexp_replace("file", "/[^/]*$", "")
    n = own.nodes.agg(F.count("*").alias("nodes"), F.sum((F.col("node_type") == "api_route").cast("int")).alias("apis"), F.countDistinct(folder).alias("folders"), F.sum(F.col("name").rlike(pattern).cast("int")).alias("hits"))
    e = own.edges.agg(F.count("*").alias("inner"))
    return n.crossJoin(e).select("nodes", "inner", S.discovery_confidence(F.col("nodes"), F.col("inner"), F.col("apis"), F.col("folders"), F.col("hits")).alias("confidence"))


def evidence(graph: Graph, target, max_depth: int = 5) -> DataFrame:
    """(node, depth, chain, kind) of callers: the names on the way from the caller to the target, by first discoverers."""
    found = traversal.bfs(graph, target, INCOMING, max_depth)
    names = graph.nodes.select(F.col("id").alias("node"), "name", "node_type")
    rows = Scratch(graph.edges.sparkSession, "evidence").save(found.join(names, "node", "left"), "rows")
    chain = rows.where("depth = 0").select("node", "depth", F.array("name").alias("chain"), "node_type")
    out = chain.where("depth > 0")
    for depth in range(1, max_depth + 1):
        above = chain.select(F.col("node").alias("parent"), F.col("chain").alias("rest"))
        chain = rows.where(F.col("depth") == depth).join(above, "parent").select("node", "depth", F.concat(F.array("name"), "rest").alias("chain"), "node_type")
        out = out.union(chain)
    kind = F.when(F.col("node_type") == "api_route", "api").when(F.col("node_type") == "service", "service").otherwise("caller")
    return out.select("node", "depth", F.array_join("chain", " > ").alias("chain"), kind.alias("kind"))


#: Most interfaces that chains are made for, and the confidence of such a chain, of a path to the nearest one and of a journey.
MOST_APIS, API_SURE, PATH_SURE, JOURNEY_SURE = 12, 0.75, 0.85, 1.0


def evidence_chains(graph: Graph, source, impacted: DataFrame, workflows: DataFrame, journeys: DataFrame, direction: str = OUTGOING) -> DataFrame:
    """(chain_type, target, summary, confidence_percent, steps) of why a change of ``source`` matters.

    ``impacted(node)`` are nodes within reach; ``workflows(workflow, service, confidence)`` the workflows hit; ``journeys(journey,
    workflow)`` all journeys. Chains: from the source by each workflow to its service; by all journeys hit to each of them; to
    each of the first twelve impacted interfaces by id (by route, else by name); and the path to the nearest of all of these.
    Steps are arrays of (label, step_type). Of chains with one type and summary the surest stays.
    """
    spark = graph.edges.sparkSession
    names = graph.nodes.select("id", "name")
    label = F.coalesce(F.col("route_path"), F.col("name")) if "route_path" in graph.nodes.columns else F.col("name")
    first = names.where(F.col("id") == F.lit(source)).agg(F.first("name").alias("name")).first().name
    step = lambda value, kind: F.struct(value.alias("label"), F.lit(kind).alias("step_type"))
    begin = F.array(step(F.lit(first), "node")) if first is not None else F.array().cast("array<struct<label:string,step_type:string>>")

    def chains(df: DataFrame, kind: str, steps, target, sure) -> DataFrame:
        way = F.concat(begin, steps, F.array(step(target, kind)))
        return df.select(F.lit(kind).alias("chain_type"), target.alias("target"), way.alias("steps"), F.round(sure * 100, 1).alias("confidence_percent"))

    nothing = F.array().cast("array<struct<label:string,step_type:string>>")
    hit = workflows.where("workflow is not null")
    out = chains(hit, "service", F.array(step(F.col("workflow"), "workflow")), F.col("service"), F.coalesce("confidence", F.lit(0.0)))
    struck = journeys.join(hit.select("workflow").distinct(), "workflow", "left_semi").select("journey").distinct()
    # Journeys are described by hand: a few rows, gathered into one.
    every = struck.agg(F.sort_array(F.collect_list("journey")).alias("_all"))
    both = struck.join(F.broadcast(every))
    out = out.union(chains(both, "journey", F.transform("_all", lambda j: F.struct(j.alias("label"), F.lit("journey").alias("step_type"))), F.col("journey"), F.lit(JOURNEY_SURE)))
    apis = graph.nodes.where("node_type = 'api_route'").join(impacted.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    out = out.union(chains(apis.orderBy("id").limit(MOST_APIS), "api_route", nothing, label, F.lit(API_SURE)))
    path = traversal.nearest_target(graph, source, apis.select(F.col("id").alias("node")), direction)
    if path:
        kind = graph.nodes.schema["id"].dataType.simpleString()
        placed = spark.createDataFrame([(n, k) for k, n in enumerate(path)], f"id {kind}, place int").join(names, "id", "left")
        said = placed.agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "name"))), lambda x: x["name"]).alias("_names"))  # a path of a few steps
        inner = F.transform(F.slice("_names", F.lit(1), F.size("_names") - 1), lambda n: F.struct(n.alias("label"), F.lit("node").alias("step_type")))
        out = out.union(chains(said, "api_route", inner, F.element_at("_names", -1), F.lit(PATH_SURE)))
    told = out.withColumn("summary", F.array_join(F.transform("steps", lambda x: x["label"]), " → "))
    best = told.groupBy("chain_type", "summary").agg(F.max(F.struct("confidence_percent", "target", "steps")).alias("b"))
    return best.select("chain_type", "b.target", "summary", "b.confidence_percent", "b.steps")


def outbound(graph: Graph, visited: DataFrame, types: list[str]) -> DataFrame:
    """(name, type) that visited(node) nodes lead to by the given edge types, distinct by name."""
    names = graph.nodes.select(F.col("id").alias("dst"), "name")
    return graph.edges.where(F.col("type").isin(types)).join(visited.select(F.col("node").alias("src")).distinct(), "src", "left_semi").join(names, "dst").groupBy("name").agg(F.min("type").alias("type"))


def cycles_met(graph: Graph, visited: DataFrame) -> DataFrame:
    """One row: edges among visited(node, depth) that lead back to an equal or smaller depth of the upstream search."""
    a = visited.select(F.col("node").alias("src"), F.col("depth").alias("da"))
    b = visited.select(F.col("node").alias("dst"), F.col("depth").alias("db"))
    return graph.edges.join(a, "src").join(b, "dst").where("da <= db").agg(F.count("*").alias("n"))
