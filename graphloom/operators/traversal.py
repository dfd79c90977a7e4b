"""Level-synchronous traversals: each level is one join of the frontier with the edges."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..graph import BOTH, INCOMING, OUTGOING, Graph
from ..scratch import Scratch


def walk(steps: DataFrame, starts: DataFrame, max_depth: int | None = None, targets: DataFrame | None = None, max_nodes: int | None = None, stop: DataFrame | None = None, until: Column | None = None) -> DataFrame:
    """Breadth-first search from many sources at once.

    ``steps(at, to, ordinal, ...)`` and ``starts(source, node)`` give (source, node, depth, parent): every node
    within ``max_depth`` steps of its source (None: however far), at its least depth, the source itself at 0. The parent is the first
    discoverer: the one with the smallest ordinal, then the smallest id. With ``targets(source, node)`` a source goes
    no further than the level on which all its targets have been met. With ``max_nodes`` a source goes no further than the
    level on which it has so many nodes, and its result is trimmed to them by depth and id. ``stop(node)`` are nodes
    that are reached but not left. The whole search ends with the level on which a row meets ``until``.
    """
    spark = starts.sparkSession
    scratch = Scratch(spark, "walk")
    met = F.lit(False) if until is None else F.coalesce(until, F.lit(False))
    kind = starts.schema["node"].dataType
    first = starts.distinct().select("source", "node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"))
    visited = frontier = scratch.save(first, "0")
    slim = steps.select("at", "to", "ordinal")
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        if stop is not None:
            frontier = frontier.join(stop.select("node"), "node", "left_anti").select("source", "node", "depth", "parent")
        if max_nodes is not None:
            full = visited.groupBy("source").agg(F.count("*").alias("n")).where(F.col("n") >= max_nodes).select("source")
            frontier = frontier.join(full, "source", "left_anti")
        if targets is not None:
            open_sources = targets.join(visited, ["source", "node"], "left_anti").select("source").distinct()
            frontier = frontier.join(open_sources, "source", "left_semi")
        found = frontier.join(slim, frontier["node"] == slim["at"]).groupBy("source", F.col("to").alias("node")).agg(F.min(F.struct("ordinal", F.col("at").alias("parent")))["parent"].alias("parent"))
        fresh = found.join(visited.select("source", "node"), ["source", "node"], "left_anti")
        frontier = scratch.save(fresh.select("source", "node", F.lit(depth).alias("depth"), "parent"), str(depth))
        state = frontier.agg(F.count("*").alias("n"), F.max(met).alias("met")).first()
        visited = scratch.together([str(k) for k in range(depth + 1)], visited)
        if not state.n or state.met:
            break
    if max_nodes is not None:
        order = Window.partitionBy("source").orderBy("depth", "node")
        visited = visited.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_nodes).drop("_n")
    return visited


def _from(graph: Graph, ids, name: str = "node") -> DataFrame:
    kind = graph.edges.schema["src"].dataType
    rows = [(i, i) for i in (ids if isinstance(ids, (list, tuple, set)) else [ids])]
    return graph.edges.sparkSession.createDataFrame(rows, f"source {kind.simpleString()}, {name} {kind.simpleString()}")


def bfs(graph: Graph, start, direction: str = OUTGOING, max_depth: int | None = None, types: list[str] | None = None, target=None, max_nodes: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(node, depth, parent) of everything within reach of ``start``, itself included.

    ``max_edges`` keeps what the first so many steps lead to, in the order of depth, node and step.
    """
    steps = graph.directed(direction, types)
    until = None if target is None else F.col("node") == F.lit(target)
    found = walk(steps, _from(graph, start), 0 if target is not None and target == start else max_depth, None, max_nodes, until=until).drop("source")
    if max_edges is None:
        return found
    # A report of the first steps: sorted and cut, then the nodes that they lead to.
    taken = steps.join(found.select(F.col("node").alias("at"), F.col("depth").alias("_d")), "at").orderBy("_d", "at", "ordinal", "to").limit(max_edges)
    return found.join(taken.select(F.col("to").alias("node")).distinct(), "node", "left_semi").union(found.where("depth = 0")).distinct()


def leaves(graph: Graph, visited: DataFrame, direction: str = OUTGOING) -> DataFrame:
    """Visited nodes other than the start that discovered no node."""
    parents = visited.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    return visited.where("depth > 0").join(parents, "node", "left_anti")


def expand(graph: Graph, ids: DataFrame, direction: str = OUTGOING, types: list[str] | None = None) -> DataFrame:
    """One step from each row of ``ids(id)``; repeated rows and parallel edges are kept."""
    steps = graph.directed(direction, types)
    return ids.join(steps, ids["id"] == steps["at"]).select(F.col("to").alias("id"))


def edge_filter(graph: Graph, ids: DataFrame, kind: str | None) -> DataFrame:
    """Targets of out-edges of one type; without a type the ids themselves."""
    return ids if kind is None else expand(graph, ids, OUTGOING, [kind])


def path_expand(graph: Graph, ids: DataFrame, depth: int = 2) -> DataFrame:
    """The set of ids within ``depth`` outgoing steps, the given ones included."""
    one = ids.select(F.lit(0).alias("source"), F.col("id").alias("node")).distinct()
    return walk(graph.directed(), one, depth).select(F.col("node").alias("id")).distinct()


def expand_where(
    graph: Graph,
    start,
    direction: str = OUTGOING,
    types: list[str] | None = None,
    node_types: list[str] | None = None,
    min_depth: int = 1,
    max_depth: int | None = 3,
    max_nodes: int | None = None,
    stop_types: list[str] | None = None,
    stop: Column | None = None,
    where: Column | None = None,
    track_paths: bool = False,
) -> DataFrame:
    """(node, depth, [path]) with the edge types filtered before each step, depth, node types and ``where`` on what is returned.

    Nodes of ``stop_types``, or for which ``stop`` holds, are reached but not left; ``stop`` and ``where`` are conditions on
    the columns of the nodes. ``max_nodes`` ends the search. ``track_paths`` gives the way by first discoverers.
    """
    halt = F.lit(False)
    if stop_types is not None:
        halt = halt | F.coalesce(F.col("node_type").isin(stop_types), F.lit(False))
    if stop is not None:
        halt = halt | F.coalesce(stop, F.lit(False))
    halted = graph.nodes.where(halt).select(F.col("id").alias("node")) if stop_types is not None or stop is not None else None
    found = walk(graph.directed(direction, types), _from(graph, start), max_depth, None, max_nodes, halted).drop("source")
    if track_paths:
        found = with_paths(found)
    out = found.where(F.col("depth") >= min_depth).drop("parent")
    if node_types is None and where is None:
        return out
    wanted = graph.nodes
    if node_types is not None:
        wanted = wanted.where(F.col("node_type").isin(node_types))
    if where is not None:
        wanted = wanted.where(where)
    return out.join(wanted.select(F.col("id").alias("node")), "node", "left_semi")


def with_paths(found: DataFrame) -> DataFrame:
    """``found(node, depth, parent)`` of one source with the array of nodes from it to each; one join for each level."""
    scratch = Scratch(found.sparkSession, "ways")
    found = scratch.save(found, "found")
    level = out = found.where("depth = 0").withColumn("path", F.array("node"))
    for depth in range(1, (found.agg(F.max("depth")).first()[0] or 0) + 1):
        before = level.select(F.col("node").alias("parent"), F.col("path").alias("_way"))
        nearer = found.where(F.col("depth") == depth).join(before, "parent")
        level = scratch.save(nearer.select("node", "depth", "parent", F.array_append("_way", F.col("node")).alias("path")), str(depth))
        out = out.union(level)
    return out


def ancestors(graph: Graph, start, max_depth: int | None = None, types: list[str] | None = None) -> DataFrame:
    return bfs(graph, start, INCOMING, max_depth, types).where("depth > 0").select("node", "depth")


def descendants(graph: Graph, start, max_depth: int | None = None, types: list[str] | None = None) -> DataFrame:
    return bfs(graph, start, OUTGOING, max_depth, types).where("depth > 0").select("node", "depth")


def neighborhood(graph: Graph, start, hops: int = 1, direction: str = BOTH) -> DataFrame:
    return bfs(graph, start, direction, hops).where("depth > 0").select("node", "depth")


def reachable(graph: Graph, start, targets: list | DataFrame, direction: str = OUTGOING, max_depth: int | None = None) -> DataFrame:
    """(node, depth) of those targets, a list or a table ``targets(node)`` of any size, that are within reach."""
    found = bfs(graph, start, direction, max_depth).select("node", "depth")
    if isinstance(targets, DataFrame):
        return found.join(targets.select("node"), "node", "left_semi")
    return found.where(F.col("node").isin(targets))


def shortest_path(graph: Graph, start, target, direction: str = OUTGOING, max_depth: int | None = None) -> list:
    """Nodes of one shortest path, by first discoverers; empty if there is none, one node if start is target.

    The way back is found by doubling: in each round the parents of 1, 2, 4 ... steps are joined to what is known of it.
    """
    if start is None or target is None:
        raise ValueError("a shortest path needs two nodes")
    if start == target:
        return [start]
    scratch = Scratch(graph.edges.sparkSession, "path")
    found = scratch.save(bfs(graph, start, direction, max_depth, target=target), "found")
    end = found.where(F.col("node") == F.lit(target)).select("node", "depth").first()
    return [] if end is None else _trace(found, target, end.depth, scratch)


def _trace(found: DataFrame, end, depth: int, scratch: Scratch) -> list:
    """Nodes from depth 0 to ``end``, by the parents in ``found(node, depth, parent)``."""
    hops, way, reach = found.where("parent is not null").select("node", F.col("parent").alias("to")), found.where(F.col("node") == F.lit(end)).select("node"), 1
    while reach <= depth:
        way = scratch.save(way.union(way.join(hops, "node").select(F.col("to").alias("node"))), f"way-{reach}")
        further = hops.select(F.col("node").alias("to"), F.col("to").alias("far"))
        hops = scratch.save(hops.join(further, "to").select("node", F.col("far").alias("to")), f"hops-{reach}")
        reach *= 2
    return [r.node for r in found.join(way, "node", "left_semi").orderBy("depth").select("node").collect()]


def nearest_target(graph: Graph, start, targets: DataFrame, direction: str = OUTGOING, types: list[str] | None = None, max_depth: int | None = None) -> list:
    """Nodes of a shortest path from ``start`` to the nearest of ``targets(node)``, however many these are; empty if there is none.

    One search from all targets at once, against the direction, that ends with the level on which it meets the start.
    """
    spark = graph.edges.sparkSession
    scratch = Scratch(spark, "nearest")
    kind = graph.edges.schema["src"].dataType
    starts = targets.where("node is not null").select(F.lit(0).alias("source"), F.col("node").cast(kind).alias("node")).distinct()
    steps = graph.directed(_opposite(direction), types)
    at_once = starts.where(F.col("node") == F.lit(start)).isEmpty()
    if not at_once:
        return [start]
    found = scratch.save(walk(steps, starts, max_depth, until=F.col("node") == F.lit(start)).drop("source"), "found")
    met = found.where(F.col("node") == F.lit(start)).first()
    return [] if met is None else _trace(found, start, met.depth, scratch)[::-1]


def bidirectional(graph: Graph, start, target, max_depth: int | None = None) -> DataFrame:
    """(meeting, length) of a shortest path; empty if there is none.

    Both ends search at the same time, a level of either in turn; each goes on from its last level.
    """
    scratch = Scratch(graph.edges.sparkSession, "meet")
    sides, turn = [], 1
    for node, direction in ((start, OUTGOING), (target, INCOMING)):
        first = scratch.save(_from(graph, node).select("node", F.lit(0).alias("depth")), f"{direction}-0")
        sides.append({"steps": graph.directed(direction).select("at", "to"), "name": direction, "depth": 0, "seen": first, "last": first})
    last = sides[0]["last"]
    while True:
        # The last level against all of the other side: earlier levels have been compared with it already.
        other = sides[turn]["seen"].select("node", F.col("depth").alias("_other"))
        met = last.join(other, "node").select(F.col("node").alias("meeting"), (F.col("depth") + F.col("_other")).alias("length"))
        best = scratch.save(met.orderBy("length", "meeting").limit(1), f"best-{sides[0]['depth']}-{sides[1]['depth']}")
        if not best.isEmpty() or max_depth is not None and sides[0]["depth"] + sides[1]["depth"] >= max_depth:
            return best
        side = sides[turn]
        side["depth"] += 1
        found = side["last"].join(side["steps"], side["last"]["node"] == side["steps"]["at"]).select(F.col("to").alias("node")).distinct()
        fresh = found.join(side["seen"], "node", "left_anti").select("node", F.lit(side["depth"]).alias("depth"))
        last = side["last"] = scratch.save(fresh, f"{side['name']}-{side['depth']}")
        if last.isEmpty():
            return best
        side["seen"] = scratch.together([f"{side['name']}-{k}" for k in range(side["depth"] + 1)], last)
        turn = 1 - turn


def _opposite(direction: str) -> str:
    return {OUTGOING: INCOMING, INCOMING: OUTGOING}.get(direction, direction)


def _distances(steps: DataFrame, nodes: list, kind, max_depth: int | None) -> DataFrame:
    """(node, left): least number of steps from any of the nodes."""
    spark = steps.sparkSession
    starts = spark.createDataFrame([(0, n) for n in nodes], f"source int, node {kind.simpleString()}")
    return walk(steps, starts, max_depth).select("node", F.col("depth").alias("left"))


def simple_paths(graph: Graph, start, targets: list | None = None, max_depth: int = 12, types: list[str] | None = None, direction: str = OUTGOING) -> DataFrame:
    """(node, depth, path) of every path without a repeated node, up to ``max_depth`` steps, ending in a target.

    With targets, the distance of every node to the nearest one is found first, and a path only grows into nodes from
    which a target can still be met within the depth.
    """
    scratch = Scratch(graph.edges.sparkSession, "paths")
    steps = graph.directed(direction, types).select("at", "to").distinct()
    if targets is not None:
        toward = _distances(graph.directed(_opposite(direction), types), targets, graph.edges.schema["src"].dataType, max_depth)
        steps = scratch.save(steps.join(toward.withColumnRenamed("node", "to"), "to"), "steps")
    frontier = _from(graph, start).select("node", F.lit(0).alias("depth"), F.array("node").alias("path"))
    out = None
    for depth in range(1, max_depth + 1):
        able = steps if targets is None else steps.where(F.col("left") + depth <= max_depth)
        longer = frontier.join(able, frontier["node"] == able["at"]).where(~F.array_contains("path", F.col("to")))
        frontier = scratch.save(longer.select(F.col("to").alias("node"), F.lit(depth).alias("depth"), F.array_append("path", F.col("to")).alias("path")), str(depth))
        out = frontier if out is None else out.union(frontier)
        if frontier.isEmpty():
            break
    return out if targets is None else out.where(F.col("node").isin(targets))


def shortest_ways(graph: Graph, start, target, direction: str = OUTGOING, types: list[str] | None = None, max_depth: int | None = None) -> tuple[DataFrame, int | None]:
    """Steps (at, to, depth) that lie on some shortest path, and its length (None if there is none).

    One search from the start that ends with the target's level, and one back from the target over as many levels; a step
    is on a shortest path if both distances and the step itself add up to the length.
    """
    scratch = Scratch(graph.edges.sparkSession, "ways")
    kind = graph.edges.schema["src"].dataType
    found = scratch.save(bfs(graph, start, direction, max_depth, types, target=target).select("node", "depth"), "from")
    end = found.where(F.col("node") == F.lit(target)).first()
    if end is None or end.depth == 0:
        none = graph.directed(direction, types).select("at", "to", F.lit(0).alias("depth")).limit(0)
        return none, None if end is None else 0
    back = _distances(graph.directed(_opposite(direction), types), [target], kind, end.depth)
    on = scratch.save(found.join(back, "node").where(F.col("depth") + F.col("left") == end.depth).select("node", "depth"), "on")
    a, b = on.select(F.col("node").alias("at"), "depth"), on.select(F.col("node").alias("to"), (F.col("depth") - 1).alias("_before"))
    steps = graph.directed(direction, types).select("at", "to").distinct().join(a, "at").join(b, "to").where("depth = _before")
    return scratch.save(steps.select("at", "to", "depth"), "steps"), end.depth


def all_shortest_paths(graph: Graph, start, target, direction: str = OUTGOING, types: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(path) of every shortest path from start to target; a path of one node if they are the same, none if there is none."""
    if start is None or target is None:
        raise ValueError("a shortest path needs two nodes")
    kind = graph.edges.schema["src"].dataType.simpleString()
    spark = graph.edges.sparkSession
    steps, length = shortest_ways(graph, start, target, direction, types, max_depth)
    scratch = Scratch(spark, "all-shortest")
    if length is None:
        return spark.createDataFrame([], f"path array<{kind}>")
    paths = spark.createDataFrame([([start],)], f"path array<{kind}>")
    for depth in range(length):
        at = F.element_at("path", -1)
        paths = scratch.save(paths.withColumn("at", at).join(steps.where(F.col("depth") == depth), "at").select(F.array_append("path", F.col("to")).alias("path")), str(depth))
    return paths


def count_shortest_paths(graph: Graph, start, target, direction: str = OUTGOING, types: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(node, depth, n_paths) of the nodes on shortest paths: how many lead from the start to each, without listing them."""
    spark = graph.edges.sparkSession
    steps, length = shortest_ways(graph, start, target, direction, types, max_depth)
    scratch = Scratch(spark, "shortest-counts")
    kind = graph.edges.schema["src"].dataType.simpleString()
    level = spark.createDataFrame([(start, 0, 1)] if length is not None else [], f"node {kind}, depth int, n_paths decimal(38,0)" if length is None else f"node {kind}, depth int, n_paths long")
    level = level.withColumn("n_paths", F.col("n_paths").cast("decimal(38,0)"))
    out = level
    for depth in range(length or 0):
        onward = steps.where(F.col("depth") == depth).join(level.select(F.col("node").alias("at"), "n_paths"), "at")
        level = scratch.save(onward.groupBy(F.col("to").alias("node")).agg(F.sum("n_paths").cast("decimal(38,0)").alias("n_paths")).select("node", F.lit(depth + 1).alias("depth"), "n_paths"), str(depth))
        out = out.union(level)
    return out


def depth_first(graph: Graph, start, direction: str = OUTGOING, max_depth: int | None = None) -> DataFrame:
    """(node, depth, preorder, leaf, cycle) of a depth-first search that takes neighbours by ordinal and id.

    ``leaf``: no step leads on from it (never the start). ``cycle``: a step leads from it to a node on its own path. A
    preorder is sequential by nature: the search runs in one task over the subgraph within reach of the start, so it is
    meant for small results; for the visited set alone use ``bfs``.
    """
    import pandas as pd

    steps = graph.directed(direction)
    near = bfs(graph, start, direction, max_depth).select("node")
    inner = steps.join(near.withColumnRenamed("node", "at"), "at", "left_semi").select(F.lit(0).alias("one"), "at", "to", "ordinal")
    kind = graph.edges.schema["src"].dataType.simpleString()
    alone = graph.edges.sparkSession.createDataFrame([(0, start, None, None)], f"one int, at {kind}, to {kind}, ordinal {inner.schema['ordinal'].dataType.simpleString()}")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["to"].notna()]
        pdf = pdf.assign(to=pdf["to"].astype(type(start)))
        after = {k: list(g.sort_values(["ordinal", "to"])["to"]) for k, g in pdf.groupby("at")}
        rows, seen, active = [], {start}, {start}
        todo = [(start, iter(after.get(start, ())))]
        rows.append([start, 0, 0, False, False])
        place = {start: 0}
        while todo:
            node, rest = todo[-1]
            step = next(rest, None)
            if step is None:
                todo.pop()
                active.discard(node)
            elif step in active:
                rows[place[node]][4] = True
            elif step not in seen and (max_depth is None or len(todo) <= max_depth):
                seen.add(step)
                active.add(step)
                place[step] = len(rows)
                rows.append([step, len(todo), len(rows), step not in after, False])
                todo.append((step, iter(after.get(step, ()))))
        return pd.DataFrame(rows, columns=["node", "depth", "preorder", "leaf", "cycle"])

    return inner.union(alone).groupBy("one").applyInPandas(search, f"node {kind}, depth int, preorder int, leaf boolean, cycle boolean")


def levels(depth: str = "depth"):
    """Impact level of a depth: 1 direct, 2 indirect, from 3 on workflow."""
    return F.when(F.col(depth) <= 1, "L1").when(F.col(depth) == 2, "L2").otherwise("L3")


def both_ways(graph: Graph, start, max_depth: int = 5, types: list[str] | None = None) -> DataFrame:
    """(node, depth, direction) up and down from a node; at equal depth downstream comes first."""
    down = descendants(graph, start, max_depth, types).withColumn("rank", F.lit(0))
    up = ancestors(graph, start, max_depth, types).withColumn("rank", F.lit(1))
    best = down.union(up).groupBy("node").agg(F.min(F.struct("depth", "rank")).alias("b"))
    return best.select("node", F.col("b.depth").alias("depth"), F.when(F.col("b.rank") == 0, "downstream").otherwise("upstream").alias("direction"))


def with_edge_types(graph: Graph, found: DataFrame, direction: str = OUTGOING, types: list[str] | None = None) -> DataFrame:
    """``found(node, parent, ...)`` with ``edge_type``: of the step from the parent that comes first by ordinal, then by type; null at a start."""
    steps = graph.directed(direction, types).groupBy(F.col("at").alias("parent"), F.col("to").alias("node")).agg(F.min(F.struct("ordinal", "type"))["type"].alias("edge_type"))
    return found.join(steps, ["parent", "node"], "left").select(*found.columns, "edge_type")


def counted(rows: DataFrame, name: str = "traversal"):
    """The rows as they are, and an observation whose ``get["n"]`` is their number once an action has passed them on."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("n")), seen


#: Pairs that a task makes distinct, about; pairs of one target from which on they are dealt over tasks; nodes in one packed row, about.
TASK_PAIRS, HEAVY, PACK = 2_000_000, 20_000_000, 1_000


def reverse_pairs(edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """(target, affected, depth) for all nodes: who reaches whom in up to ``max_depth`` steps, and in how many at least.

    A node affects itself only by a loop, not by a longer cycle. Pairs are made distinct in every round.
    """
    scratch = Scratch(edges.sparkSession, "pairs")
    slim = edges.select("src", "dst").distinct()
    frontier = scratch.save(slim.select(F.col("dst").alias("target"), F.col("src").alias("affected"), F.lit(1).alias("depth")), "1")
    out = frontier
    for depth in range(2, max_depth + 1):
        longer = frontier.join(slim, frontier["affected"] == slim["dst"]).select("target", F.col("src").alias("affected")).where("target <> affected").distinct()
        frontier = scratch.save(longer.join(out, ["target", "affected"], "left_anti").withColumn("depth", F.lit(depth)), str(depth))
        if frontier.isEmpty():
            break
        out = out.union(frontier)
    return out


def _packed(pairs: DataFrame) -> DataFrame:
    """``pairs(target, affected)`` as (target, nodes): arrays of about PACK nodes."""
    parts = pairs.groupBy("target").agg(F.ceil(F.count("*") / PACK).alias("_parts")).where("_parts > 1")
    part = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64("affected"), "_parts")).otherwise(F.lit(0))
    return pairs.join(parts, "target", "left").groupBy("target", part.alias("_part")).agg(F.collect_list("affected").alias("nodes")).select("target", "nodes")


def reverse_counts(edges: DataFrame, max_depth: int = 8) -> DataFrame:
    """(target, n): how many nodes reach each target in up to ``max_depth`` steps; the pairs of ``reverse_pairs``, counted.

    Only pairs of up to half the depth become a table. A longer way leads through a node at exactly half the depth, so
    each target is sent what is behind those nodes, packed in arrays, by one shuffle; they are made distinct where they
    arrive, by an aggregation that can spill. Targets of very many pairs have theirs dealt over all tasks.
    """
    if max_depth < 2:
        return reverse_pairs(edges, max_depth).groupBy("target").agg(F.count("*").alias("n"))
    half = max_depth // 2
    scratch = Scratch(edges.sparkSession, "reach-counts")
    behind = scratch.save(reverse_pairs(edges, max_depth - half), "behind")
    near = behind.where(F.col("depth") <= half)
    packs = scratch.save(_packed(behind), "packs")
    own = packs if max_depth - half == half else _packed(near)
    far = near.where((F.col("depth") == half) & (F.col("target") != F.col("affected"))).select("target", F.col("affected").alias("via"))
    sizes = packs.groupBy(F.col("target").alias("via")).agg(F.sum(F.size("nodes")).alias("size"))
    loads = scratch.save(far.join(sizes, "via").groupBy("target").agg(F.sum("size").alias("size")), "loads")
    sent = far.join(packs.withColumnRenamed("target", "via"), "via").select("target", "nodes", F.lit(False).alias("own")).union(own.select("target", "nodes", F.lit(True)))
    # A longer way back to the target is not counted, a loop is.
    apart = lambda rows: rows.select("target", "own", F.explode("nodes").alias("affected")).where("own or target <> affected").select("target", "affected")
    counted = lambda pairs: pairs.distinct().groupBy("target").agg(F.count("*").alias("n"))
    total = (loads.agg(F.sum("size")).first()[0] or 0) + behind.count()
    tasks = max(int(total / TASK_PAIRS) + 1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = loads.where(F.col("size") > HEAVY).select("target")
    if heavy.isEmpty():
        return counted(apart(sent.repartition(tasks, "target")))
    light = sent.join(heavy, "target", "left_anti").repartition(tasks, "target")
    return counted(apart(light)).union(counted(apart(sent.join(heavy, "target", "left_semi"))))
