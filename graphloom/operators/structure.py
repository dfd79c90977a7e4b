"""Components, topological levels and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..scratch import Scratch
from .traversal import walk

#: Edges that a task contracts or labels at once, and sweeps over them before labels go on to other tasks.
BATCH, SWEEPS = 200_000, 500


def _batches(batches: Iterator[pa.RecordBatch], size: int = BATCH) -> Iterator[pa.Table]:
    """Batches joined to tables of up to about ``size`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct values in order, and the place of each value among them."""
    columns = [c.combine_chunks() for c in columns]
    known = pa.concat_arrays(columns).unique().sort()
    return known, [pa.compute.index_in(c, known).to_numpy() for c in columns]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch, replaced by one from each node to the smallest of its group."""
    for table in _batches(batches):
        known, (a, b) = _coded(table.column(0), table.column(1))
        label = np.arange(len(known))
        while True:
            low, new = np.minimum(label[a], label[b]), label.copy()
            for at in (a, b, label[a], label[b]):
                np.minimum.at(new, at, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = np.flatnonzero(label != np.arange(len(known)))
        yield pa.RecordBatch.from_arrays([known.take(pa.array(moved)), known.take(pa.array(label[moved]))], names=["src", "dst"])


def weak_components(graph: Graph) -> DataFrame:
    """(node, component) for every node: the smallest id that edges connect it with, in either direction.

    Tasks contract their own edges first. Then every node sends its larger neighbours to its smallest one, and its smaller
    neighbours likewise, until nothing changes: rounds grow with the logarithm of the size, and a node with very many
    neighbours meets only its smallest.
    """
    scratch = Scratch(graph.edges.sparkSession, "components")
    kind = graph.edges.schema["src"].dataType.simpleString()
    ends = graph.edges.select("src", "dst").where("src <> dst")
    ids = graph.nodes.select(F.col("id").alias("node")).union(ends.select("src")).union(ends.select("dst")).distinct()
    now = scratch.save(ends.mapInArrow(_contracted, f"src {kind}, dst {kind}").distinct(), "0")
    seen, n = None, 0
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        # With one root for each node, and no root below another one, the stars are the components.
        if state == seen or now.join(now.select(F.col("dst").alias("src")), "src", "left_semi").isEmpty() and now.groupBy("src").count().where("count > 1").isEmpty():
            break
        seen, n = state, n + 1
        both = now.union(now.select("dst", "src")).toDF("src", "dst")
        lows = both.groupBy("src").agg(F.least(F.min("dst"), F.first("src")).alias("low"))
        large = scratch.save(both.where("dst > src").join(lows, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").distinct(), f"{n}-large")
        least = large.groupBy("src").agg(F.min("dst").alias("low"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).where("src <> dst").union(least)
        now = scratch.save(small.distinct(), str(n))
    found = now.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return ids.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _peeled(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, level) of the nodes that come free when those without open predecessors are taken away level by level.

    Open in-degrees are counters. A level takes its own out-edges off them; counters that have been touched and are not at
    zero yet are carried on as a small table, and neither the edges nor the other counters are written again.
    """
    slim = scratch.save(edges.select("src", "dst").distinct(), "edges")
    need = scratch.save(slim.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")), "need")
    level, names = 0, ["level-0"]
    free = scratch.save(nodes.select("node").distinct().join(need, "node", "left_anti").withColumn("level", F.lit(0)), "level-0")
    partial = None
    while not free.isEmpty():
        level += 1
        given = free.join(slim, free["node"] == slim["src"]).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("got"))
        if partial is not None:
            given = given.unionByName(partial).groupBy("node").agg(F.sum("got").alias("got"))
        touched = scratch.save(given.join(need, "node"), f"touched-{level}")
        free = scratch.save(touched.where("got = need").select("node", F.lit(level).alias("level")), f"level-{level}")
        partial = touched.where("got < need").select("node", "got")
        names.append(f"level-{level}")
    return scratch.together(names, free)


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, level): the longest way from a node without predecessors; nodes on or behind a cycle don't appear."""
    scratch = Scratch(edges.sparkSession, "topological")
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return _peeled(edges, ends if nodes is None else ends.union(nodes), scratch)


def topological_from(graph: Graph, start, types: list[str] | None = None) -> DataFrame:
    """(node, level, blocked) of what ``start`` (a node or a list) reaches, ordered by the edges among it.

    Nodes on or behind a cycle are ``blocked`` and have no level: the order is partial if there are any.
    """
    scratch = Scratch(graph.edges.sparkSession, "topological-from")
    steps = graph.directed("OUTGOING", types)
    kind = graph.edges.schema["src"].dataType.simpleString()
    starts = graph.edges.sparkSession.createDataFrame([(0, i) for i in (start if isinstance(start, (list, tuple, set)) else [start])], f"source int, node {kind}")
    reach = scratch.save(walk(steps, starts).select("node").distinct(), "reach")
    inner = steps.join(reach.withColumnRenamed("node", "at"), "at", "left_semi").select(F.col("at").alias("src"), F.col("to").alias("dst"))
    found = _peeled(inner, reach, scratch)
    return reach.join(found, "node", "left").select("node", "level", F.col("level").isNull().alias("blocked"))


def _shuffled(df: DataFrame) -> DataFrame:
    """A side of a join in a loop: never sent to all tasks by way of the driver, which would get a table of nodes in each round."""
    return df.hint("merge")


def _trimmed(edges: DataFrame, scratch: Scratch, name: str = "trim") -> DataFrame:
    """Edges left when nodes without a predecessor or without a successor are taken away again and again."""
    left, n, before = scratch.save(edges.select("src", "dst").distinct(), f"{name}-0"), 0, None
    while True:
        now = left.count()
        if now == before:
            return left
        before, n = now, n + 1
        has_in, has_out = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = scratch.save(left.join(_shuffled(has_in), "src", "left_semi").join(_shuffled(has_out), "dst", "left_semi"), f"{name}-{n}")


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(src, dst, label, own)``: the label of each edge's source goes on along the batch's edges, the largest one wins."""
    for table in _batches(batches):
        known, (a, b) = _coded(table.column("src"), table.column("dst"))
        values, (of_src, of_dst) = _coded(table.column("label"), table.column("own"))
        label = np.full(len(known), -1, dtype=np.int64)
        label[a], before = of_src, np.full(len(known), -1, dtype=np.int64)
        np.maximum.at(label, b, of_dst)
        before[b] = of_dst
        order = np.argsort(label[a], kind="stable")
        a, b = a[order], b[order]
        for _ in range(SWEEPS):
            new = label.copy()
            np.maximum.at(new, b, label[a])
            if (new == label).all():
                break
            label = new
        moved = np.unique(b[label[b] > before[b]])
        yield pa.RecordBatch.from_arrays([known.take(pa.array(moved)), values.take(pa.array(label[moved]))], names=["node", "label"])


def _spread(edges: DataFrame, labels: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``labels(node, label)`` with the largest label of all nodes from which ``edges(src, dst)`` lead to a node.

    A round joins labels to the edges, sweeps inside the tasks, and takes the largest label found for each node.
    """
    node, label = (labels.schema[c].dataType.simpleString() for c in ("node", "label"))
    n = 0
    while True:
        n += 1
        with_src = edges.join(_shuffled(labels.withColumnRenamed("node", "src")), "src")
        both = with_src.join(_shuffled(labels.select(F.col("node").alias("dst"), F.col("label").alias("own"))), "dst").select("src", "dst", "label", "own")
        found = both.mapInArrow(_swept, f"node {node}, label {label}").groupBy("node").agg(F.max("label").alias("found"))
        found = scratch.save(found, f"{name}-found-{n}")
        if found.isEmpty():
            return labels
        labels = scratch.save(labels.join(_shuffled(found), "node", "left").select("node", F.greatest("label", F.coalesce("found", "label")).alias("label")), f"{name}-{n}")


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """(node) of every node that reaches itself, however long its cycle is.

    By colours: the largest node that reaches a node is its colour; those of a colour that reach the node it is named
    for are a strongly connected component. Components found are taken away with the edges between colours, what is
    left is trimmed, and coloured again. Tables have a row for each node or edge, never for each pair.
    """
    scratch = Scratch(edges.sparkSession, "cycles")
    out = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left, n = _trimmed(edges.where("src <> dst"), scratch, "trim-0"), 0
    while not left.isEmpty():
        n += 1
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colours = _spread(left, scratch.save(nodes.select("node", F.col("node").alias("label")), f"nodes-{n}"), scratch, f"colour-{n}")
        of = lambda end: _shuffled(colours.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")))
        same = scratch.save(left.join(of("src"), "src").join(of("dst"), "dst").where("_src = _dst").select("src", "dst"), f"same-{n}")
        roots = colours.select("node", (F.col("node") == F.col("label")).cast("int").alias("label"))
        back = _spread(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")), scratch.save(roots, f"roots-{n}"), scratch, f"back-{n}")
        done = scratch.save(back.where("label = 1").select("node"), f"done-{n}")
        # A root alone is no cycle: on one are the roots that an edge of their colour leads back to, and all behind them.
        at = lambda end: _shuffled(done.withColumnRenamed("node", end))
        inner = same.join(at("src"), "src", "left_semi").join(at("dst"), "dst", "left_semi")
        out = out.union(inner.select(F.col("src").alias("node")).distinct())
        rest = same.join(at("src"), "src", "left_anti").join(at("dst"), "dst", "left_anti")
        left = _trimmed(rest, scratch, f"trim-{n}")
    return scratch.save(out.distinct(), "out")


def simple_cycles(edges: DataFrame, max_length: int = 6) -> DataFrame:
    """(cycle) as arrays of nodes, the smallest id first and not repeated at the end; a loop has one node."""
    scratch = Scratch(edges.sparkSession, "simple-cycles")
    left = _trimmed(edges, scratch)
    paths = left.select(F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src").alias("path"))
    out = None
    for n in range(1, max_length + 1):
        closed = paths.where("first = last").select(F.col("path").alias("cycle"))
        out = closed if out is None else out.union(closed)
        if n == max_length:
            return out
        grown = paths.where("last > first").where(~F.array_contains("path", F.col("last")))
        longer = grown.join(left, grown["last"] == left["src"]).select("first", F.col("dst").alias("next"), F.array_append("path", F.col("last")).alias("path"))
        paths = scratch.save(longer.select("first", F.col("next").alias("last"), "path"), f"paths-{n}")
