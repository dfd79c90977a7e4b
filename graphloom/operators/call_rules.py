"""Rules that a call graph and its derived indexes keep, and the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unequal_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key) for which ``left(key, value)`` and ``right(key, value)`` do not hold the same values equally often.

    Each side is reduced to one fingerprint a key, the number of its values and the sums of two hashes of them, whatever
    their order; a key of very many values is summed in parts. Only fingerprints are joined.
    """

    def prints(df: DataFrame, side: str) -> DataFrame:
        value = F.struct("value")
        sums = [F.sum(F.xxhash64(F.lit(k), value).cast("decimal(38,0)")) for k in (1, 2)]
        return df.groupBy("key").agg(F.struct(F.count("*").alias("n"), *(s.alias(f"h{k}") for k, s in enumerate(sums))).alias(side))

    both = prints(left, "_a").join(prints(right, "_b"), "key", "full")
    return both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select("key")


def index_differences(source: DataFrame, index: DataFrame) -> DataFrame:
    """(key, value, in_source, in_index): how often values of unequal keys stand on either side where that differs."""
    bad = unequal_keys(source, index)
    count = lambda df, name: df.join(bad, "key", "left_semi").groupBy("key", "value").agg(F.count("*").alias(name))
    both = count(source, "in_source").join(count(index, "in_index"), ["key", "value"], "full").fillna(0, ["in_source", "in_index"])
    return both.where("in_source <> in_index")


def call_graph_violations(nodes: DataFrame, edges: DataFrame, by_id: DataFrame | None = None, by_name: DataFrame | None = None, by_file: DataFrame | None = None, forward: DataFrame | None = None, backward: DataFrame | None = None, counts: dict | None = None) -> DataFrame:
    """(severity, code, category, target, other) of every broken rule.

    ``nodes(id, name, qualified_name, node_type, file, is_external)``, ``edges(src, dst, weight)``; indexes, where given, as
    (key, value): ``by_id``, ``by_name`` and ``by_file`` give node ids, ``forward`` and ``backward`` neighbours by node.
    ``counts`` are the node_count and edge_count that the graph claims. Empty strings count as missing.

    Nodes: MISSING_SYMBOL_ID, EMPTY_NODE_NAME, MISSING_FQN, INVALID_NODE_TYPE, MISSING_FILE_PATH. Edges:
    MISSING_CALLER_SYMBOL_ID, MISSING_CALLEE_SYMBOL_ID, CALLER_DOES_NOT_EXIST, CALLEE_DOES_NOT_EXIST, INVALID_EDGE_WEIGHT,
    SELF_LOOP_RECURSION. Indexes: INDEXED_NODE_MISSING, INDEXED_FQN_MISSING, INDEXED_FILE_NODE_MISSING. Consistency:
    NODE_COUNT_MISMATCH, EDGE_COUNT_MISMATCH, INDEX_NODE_COUNT_MISMATCH. References: DANGLING_ADJACENCY_CALLER,
    DANGLING_ADJACENCY_CALLEE, ASYMMETRIC_ADJACENCY, and ADJACENCY_MISMATCH where the lists are not those of the edges.
    """
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    missing = lambda c: F.col(c).isNull() | (text(c) == "")

    def say(df: DataFrame, severity: str, code: str, category: str, target=none, other=none) -> DataFrame:
        return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(category).alias("category"), target.alias("target"), other.alias("other"))

    known = nodes.select(F.col("id").alias("_id")).where("_id is not null").distinct()
    absent = lambda df, c: df.where(~missing(c)).join(known, F.col(c) == F.col("_id"), "left_anti")
    external = F.coalesce(F.col("is_external"), F.lit(False))
    out = [
        say(nodes.where(missing("id")), "error", "MISSING_SYMBOL_ID", "node", none, text("name")),
        say(nodes.where(missing("name")), "warning", "EMPTY_NODE_NAME", "node", text("id")),
        say(nodes.where(missing("qualified_name")), "warning", "MISSING_FQN", "node", text("id")),
        say(nodes.where(missing("node_type")), "warning", "INVALID_NODE_TYPE", "node", text("id")),
        say(nodes.where(missing("file") & ~external), "info", "MISSING_FILE_PATH", "node", text("id")),
        say(edges.where(missing("src")), "error", "MISSING_CALLER_SYMBOL_ID", "edge", none, text("dst")),
        say(edges.where(missing("dst")), "error", "MISSING_CALLEE_SYMBOL_ID", "edge", text("src")),
        say(absent(edges, "src"), "error", "CALLER_DOES_NOT_EXIST", "edge", text("src"), text("dst")),
        say(absent(edges, "dst"), "error", "CALLEE_DOES_NOT_EXIST", "edge", text("src"), text("dst")),
        say(edges.where("weight < 1"), "warning", "INVALID_EDGE_WEIGHT", "edge", text("src"), text("dst")),
        say(edges.where(~missing("src") & (F.col("src") == F.col("dst"))), "info", "SELF_LOOP_RECURSION", "edge", text("src"), text("dst")),
    ]
    for index, code in ((by_id, "INDEXED_NODE_MISSING"), (by_name, "INDEXED_FQN_MISSING"), (by_file, "INDEXED_FILE_NODE_MISSING")):
        if index is not None:
            out.append(say(absent(index, "value"), "error", code, "index", text("key"), text("value")))
    for name, table, code in (("node_count", nodes, "NODE_COUNT_MISMATCH"), ("edge_count", edges, "EDGE_COUNT_MISMATCH")):
        if counts and name in counts:
            n = table.agg(F.count("*").alias("n")).where(F.col("n") != counts[name])
            out.append(say(n, "error", code, "consistency", F.lit(str(counts[name])), text("n")))
    if by_id is not None:
        n = by_id.agg(F.countDistinct("key").alias("i")).crossJoin(nodes.agg(F.count("*").alias("n"))).where("i <> n")  # one row each
        out.append(say(n, "warning", "INDEX_NODE_COUNT_MISMATCH", "consistency", text("i"), text("n")))
    if forward is not None:
        lists = forward.select("key", "value")
        out.append(say(absent(lists.select("key").distinct(), "key"), "error", "DANGLING_ADJACENCY_CALLER", "reference", text("key")))
        out.append(say(absent(lists, "value"), "error", "DANGLING_ADJACENCY_CALLEE", "reference", text("key"), text("value")))
        of = edges.where("src is not null and dst is not null").select(F.col("src").alias("key"), F.col("dst").alias("value"))
        out.append(say(index_differences(of.distinct(), lists.distinct()), "error", "ADJACENCY_MISMATCH", "reference", text("key"), text("value")))
        if backward is not None:
            turned = backward.select(F.col("value").alias("key"), F.col("key").alias("value")).distinct()
            lost = index_differences(lists.distinct(), turned).where("in_index = 0")
            out.append(say(lost, "warning", "ASYMMETRIC_ADJACENCY", "reference", text("key"), text("value")))
    return reduce(DataFrame.union, out)
