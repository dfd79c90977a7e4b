"""Certificates accept right results and tell what is wrong with damaged ones."""

import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import certificates, structure, traversal


@pytest.fixture(scope="module")
def graph(spark):
    rng = random.Random(2)
    return Graph.from_lists(spark, {f"n{k}": [f"n{rng.randrange(60)}" for _ in range(rng.randrange(4))] for k in range(60)} | {"n0": ["n1", "n2", "n3"]})


def codes(df):
    return {r.code for r in df.collect()}


def test_walks(spark, graph):
    steps = graph.directed()
    for most in (None, 2):
        found = traversal.bfs(graph, "n0", max_depth=most)
        rows = [tuple(r) for r in found.select("node", "depth", "parent").collect()]
        make = lambda rows: spark.createDataFrame(rows, "node string, depth int, parent string")
        check = lambda rows: codes(certificates.walk_certificate(steps, make(rows), "n0", most))
        assert check(rows) == set()
        one = next(r for r in rows if r[1] == 1)
        rest = [r for r in rows if r != one]
        assert "MISSED" in check(rest)
        assert check([*rest, (one[0], 2, one[2])]) >= {"DEPTH", "SHORTCUT"}
        assert "TWICE" in check([*rows, one])
        far = next(r for r in rows if r[1] == 2)
        assert "EDGE" in check([*(r for r in rows if r != far), (far[0], 2, next(r[0] for r in rows if r[1] == 1 and not graph.edges.where(f"src = '{r[0]}' and dst = '{far[0]}'").count()))])
        assert check([*(r for r in rows if r != far), (far[0], 2, "nobody")]) >= {"PARENT"}
        assert check([r for r in rows if r[0] != "n0"]) >= {"START"} and "START" in check([])
    deep = [tuple(r) for r in traversal.bfs(graph, "n0").select("node", "depth", "parent").collect()]
    assert codes(certificates.walk_certificate(steps, make(deep), "n0", 1)) == {"DEEP"}


def test_components(spark, graph):
    found = structure.weak_components(graph)
    rows = [tuple(r) for r in found.select("node", "component").collect()]
    check = lambda rows: codes(certificates.components_certificate(graph.edges, graph.nodes, spark.createDataFrame(rows, "node string, component string")))
    assert check(rows) == set()
    assert "MISSED" in check(rows[1:]) and "TWICE" in check([*rows, rows[0]])
    linked = graph.edges.where("src <> dst").first().src
    assert check([(n, n if n == linked else c) for n, c in rows if n != c or n != linked] + [(linked, "zz")]) >= {"SPLIT", "NAME"}


def test_levels(spark):
    g = Graph.from_lists(spark, {"A": ["B", "C"], "B": ["D"], "C": ["D"], "D": ["X"], "X": ["Y"], "Y": ["X", "Z"], "Z": []})
    found = structure.topological_from(g, "A")
    rows = [tuple(r) for r in found.select("node", "level", "blocked").collect()]
    check = lambda rows: codes(certificates.levels_certificate(g.edges, spark.createDataFrame([(r[0],) for r in base], "node string"), spark.createDataFrame(rows, "node string, level int, blocked boolean")))
    base = rows
    assert check(rows) == set()
    swap = lambda node, level, blocked: [(node, level, blocked) if r[0] == node else r for r in rows]
    assert check(swap("D", 1, False)) == {"ORDER", "GAP"} and check(swap("D", 5, False)) == {"GAP"}
    assert check(swap("Z", 9, False)) >= {"BEHIND"} and check(swap("B", None, True)) >= {"FREE", "BEHIND"}
    assert "MISSED" in check(rows[1:]) and "TWICE" in check([*rows, rows[0]])
