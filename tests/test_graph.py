"""Traversals, structure, indexes and edge building on small graphs with known answers."""

import pytest
from pyspark.sql import functions as F

from graphloom.graph import BOTH, Graph
from graphloom.operators import analytics, edges, flows, incremental, indexes, quality, search, structure, traversal
from graphloom.plans import expressions as X
from graphloom.plans.query import Builder, Context, estimate, from_json, to_json
from graphloom.plans.verbs import GraphEngine


@pytest.fixture(scope="module")
def cyclic(spark):
    return Graph.from_lists(spark, {"A": [("B", "CALLS"), ("E", "IMPORTS")], "B": [("C", "CALLS")], "C": [("D", "CALLS"), ("A", "CALLS")], "E": [("F", "IMPORTS")]})


def pairs(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_bfs(cyclic):
    found = traversal.bfs(cyclic, "A")
    assert pairs(found, "node", "depth") == {("A", 0), ("B", 1), ("E", 1), ("C", 2), ("F", 2), ("D", 3)}
    assert pairs(traversal.leaves(cyclic, found), "node") == {("D",), ("F",)}
    assert traversal.bfs(cyclic, "A", max_nodes=3).count() == 3
    assert pairs(traversal.bfs(cyclic, "A", target="E"), "node") == {("A",), ("B",), ("E",)}


def test_reach_and_paths(cyclic):
    assert pairs(traversal.reachable(cyclic, "A", ["C", "F", "X"]), "node") == {("C",), ("F",)}
    assert traversal.shortest_path(cyclic, "A", "D") == ["A", "B", "C", "D"]
    assert traversal.shortest_path(cyclic, "F", "A") == []
    assert traversal.shortest_path(cyclic, "A", "A") == ["A"]
    with pytest.raises(ValueError):
        traversal.shortest_path(cyclic, "A", None)
    assert [r.length for r in traversal.bidirectional(cyclic, "A", "D").collect()] == [3]
    assert {">".join(r.path) for r in traversal.simple_paths(cyclic, "A", ["D"]).collect()} == {"A>B>C>D"}
    assert pairs(traversal.neighborhood(cyclic, "B"), "node") == {("A",), ("C",)}
    assert pairs(traversal.ancestors(cyclic, "C"), "node") == {("A",), ("B",)}
    assert pairs(traversal.descendants(cyclic, "A"), "node") == {("B",), ("C",), ("D",), ("E",), ("F",)}


def test_depth_first(cyclic):
    order = [r.node for r in traversal.depth_first(cyclic, "A").orderBy("preorder").collect()]
    assert order == ["A", "B", "C", "D", "E", "F"]


def test_structure(spark, cyclic):
    assert pairs(structure.weak_components(cyclic), "component") == {("A",)}
    assert pairs(structure.cycle_nodes(cyclic.edges), "node") == {("A",), ("B",), ("C",)}
    assert [r.cycle for r in structure.simple_cycles(cyclic.edges).collect()] == [["A", "B", "C"]]
    chain = Graph.from_lists(spark, {"X": ["Y"], "Y": ["Z"]})
    assert pairs(structure.topological_levels(chain.edges), "node", "level") == {("X", 0), ("Y", 1), ("Z", 2)}
    loop = Graph.from_lists(spark, {"X": ["X", "Y"]})
    assert [r.cycle for r in structure.simple_cycles(loop.edges).collect()] == [["X"]]
    assert pairs(traversal.neighborhood(loop, "X"), "node") == {("Y",)}
    assert loop.directed(BOTH).count() == 3


def test_scores(cyclic):
    got = {r.id: (r.fan_in, r.fan_out, round(r.coupling, 4)) for r in analytics.coupling(cyclic).collect()}
    assert got == {"A": (1, 2, 0.2222), "B": (1, 1, 0.25), "C": (1, 2, 0.2222), "D": (1, 0, 0.0), "E": (1, 1, 0.25), "F": (1, 0, 0.0)}
    assert {r.id: r.blast_radius for r in analytics.blast_radius(cyclic).collect()} == {"A": 2, "B": 2, "C": 2, "D": 3, "E": 3, "F": 4}
    empty = analytics.architecture_health(Graph(cyclic.nodes.limit(0).withColumn("node_type", F.lit("x")), cyclic.edges.limit(0))).first()
    assert empty.overall_score == 100 and empty.health == "Excellent"


def test_pipeline_of_steps(spark):
    g = Graph.from_lists(spark, {"1": [("2", "CALLS")], "2": [("3", "IMPORTS")]})
    one = spark.createDataFrame([("1",)], "id string")
    assert [r.id for r in traversal.expand(g, one).collect()] == ["2"]
    assert [r.id for r in traversal.edge_filter(g, one, "CALLS").collect()] == ["2"]
    assert traversal.edge_filter(g, one, None).collect() == one.collect()
    assert pairs(traversal.path_expand(g, one, 2), "id") == {("1",), ("2",), ("3",)}


@pytest.mark.parametrize("batch", [200_000, 40])
def test_long_graph(spark, monkeypatch, batch):
    n = 300
    e = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("IMPORTS").alias("type")).union(spark.range(n - 5).select("id", F.col("id") + 5, F.lit("CALLS")))
    g = Graph(spark.range(n), e)
    got = {r.node: r.depth for r in traversal.bfs(g, 0, max_depth=12).collect()}
    assert all(d == k // 5 + k % 5 for k, d in got.items()) and len(got) == sum(k // 5 + k % 5 <= 12 for k in range(n))
    monkeypatch.setattr(structure, "BATCH", batch)
    two = Graph(spark.range(2 * n), e.union(e.select(F.col("src") + n, F.col("dst") + n, "type")))
    assert {(r.node, r.component) for r in structure.weak_components(two).collect()} == {(k, k // n * n) for k in range(2 * n)}


def test_long_way(spark):
    """A way of more than 100 steps is found whole by a search that has no depth of its own."""
    n = 104
    g = Graph(spark.range(n + 1), spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit("CALLS").alias("type")))
    assert traversal.shortest_path(g, 0, n) == list(range(n + 1))
    assert traversal.shortest_path(g, 4, 4) == [4] and traversal.bidirectional(g, 5, 5).first().length == 0
    assert traversal.bidirectional(g, 90, 97).first().length == 7 and traversal.bidirectional(g, n, n - 1).isEmpty()
    assert GraphEngine(g).find_dependencies(95).count() == n - 95


def test_expand_options(cyclic):
    every = {r.node: r.depth for r in traversal.bfs(cyclic, "A").collect()}
    assert traversal.bfs(cyclic, "A", max_nodes=3).count() == 3
    assert {r.node for r in traversal.expand_where(cyclic, "A", max_depth=None, track_paths=True).collect()} == set(every) - {"A"}
    for r in traversal.expand_where(cyclic, "A", max_depth=None, track_paths=True).collect():
        assert r.path[0] == "A" and r.path[-1] == r.node and len(r.path) == r.depth + 1
    first = traversal.bfs(cyclic, "A", max_edges=1)
    assert first.count() == 2
    stopped = traversal.expand_where(cyclic, "A", max_depth=None, stop=F.col("id") != "A")
    assert {r.node for r in stopped.collect()} == {n for n, d in every.items() if d == 1}
    assert {r.node for r in traversal.expand_where(cyclic, "A", max_depth=None, where=F.col("id") == "C").collect()} <= {"C"}


def test_edge_lookups(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "CALLS"), ("e2", "a", "b", "USES"), ("e3", "b", "b", "CALLS"), ("e4", "c", "a", "IMPORTS")], "edge_id string, src string, dst string, type string")
    g = Graph(spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string"), edges)
    ids = lambda df: sorted(r.edge_id for r in df.collect())
    assert ids(indexes.edge_by_id(edges, "e2")) == ["e2"] and ids(indexes.outgoing(edges, "a")) == ["e1", "e2"]
    assert ids(indexes.incoming(edges, "b")) == ["e1", "e2", "e3"] and ids(indexes.node_relations(edges, "b")) == ["e1", "e2", "e3"]
    assert ids(indexes.of_type(edges, "calls")) == ["e1", "e3"]
    assert {r.node: r.edge_ids for r in indexes.edge_lists(g).collect()} == {"a": ["e1", "e2"], "b": ["e3"], "c": ["e4"], "d": []}
    assert {r.node: r.n for r in indexes.edge_lists(g, reverse=True).collect()} == {"a": 1, "b": 3, "c": 0, "d": 0}
    assert [(r.node, r.start, r.stop) for r in indexes.compressed_rows(g).orderBy("node").collect()] == [("a", 0, 2), ("b", 2, 3), ("c", 3, 4), ("d", 4, 4)]


def test_indexes(spark):
    nodes = spark.createDataFrame([("n1", "a.py"), ("n2", "b.py"), ("n3", "c.py")], "id string, file string")
    e = spark.createDataFrame([("e1", "n1", "n2", "CALLS"), ("e2", "n1", "n3", "IMPORTS"), ("e3", "n2", "n3", "CALLS"), ("e4", "n3", "n3", "USES")], "edge_id string, src string, dst string, type string")
    g = Graph(nodes, e)
    assert {r.node: (r.neighbors, r.degree) for r in indexes.adjacency(g).collect()} == {"n1": (["n2", "n3"], 2), "n2": (["n3"], 1), "n3": (["n3"], 1)}
    assert {r.node: r.degree for r in indexes.adjacency(g, reverse=True).collect()} == {"n1": 0, "n2": 1, "n3": 3}
    assert {r.node: r.n_edges for r in indexes.incident(g).collect()} == {"n1": 2, "n2": 2, "n3": 3}
    assert pairs(indexes.by_type(e), "type", "n") == {("CALLS", 2), ("IMPORTS", 1), ("USES", 1)}
    assert pairs(indexes.self_loops(e), "src") == {("n3",)}
    with pytest.raises(ValueError):
        indexes.adjacency(Graph(nodes.where("id <> 'n3'"), e))
    assert pairs(quality.violations(Graph(nodes.where("id <> 'n3'"), e)), "code") == {("UNRESOLVED_TARGET",), ("DANGLING_SOURCE",)}
    with pytest.raises(ValueError):
        indexes.unique_lookup(spark.createDataFrame([("a", "q"), ("b", "q")], "id string, name string"), "name")


def test_semantic(spark):
    rows = [("base", "BaseService", "CLASS", "s.py", {}, []), ("derived", "AuthService", "CLASS", "s.py", {}, []), ("iface", "IAuth", "INTERFACE", "i.py", {}, []), ("handler", "login_handler", "FUNCTION", "h.py", {"visibility": "public", "is_async": "true"}, ["@router.post", "login"])]
    nodes = spark.createDataFrame(rows, "id string, name string, node_type string, file string, attributes map<string,string>, decorators array<string>")
    e = spark.createDataFrame([("derived", "base", "INHERITS"), ("derived", "iface", "IMPLEMENTS"), ("handler", "derived", "CALLS"), ("handler", "derived", "IMPORTS")], "src string, dst string, type string")
    g, engine = Graph(nodes, e), GraphEngine(Graph(nodes, e))
    assert pairs(indexes.hierarchy(e), "child", "parent") == {("derived", "base")}
    assert pairs(indexes.implementations(e), "interface", "implementation") == {("iface", "derived")}
    assert pairs(indexes.referrers(e), "definition", "n_referrers") == {("derived", 1)}
    assert pairs(indexes.file_imports(g), "file", "imported") == {("h.py", "derived")}
    assert pairs(indexes.attribute_groups(nodes), "attribute", "n") == {("visibility:public", 4), ("async", 1)}
    assert pairs(indexes.annotations(nodes), "annotation", "n") == {("@router.post", 1), ("@login", 1)}
    assert pairs(engine.search_by_annotation("login"), "id") == {("handler",)}
    assert pairs(engine.find_hierarchy("derived", "SUPERTYPES"), "node") == {("base",), ("iface",)}
    assert pairs(engine.find_callers("derived"), "id") == {("handler",)}
    assert pairs(engine.lookup_class("AuthService"), "id") == {("derived",)}
    assert engine.is_reachable("handler", "base") and not engine.is_reachable("base", "handler")
    with pytest.raises(ValueError):
        engine.find_impact("base", 0)


def test_call_graph(spark):
    calls = spark.createDataFrame([("a", "b", "b"), ("a", "b", "b"), ("a", "a", "a"), ("a", None, "print"), (None, "b", "b")], "caller string, callee string, callee_name string")
    g = edges.call_graph(calls, spark.createDataFrame([("a", "fn_a")], "id string, name string"))
    assert pairs(g.edges, "src", "dst", "weight") == {("a", "b", 2), ("a", "a", 1), ("a", "external:print", 1)}
    assert pairs(g.nodes, "id", "name", "is_external") == {("a", "fn_a", False), ("b", "b", False), ("external:print", "print", True)}


SYMBOL_COLUMNS = "id string, name string, qualified_name string, namespace string, file string, kind string"


def test_resolvers(spark):
    rows = [("1", "run", "app.Main.run", "app.Main", "main.py", "METHOD"), ("2", "Base", "lib.Base", "lib", "lib.py", "class"), ("3", "run", "lib.run", "lib", "lib.py", "function"), ("4", "only", "x.only", "x", "x.py", "function"), ("5", "only", "y.only", "app.Main", "x.py", "class"), ("6", "Shape", "lib.Shape", "lib", "lib.py", "interface"), ("7", "Color", "lib.Color", "lib", "lib.py", "enum")]
    symbols = spark.createDataFrame(rows, SYMBOL_COLUMNS)
    calls = [("c", "app.Main.run", "z", "z.py"), ("c", "self.run", "app.Main", "z.py"), ("c", "run", "z", "lib.py"), ("c", "only", "z", "z.py"), ("c", "run", "z", "z.py"), ("c", "self.x.run", "app.Main", "z.py"), ("c", "self.only", "app.Main", "z.py"), ("4", "only", "z", "z.py"), ("c", "this.Base", "lib", "z.py")]
    got = sorted((r.caller, r.name, r.strategy, r.target, r.confidence, r.recursive) for r in edges.resolve_calls(spark.createDataFrame(calls, "caller string, name string, namespace string, file string"), symbols).collect())
    assert got == sorted(
        [
            ("c", "app.Main.run", "exact", "1", 1.0, False),
            ("c", "self.run", "self", "1", 1.0, False),
            ("c", "run", "file", "3", 0.95, False),
            ("c", "only", "name", "4", 0.85, False),
            ("c", "run", "external", "external:run", 0.5, False),
            ("c", "self.x.run", "external", "external:self.x.run", 0.5, False),  # the receiver is not just self
            ("c", "self.only", "name", "4", 0.85, False),  # a class is no call's target
            ("4", "only", "name", "4", 0.85, True),
            ("c", "this.Base", "external", "external:this.Base", 0.5, False),
        ]
    )
    bases = spark.createDataFrame([("k", "Base", "other.py", None), ("k2", "Base", "lib.py", True), ("k", "Nope", "lib.py", None), ("k", "lib.Shape", "q/r.py", None), ("k", "run", "lib.py", None), ("k3", "Base", "lib/z.py", None)], "child string, name string, file string, is_interface boolean")
    assert pairs(edges.resolve_bases(bases, symbols), "child", "target", "strategy", "confidence", "is_interface") == {("k", "2", "name", 0.9, False), ("k2", "2", "file", 1.0, True), ("k", "external:Nope", "external", 0.5, False), ("k", "6", "exact", 1.0, True), ("k", "external:run", "external", 0.5, False), ("k3", "2", "exact", 1.0, False)}
    types = spark.createDataFrame([("o", "Optional[Base]", "z"), ("o", "&Color", "z"), ("o", "str", "z"), ("o", "Map<Unheard>", "z"), ("o", "Either[A, Base]", "z")], "owner string, type_name string, file string")
    assert pairs(edges.resolve_types(types, symbols), "name", "target", "strategy") == {("Base", "2", "name"), ("Color", "7", "name"), ("str", "external:str", "primitive"), ("Unheard", "external:Unheard", "external"), ("Either[A, Base]", "external:Either[A, Base]", "external")}


def test_imports(spark):
    names = ["repo.core.app", "core.direct", "repo.src.util", "repo.pkg.sub.near", "repo.a.b.core.X", "repo.lib.tool", "a.b.here"]
    symbols = spark.createDataFrame([(str(k), n.split(".")[-1], n, "n", "f", "module") for k, n in enumerate(names)], SYMBOL_COLUMNS)
    rows = [("m.py", "core.app", None), ("m.py", "core", "direct"), ("m.py", "util", None), ("pkg/sub/m.py", "near", None), ("a/b/c/m.py", "..core", "X"), ("a\\b\\c\\m.py", "..core", "X"), ("m.py", "lib.tool", "Thing"), ("m.py", "os", "path"), ("m.py", "..too", "far"), ("a/b/m.py", ".", "here"), ("m.py", "..core", "X")]
    found = edges.resolve_imports(spark.createDataFrame(rows, "file string, module string, name string"), symbols, "repo").collect()
    got = {(r.file, r.module, r.name): (r.target, r.strategy, r.confidence) for r in found}
    assert len(found) == len(rows) and got == {
        rows[0]: ("0", "exact", 1.0),
        rows[1]: ("1", "exact", 1.0),
        rows[2]: ("2", "exact", 1.0),
        rows[3]: ("3", "exact", 1.0),
        rows[4]: ("4", "relative", 1.0),
        rows[5]: ("4", "relative", 1.0),
        rows[6]: ("5", "parent", 0.9),
        rows[7]: ("external:os.path", "external", 0.5),
        rows[8]: ("external:too.far", "external", 0.5),
        rows[9]: ("external:here", "external", 0.5),
        rows[10]: ("external:core.X", "external", 0.5),
    }
    alone = edges.resolve_imports(spark.createDataFrame(rows[9:10], "file string, module string, name string"), symbols)
    assert pairs(alone, "target", "strategy") == {("6", "exact")}


def test_maps_in_rows(spark):
    kind = "id string, n int, attributes map<string,string>"
    rows = [("a", 1, {"x": "1"}), ("a", 2, {"x": "2"}), ("b", 1, None)]
    table = spark.createDataFrame(rows, kind)
    assert sorted((r.id, r.n, r.attributes) for r in edges.keep_last(table, "id", "n").collect()) == [("a", 2, {"x": "2"}), ("b", 1, None)]
    merged = edges.merge_edges(table.withColumnRenamed("id", "edge_id").where("n = 1"), table.withColumnRenamed("id", "edge_id"))
    assert sorted((r.edge_id, r.n, r.attributes) for r in merged.collect()) == [("a", 1, {"x": "1"}), ("b", 1, None)]
    new = spark.createDataFrame([("b", 5, {"y": "1"}), ("c", 6, {"z": "1"}), ("c", 7, {"z": "2"}), ("", 8, {})], kind)
    assert sorted((r.id, r.n) for r in incremental.upsert(table.where("n = 1"), new, ["id"]).collect()) == [("a", 1), ("b", 5), ("c", 7)]


def test_edge_ids_tell_parts_apart(spark):
    rows = [("a", "b|c", "t"), ("a|b", "c", "t"), (None, "a", "t"), ("a", None, "t"), ("", "a", "t"), ("a", "b", "t")]
    found = edges.edge_ids(spark.createDataFrame(rows, "src string, dst string, type string")).collect()
    assert len({r.edge_id for r in found}) == len(rows)


def test_depth_first_results(spark):
    g = Graph.from_lists(spark, {"A": ["B", "C"], "B": ["D"], "C": ["A"], "D": [], "Z": ["Z"]})
    got = {r.node: (r.depth, r.preorder, r.leaf, r.cycle) for r in traversal.depth_first(g, "A").collect()}
    assert got == {"A": (0, 0, False, False), "B": (1, 1, False, False), "D": (2, 2, True, False), "C": (1, 3, False, True)}
    assert [tuple(r) for r in traversal.depth_first(g, "D").collect()] == [("D", 0, 0, False, False)]
    assert [tuple(r) for r in traversal.depth_first(g, "Z").collect()] == [("Z", 0, 0, False, True)]
    assert {r.node for r in traversal.depth_first(g, "A", max_depth=1).collect()} == {"A", "B", "C"}


def test_relationships_in_conditions(spark):
    g = Graph.from_lists(spark, {"a": [("b", "CALLS")], "b": [("c", "USES")], "c": [], "d": []})
    at = Context(g)
    ids = lambda p: {r.id for r in Builder().table("nodes").filter(p).build().compile(at).collect()}
    assert ids(X.Or((X.Related("USES"), X.Equals("id", "d")))) == {"b", "d"}
    assert ids(X.And((X.Related(), X.Not(X.Related("USES"))))) == {"a"}
    assert ids(X.Not(X.Related(None, "INCOMING"))) == {"a", "d"}


def brute_paths(adjacency, a, b, most):
    out, todo = [], [[a]]
    while todo:
        path = todo.pop()
        if path[-1] == b and len(path) > 1:
            out.append(path)
        if len(path) <= most:
            todo += [[*path, t] for t in set(adjacency.get(path[-1], ())) if t not in path]
    return out


def test_paths_that_arrive(spark):
    """A graph of high out-degree: ten layers of six, all joined, and one way on from it."""
    import random

    rng = random.Random(1)
    adjacency = {f"{k}-{n}": [f"{k + 1}-{m}" for m in range(6)] for k in range(4) for n in range(6)}
    adjacency |= {"s": ["0-0", "0-1", "x"], "x": ["y"], "y": ["t", "s"], "4-0": ["t"], "4-1": ["s"]}
    short = {k: list(v) for k, v in adjacency.items() if k not in ("x", "y")}
    for _ in range(20):
        adjacency.setdefault(f"{rng.randrange(4)}-{rng.randrange(6)}", []).append(f"{rng.randrange(4)}-{rng.randrange(6)}")
    g = Graph.from_lists(spark, adjacency)
    for most in (3, 5):
        got = sorted(r.path for r in traversal.simple_paths(g, "s", ["t"], most).collect())
        assert got == sorted(brute_paths(adjacency, "s", "t", most))
    h = Graph.from_lists(spark, short)
    every = brute_paths(short, "s", "t", 6)
    least = min(map(len, every))
    expected = sorted(p for p in every if len(p) == least)
    assert sorted(r.path for r in traversal.all_shortest_paths(h, "s", "t").collect()) == expected and len(expected) > 100
    counts = {r.node: int(r.n_paths) for r in traversal.count_shortest_paths(h, "s", "t").collect()}
    assert counts["t"] == len(expected) and counts["s"] == 1
    assert [r.path for r in traversal.all_shortest_paths(h, "s", "s").collect()] == [["s"]]
    assert traversal.all_shortest_paths(h, "t", "s").collect() == [] and traversal.count_shortest_paths(h, "t", "s").collect() == []
    back = sorted(r.path[::-1] for r in traversal.all_shortest_paths(h, "t", "s", "INCOMING").collect())
    assert back == expected


def test_topological_from(spark):
    g = Graph.from_lists(spark, {"A": ["B", "C"], "B": ["D"], "C": ["D"], "D": ["E"], "E": [], "X": ["D", "Y"], "Y": ["X"], "P": ["Q", "R"], "Q": ["P", "S"], "R": [], "S": []})
    assert pairs(structure.topological_from(g, "A"), "node", "level", "blocked") == {("A", 0, False), ("B", 1, False), ("C", 1, False), ("D", 2, False), ("E", 3, False)}
    assert pairs(structure.topological_from(g, "X"), "node", "level", "blocked") == {("X", None, True), ("Y", None, True), ("D", None, True), ("E", None, True)}
    assert pairs(structure.topological_from(g, ["P", "A"]), "node", "blocked") >= {("P", True), ("Q", True), ("R", True), ("S", True), ("A", False)}
    assert pairs(structure.topological_from(g, "E"), "node", "level", "blocked") == {("E", 0, False)}


def test_formulas(spark):
    from graphloom.functions import scores as S
    from graphloom.functions import text as text_functions
    from graphloom.operators import analytics

    rows = [(2, 14, 1, 4), (0, 0, 0, 0), (100, 40, 9, 30), (23, 3, 0, 1)]
    df = spark.createDataFrame(rows, "b int, f int, a int, d int")
    score = S.risk_score_10(F.col("b"), F.col("f"), F.col("a"), F.col("d"))
    got = {r.b: (r.s, r.l) for r in df.select("b", score.alias("s"), S.risk_label_10(score).alias("l")).collect()}
    for b, f, a, d in rows:
        value = round(min(b / 10, 5.0) + min(f / 10, 2.0) + min(a * 0.5, 2.0) + min(d * 0.1, 1.0), 1)
        assert got[b] == (value, "critical" if value >= 7.5 else "high" if value >= 5 else "medium" if value >= 2.5 else "low")
    assert got[2] == (2.5, "medium")
    units = spark.createDataFrame([(1.9,), (2.0,), (7.9,), (8.0,), (40.0,)], "h double").select(S.effort_unit(F.col("h")).alias("u")).collect()
    assert [r.u for r in units] == ["minutes", "hours", "hours", "days", "weeks"]
    paths = {"src/main.py": 1.0, "Main.PY": 1.0, "main.go": 0.5, "src/routes/x.py": 0.9, "lib/api.py": 0.9, "src/service.py": 0.5, "tests/x.py": 0.3, "a/test_x.py": 0.3, "docs/x.md": 0.5, "index.ts": 1.0}
    found = spark.createDataFrame([(p,) for p in paths], "p string").select("p", text_functions.importance(F.col("p")).alias("i")).collect()
    assert {r.p: r.i for r in found} == paths
    risk = lambda **k: S.older_risk(*(F.lit(k.get(n, 0)) for n in ("depth", "apis", "functions", "files", "central", "workflows")), F.lit(k.get("text", "")), F.array(*map(F.lit, k.get("tags", ["none"]))), F.lit(k.get("scenario", "modify")), F.lit(k.get("nodes", 0)))
    one = spark.range(1).select(risk().alias("a"), risk(text="Login page").alias("b"), risk(text="postgres").alias("c"), risk(text="main.py").alias("d"), risk(tags=["HotFix"]).alias("e"), risk(scenario="delete", nodes=4).alias("f"), risk(scenario="delete", nodes=3, workflows=9).alias("g"), risk(text="github oauth db_ router", depth=9, apis=9, functions=9, files=9, central=1.0).alias("h")).first()
    assert tuple(one) == (0, 20, 12, 15, 8, 10, 12, 100)
    journeys = spark.createDataFrame([("user_login", "w1"), ("other", "w1"), ("both", "w1"), ("both", "w2"), ("none", "w3")], "journey string, workflow string")
    assert pairs(analytics.journeys_hit(journeys, spark.createDataFrame([("w1",), ("w2",)], "workflow string")), "journey", "severity") == {("user_login", "high"), ("other", "medium"), ("both", "high")}


def test_name_edges(spark):
    rows = [("1", "a", ["m.b", "a"], [], "SELECT x FROM users"), ("2", "b", [], ["pkg/a"], "insert into logs values (1); update users set x = 1; delete from old_rows")]
    records = spark.createDataFrame(rows, "id string, name string, calls array<string>, imports array<string>, code string")
    assert pairs(edges.name_edges(records), "src", "dst", "type") == {("1", "2", "calls"), ("2", "1", "imports"), ("1", "table:users", "reads_table"), ("2", "table:logs", "writes_table"), ("2", "table:users", "updates_table"), ("2", "table:old_rows", "deletes_table")}
    assert edges.name_edges(records, cap=2).count() == 2


def test_flow(spark):
    g = Graph.from_lists(spark, {"r": [("s", "calls"), ("t", "calls"), ("u", "imports")], "s": [("t", "calls")]})
    g = Graph(g.nodes.withColumn("node_type", F.lit("function")).withColumn("file", F.concat(F.lit("d/"), "id")), g.edges)
    nodes, steps = flows.flow(g, "r", ["calls"])
    assert {(r.node, r.depth, r.critical) for r in nodes.collect()} == {("r", 0, True), ("s", 1, False), ("t", 1, True)}
    assert [(r.src, r.dst) for r in steps.orderBy("ordinal").collect()] == [("r", "s"), ("r", "t"), ("s", "t")]
    assert {(r.node, r.chain) for r in flows.evidence(g, "t").collect()} == {("r", "r > t"), ("s", "s > t")}
    assert pairs(flows.cluster(g, spark.createDataFrame([("r",)], "id string"), "[rst]"), "id") == {("r",), ("s",), ("t",)}
    assert 0.55 <= flows.confidence(g, g.nodes, "r").first().confidence <= 0.98


def test_incremental(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, content_hash string")
    assert pairs(incremental.plan(old, new), "path", "action") == {("a", "unchanged"), ("b", "parse"), ("c", "deleted"), ("d", "parse")}
    assert [incremental.needs_run(*x) for x in ((None, "x"), ("x", "x"), ("y", "x"))] == ["all", "none", "changed"]
    up = incremental.upsert(old, spark.createDataFrame([("a", "9"), ("", "0"), (None, "0"), ("z", "3")], old.schema), ["path"])
    assert pairs(up, "path", "content_hash") == {("a", "9"), ("b", "1"), ("c", "1"), ("z", "3")}
    entries = spark.createDataFrame([("x", 5, 1, 10.0, 100.0), ("y", 5, 1, 20.0, 100.0), ("z", 5, 0, 30.0, 1.0)], "key string, size long, priority int, last_access double, ttl double")
    assert pairs(incremental.evict(entries, 8, 50.0), "key") == {("z",), ("x",)}
    parts = spark.createDataFrame([("p", 100, 90, "ACTIVE"), ("q", 100, 10, "ACTIVE"), ("r", 100, 0, "READONLY")], "partition_id string, capacity_bytes long, current_size_bytes long, status string")
    assert incremental.placement(parts).first().partition_id == "q"
    assert pairs(incremental.rebalance(parts), "source", "target") == {("p", "q"), ("p", "r")}


def test_query_tree(spark):
    nodes = spark.createDataFrame([("a", "x", 3), ("b", "x", None), ("c", "y", 1)], "id string, node_type string, size int")
    e = spark.createDataFrame([("a", "b", "CALLS"), ("b", "c", "USES")], "src string, dst string, type string")
    at = Context(Graph(nodes, e))
    b = Builder().table("nodes").filter(X.NodeIs("x", X.Exists("size"))).project("id", "size", aliases={"size": "s"})
    assert [tuple(r) for r in b.build().compile(at).collect()] == [("a", 3)]
    assert pairs(Builder().lookup("symbol", "a").expand(max_depth=2).build().compile(at), "id", "depth") == {("b", 1), ("c", 2)}
    assert pairs(Builder().table("nodes").filter(X.Related("USES", "INCOMING")).build().compile(at), "id") == {("c",)}
    grouped = Builder().table("nodes").aggregate(("COUNT", None, None), ("SUM", X.Property("size"), None), keys=("node_type",)).build().compile(at)
    assert pairs(grouped, "node_type", "count_val", "sum_val") == {("x", 2, 3), ("y", 1, 1)}
    ordered = Builder().table("nodes").sort("size", True, True).limit(2).build()
    assert [r.id for r in ordered.compile(at).collect()] == ["b", "c"]
    for q in (b.build(), ordered, Builder().lookup("class", "A").expand(types=("CALLS",)).build()):
        assert from_json(to_json(q)) == q
    with pytest.raises(ValueError):
        Builder().table("nodes").limit(-1)
    with pytest.raises(ValueError):
        Builder().build()
    assert estimate(Builder().lookup("symbol", "a").expand(max_depth=2).build()) == 25.0


def test_plans_push_down(spark):
    """Filters and columns reach the scan, small sides are broadcast by their measured size."""
    from graphloom.catalog.relational import filter_pruned_scan

    plan = filter_pruned_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(o_totalprice" in plan
    assert "o_orderpriority" not in plan


def test_search(spark):
    nodes = spark.createDataFrame([("1", "login", "auth/login.py"), ("2", "login_user", "auth/user.py"), ("3", "pay", "shop/pay.py")], "id string, name string, file string")
    g = Graph(nodes, spark.createDataFrame([("3", "1", "CALLS")], "src string, dst string, type string"))
    assert [r.id for r in search.by_name(nodes, "login").collect()] == ["1", "2"]
    assert [r.id for r in search.fuzzy(nodes, "logins", 0.5).collect()] == ["1"]
    found = {r.id: r.score for r in search.resolve(g, "login").collect()}
    assert found["1"] == 100.0 and found["3"] == 20.0
    assert search.graded(nodes, "pay").first().grade == 100


def test_long_cycle(spark):
    """A ring with a loop behind it and a bridge between, two rings with a way from one to the other."""
    n = 200
    links = [(k, (k + 1) % n) for k in range(n)] + [(3, 1000), (1000, 1001), (1001, 1001), (1001, 1002)] + [(2000, 2001), (2001, 2000), (2001, 2010), (2010, 2002), (2002, 2003), (2003, 2002)]
    found = structure.cycle_nodes(spark.createDataFrame(links, "src long, dst long"))
    assert sorted(r.node for r in found.collect()) == [*range(n), 1001, 2000, 2001, 2002, 2003]


def test_cycles_against_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    for m in (80,):
        links = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (m, 2)).tolist()}
        reach = set(links)
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in links if b == c}
            if more == reach:
                break
            reach = more
        found = structure.cycle_nodes(spark.createDataFrame(sorted(links), "src string, dst string").repartition(3))
        assert sorted(r.node for r in found.collect()) == sorted({a for a, b in reach if a == b})


def test_call_graph_rules(spark):
    from graphloom.operators.call_rules import call_graph_violations, index_differences, unequal_keys

    nodes = spark.createDataFrame([("a", "a", "m.a", "function", "f.py", False), ("b", "", None, None, None, True), ("c", "c", "m.c", "class", None, False), (None, "lost", "x", "class", "f", False)], "id string, name string, qualified_name string, node_type string, file string, is_external boolean")
    e = spark.createDataFrame([("a", "b", 1), ("a", "gone", 1), ("ghost", "a", 0), ("c", "c", 2), (None, "a", 1), ("a", "", 1)], "src string, dst string, weight int")
    pair = lambda rows: spark.createDataFrame(rows, "key string, value string")
    found = call_graph_violations(nodes, e, by_id=pair([("a", "a"), ("z", "z")]), by_name=pair([("m.q", "q")]), by_file=pair([("f.py", "a"), ("f.py", "y")]), forward=pair([("a", "b"), ("a", "gone"), ("ghost", "a"), ("c", "c"), ("a", "")]), backward=pair([("b", "a"), ("c", "c"), ("a", "ghost"), ("", "a")]), counts={"node_count": 4, "edge_count": 9}).collect()
    got = sorted((r.code, r.target, r.other) for r in found)
    assert sorted(got, key=str) == sorted(
        [
            ("MISSING_SYMBOL_ID", None, "lost"), ("EMPTY_NODE_NAME", "b", None), ("MISSING_FQN", "b", None), ("INVALID_NODE_TYPE", "b", None), ("MISSING_FILE_PATH", "c", None),
            ("MISSING_CALLER_SYMBOL_ID", None, "a"), ("MISSING_CALLEE_SYMBOL_ID", "a", None), ("CALLER_DOES_NOT_EXIST", "ghost", "a"), ("CALLEE_DOES_NOT_EXIST", "a", "gone"), ("INVALID_EDGE_WEIGHT", "ghost", "a"), ("SELF_LOOP_RECURSION", "c", "c"),
            ("INDEXED_NODE_MISSING", "z", "z"), ("INDEXED_FQN_MISSING", "m.q", "q"), ("INDEXED_FILE_NODE_MISSING", "f.py", "y"), ("EDGE_COUNT_MISMATCH", "9", "6"), ("INDEX_NODE_COUNT_MISMATCH", "2", "4"),
            ("DANGLING_ADJACENCY_CALLER", "ghost", None), ("DANGLING_ADJACENCY_CALLEE", "a", "gone"), ("ASYMMETRIC_ADJACENCY", "a", "gone"),
        ],
        key=str,
    )
    one, two = pair([("k", "a"), ("k", "b"), ("k", "b"), ("l", "x"), ("m", None)]), pair([("k", "b"), ("k", "a"), ("k", "a"), ("l", "x"), ("n", "y"), ("m", None)])
    assert {r.key for r in unequal_keys(one, two).collect()} == {"k", "n"} and unequal_keys(one, one).collect() == []
    assert pairs(index_differences(one, two), "key", "value", "in_source", "in_index") == {("k", "a", 1, 2), ("k", "b", 2, 1), ("n", "y", 0, 1)}


def test_evidence_chains(spark):
    nodes = spark.createDataFrame([("s", "start", "function", None), ("m", "middle", "function", None), ("x", "far", "api_route", "/far"), ("y", "near", "api_route", None), ("z", "other", "api_route", "/other")], "id string, name string, node_type string, route_path string")
    e = spark.createDataFrame([("s", "m", "CALLS"), ("m", "y", "CALLS"), ("y", "x", "CALLS")], "src string, dst string, type string")
    g = Graph(nodes, e)
    workflows = spark.createDataFrame([("login", "auth", 0.9), ("pay", "billing", None), (None, "q", 1.0), ("login", "auth", 0.4)], "workflow string, service string, confidence double")
    journeys = spark.createDataFrame([("enter", "login"), ("enter", "pay"), ("buy", "pay"), ("leave", "none")], "journey string, workflow string")
    impacted = traversal.bfs(g, "s").select("node")
    found = flows.evidence_chains(g, "s", impacted, workflows, journeys).collect()
    assert {(r.chain_type, r.target, r.summary, r.confidence_percent) for r in found} == {
        ("service", "auth", "start → login → auth", 90.0),
        ("service", "billing", "start → pay → billing", 0.0),
        ("journey", "enter", "start → buy → enter → enter", 100.0),
        ("journey", "buy", "start → buy → enter → buy", 100.0),
        ("api_route", "/far", "start → /far", 75.0),
        ("api_route", "near", "start → near", 75.0),
        ("api_route", "near", "start → start → middle → near", 85.0),
    }
    assert next(r for r in found if r.confidence_percent == 90.0).steps[1].step_type == "workflow"
    targets = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node string")
    assert traversal.nearest_target(g, "s", targets("x", "y", "z")) == ["s", "m", "y"]
    assert traversal.nearest_target(g, "s", targets("z")) == [] and traversal.nearest_target(g, "s", targets("s", "x")) == ["s"]
    assert traversal.nearest_target(g, "x", targets("s"), "INCOMING") == ["x", "y", "m", "s"]


def test_small_steps(spark, cyclic):
    found = traversal.with_edge_types(cyclic, traversal.bfs(cyclic, "A"))
    assert pairs(found, "node", "edge_type") == {("A", None), ("B", "CALLS"), ("E", "IMPORTS"), ("C", "CALLS"), ("F", "IMPORTS"), ("D", "CALLS")}
    rows, seen = traversal.counted(found)
    assert len(rows.collect()) == seen.get["n"] == 6
    nodes = spark.createDataFrame([("a", "get", "/x"), ("b", "POST", "/x"), ("c", None, "/y")], "id string, http_method string, route_path string")
    assert pairs(indexes.routes(nodes), "key", "id") == {("GET:/x", "a"), ("POST:/x", "b")}
    twice = nodes.union(spark.createDataFrame([("d", "GET", "/x")], nodes.schema))
    with pytest.raises(ValueError):
        indexes.routes(twice)
    assert ("GET:/x", "d") in pairs(indexes.routes(twice, True), "key", "id")
    from graphloom.functions.scores import blast_or_fan_in

    kept = spark.createDataFrame([(1, 5), (None, 3), (None, None)], "b int, f int").select(blast_or_fan_in(F.col("b"), F.col("f")).alias("x")).collect()
    assert [r.x for r in kept] == [1, 3, 0]


def test_usage_search_as_far_as_its_sql(spark, tmp_path):
    """A chain of 25 uses: the query goes 20 steps, as its SQL does, and the verb as far as it is asked to."""
    import duckdb

    from graphloom.catalog import load
    from graphloom.plans.verbs import GraphEngine
    from graphloom.sources.derived import part_graph

    # Following parts 2k and 2k + 2 give a sum of 4k + 2, which is a use; part 100 uses the last one too.
    pairs = [(2 * k, 2 * k + 2) for k in range(25)] + [(100, 50)]
    spark.createDataFrame([(n, "x", "b", "t", 1, 1.0) for n in range(101)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    lines = [(o, n + 1, p) for o, pair in enumerate(pairs) for n, p in enumerate(pair)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    queries, oracles = load()
    got = sorted(map(tuple, queries["usage_search"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.execute(oracles["usage_search"]).fetchall()) and max(d for _, d in got) == 20
    engine = GraphEngine(part_graph(spark, str(tmp_path)))
    assert engine.find_usages(50, True).agg({"depth": "max"}).first()[0] == 25
    assert engine.find_usages(50).count() == 2


def test_blast_radius_of_half_pairs(spark, monkeypatch):
    """Counts equal the pairs' for all depths, with loops, hubs, packs of two and heavy targets; no table of pairs beyond half the depth."""
    import random

    from graphloom.operators import analytics, traversal
    from graphloom.graph import Graph

    draw = random.Random(5)
    links = {(draw.randrange(60), draw.randrange(60)) for _ in range(110)} | {(k, 7) for k in range(60, 80)} | {(3, 3), (7, 7)}
    edges = spark.createDataFrame(sorted(links), "src long, dst long")
    asked, pairs = [], traversal.reverse_pairs

    def spied(edges, depth=8):
        asked.append(depth)
        return pairs(edges, depth)

    monkeypatch.setattr(traversal, "reverse_pairs", spied)
    monkeypatch.setattr(traversal, "PACK", 2)
    for depth, heavy in ((1, 50), (2, 50), (5, 0), (8, 50)):
        monkeypatch.setattr(traversal, "HEAVY", heavy)
        before, out = {}, {}
        for a, b in links:
            out.setdefault(b, set()).add(a)
        for target in out:
            seen, level = set(), {target}
            for k in range(depth):
                level = {a for t in level for a in out.get(t, ()) if a != target or k == 0} - seen
                seen |= level
            before[target] = len(seen)
        assert {r.target: r.n for r in traversal.reverse_counts(edges, depth).collect()} == before
    asked.clear()
    nodes = spark.range(81)
    assert {r.id: r.blast_radius for r in analytics.blast_radius(Graph(nodes, edges)).collect()} == {k: before.get(k, 0) for k in range(81)}
    assert asked == [4]


def test_reachable_targets_as_a_table(spark):
    """Targets of any number are a table that is joined; repeated and unknown ones and nulls add no rows."""
    from graphloom.graph import Graph
    from graphloom.plans.verbs import GraphEngine

    g = Graph.from_lists(spark, {"A": ["B"], "B": ["C", "D"], "C": ["E"]})
    targets = spark.createDataFrame([("A",), ("D",), ("D",), ("E",), ("Z",), (None,)], "node string")
    found = GraphEngine(g).find_reachable_nodes("A", targets, 2)
    assert {tuple(r) for r in found.collect()} == {("A", 0), ("D", 2)} and found.count() == 2
    assert {tuple(r) for r in GraphEngine(g).find_reachable_nodes("A", ["D", "E"]).collect()} == {("D", 2), ("E", 3)}


def test_cycle_rounds_send_no_table_to_the_driver(spark, monkeypatch):
    """Joins of a round are shuffled: a broadcast would pass a table of the nodes through the driver, round after round."""
    from graphloom.operators import structure
    from graphloom.scratch import Scratch

    plans, save = [], Scratch.save

    def spied(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", spied)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (7, 7)], "src long, dst long")
    assert {r.node for r in structure.cycle_nodes(edges).collect()} == {1, 2, 3, 4, 5, 7}
    assert any("Join" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_resolve_deals_nodes_of_one_split_over_tasks(spark, monkeypatch):
    from graphloom.operators import search

    tasks = {}

    class Counting(search.Scratch):
        def save(self, df, name):
            tasks[name] = df.rdd.getNumPartitions()
            return super().save(df, name)

    monkeypatch.setattr(search, "Scratch", Counting)
    nodes = spark.createDataFrame([(k, f"word{k} red", f"f{k}") for k in range(40)], "id long, name string, file string").coalesce(1)
    edges = spark.createDataFrame([(0, 1, "CALLS")], "src long, dst long, type string")
    assert search.resolve(Graph(nodes, edges), "red ring").count() == 25
    assert tasks["embeddings"] > 1
