"""Scopes, symbol tables and re-exports against brute force."""

import collections
import random

import pytest

from graphloom.operators import forest, scopes, skew


def brute_labels(parents):
    kids, labels = collections.defaultdict(list), {}
    for i in sorted(parents):
        kids[parents[i] if parents[i] in parents else None].append(i)
    count = 0
    todo = [(i, 0, i) for i in reversed(kids[None])]
    order = []
    while todo:
        i, depth, root = todo.pop()
        order.append(i)
        labels[i] = [root, depth, count, count]
        count += 1
        todo += [(k, depth + 1, root) for k in reversed(kids[i])]
    for i in reversed(order):
        p = parents[i]
        if p in labels:
            labels[p][3] = max(labels[p][3], labels[i][3])
    return labels


def some_forest(n=120, seed=1):
    rng = random.Random(seed)
    parents = {}
    for k in range(n):
        parents[f"s{k:03}"] = None if k < 3 else f"s{rng.choice([0, 0, 0, rng.randrange(k), k - 1]):03}"
    parents |= {"d1": "nowhere", "d2": "d1", "r1": "r3", "r2": "r1", "r3": "r2", "r4": "r2", "self": "self"}
    for k in range(40):
        parents[f"t{k:02}"] = f"t{k - 1:02}" if k else "s001"
    return parents


@pytest.fixture(params=[20_000, 2])
def hot(request, monkeypatch, spark):
    """Few or all keys are hot, and shards stay apart."""
    monkeypatch.setattr(skew, "HOT_KEYS", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def labelled(spark, parents):
    return scopes.scope_intervals(spark.createDataFrame(list(parents.items()), "id string, parent string"))


def around(parents, i):
    out, seen = [], {i}
    while (i := parents.get(i)) in parents and i not in seen:
        seen.add(i)
        out.append(i)
    return out


def test_labels(spark, hot):
    parents = some_forest()
    labels = labelled(spark, parents).collect()
    expected = brute_labels(parents)
    assert {r.id: [r.root, r.depth, r.start, r.stop] for r in labels if r.state != "ring"} == expected
    assert {r.id for r in labels if r.state == "ring"} == {"r1", "r2", "r3", "r4", "self"}
    assert {r.id for r in labels if r.state == "dangling"} == {"d1"} and all(r.start is None for r in labels if r.state == "ring")
    assert {r.id: r.parent for r in labels} == parents


def test_labels_of_nothing_and_of_a_chain(spark):
    assert scopes.scope_intervals(spark.createDataFrame([], "id string, parent string")).collect() == []
    chain = {f"{k:04}": f"{k - 1:04}" if k else None for k in range(1000)}
    assert {r.id: r.depth for r in labelled(spark, chain).collect()} == {f"{k:04}": k for k in range(1000)}


def test_relatives(spark):
    parents = some_forest(60)
    labels = labelled(spark, parents)
    ids = spark.createDataFrame([("s005",), ("t39",), ("s000",), ("r1",), ("d2",)], "id string")
    good = [i for i in ("s005", "t39", "s000", "d2")]
    assert {tuple(r) for r in scopes.ancestors(labels, ids).collect()} == {(i, a, k + 1) for i in good for k, a in enumerate(around(parents, i))}
    below = {(a, i, k + 1) for i in parents if not i.startswith("r") and i != "self" for k, a in enumerate(around(parents, i)) if a in good}
    assert {tuple(r) for r in scopes.descendants(labels, ids).collect()} == below
    assert {tuple(r) for r in scopes.children(labels, ids).collect()} == {(p, i) for i, p in parents.items() if p in ("s005", "t39", "s000", "r1", "d2")}


def declared_names(parents, seed=3):
    rng, rows = random.Random(seed), []
    for i in parents:
        for k in range(rng.randrange(3)):
            rows.append((i, rng.choice(["x", "x", "y", "z"]), f"{i}-{k}", rng.randrange(9)))
    return rows


def test_names_in_scope(spark, hot):
    parents = some_forest()
    rows, rng = declared_names(parents), random.Random(4)
    own = collections.defaultdict(list)
    for scope, name, symbol, ordinal in rows:
        own[scope, name].append((ordinal, symbol))
    uses = [(k, rng.choice([*parents, "unknown"]), rng.choice(["x", "y", "z", "w", None])) for k in range(600)]
    labels = labelled(spark, parents)
    declarations = spark.createDataFrame(rows, "scope string, name string, symbol string, ordinal int")
    got = scopes.resolve_in_scope(labels, declarations, spark.createDataFrame(uses, "use int, scope string, name string")).collect()
    expected = {}
    for k, scope, name in uses:
        chain = [] if scope not in parents else [scope] if scope[0] == "r" or scope == "self" else [scope, *around(parents, scope)]
        at = next((s for s in chain if (s, name) in own), None)
        expected[k] = (None, None) if at is None else (min(own[at, name])[1], at)
    assert {r.use: (r.symbol, r.declared_in) for r in got} == expected and len(got) == len(uses)
    shadows = {(name, s, min(own[s, name])[1], o, min(own[o, name])[1]) for s, name in own if not (s[0] == "r" or s == "self") for o in [next((a for a in around(parents, s) if (a, name) in own), None)] if o}
    assert {tuple(r) for r in scopes.shadowed_names(labels, declarations).collect()} == shadows and shadows
    ids = spark.createDataFrame([("t20",), ("s010",), ("r2",)], "id string")
    seen = {}
    for i in ("t20", "s010", "r2"):
        for s in [i] if i == "r2" else [i, *around(parents, i)]:
            for (scope, name), found in own.items():
                if scope == s:
                    seen.setdefault((i, name), (min(found)[1], s))
    assert {(r.id, r.name): (r.symbol, r.declared_in) for r in scopes.visible_symbols(labels, declarations, ids).collect()} == seen


def test_scope_violations(spark):
    rows = [("a", None, 1, 9, 0, 0), ("b", "gone", 5, 3, 0, 0), ("c", "d", 1, 1, 4, 2), ("d", "c", 1, 1, 1, 2)]
    table = spark.createDataFrame(rows, "id string, parent string, start_line int, end_line int, start_column int, end_column int")
    declarations = spark.createDataFrame([("a", "x", "s1", 0), ("a", "y", "s2", 1)], "scope string, name string, symbol string, ordinal int")
    found = scopes.scope_violations(table, declarations, spark.createDataFrame([("s1",)], "id string")).collect()
    assert sorted(((r.severity, r.code, r.scope, r.symbol) for r in found), key=str) == sorted([("error", "DANGLING_PARENT", "b", None), ("error", "CIRCULAR_SCOPE", "c", None), ("error", "CIRCULAR_SCOPE", "d", None), ("error", "UNOWNED_SYMBOL", "a", "s2"), ("warning", "INVALID_LOCATION", "b", None), ("warning", "INVALID_LOCATION", "c", None)], key=str)


def test_sums(spark, hot):
    from graphloom.scratch import Scratch

    parents = {k: v for k, v in some_forest(50).items() if v is None or v in some_forest(50)}
    value = {i: k % 7 for k, i in enumerate(parents)}
    df = spark.createDataFrame([(i, p if p in parents else None, value[i]) for i, p in parents.items()], "id string, parent string, v int")
    good = [i for i in parents if i[0] != "r" and i != "self"]
    below = collections.Counter({i: value[i] for i in good})
    for i in good:
        for a in around(parents, i):
            below[a] += value[i]
    assert {r.id: r.v for r in forest.subtree_sums(df, ["v"], Scratch(spark, "t")).collect()} == dict(below)
    got = {r.id: (r.v, r.hops) for r in forest.path_sums(df, ["v"], Scratch(spark, "t")).collect() if r.root}
    assert got == {i: (value[i] + sum(value[a] for a in around(parents, i)), len(around(parents, i))) for i in good}


def test_nodes_without_children_take_no_part_in_rounds(spark):
    from graphloom.scratch import Scratch

    star = spark.createDataFrame([("a", None)] + [(f"x{k}", "a") for k in range(50)], "id string, parent string").selectExpr("id", "parent", "1 as v")
    scratch = Scratch(spark, "t")
    got = {r.id: (r.root, r.hops, r.v) for r in forest.path_sums(star, ["v"], scratch).collect()}
    assert got == {"a": ("a", 0, 1)} | {f"x{k}": ("a", 1, 2) for k in range(50)}
    assert spark.read.parquet(f"{scratch.root}/paths-0").count() == 1


def test_resolve_in_scope_reads_its_uses_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    uses = spark.createDataFrame([("b", "x"), ("b", "y"), ("a", "x"), ("b", "x")], "scope string, name string").mapInArrow(seen, "scope string, name string")
    declarations = spark.createDataFrame([("a", "x", "s1", 0)], "scope string, name string, symbol string, ordinal int")
    found = scopes.resolve_in_scope(labelled(spark, {"a": None, "b": "a"}), declarations, uses).collect()
    assert sorted((r.scope, r.name, r.symbol or "") for r in found) == [("a", "x", "s1"), ("b", "x", "s1"), ("b", "x", "s1"), ("b", "y", "")]
    assert read.value <= 8  # once for the distinct pairs and once for the answers, of four rows


def test_enclosing_over_many_batches(spark):
    from graphloom.scratch import Scratch

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    outer = [("k", s, e, f"l{s}-{e}") for s, e in ((0, 90), (1, 40), (2, 9), (12, 30), (50, 60))]
    points = [("k", s, s) for s in range(100)] + [("other", 5, 500)]
    a, b = spark.createDataFrame(outer, "key string, start long, stop long, label string"), spark.createDataFrame(points, "key string, start long, point long")
    found = forest.enclosing(a, b, Scratch(spark, "t"), innermost=False).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, found)) == sorted((p, label) for _, at, p in points[:100] for _, s, e, label in outer if s <= at <= e)
