"""Re-exports against a search from each name."""

import random

import pytest

from graphloom.operators import re_exports as R

EXPORTS = "package string, name string, source string, original string, ordinal int"
SYMBOLS = "id long, fqn string, name string, kind string, file string"


def brute(exports, symbols, asked=None):
    named, stars = {}, {}
    for package, name, source, original, ordinal in sorted(exports, key=lambda e: e[4]):
        if name is None:
            if source and source not in stars.setdefault(package, []):
                stars[package].append(source)
        else:
            named[package, name] = (source, original or name)
    rows = sorted(symbols)

    def inside(module, name):
        exact = next((s[0] for s in rows if s[3] != "module" and s[1] == f"{module}.{name}"), None)
        file = next((s[4] for s in rows if s[3] == "module" and s[1] == module), None)
        return exact if exact is not None else next((s[0] for s in rows if s[3] != "module" and s[2] == name and s[4] == file), None)

    def anywhere(package, name):
        return next((s[0] for s in rows if s[3] != "module" and s[2] == name and s[1].startswith(package + ".")), None)

    def find(package, name, seen):
        """The symbol, and whether a ring was met on the way."""
        if (package, name) in seen:
            return None, True
        seen, ring = seen | {(package, name)}, False
        if (package, name) in named:
            source, original = named[package, name]
            if source:
                got = inside(source, original)
                if got is not None:
                    return got, False
                got, ring = find(source, original, seen)
                if got is not None or ring:
                    return got, ring
            return anywhere(package, original), ring
        for source in stars.get(package, []):
            got = inside(source, name)
            if got is not None:
                return got, False
            got, met = find(source, name, seen)
            ring |= met
            if got is not None:
                return got, False
        return None, ring

    out = {}
    for package, name in asked if asked is not None else named:
        got, ring = find(package, name, frozenset())
        out[package, name] = (got, "resolved" if got is not None else "ring" if ring else "unresolved")
    return out


def run(spark, exports, symbols, asked=None):
    wanted = None if asked is None else spark.createDataFrame(asked, "package string, name string")
    rows = R.re_exports(spark.createDataFrame(exports, EXPORTS), spark.createDataFrame(symbols, SYMBOLS), wanted).collect()
    fqn = {s[0]: s[1] for s in symbols}
    assert all(r.fqn == fqn.get(r.symbol) for r in rows) and len({(r.package, r.name) for r in rows}) == len(rows)
    return {(r.package, r.name): (r.symbol, r.state) for r in rows}


SYMBOL_ROWS = [
    (1, "web.app", "app", "module", "web/app.py"),
    (2, "web.app.App", "App", "class", "web/app.py"),
    (3, "web.routing", "routing", "module", "web/routing.py"),
    (4, "odd.Router", "Router", "class", "web/routing.py"),
    (5, "web.deep.down.Hidden", "Hidden", "class", "web/deep/down.py"),
    (6, "web.params.Query", "Query", "function", "web/params.py"),
    (7, "web.app.Own", "Own", "class", "web/app.py"),
]


def test_kinds_of_exports(spark):
    exports = [
        ("web", "App", "web.app", "App", 0),
        ("web", "Router", "web.routing", "Router", 1),
        ("web", "Hidden", None, "Hidden", 2),
        ("web", "Nothing", "web.app", "Nothing", 3),
        ("top", "Application", "web", "App", 4),
        ("top", "Application2", "web.none", "App", 5),
        ("top", "Application2", "web", "App", 6),
        ("top", None, "web", None, 7),
        ("star", None, "web.params", None, 8),
        ("star", None, "top", None, 9),
        ("a", "X", "b", "X", 10),
        ("b", "X", "c", "X", 11),
        ("c", "X", "a", "X", 12),
        ("into", "X", "a", "X", 13),
    ]
    asked = [("star", "Query"), ("star", "App"), ("star", "Application"), ("star", "gone"), ("top", "Router"), ("web.app", "Own"), ("nowhere", "x")]
    assert run(spark, exports, SYMBOL_ROWS) == brute(exports, SYMBOL_ROWS)
    got = run(spark, exports, SYMBOL_ROWS, asked)
    expected = brute(exports, SYMBOL_ROWS, asked) | {("web.app", "Own"): (7, "resolved")}
    assert got == expected
    assert run(spark, exports, SYMBOL_ROWS)["a", "X"] == (None, "ring") == run(spark, exports, SYMBOL_ROWS)["into", "X"]


def test_long_chains_and_rings(spark):
    chain = [(f"p{k}", "N", f"p{k + 1}", "N", k) for k in range(1000)]
    symbols = [(1, "p1000.N", "N", "class", "f")]
    got = run(spark, chain, symbols)
    assert set(got.values()) == {(1, "resolved")} and len(got) == 1000
    ring = [(f"p{k}", "N", f"p{(k + 1) % 1000}", "N", k) for k in range(1000)]
    assert set(run(spark, ring, symbols).values()) == {(None, "ring"), (1, "resolved")} - {(1, "resolved")}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_packages(spark, seed):
    """Layers of packages, so that no ring has several ways on."""
    rng = random.Random(seed)
    names, exports, symbols = ["A", "B", "C"], [], []
    for layer in range(6):
        for k in range(4):
            package = f"l{layer}.p{k}"
            symbols.append((len(symbols), package, f"p{k}", "module", f"{package}.py"))
            for name in names:
                if rng.random() < 0.15:
                    symbols.append((len(symbols), rng.choice([f"{package}.{name}", f"{package}.inner.{name}", f"other.{name}{k}"]), name, "class", f"{package}.py"))
            for _ in range(rng.randrange(4)):
                source = f"l{layer + 1}.p{rng.randrange(4)}" if rng.random() < 0.9 else None
                name = rng.choice([*names, None]) if source else rng.choice(names)
                exports.append((package, name, source, rng.choice(names) if name else None, len(exports)))
    asked = [(f"l{layer}.p{k}", n) for layer in range(3) for k in range(4) for n in names]
    expected = brute(exports, symbols, asked)
    got = run(spark, exports, symbols, asked)
    own = {s[1] for s in symbols if s[3] == "class"}
    handed = {(e[0], e[1]) for e in exports if e[1]}
    stars = {e[0] for e in exports if e[1] is None}
    for key, value in expected.items():
        if key in handed or key[0] in stars:
            assert got[key] == value, key
    assert own and sum(v[1] == "resolved" for v in got.values()) > 5


def test_stars_in_rings(spark):
    symbols = [(1, "s1.N", "N", "class", "f"), (2, "s2.N", "N", "class", "g")]
    exports = [("a", None, "b", None, 0), ("a", None, "s1", None, 1), ("b", None, "a", None, 2), ("b", None, "s2", None, 3), ("c", None, "d", None, 4), ("c", None, "e", None, 5), ("d", None, "c", None, 6), ("e", None, "c", None, 7)]
    got = run(spark, exports, symbols, [("a", "N"), ("b", "N"), ("c", "N"), ("d", "N")])
    # a star that leads back is passed over, so each takes its own other one
    assert got == {("a", "N"): (1, "resolved"), ("b", "N"): (2, "resolved"), ("c", "N"): (None, "ring"), ("d", "N"): (None, "ring")}


def test_export_violations(spark):
    exports = [("a", "X", "b", "X", 0), ("a", "X", "m", "X", 1), ("b", None, "a", None, 2), ("c", "Y", None, "Y", 3)]
    found = R.export_violations(spark.createDataFrame(exports, EXPORTS)).collect()
    assert sorted(((r.code, r.package, r.name) for r in found), key=str) == sorted([("DUPLICATE_EXPORT", "a", "X"), ("MISSING_SOURCE_MODULE", "c", "Y"), ("CYCLIC_EXPORT", "a", None), ("CYCLIC_EXPORT", "b", None)], key=str)


def test_only_names_that_nothing_exports_are_looked_for_again(spark, monkeypatch):
    rows = {}

    class Counting(R.Scratch):
        def save(self, df, name):
            saved = super().save(df, name)
            rows[name] = saved.count()
            return saved

    monkeypatch.setattr(R, "Scratch", Counting)
    exports = spark.createDataFrame([("p", "A", "q", "A", 0), ("p", "B", "q", "B", 0)], "package string, name string, source string, original string, ordinal int")
    symbols = spark.createDataFrame([("q.A", "q.A", "A", "class", None)], "id string, fqn string, name string, kind string, file string")
    asked = spark.createDataFrame([("p", "A"), ("p", "B"), ("q", "A"), ("q", "C")], "package string, name string")
    found = R.re_exports(exports, symbols, asked).collect()
    assert {(r.package, r.name, r.fqn, r.state) for r in found} == {("p", "A", "q.A", "resolved"), ("p", "B", None, "unresolved"), ("q", "A", "q.A", "resolved"), ("q", "C", None, "unresolved")}
    assert rows["own-asked"] == 2
