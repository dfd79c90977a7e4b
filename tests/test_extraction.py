"""Typed edges of parsed records, one family after the other."""

from graphloom.operators import extraction as X

COLUMNS = "id string, name string, node_type string, file string, calls array<string>, imports array<string>, bases array<string>, depends_on array<string>, code string"


def edges_of(spark, rows, files):
    base = dict(calls=[], imports=[], bases=[], depends_on=[], code=None)
    rows = [tuple((base | r)[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows]
    return {tuple(r) for r in X.typed_edges(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame([(f,) for f in files], "file string")).collect()}


def test_families(spark):
    rows = [
        dict(id="a.py:run", name="run", node_type="function", file="a.py", calls=["go", "run", "get", "go"], imports=["b", "pkg.mod.Thing"], depends_on=["verify_token", "go", "make_db"]),
        dict(id="b.py:go", name="go", node_type="function", file="b.py"),
        dict(id="c.py:K.go", name="K.go", node_type="method", file="c.py", code="x = redis.get(1); redis(2); SELECT a FROM logs; select(User); session.add(user)"),
        dict(id="c.py:K", name="K", node_type="class", file="c.py", bases=["Base", "object", "L"]),
        dict(id="d.py:L", name="L", node_type="class", file="d.py"),
        dict(id="d.py:route", name="route", node_type="api_route", file="d.py", calls=["run"], code="app.add_middleware(CORSMiddleware); requests.get('https://api.github.com'); update t set x; INSERT INTO logs; delete from old"),
        dict(id="pkg/mod.py:Thing", name="Thing", node_type="class", file="pkg/mod.py"),
        dict(id="x:var", name="var", node_type="variable", file="a.py", code="select 1 from where"),
    ]
    got = edges_of(spark, rows, ["a.py", "b.py", "c.py", "d.py", "pkg/mod.py"])
    want = {("a.py:run", "b.py:go", "calls"), ("a.py:run", "c.py:K.go", "calls"), ("d.py:route", "a.py:run", "api_calls")}
    want |= {("a.py:run", "b.py:go", "imports"), ("a.py:run", "pkg/mod.py:Thing", "imports"), ("c.py:K", "c.py:K.go", "class_contains")}
    want |= {("c.py:K", "_ext_Base", "inherits"), ("c.py:K", "d.py:L", "inherits")}
    want |= {("a.py:run", "_auth_verify_token", "auth_dependency"), ("a.py:run", "b.py:go", "dependency_injection"), ("a.py:run", "_di_make_db", "dependency_injection")}
    want |= {("c.py:K.go", "__svc__Redis", "uses_service"), ("d.py:route", "__api__External HTTP", "external_api"), ("d.py:route", "__api__GitHub API", "external_api"), ("d.py:route", "__mw__CORSMiddleware", "middleware_dependency")}
    want |= {("c.py:K.go", "__table__logs", "reads_table"), ("c.py:K.go", "__table__users", "reads_table"), ("c.py:K.go", "__table__users", "writes_table")}
    want |= {("d.py:route", "__table__t", "updates_table"), ("d.py:route", "__table__logs", "writes_table"), ("d.py:route", "__table__old", "deletes_table")}
    want |= {(f, i, "contains") for f, i in (("a.py", "a.py:run"), ("b.py", "b.py:go"), ("c.py", "c.py:K.go"), ("c.py", "c.py:K"), ("d.py", "d.py:L"), ("d.py", "d.py:route"), ("pkg/mod.py", "pkg/mod.py:Thing"))}
    assert got == want
    nodes = {tuple(r) for r in X.generic_nodes(spark.createDataFrame(list(got), "src string, dst string, type string")).collect()}
    assert nodes >= {("__svc__Redis", "Redis", "service"), ("_ext_Base", "Base", "class"), ("_di_make_db", "make_db", "function"), ("__table__logs", "logs", "database_table")} and len(nodes) == 11


def test_import_files(spark):
    files = ["src/app/main.ts", "src/lib/util.ts", "src/lib/index.js", "src/x.js", "app/models.py", "app/core/__init__.py", "app/services.py", "top.py"]
    said = {"./util": "src/lib/util.ts", "../lib": "src/lib/index.js", "../x.js": "src/x.js", "../../../../top.py": "top.py", "./none": None, "app.models.Node": "app/models.py", "app.core": "app/core/__init__.py", "app.serv": "app/services.py", "app.models": "app/models.py", "@scope/x": None, "lib/util": None, "nothing.here": None, "": None, "top/": "top.py"}
    rows = spark.createDataFrame([("1", "src/lib/a.ts", s) for s in said], "id string, file string, said string")
    got = {r.said: r.target for r in X.import_files(rows, spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == {s: t for s, t in said.items() if t}


def test_nothing(spark):
    assert edges_of(spark, [], ["a.py"]) == set()
    assert edges_of(spark, [dict(id="a", name="a", node_type="function", file="gone.py", calls=None, imports=None, bases=None, depends_on=None)], ["a.py"]) == set()


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """Many callers of one name in rows of a few each, an id with two names, repeated records; only the small families are made distinct."""
    monkeypatch.setattr(X, "PART", 3)
    monkeypatch.setattr(X, "TASK", 10)
    rows = [dict(id=f"f{k}", name="go", node_type="function", file="a.py", calls=["go", "run"]) for k in range(20)] * 2
    rows += [dict(id="two", name=n, node_type="class", file="b.py", bases=["go", "Gone", "object"]) for n in ("go", "run")]
    got = edges_of(spark, rows, [])
    want = {(f"f{a}", f"f{b}", "calls") for a in range(20) for b in range(20) if a != b} | {(f"f{a}", "two", "calls") for a in range(20)}
    assert got == want | {("two", f"f{a}", "inherits") for a in range(20)} | {("two", "two", "inherits"), ("two", "_ext_Gone", "inherits")}
    base = dict(calls=[], imports=[], bases=[], depends_on=[], code=None)
    frame = X.typed_edges(spark.createDataFrame([tuple((base | r)[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], COLUMNS), spark.createDataFrame([], "file string"))
    assert frame.count() == len(got)
    plan = frame._jdf.queryExecution().optimizedPlan()
    # The calls and bases of names are beside, not under, the aggregation of the others.
    assert plan.nodeName() == "Union"


def test_a_row_makes_pairs_of_one_source(spark, monkeypatch):
    """What a row explodes into is held at once, so sources are rows of their own; with and without dealt tasks the pairs are the same."""
    monkeypatch.setattr(X, "PART", 3)
    base = dict(calls=[], imports=[], bases=[], depends_on=[], code=None)
    rows = [base | dict(id=f"f{k}", name="go" if k < 20 else "far", node_type="function", file="a.py", calls=["go", "far", "none", None]) for k in range(27)]
    frame = spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS.split(", ")) for r in rows], COLUMNS)
    for task in (10, 20_000_000):
        monkeypatch.setattr(X, "TASK", task)
        made = X.typed_edges(frame, spark.createDataFrame([], "file string"))
        assert sorted(map(tuple, made.collect())) == sorted((f"f{a}", f"f{b}", "calls") for a in range(27) for b in range(27) if a != b)
        steps = [line.lstrip("+-: ") for line in made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()]
        steps = [s.partition(") ")[2] if s.startswith("*(") else s for s in steps]
        of = [k for k, s in enumerate(steps) if s.startswith("Generate explode(dsts")]
        assert of and all(next(s for s in steps[k + 1 :] if not s.startswith(("Project", "Filter"))).startswith("SortMergeJoin") for k in of)
