"""Snapshots, file scans, payloads and streams."""

import datetime

import pytest

from graphloom.graph import Graph
from graphloom.sources.store import SnapshotStore, from_payload, list_folders, read_json_graph, scan_files
from graphloom.sources.buckets import BucketTable, Conflict
from graphloom.streaming.edges import upsert_sink, windowed_weights


def test_snapshots(spark, tmp_path):
    store, g = SnapshotStore(spark, f"file://{tmp_path}/snapshots"), Graph.from_lists(spark, {"a": ["b"], "b": ["c"]})
    for name, parent in (("s1", None), ("s2", "s1"), ("s3", "s2")):
        store.create(name, g, parent)
    assert store.list() == ["s1", "s2", "s3"] and store.latest() == "s3" and store.verify("s2")
    assert store.ancestors("s3") == ["s1", "s2"] and store.descendants("s1") == ["s2", "s3"]
    assert store.is_ancestor("s1", "s3") and not store.is_ancestor("s3", "s1")
    assert store.load("s1").edges.count() == 2
    store.delete("s3")
    assert not store.exists("s3") and store.latest() == "s2"


def test_scan(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\ny = 2\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"\x00\x01\x02")
    (tmp_path / "big.py").write_text("x" * 600_000)
    (tmp_path / "node_modules" / "c.js").write_text("no")
    got = {r.path: r for r in scan_files(spark, f"file://{tmp_path}").collect()}
    assert set(got) == {"src/a.py", "src/b.bin"}
    assert (got["src/a.py"].language, got["src/a.py"].line_count, got["src/a.py"].depth) == ("python", 2, 1)
    assert got["src/b.bin"].preview is None


def test_scan_prunes(spark, tmp_path):
    for name in ("src/deep", "docs", ".hidden", "venv/lib", "App"):
        (tmp_path / name).mkdir(parents=True)
        for k in range(3):
            (tmp_path / name / f"f{k}.py").write_text("x = 1\n")
    (tmp_path / "top.py").write_text("y = 2\n")
    (tmp_path / "venv" / "lib" / "f0.py").chmod(0)
    root = f"file://{tmp_path}"
    folders, left_out = list_folders(spark, root)
    assert sorted(f.removeprefix("file:").removeprefix(str(tmp_path)) for f in folders) == ["", "/App", "/docs", "/src", "/src/deep"] and left_out == []
    assert {r.path for r in scan_files(spark, root).collect()} == {"top.py", *(f"{d}/f{k}.py" for d in ("src/deep", "docs", "App") for k in range(3))}
    folders, left_out = list_folders(spark, root, large=10)
    assert left_out == ["docs"]
    assert {r.path for r in scan_files(spark, root, large=10).collect()} == {"top.py", *(f"{d}/f{k}.py" for d in ("src/deep", "App") for k in range(3))}
    assert list_folders(spark, root, large=11)[1] == []


def test_payload(spark, tmp_path):
    g = from_payload(spark.createDataFrame([("1", "f", "function"), ("2", "g", None)], "id string, name string, kind string"), spark.createDataFrame([("1", "2", "call"), ("2", "1", "odd")], "source_id string, target_id string, kind string"))
    assert {(r.src, r.type) for r in g.edges.collect()} == {("1", "CALLS"), ("2", "USES")}
    g.nodes.write.json(f"{tmp_path}/n")
    g.edges.write.json(f"{tmp_path}/e")
    assert read_json_graph(spark, f"{tmp_path}/n", f"{tmp_path}/e").edges.count() == 2


def test_streams(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1, 10, 5)
    rows = [(t, "a", "b"), (t, "a", "b"), (t + datetime.timedelta(hours=1), "a", "c")]
    spark.createDataFrame(rows, "ts timestamp, src string, dst string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, src string, dst string").parquet(f"{tmp_path}/in")
    q = windowed_weights(stream).writeStream.outputMode("complete").format("memory").queryName("weights").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.src, r.dst, r.weight) for r in spark.table("weights").collect()} == {("a", "b", 2), ("a", "c", 1)}
    q = stream.writeStream.foreachBatch(upsert_sink(f"{tmp_path}/out", ["src", "dst"])).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    out = BucketTable(spark, f"file://{tmp_path}/out", ["src", "dst"])
    assert out.read().count() == 2
    upsert_sink(f"file://{tmp_path}/out", ["src", "dst"])(spark.createDataFrame([(t, "z", "z")], "ts timestamp, src string, dst string"), 0)  # the same batch again
    assert out.read().count() == 2 and out.versions() == [0]


def test_buckets(spark, tmp_path):
    root = f"file://{tmp_path}/table"
    table = BucketTable(spark, root, ["id"], 8)
    kind = "id long, n int, attributes map<string,string>"
    rows = [(k, k * 2, {"k": str(k)}) for k in range(200)]
    assert table.upsert(spark.createDataFrame(rows, kind)) == 0 and len(table.manifest()["folders"]) == 8
    before = table.manifest()["folders"]
    # a batch of one key rewrites one bucket
    assert table.upsert(spark.createDataFrame([(7, -1, None), (7, -2, None)], kind)) == 1
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert {r.id: r.n for r in table.read().collect()} == {k: -1 if k == 7 else k * 2 for k in range(200)}
    assert {r.id: r.attributes for r in table.read(0).collect()}[7] == {"k": "7"}  # an older version stays readable
    # other types of keys, new columns, null keys, nothing at all
    assert table.upsert(spark.createDataFrame([(8, "x"), (None, "y"), (500, "z")], "id int, more string")) == 2
    got = {r.id: (r.n, r.more) for r in table.read().collect()}
    assert got[8] == (None, "x") and got[500] == (None, "z") and got[9] == (18, None) and len(got) == 201
    assert table.upsert(spark.createDataFrame([], kind)) == 3 and table.read().count() == 201
    found = table.find(spark.createDataFrame([(3,), (500,), (999,)], "id int"))
    assert sorted(r.id for r in found.collect()) == [3, 500]
    assert len(found.inputFiles()) < len(table.read().inputFiles())
    table.delete(spark.createDataFrame([(3,), (500,)], "id long"))
    assert table.read().count() == 199 and table.find(spark.createDataFrame([(3,)], "id long")).count() == 0
    again = BucketTable(spark, root, ["id"], 999)
    assert again.buckets == 8 and again.read().count() == 199
    with pytest.raises(ValueError):
        BucketTable(spark, root, ["n"])
    held = table.manifest()
    with pytest.raises(Conflict):  # two writers on one version
        table._commit({**held, "token": "other"})
    assert table.manifest() == held
    assert table.vacuum(1) > 0 and table.read().count() == 199 and table.versions() == [held["version"]]
    assert BucketTable(spark, f"file://{tmp_path}/none", ["id"]).versions() == []
    with pytest.raises(ValueError):
        BucketTable(spark, f"file://{tmp_path}/none", ["id"]).read()


def test_trigram_index(spark, tmp_path):
    import random

    from graphloom.operators import search
    from graphloom.sources.postings import TrigramIndex

    rng = random.Random(6)
    words = ["login", "logins", "handler", "session", "token", "tokens", "read", "reader", "a", "zz"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for k in range(300)] + [(900, None), (901, ""), (902, "!!!")]
    nodes = spark.createDataFrame(rows, "id long, name string")
    index = TrigramIndex(spark, f"file://{tmp_path}/index", 4).build(nodes)
    for term, least in (("login token", 0.3), ("session", 0.9), ("sesion handlr", 0.2), ("unknown", 0.1), ("reader reader", 1.0), ("a", 0.5)):
        want = {r.id: r.similarity for r in search.fuzzy(nodes, term, least).collect()}
        assert {r.id: r.similarity for r in index.find(term, least).collect()} == want
        assert {r.id for r in search.fuzzy(nodes, term, least, index=index).collect()} == set(want)
    assert index.candidates("login token", 0.6).count() < 300 and index.candidates("!!!", 0.5) is None
    plan = index.candidates("session", 0.9)._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :]
    assert "(gram" in pushed or "gram)" in pushed
