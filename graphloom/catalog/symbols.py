"""Scopes, re-exports, resolution of names to symbols, orders and shortest paths, certificates, bucketed tables."""

from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import call_rules, certificates, edges, extraction, flows, re_exports, scopes, structure, traversal
from ..scratch import Scratch
from ..sources.buckets import BucketTable
from ..sources.derived import order_graph, part_graph, part_nodes, table
from . import ALL_EDGES, EDGES, GRAPH, NODES, query
from .graphs import OUTGOING, START, _reach, start

C = F.col
s = lambda c: C(c).cast("string")


def _id(kind, column):
    return F.concat(F.lit(kind), s(column))


# Regions, nations, customers and orders as scopes within each other; each declares some names.
SCOPES = """sc AS (SELECT 'R' || r_regionkey AS id, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey FROM orders)"""
DECLARED = """dc AS (SELECT 'R' || r_regionkey AS scope, 'v' || (r_regionkey % 5) AS name, 0 AS ordinal FROM region UNION ALL SELECT 'N' || n_nationkey, 'v' || (n_nationkey % 7), 0 FROM nation
 UNION ALL SELECT 'C' || c_custkey, 'v' || (c_custkey % 8), 0 FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'O' || o_orderkey, 'v' || (o_orderkey % 9), 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'O' || o_orderkey, 'v' || (o_orderkey % 9), 0 FROM orders WHERE o_orderkey % 4 = 0),
 dd AS (SELECT scope, name, min(scope || '.' || name || '.' || ordinal) AS symbol FROM dc GROUP BY 1, 2)"""
ABOVE = "ab AS (SELECT o_orderkey AS o, 'O' || o_orderkey AS s0, 'C' || c_custkey AS s1, 'N' || n_nationkey AS s2, 'R' || n_regionkey AS s3 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)"


def scope_table(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    out = r.select(_id("R", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    for df, key, up, kinds in ((n, "n_nationkey", "n_regionkey", "NR"), (c, "c_custkey", "c_nationkey", "CN"), (o, "o_orderkey", "o_custkey", "OC")):
        out = out.union(df.select(_id(kinds[0], key), _id(kinds[1], up)))
    return out


def declared(spark, d):
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    rows = [(r, "R", "r_regionkey", 5, 0), (n, "N", "n_nationkey", 7, 0), (c.where("c_custkey % 3 = 0"), "C", "c_custkey", 8, 0), (o.where("o_orderkey % 2 = 0"), "O", "o_orderkey", 9, 1), (o.where("o_orderkey % 4 = 0"), "O", "o_orderkey", 9, 0)]
    out = None
    for df, kind, key, of, ordinal in rows:
        part = df.select(_id(kind, key).alias("scope"), F.concat(F.lit("v"), (C(key) % of).cast("string")).alias("name"), F.lit(ordinal).alias("ordinal"))
        out = part if out is None else out.union(part)
    return out.withColumn("symbol", F.concat_ws(".", "scope", "name", s("ordinal")))


@query(
    "scope_intervals",
    f"""WITH {SCOPES}, p AS (SELECT id, 0 AS depth, [id] AS path FROM sc WHERE parent IS NULL UNION ALL SELECT n.id, 1, [n.parent, n.id] FROM sc n WHERE n.id LIKE 'N%' UNION ALL SELECT c.id, 2, [n.parent, n.id, c.id] FROM sc c JOIN sc n ON n.id = c.parent WHERE c.id LIKE 'C%'
     UNION ALL SELECT o.id, 3, [n.parent, n.id, c.id, o.id] FROM sc o JOIN sc c ON c.id = o.parent JOIN sc n ON n.id = c.parent WHERE o.id LIKE 'O%'), z AS (SELECT x AS id, count(*) AS size FROM (SELECT unnest(path) AS x FROM p) GROUP BY 1)
    SELECT p.id, path[1] AS root, depth::BIGINT AS depth, row_number() OVER (ORDER BY path) - 1 AS start, row_number() OVER (ORDER BY path) + size - 2 AS stop FROM p JOIN z USING (id)""",
)
def scope_intervals(spark, d):
    return scopes.scope_intervals(scope_table(spark, d)).select("id", "root", "depth", "start", "stop")


@query(
    "resolve_in_scope",
    f"""WITH {DECLARED}, {ABOVE}, u AS (SELECT l_orderkey, l_linenumber, 'v' || (l_partkey % 10) AS name FROM lineitem)
    SELECT l_orderkey, l_linenumber, u.name, coalesce(d0.symbol, d1.symbol, d2.symbol, d3.symbol) AS symbol, CASE WHEN d0.symbol IS NOT NULL THEN s0 WHEN d1.symbol IS NOT NULL THEN s1 WHEN d2.symbol IS NOT NULL THEN s2 WHEN d3.symbol IS NOT NULL THEN s3 END AS declared_in
    FROM u JOIN ab ON o = l_orderkey LEFT JOIN dd d0 ON d0.scope = s0 AND d0.name = u.name LEFT JOIN dd d1 ON d1.scope = s1 AND d1.name = u.name LEFT JOIN dd d2 ON d2.scope = s2 AND d2.name = u.name LEFT JOIN dd d3 ON d3.scope = s3 AND d3.name = u.name""",
)
def resolve_in_scope(spark, d):
    uses = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _id("O", "l_orderkey").alias("scope"), F.concat(F.lit("v"), (C("l_partkey") % 10).cast("string")).alias("name"))
    return scopes.resolve_in_scope(scopes.scope_intervals(scope_table(spark, d)), declared(spark, d), uses).drop("scope")


@query(
    "shadowed_names",
    f"""WITH {DECLARED}, {ABOVE}, up AS (SELECT s0 AS inner_scope, s1 AS a, s2 AS b, s3 AS c FROM ab UNION SELECT 'C' || c_custkey, 'N' || n_nationkey, 'R' || n_regionkey, NULL FROM customer JOIN nation ON n_nationkey = c_nationkey UNION SELECT 'N' || n_nationkey, 'R' || n_regionkey, NULL, NULL FROM nation)
    SELECT i.name, inner_scope, i.symbol AS shadowing_symbol, CASE WHEN d1.symbol IS NOT NULL THEN a WHEN d2.symbol IS NOT NULL THEN b ELSE c END AS outer_scope, coalesce(d1.symbol, d2.symbol, d3.symbol) AS shadowed_symbol
    FROM dd i JOIN up ON inner_scope = i.scope LEFT JOIN dd d1 ON d1.scope = a AND d1.name = i.name LEFT JOIN dd d2 ON d2.scope = b AND d2.name = i.name LEFT JOIN dd d3 ON d3.scope = c AND d3.name = i.name WHERE coalesce(d1.symbol, d2.symbol, d3.symbol) IS NOT NULL""",
)
def shadowed_names(spark, d):
    return scopes.shadowed_names(scopes.scope_intervals(scope_table(spark, d)), declared(spark, d))


# Orders hand on a name of their customer, customers one of their nation, nations one of their region, where it is defined;
# the nations of region 4 hand it round, region 3 lacks it, some customers define their own. Suppliers hand on all of their nation.
@query(
    "re_exports",
    """WITH n AS (SELECT n_nationkey, 'n' || n_nationkey AS package, 'Head' AS name, CASE WHEN n_regionkey < 3 THEN 'r' || n_regionkey || '.Chief' END AS fqn, CASE n_regionkey WHEN 4 THEN 'ring' WHEN 3 THEN 'unresolved' ELSE 'resolved' END AS state FROM nation),
    c AS (SELECT c_custkey, 'c' || c_custkey AS package, 'Owner' AS name, fqn, state FROM customer JOIN n ON n_nationkey = c_nationkey)
    SELECT package, name, fqn, state FROM n UNION ALL SELECT package, name, fqn, state FROM c
    UNION ALL SELECT 'o' || o_orderkey, 'Owner', CASE WHEN c_custkey % 6 = 0 THEN 'c' || c_custkey || '.Owner' ELSE fqn END, CASE WHEN c_custkey % 6 = 0 THEN 'resolved' ELSE state END FROM orders JOIN c ON c_custkey = o_custkey
    UNION ALL SELECT 's' || s_suppkey, 'Head', fqn, state FROM supplier JOIN n ON n_nationkey = s_nationkey""",
)
def exported(spark, d):
    from pyspark.sql import Window

    n, c, o, p = (table(spark, d, t) for t in ("nation", "customer", "orders", "supplier"))
    none = F.lit(None).cast("string")
    after = F.coalesce(F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")))
    ring = C("n_regionkey") == 4
    rows = [
        n.withColumn("after", after).select(_id("n", "n_nationkey").alias("package"), F.lit("Head").alias("name"), F.when(ring, _id("n", "after")).otherwise(_id("r", "n_regionkey")).alias("source"), F.when(ring, "Head").otherwise("Chief").alias("original")),
        c.select(_id("c", "c_custkey"), F.lit("Owner"), _id("n", "c_nationkey"), F.lit("Head")),
        o.select(_id("o", "o_orderkey"), F.lit("Owner"), _id("c", "o_custkey"), F.lit("Owner")),
        p.select(_id("s", "s_suppkey"), none, _id("n", "s_nationkey"), none),
    ]
    exports = rows[0].union(rows[1]).union(rows[2]).union(rows[3]).withColumn("ordinal", F.lit(0))
    chiefs = table(spark, d, "region").where("r_regionkey < 3").select(F.concat(_id("r", "r_regionkey"), F.lit(".Chief")).alias("fqn"), F.lit("Chief").alias("name"))
    owners = c.where("c_custkey % 6 = 0").select(F.concat(_id("c", "c_custkey"), F.lit(".Owner")).alias("fqn"), F.lit("Owner").alias("name"))
    symbols = chiefs.union(owners).select(C("fqn").alias("id"), "fqn", "name", F.lit("class").alias("kind"), F.lit(None).cast("string").alias("file"))
    asked = exports.where("name is not null").select("package", "name").union(p.select(_id("s", "s_suppkey"), F.lit("Head")))
    return re_exports.re_exports(exports, symbols, asked).select("package", "name", "fqn", "state")


# Every third part is a symbol of a repository; all parts say names in several ways.
PLACE = "'m' || p_size AS m, replace(p_name, ' ', '_') AS name"
SYMBOLS = f"""sy AS (SELECT lpad(p_partkey::VARCHAR, 12, '0') AS id, name, 'repo.' || m || '.' || name AS qn, m || '/f' || (p_partkey % 4) || '.py' AS file, ['function','class','interface','enum','module'][p_partkey % 5 + 1] AS kind FROM (SELECT p_partkey, {PLACE} FROM part WHERE p_partkey % 3 = 0))"""
PARTS = f"pa AS (SELECT p_partkey, {PLACE} FROM part)"


def _parts(spark, d):
    return table(spark, d, "part").select("p_partkey", _id("m", "p_size").alias("m"), F.translate("p_name", " ", "_").alias("name"))


def _symbols(spark, d):
    p = _parts(spark, d).where("p_partkey % 3 = 0")
    kind = F.element_at(F.array(*map(F.lit, ("function", "class", "interface", "enum", "module"))), (C("p_partkey") % 5 + 1).cast("int"))
    file = F.concat("m", F.lit("/f"), (C("p_partkey") % 4).cast("string"), F.lit(".py"))
    return p.select(F.lpad(s("p_partkey"), 12, "0").alias("id"), "name", F.concat_ws(".", F.lit("repo"), "m", "name").alias("qualified_name"), C("m").alias("namespace"), file.alias("file"), kind.alias("kind"))


def _way(*choices):
    k, out = C("p_partkey") % len(choices), choices[-1]
    for n in range(len(choices) - 1, 0, -1):
        out = F.when(k == n - 1, choices[n - 1]).otherwise(out)
    return out


@query(
    "resolve_imports",
    f"""WITH {SYMBOLS}, {PARTS}, q AS (SELECT qn, min(id) AS id FROM sy GROUP BY 1),
    i AS (SELECT p_partkey, m, name, [m, name, '..' || name, m || '.' || name, 'missing' || p_partkey][p_partkey % 5 + 1] AS module, CASE p_partkey % 5 WHEN 0 THEN name WHEN 3 THEN 'inner' END AS said, CASE p_partkey % 5 WHEN 2 THEN m || '/sub/a.py' ELSE m || '/a.py' END AS file FROM pa)
    SELECT p_partkey::VARCHAR AS line, file, module, CASE WHEN p_partkey % 5 < 4 AND q.id IS NOT NULL THEN q.id ELSE 'external:' || ltrim(module, '.') || coalesce('.' || said, '') END AS target,
    CASE WHEN p_partkey % 5 = 4 OR q.id IS NULL THEN 0.5::DOUBLE WHEN p_partkey % 5 = 3 THEN 0.9 ELSE 1.0 END AS confidence, CASE WHEN p_partkey % 5 = 4 OR q.id IS NULL THEN 'external' ELSE ['exact', 'exact', 'relative', 'parent'][p_partkey % 5 + 1] END AS strategy
    FROM i LEFT JOIN q ON qn = 'repo.' || m || '.' || name""",
)
def resolve_imports(spark, d):
    p = _parts(spark, d)
    module = _way(C("m"), C("name"), F.concat(F.lit(".."), "name"), F.concat_ws(".", "m", "name"), F.concat(F.lit("missing"), s("p_partkey")))
    said = _way(C("name"), F.lit(None), F.lit(None), F.lit("inner"), F.lit(None))
    file = F.concat("m", F.when(C("p_partkey") % 5 == 2, "/sub/a.py").otherwise("/a.py"))
    rows = p.select(F.concat_ws("#", file, s("p_partkey")).alias("key"), file.alias("file"), module.alias("module"), said.alias("name"), "p_partkey")
    # The line of the statement goes along in the file's name, behind what the rules look at.
    found = edges.resolve_imports(rows.select(C("key").alias("file"), "module", "name"), _symbols(spark, d), "repo")
    return found.select(F.substring_index("file", "#", -1).alias("line"), F.substring_index("file", "#", 1).alias("file"), "module", "target", "confidence", "strategy")


def _kinds_sql(kinds):
    return f"""k AS (SELECT * FROM sy WHERE kind IN {kinds}), q AS (SELECT qn, min(id) AS id FROM k GROUP BY 1), f AS (SELECT file, name, min(id) AS id FROM k GROUP BY 1, 2), a AS (SELECT name, min(id) AS id FROM k GROUP BY 1 HAVING count(*) = 1)"""


@query(
    "resolve_bases",
    f"""WITH {SYMBOLS}, {PARTS}, {_kinds_sql("('class', 'interface', 'struct')")},
    b AS (SELECT p_partkey AS child, [m || '.' || name, name, name, 'Missing' || p_partkey][p_partkey % 4 + 1] AS said, CASE WHEN p_partkey % 4 = 1 THEN m || '/f' || (p_partkey % 4) || '.py' ELSE 'elsewhere.py' END AS file FROM pa),
    r AS (SELECT child, said, file, (SELECT id FROM q WHERE qn = 'repo.' || said) AS x, CASE WHEN contains(file, '/') THEN (SELECT id FROM q WHERE qn = 'repo.' || string_split(file, '/')[1] || '.' || said) END AS y, (SELECT id FROM f WHERE f.file = b.file AND f.name = said) AS z, (SELECT id FROM a WHERE a.name = said) AS w FROM b)
    SELECT child, said AS name, coalesce(x, y, z, w, 'external:' || said) AS target, CASE WHEN coalesce(x, y, z) IS NOT NULL THEN 1.0::DOUBLE WHEN w IS NOT NULL THEN 0.9 ELSE 0.5 END AS confidence, coalesce((SELECT kind = 'interface' FROM sy WHERE id = coalesce(x, y, z, w)), false) AS is_interface FROM r""",
)
def resolve_bases(spark, d):
    p = _parts(spark, d)
    name = _way(F.concat_ws(".", "m", "name"), C("name"), C("name"), F.concat(F.lit("Missing"), s("p_partkey")))
    file = F.when(C("p_partkey") % 4 == 1, F.concat("m", F.lit("/f1.py"))).otherwise("elsewhere.py")
    return edges.resolve_bases(p.select(C("p_partkey").alias("child"), name.alias("name"), file.alias("file")), _symbols(spark, d), "repo").drop("strategy")


@query(
    "resolve_types",
    f"""WITH {SYMBOLS}, {PARTS}, {_kinds_sql("('class', 'interface', 'struct', 'enum', 'type_alias')")},
    b AS (SELECT p_partkey AS owner, [m || '.' || name, name, 'Int', 'Missing' || p_partkey][p_partkey % 4 + 1] AS said FROM pa)
    SELECT owner, said AS name, CASE WHEN said = 'Int' THEN 'external:Int' ELSE coalesce(q.id, a.id, 'external:' || said) END AS target, CASE WHEN said = 'Int' THEN 0.5::DOUBLE WHEN q.id IS NOT NULL THEN 1.0 WHEN a.id IS NOT NULL THEN 0.9 ELSE 0.5 END AS confidence FROM b LEFT JOIN q ON qn = 'repo.' || said LEFT JOIN a ON a.name = said""",
)
def resolve_types(spark, d):
    p = _parts(spark, d)
    said = _way(F.concat(F.lit("*"), "m", F.lit("."), "name"), F.concat(F.lit("List["), "name", F.lit("]")), F.lit("Int"), F.concat(F.lit("Missing"), s("p_partkey")))
    rows = p.select(C("p_partkey").alias("owner"), said.alias("type_name"), F.lit("elsewhere.py").alias("file"))
    return edges.resolve_types(rows, _symbols(spark, d), "repo").drop("strategy")


@query(
    "topo_reachable",
    f"""WITH RECURSIVE {EDGES}, e AS MATERIALIZED (SELECT src, dst FROM edges WHERE src < dst OR src % 10 = 0 AND src > 0.7 * (SELECT max(src) FROM edges)), starts AS (SELECT DISTINCT src AS node FROM e ORDER BY 1 LIMIT 60),
    reach(node) AS (SELECT node FROM starts UNION SELECT dst FROM reach JOIN e ON src = node),
    sub AS MATERIALIZED (SELECT src, dst FROM e WHERE src IN (FROM reach)), back AS (SELECT DISTINCT src, dst FROM sub WHERE dst < src), low(src, y) AS (SELECT src, dst FROM back UNION SELECT low.src, sub.dst FROM low JOIN sub ON sub.src = low.y),
    cyc AS (SELECT DISTINCT src AS node FROM low WHERE src = y), blocked AS (SELECT node FROM cyc UNION SELECT y FROM low WHERE src IN (FROM cyc)),
    walk(node, level) AS (SELECT node, 0 FROM reach WHERE node NOT IN (SELECT dst FROM sub) UNION SELECT dst, level + 1 FROM walk JOIN sub ON src = node WHERE dst NOT IN (FROM blocked))
    SELECT node, max(level)::INT AS level, node IN (FROM blocked) AS blocked FROM reach LEFT JOIN walk USING (node) GROUP BY 1""",
)
def topo_reachable(spark, d):
    g = part_graph(spark, d)
    last = g.edges.agg(F.max("src")).first()[0]
    e = g.edges.where((C("src") < C("dst")) | (C("src") % 10 == 0) & (C("src") > 0.7 * last))
    starts = [r.src for r in e.select("src").distinct().orderBy("src").limit(60).collect()]
    return structure.topological_from(Graph(g.nodes, e), starts)


FAR = f"{ALL_EDGES}, {_reach(OUTGOING, 5)}, far AS MATERIALIZED (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)"


@query("paths_all_shortest", f"WITH RECURSIVE {FAR}, pick AS (SELECT node, depth FROM far ORDER BY depth DESC, node LIMIT 1), back(node, depth, path) AS (SELECT node, depth, [node] FROM pick UNION ALL SELECT e.src, b.depth - 1, list_prepend(e.src, b.path) FROM back b JOIN edges e ON e.dst = b.node JOIN far f ON f.node = e.src AND f.depth = b.depth - 1) SELECT array_to_string(path, '>') AS path FROM back WHERE depth = 0")
def paths_all_shortest(spark, d):
    g = order_graph(spark, d)
    first = start(g)
    far = traversal.bfs(g, first, max_depth=5).orderBy(F.desc("depth"), "node").first().node
    found = traversal.all_shortest_paths(g, first, far)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("paths_to_target", f"WITH RECURSIVE {FAR}, pick AS (SELECT node FROM far WHERE depth = 2 ORDER BY node LIMIT 1), paths(node, depth, path) AS (SELECT {START}, 0, [{START}] UNION ALL SELECT e.dst, p.depth + 1, list_append(p.path, e.dst) FROM paths p JOIN edges e ON e.src = p.node WHERE p.depth < 3 AND NOT list_contains(p.path, e.dst)) SELECT array_to_string(path, '>') AS path, depth FROM paths JOIN pick USING (node) WHERE depth > 0")
def paths_to_target(spark, d):
    g = order_graph(spark, d)
    first = start(g)
    target = traversal.bfs(g, first, max_depth=2).where("depth = 2").agg(F.min("node")).first()[0]
    found = traversal.simple_paths(g, first, [target], 3)
    return found.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "depth")


# A search whose result was damaged: some depths are one too large, some nodes are gone.
@query(
    "walk_certificate",
    f"""WITH RECURSIVE {FAR}, p AS (SELECT f.node, f.depth, (SELECT min(e.src) FROM edges e JOIN far g ON g.node = e.src WHERE e.dst = f.node AND g.depth = f.depth - 1) AS parent FROM far f),
    r AS (SELECT node, depth + (node % 50 = 0 AND depth > 0)::INT AS depth, parent FROM p WHERE node % 77 <> 0 OR depth = 0), k AS (SELECT DISTINCT src, dst FROM edges)
    SELECT 'DEPTH' AS code, r.node, r.parent AS other FROM r JOIN r a ON a.node = r.parent WHERE r.depth <> a.depth + 1 UNION ALL SELECT 'PARENT', r.node, r.parent FROM r WHERE r.depth > 0 AND r.parent NOT IN (SELECT node FROM r)
    UNION ALL SELECT 'SHORTCUT', a.node, b.node FROM k JOIN r a ON a.node = src JOIN r b ON b.node = dst WHERE b.depth > a.depth + 1 UNION ALL SELECT 'MISSED', a.node, dst FROM k JOIN r a ON a.node = src WHERE a.depth < 5 AND dst NOT IN (SELECT node FROM r)
    UNION ALL SELECT 'DEEP', node, NULL FROM r WHERE depth > 5""",
)
def walk_certificate(spark, d):
    g = order_graph(spark, d)
    first = start(g)
    found = traversal.bfs(g, first, max_depth=5)
    late = (C("node") % 50 == 0) & (C("depth") > 0)
    damaged = found.where("node % 77 <> 0 or depth = 0").select("node", (C("depth") + late.cast("int")).alias("depth"), "parent")
    return certificates.walk_certificate(g.directed(), damaged, first, 5)


@query(
    "bucketed_upsert",
    """SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 10 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_custkey % 13 > 0
    UNION ALL SELECT c_custkey + 1000000, c_nationkey, c_acctbal FROM customer WHERE c_custkey % 50 = 0""",
)
def bucketed_upsert(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    held = BucketTable(spark, f"{Scratch(spark, 'buckets').root}/customers", ["c_custkey"], 16)
    held.upsert(c)
    held.upsert(c.where("c_custkey % 10 = 0").withColumn("c_acctbal", F.lit(0).cast(c.schema["c_acctbal"].dataType)))
    held.upsert(c.where("c_custkey % 50 = 0").withColumn("c_custkey", C("c_custkey") + 1000000))
    held.delete(c.where("c_custkey % 13 = 0"))
    return held.read()


# Parts as parsed records of forty files: functions, classes, methods and interfaces that name each other.
RECORDS = """r AS (SELECT p_partkey AS k, 'src/m' || (p_partkey % 40) || '.py' AS file, CASE p_partkey % 5 WHEN 1 THEN 'K' || (p_partkey % 60) WHEN 2 THEN 'K' || ((p_partkey - 1) % 60) || '.run' ELSE 'f' || (p_partkey % 150) END AS name,
 ['function','class','method','api_route','variable'][p_partkey % 5 + 1] AS kind, ['redis.get(1)', 'requests.get(u)', 'add(CORSMiddleware)', 'SELECT a FROM logs WHERE 1', 'update t set x; delete from old', 'select(user) db.add(user)', NULL][p_partkey % 7 + 1] AS code FROM part),
 n AS (SELECT *, file || ':' || name || '.' || k AS id, CASE WHEN kind = 'method' THEN 'run' ELSE name END AS short, 'f' || (k * 7 % 150) AS called, 'K' || (k * 3 % 80) AS base, CASE k % 4 WHEN 0 THEN 'verify_token' WHEN 1 THEN 'f' || (k % 200) ELSE 'make' || (k % 9) END AS dep, 'src.m' || (k % 50) || '.Thing' AS imp FROM r),
 firsts AS (SELECT short, min(id) AS id FROM n GROUP BY 1), home AS (SELECT file, min(id) AS id FROM n GROUP BY 1)"""


@query(
    "typed_edges",
    f"""WITH {RECORDS} SELECT DISTINCT * FROM (SELECT a.id AS src, b.id AS dst, CASE a.kind WHEN 'api_route' THEN 'api_calls' ELSE 'calls' END AS type FROM n a JOIN n b ON b.short = a.called WHERE a.id <> b.id
    UNION ALL SELECT n.id, home.id, 'imports' FROM n JOIN home ON home.file = 'src/m' || (k % 50) || '.py' UNION ALL SELECT file || ':' || split_part(name, '.', 1), id, 'class_contains' FROM n WHERE kind = 'method'
    UNION ALL SELECT a.id, coalesce(b.id, '_ext_' || a.base), 'inherits' FROM n a LEFT JOIN n b ON b.short = a.base WHERE a.kind = 'class'
    UNION ALL SELECT n.id, coalesce(f.id, CASE WHEN dep = 'verify_token' THEN '_auth_' ELSE '_di_' END || dep), CASE WHEN dep = 'verify_token' THEN 'auth_dependency' ELSE 'dependency_injection' END FROM n LEFT JOIN firsts f ON f.short = dep
    UNION ALL SELECT id, '__svc__Redis', 'uses_service' FROM n WHERE k % 7 = 0 UNION ALL SELECT id, '__api__External HTTP', 'external_api' FROM n WHERE k % 7 = 1 UNION ALL SELECT id, '__mw__CORSMiddleware', 'middleware_dependency' FROM n WHERE k % 7 = 2
    UNION ALL SELECT id, '__table__logs', 'reads_table' FROM n WHERE k % 7 = 3 UNION ALL SELECT id, '__table__t', 'updates_table' FROM n WHERE k % 7 = 4 UNION ALL SELECT id, '__table__old', 'deletes_table' FROM n WHERE k % 7 = 4
    UNION ALL SELECT id, '__table__users', unnest(['reads_table', 'writes_table']) FROM n WHERE k % 7 = 5 UNION ALL SELECT file, id, 'contains' FROM n WHERE kind <> 'variable')""",
)
def typed_edges(spark, d):
    k = C("p_partkey")
    say = lambda lead, x: F.concat(F.lit(lead), x.cast("string"))
    pick = lambda values, by: F.element_at(F.array(*(F.lit(v).cast("string") for v in values)), (by + 1).cast("int"))
    name = F.when(k % 5 == 1, say("K", k % 60)).when(k % 5 == 2, F.concat(say("K", (k - 1) % 60), F.lit(".run"))).otherwise(say("f", k % 150))
    dep = F.when(k % 4 == 0, "verify_token").when(k % 4 == 1, say("f", k % 200)).otherwise(say("make", k % 9))
    code = pick(["redis.get(1)", "requests.get(u)", "add(CORSMiddleware)", "SELECT a FROM logs WHERE 1", "update t set x; delete from old", "select(user) db.add(user)", None], k % 7)
    file = F.concat(say("src/m", k % 40), F.lit(".py"))
    p = table(spark, d, "part").select(
        F.concat(file, F.lit(":"), name, F.lit("."), s("p_partkey")).alias("id"), name.alias("name"), pick(["function", "class", "method", "api_route", "variable"], k % 5).alias("node_type"), file.alias("file"),
        F.array(say("f", k * 7 % 150), F.lit("get")).alias("calls"), F.array(F.concat(say("src.m", k % 50), F.lit(".Thing"))).alias("imports"), F.array(say("K", k * 3 % 80)).alias("bases"), F.array(dep).alias("depends_on"), code.alias("code"),
    )
    return extraction.typed_edges(p, p.select("file"))


# The part graph with some nodes, names, files and weights spoilt, and adjacency lists that lack some edges.
@query(
    "call_graph_rules",
    f"""WITH {ALL_EDGES}, {NODES}, n AS (SELECT id, CASE WHEN id % 31 = 0 THEN '' ELSE name END AS name, qualified_name, node_type, CASE WHEN id % 17 = 0 THEN NULL ELSE file END AS file, id % 34 = 0 AS is_external FROM nodes WHERE id % 200 <> 0),
    e AS (SELECT src, dst, (src + dst) % 5 AS weight FROM edges), f AS (SELECT src AS k, dst AS v FROM e WHERE src % 100 <> 0), b AS (SELECT dst AS k, src AS v FROM e WHERE dst % 90 <> 0)
    SELECT code, count(*) AS n FROM (SELECT 'EMPTY_NODE_NAME' AS code FROM n WHERE name = '' UNION ALL SELECT 'MISSING_FILE_PATH' FROM n WHERE file IS NULL AND NOT is_external UNION ALL SELECT 'CALLER_DOES_NOT_EXIST' FROM e WHERE src NOT IN (SELECT id FROM n)
    UNION ALL SELECT 'CALLEE_DOES_NOT_EXIST' FROM e WHERE dst NOT IN (SELECT id FROM n) UNION ALL SELECT 'INVALID_EDGE_WEIGHT' FROM e WHERE weight < 1 UNION ALL SELECT 'NODE_COUNT_MISMATCH' FROM (SELECT count(*) AS c FROM n) WHERE c <> 1
    UNION ALL SELECT 'DANGLING_ADJACENCY_CALLER' FROM (SELECT DISTINCT k FROM f WHERE k NOT IN (SELECT id FROM n))
    UNION ALL SELECT 'DANGLING_ADJACENCY_CALLEE' FROM f WHERE v NOT IN (SELECT id FROM n) UNION ALL SELECT 'ADJACENCY_MISMATCH' FROM e WHERE src % 100 = 0 UNION ALL SELECT 'ASYMMETRIC_ADJACENCY' FROM f WHERE v % 90 = 0) GROUP BY 1""",
)
def call_graph_rules(spark, d):
    g = order_graph(spark, d)
    n = part_nodes(spark, d).where("id % 200 <> 0").withColumns({"name": F.when(C("id") % 31 == 0, "").otherwise(C("name")), "file": F.when(C("id") % 17 != 0, C("file")), "is_external": C("id") % 34 == 0})
    e = g.edges.select("src", "dst", ((C("src") + C("dst")) % 5).alias("weight"))
    forward = e.where("src % 100 <> 0").select(C("src").alias("key"), C("dst").alias("value"))
    backward = e.where("dst % 90 <> 0").select(C("dst").alias("key"), C("src").alias("value"))
    found = call_rules.call_graph_violations(n, e, forward=forward, backward=backward, counts={"node_count": 1})
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query(
    "typed_evidence",
    f"""WITH RECURSIVE {GRAPH}, {_reach(OUTGOING, 8)}, near AS (SELECT DISTINCT node FROM walk), one AS (SELECT name AS first FROM nodes WHERE id = {START}), w AS (SELECT DISTINCT package AS workflow, file AS service, size / 100 AS sure FROM nodes WHERE id IN (FROM near) AND size % 10 = 0),
    j AS (SELECT DISTINCT 'journey ' || (size % 6) AS journey FROM nodes WHERE package IN (SELECT workflow FROM w)), a AS (SELECT name FROM nodes WHERE node_type = 'api_route' AND id IN (FROM near) ORDER BY id LIMIT 12)
    SELECT chain_type, summary, max(round(sure * 100, 1)) AS confidence FROM (SELECT 'service' AS chain_type, first || ' → ' || workflow || ' → ' || service AS summary, sure FROM w, one
    UNION ALL SELECT 'journey', first || ' → ' || (SELECT string_agg(journey, ' → ' ORDER BY journey) FROM j) || ' → ' || journey, 1.0 FROM j, one UNION ALL SELECT 'api_route', first || ' → ' || name, 0.75 FROM a, one) GROUP BY 1, 2""",
)
def typed_evidence(spark, d):
    g = part_graph(spark, d)
    first = start(g)
    near = traversal.bfs(g, first, max_depth=8).select("node")
    inside = g.nodes.join(near.select(C("node").alias("id")), "id", "left_semi")
    workflows = inside.where("size % 10 = 0").select(C("package").alias("workflow"), C("file").alias("service"), (C("size") / 100).alias("confidence"))
    journeys = g.nodes.select(F.concat(F.lit("journey "), (C("size") % 6).cast("string")).alias("journey"), C("package").alias("workflow")).distinct()
    found = flows.evidence_chains(g, first, near, workflows, journeys)
    # The path to the nearest interface depends on which of several shortest ones is taken; tests cover it.
    return found.where(C("confidence_percent") != 85.0).select("chain_type", "summary", C("confidence_percent").alias("confidence"))
