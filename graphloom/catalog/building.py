"""Building edges, search, text functions, incremental work, flows."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..graph import Graph
from ..operators import edges, flows, incremental, search, traversal
from ..sources.derived import page_links, order_graph, part_graph, part_nodes, table
from ..streaming.edges import windowed_weights
from . import ALL_EDGES, EDGES, GRAPH, NODES, query

C = F.col
STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


@query(
    "resolve_names",
    """WITH s AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_type AS namespace, p_brand AS file, p_partkey % 6 = 0 AS able FROM part WHERE p_partkey % 3 = 0),
    c AS (SELECT p_partkey AS caller, CASE p_partkey % 5 WHEN 0 THEN p_brand || '.' || p_name WHEN 1 THEN 'self.' || p_name WHEN 2 THEN p_name WHEN 3 THEN 'self.a.' || p_name ELSE 'missing' || p_partkey END AS name, p_type AS namespace, p_brand AS file FROM part),
    k AS (SELECT *, regexp_extract(name, '([^.]+)$', 1) AS simple FROM c), r AS (SELECT caller, name, (SELECT min(id) FROM s WHERE s.qualified_name = k.name) AS e,
    CASE WHEN name = 'self.' || simple THEN (SELECT min(id) FROM s WHERE able AND s.namespace = k.namespace AND s.name = k.simple) END AS l, (SELECT min(id) FROM s WHERE able AND s.file = k.file AND s.name = k.simple) AS f,
    (SELECT CASE WHEN count(*) = 1 THEN min(id) END FROM s WHERE able AND s.name = k.simple) AS u FROM k)
    SELECT caller, name, coalesce(e::VARCHAR, l::VARCHAR, f::VARCHAR, u::VARCHAR, 'external:' || name) AS target, CASE WHEN e IS NOT NULL OR l IS NOT NULL THEN 1.0::DOUBLE WHEN f IS NOT NULL THEN 0.95 WHEN u IS NOT NULL THEN 0.85 ELSE 0.5 END AS confidence FROM r""",
)
def resolve_names(spark, d):
    p = table(spark, d, "part")
    kind = F.when(C("p_partkey") % 6 == 0, "method").otherwise("class")
    symbols = p.where("p_partkey % 3 = 0").select(C("p_partkey").cast("string").alias("id"), C("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified_name"), C("p_type").alias("namespace"), C("p_brand").alias("file"), kind.alias("kind"))
    # The smallest id is the smallest number, so ids are padded while they are compared.
    padded = symbols.withColumn("id", F.lpad("id", 12, "0"))
    way = C("p_partkey") % 5
    name = F.when(way == 0, F.concat_ws(".", "p_brand", "p_name")).when(way == 1, F.concat(F.lit("self."), "p_name")).when(way == 2, C("p_name")).when(way == 3, F.concat(F.lit("self.a."), "p_name")).otherwise(F.concat(F.lit("missing"), C("p_partkey").cast("string")))
    calls = p.select(C("p_partkey").alias("caller"), name.alias("name"), C("p_type").alias("namespace"), C("p_brand").alias("file"))
    found = edges.resolve_calls(calls, padded)
    target = F.when(C("target").rlike("^[0-9]+$"), C("target").cast("long").cast("string")).otherwise(C("target"))
    return found.select("caller", "name", target.alias("target"), "confidence")


@query("merge_edges", f"WITH {ALL_EDGES}, a AS (SELECT src || '-' || dst AS edge_id, src, dst, 'first' AS origin FROM edges WHERE src % 2 = 0), b AS (SELECT src || '-' || dst, src, dst, 'second' FROM edges) SELECT * FROM a UNION ALL SELECT * FROM b WHERE src % 2 = 1")
def merge_edges(spark, d):
    e = order_graph(spark, d).edges.select(F.concat_ws("-", C("src").cast("string"), C("dst").cast("string")).alias("edge_id"), "src", "dst")
    return edges.merge_edges(e.where("src % 2 = 0").withColumn("origin", F.lit("first")), e.withColumn("origin", F.lit("second")))


@query("node_dedup_last", "SELECT p_name, max(p_partkey) AS p_partkey, arg_max(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1")
def node_dedup_last(spark, d):
    return edges.keep_last(table(spark, d, "part").select("p_name", "p_partkey", "p_brand"), "p_name", "p_partkey")


@query("edge_ids", f"WITH {ALL_EDGES} SELECT src, dst, 'edge_' || substr(sha256(length(src::VARCHAR) || ':' || src || '|' || length(dst::VARCHAR) || ':' || dst || '|' || length(type) || ':' || type), 1, 24) AS edge_id FROM edges")
def edge_ids(spark, d):
    return edges.edge_ids(order_graph(spark, d).edges).select("src", "dst", "edge_id")


@query("external_links", "WITH links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS target FROM pages) SELECT 'external:' || target AS dst, page_id::VARCHAR AS src, count(*) AS weight FROM links GROUP BY 1, 2")
def external_links(spark, d):
    links = page_links(spark, d).select(C("page_id").cast("string").alias("caller"), F.lit(None).cast("string").alias("callee"), C("target").alias("callee_name"))
    symbols = table(spark, d, "pages").select(C("page_id").cast("string").alias("id"), C("url").alias("name"))
    return edges.call_graph(links, symbols).edges.select("dst", "src", "weight")


@query(
    "incremental_diff",
    """WITH o AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 > 0), n AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 3 > 0)
    SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL THEN 'deleted' WHEN o.path IS NULL THEN 'parse' WHEN o.h = n.h THEN 'unchanged' ELSE 'parse' END AS action FROM o FULL JOIN n ON o.path = n.path""",
)
def incremental_diff(spark, d):
    t = table(spark, d, "documents")
    old = t.where("doc_id % 5 > 0").select(C("doc_id").alias("path"), F.sha2("text", 256).alias("content_hash"))
    new = t.where("doc_id % 3 > 0").select(C("doc_id").alias("path"), F.sha2(F.when(C("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(C("text")), 256).alias("content_hash"))
    return incremental.plan(old, new)


@query("upsert", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 1000000, 1.0 FROM supplier WHERE s_suppkey % 10 = 0")
def upsert(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    new = s.where("s_suppkey % 4 = 0").withColumn("s_acctbal", F.lit(0.0)).union(s.where("s_suppkey % 10 = 0").select(C("s_suppkey") + 1000000, F.lit(1.0)))
    return incremental.upsert(s, new, ["s_suppkey"])


@query(
    "conflicts",
    """WITH t AS (SELECT DISTINCT l_partkey || '/' || l_suppkey AS key, l_orderkey AS tx, l_returnflag = 'R' AS reads FROM lineitem)
    SELECT a.key, a.tx AS tx_a, b.tx AS tx_b, 'write-write' AS kind FROM t a JOIN t b USING (key) WHERE a.tx < b.tx AND NOT a.reads AND NOT b.reads
    UNION ALL SELECT a.key, a.tx, b.tx, 'read-write' FROM t a JOIN t b USING (key) WHERE a.tx <> b.tx AND a.reads AND NOT b.reads""",
)
def conflicts(spark, d):
    l = table(spark, d, "lineitem")
    t = l.select(C("l_orderkey").alias("tx_id"), F.concat_ws("/", C("l_partkey").cast("string"), C("l_suppkey").cast("string")).alias("key"), "l_returnflag")
    return incremental.conflicts(t.where("l_returnflag = 'R'").drop("l_returnflag"), t.where("l_returnflag <> 'R'").drop("l_returnflag"))


@query(
    "tokenize",
    f"""WITH raw AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' depends on the login of ' || p_type || ' repository'), '([a-z0-9_./-]+)', 1), lambda x: length(x) > 1 AND x NOT IN ({STOPS})) AS t FROM part),
    w AS (SELECT p_partkey, flatten(list_transform(t, lambda x: CASE x WHEN 'login' THEN ['login', 'github', 'oauth', 'auth', 'callback', 'session', 'sign'] WHEN 'repository' THEN ['repository', 'repo', 'connect', 'analyze'] ELSE [x] END)) AS t FROM raw)
    SELECT p_partkey, array_to_string(list_sort(list_distinct(t)), ',') AS tokens FROM w""",
)
def tokenize(spark, d):
    words = X.tokens(F.concat("p_name", F.lit(" depends on the login of "), "p_type", F.lit(" repository")))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(words), ",").alias("tokens"))


GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '([a-z0-9]+)', 1), lambda w: list_transform(range(1, len(w) + 2), lambda k: substr('  ' || w || ' ', k, 3)))))"


@query("trigram_similarity", f"WITH t AS (SELECT p_partkey, {GRAMS.format('p_name')} AS a, {GRAMS.format(chr(39) + 'red widgets' + chr(39))} AS b FROM part), s AS (SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS x FROM t) SELECT p_partkey, ROUND(x, 6) AS similarity FROM s WHERE x >= 0.2")
def trigram_similarity(spark, d):
    p = table(spark, d, "part").select(C("p_partkey").alias("id"), C("p_name").alias("name"))
    return search.fuzzy(p, "red widgets", 0.2).select(C("id").alias("p_partkey"), F.round("similarity", 6).alias("similarity"))


@query("cosine_topk", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) AS c FROM embeddings, q) SELECT vec_id, ROUND(c, 5) AS cosine FROM s WHERE c > 0.25 ORDER BY c DESC, vec_id LIMIT 15")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    first = e.where("vec_id = 0").first().embedding
    vector = F.array(*map(F.lit, first))
    return search.nearest(e.select("vec_id", "embedding"), vector).select("vec_id", F.round("cosine", 5).alias("cosine"))


@query("hashed_embedding", "WITH w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), c AS (SELECT p_partkey, (('0x' || right(md5(w), 8))::BIGINT % 128) AS place, count(*) AS n FROM w GROUP BY 1, 2), m AS (SELECT p_partkey, sqrt(sum(n * n)) AS norm FROM c GROUP BY 1) SELECT p_partkey, place, ROUND(n / norm, 4) AS value FROM c JOIN m USING (p_partkey)")
def hashed_embedding(spark, d):
    v = table(spark, d, "part").select("p_partkey", F.posexplode(X.embedding(F.split("p_name", " "))).alias("place", "value")).where("value > 0")
    return v.select("p_partkey", C("place").cast("long").alias("place"), F.round("value", 4).alias("value"))


@query("graded_search", f"WITH {NODES}, h AS (SELECT id, name, CASE WHEN lower(name) = 'red ring' THEN 100 WHEN contains(lower(name), 'red') OR contains(lower(name), 'ring') THEN 80 ELSE 40 END AS grade FROM nodes WHERE contains(lower(name), 'red') OR contains(lower(name), 'ring')) SELECT id, grade FROM h ORDER BY grade DESC, name, id LIMIT 25")
def graded_search(spark, d):
    return search.graded(part_nodes(spark, d), "red ring").select("id", "grade")


@query("seed_aliases", "SELECT DISTINCT p_partkey AS id, w AS alias FROM (SELECT p_partkey, unnest(regexp_split_to_array(lower(p_name), '[^a-z0-9]+')) AS w FROM part) WHERE length(w) > 1")
def seed_aliases(spark, d):
    return search.seed_aliases(part_nodes(spark, d))


@query(
    "ranked_search",
    f"""WITH {GRAPH}, e AS (SELECT id, unnest(regexp_extract_all(lower(name || ' ' || file), '([a-z0-9]+)', 1)) AS w FROM nodes), p AS (SELECT id, ('0x' || right(md5(w), 8))::BIGINT % 128 AS place, count(*) AS n FROM e GROUP BY 1, 2),
    v AS (SELECT id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY id)), 6) AS x FROM p), q AS (SELECT ('0x' || right(md5(w), 8))::BIGINT % 128 AS place, round(1 / sqrt(2), 6) AS x FROM (VALUES ('red'), ('ring')) t(w)),
    cosines AS (SELECT id, round(sum(v.x * coalesce(q.x, 0)) / (sqrt(sum(v.x * v.x)) * (SELECT sqrt(sum(x * x)) FROM q)), 9) AS c FROM v LEFT JOIN q USING (place) GROUP BY 1),
    near AS (SELECT id, greatest(8.0, floor(20 * least(1.0, c / 0.5))) AS score FROM cosines WHERE c > 0.25 ORDER BY c DESC, id LIMIT 15),
    grams AS (SELECT id, {GRAMS.format('name')} AS a, {GRAMS.format(chr(39) + 'red ring' + chr(39))} AS b FROM nodes), alike AS (SELECT id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) AS s FROM grams),
    fuzzy AS (SELECT id FROM alike WHERE s > 0.35 ORDER BY s DESC, id LIMIT 20),
    base AS (SELECT id, 100.0 AS score, 'exact' AS source FROM nodes WHERE lower(name) = 'red ring' UNION ALL SELECT id, 10, 'node' FROM nodes WHERE contains(lower(name), 'red') OR contains(lower(name), 'ring')
     UNION ALL SELECT id, 10, 'file' FROM nodes WHERE contains(lower(file), 'red') OR contains(lower(file), 'ring') UNION ALL SELECT id, 15, 'trigram' FROM fuzzy
     UNION ALL SELECT DISTINCT id, 25, 'alias' FROM (SELECT id, unnest(regexp_split_to_array(lower(name), '[^a-z0-9]+')) AS w FROM nodes) WHERE w IN ('red', 'ring') UNION ALL SELECT id, 15, 'workflow' FROM nodes WHERE contains(lower(package), 'red') OR contains(lower(package), 'ring')
     UNION ALL SELECT id, score, 'embedding' FROM near),
    seeds AS (SELECT id FROM base GROUP BY 1 ORDER BY sum(score) DESC, id LIMIT 8), grown AS (SELECT dst AS id FROM edges WHERE src IN (FROM seeds) UNION SELECT src FROM edges WHERE dst IN (FROM seeds)),
    total AS (SELECT id, least(100.0, sum(score))::DOUBLE AS score, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM (SELECT * FROM base UNION ALL SELECT id, 20, 'graph' FROM grown) GROUP BY 1)
    SELECT id, score, sources FROM total ORDER BY score DESC, id LIMIT 25""",
)
def ranked_search(spark, d):
    g = part_graph(spark, d)
    found = search.resolve(g, "red ring", search.seed_aliases(g.nodes), g.nodes.select("id", C("package").alias("workflow")))
    return found.withColumn("sources", F.array_join("sources", ","))


@query(
    "sql_table_extract",
    """WITH c AS (SELECT p_partkey, 'SELECT a FROM t' || (p_partkey % 7) || ' WHERE x; INSERT INTO log' || (p_partkey % 3) || ' VALUES (1); UPDATE u' || p_size || ' SET a = 1; DELETE FROM old' AS code FROM part),
    f AS (SELECT p_partkey, 'reads' AS operation, unnest(regexp_extract_all(code, '(?is)select\\b[^;]*?\\bfrom\\s+([A-Za-z_][\\w.]*)', 1)) AS tbl FROM c UNION ALL SELECT p_partkey, 'writes', unnest(regexp_extract_all(code, '(?i)insert\\s+into\\s+([A-Za-z_][\\w.]*)', 1)) FROM c
    UNION ALL SELECT p_partkey, 'updates', unnest(regexp_extract_all(code, '(?i)update\\s+([A-Za-z_][\\w.]*)\\s+set\\b', 1)) FROM c UNION ALL SELECT p_partkey, 'deletes', unnest(regexp_extract_all(code, '(?i)delete\\s+from\\s+([A-Za-z_][\\w.]*)', 1)) FROM c)
    SELECT operation, lower(tbl) AS name, count(*) AS n FROM f GROUP BY 1, 2""",
)
def sql_table_extract(spark, d):
    p = table(spark, d, "part")
    s = lambda c: c.cast("string")
    code = F.concat(F.lit("SELECT a FROM t"), s(C("p_partkey") % 7), F.lit(" WHERE x; INSERT INTO log"), s(C("p_partkey") % 3), F.lit(" VALUES (1); UPDATE u"), s(C("p_size")), F.lit(" SET a = 1; DELETE FROM old"))
    found = p.select(F.explode(X.sql_tables(code)).alias("t"))
    return found.groupBy(C("t.operation").alias("operation"), C("t.table").alias("name")).agg(F.count("*").alias("n"))


@query("path_functions", "WITH u AS (SELECT url, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages) SELECT url, len(string_split(trim(p, '/'), '/')) - 1 AS depth, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AS extension FROM u")
def path_functions(spark, d):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, d, "pages").select("url", X.folder_depth(p).cast("long").alias("depth"), X.extension(p).alias("extension"))


@query("flow_reach", f"WITH RECURSIVE {GRAPH}, allowed AS (SELECT src, dst FROM edges WHERE type IN ('CALLS', 'USES', 'IMPORTS')), walk(node, depth) AS (SELECT (SELECT min(src) FROM edges), 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN allowed e ON e.src = w.node WHERE w.depth < 6), near AS (SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 60) SELECT node, depth FROM near")
def flow_reach(spark, d):
    g = part_graph(spark, d)
    first = g.edges.agg(F.min("src")).first()[0]
    return flows.flow(g, first, ["CALLS", "USES", "IMPORTS"])[0].select("node", "depth")


@query("flow_steps", f"WITH RECURSIVE {GRAPH}, allowed AS (SELECT src, dst, type FROM edges WHERE type IN ('CALLS', 'USES', 'IMPORTS')), walk(node, depth) AS (SELECT (SELECT min(src) FROM edges), 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN allowed e ON e.src = w.node WHERE w.depth < 6), near AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 60), o AS (SELECT e.*, least(a.depth, b.depth) AS lo, greatest(a.depth, b.depth) AS hi FROM allowed e JOIN near a ON a.node = e.src JOIN near b ON b.node = e.dst) SELECT src, dst, type, (row_number() OVER (ORDER BY lo, hi, src, dst, type))::INT AS ordinal FROM o ORDER BY ordinal LIMIT 120")
def flow_steps(spark, d):
    g = part_graph(spark, d)
    first = g.edges.agg(F.min("src")).first()[0]
    return flows.flow(g, first, ["CALLS", "USES", "IMPORTS"])[1]


@query("folder_clusters", f"WITH {NODES} SELECT file AS folder, count(*) AS n FROM nodes GROUP BY 1 HAVING count(*) >= 3")
def folder_clusters(spark, d):
    return flows.folder_clusters(part_nodes(spark, d))


@query("cluster_expand", f"WITH RECURSIVE {GRAPH}, inner_ids AS (SELECT id FROM nodes WHERE regexp_matches(name, 'red|blue|small') OR size = 7), e AS (SELECT src, dst FROM edges WHERE src IN (FROM inner_ids) AND dst IN (FROM inner_ids)), s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), walk(node, depth) AS (SELECT id, 0 FROM nodes WHERE size = 7 UNION SELECT s.b, w.depth + 1 FROM walk w JOIN s ON s.a = w.node WHERE w.depth < 3) SELECT DISTINCT node AS id FROM walk")
def cluster_expand(spark, d):
    g = part_graph(spark, d)
    return flows.cluster(g, g.nodes.where("size = 7").select("id"), "red|blue|small", 3)


@query("evidence_chains", f"WITH RECURSIVE {GRAPH}, hub AS (SELECT dst AS node FROM edges GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), walk(node, depth) AS (SELECT node, 0 FROM hub UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < 5) SELECT w.node, min(depth)::INT AS depth, CASE node_type WHEN 'api_route' THEN 'api' WHEN 'service' THEN 'service' ELSE 'caller' END AS kind FROM walk w JOIN nodes ON id = w.node GROUP BY 1, 3 HAVING min(depth) > 0")
def evidence_chains(spark, d):
    g = part_graph(spark, d)
    hub = g.edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first().dst
    return flows.evidence(g, hub).select("node", "depth", "kind")


@query("windowed_weights", "WITH s AS (SELECT ts, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT date_trunc('hour', ts) AS window_start, src, dst, count(*) AS weight FROM s WHERE dst IS NOT NULL GROUP BY 1, 2, 3")
def windowed_weights_query(spark, d):
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("ts", C("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).where("dst is not null")
    return windowed_weights(e)


@query("outbound_by_name", f"WITH RECURSIVE {GRAPH}, walk(node, depth) AS (SELECT (SELECT min(src) FROM edges), 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 4) SELECT n.name, min(e.type) AS type FROM edges e JOIN nodes n ON n.id = e.dst WHERE e.type IN ('USES', 'IMPORTS') AND e.src IN (SELECT node FROM walk) GROUP BY 1")
def outbound_by_name(spark, d):
    g = part_graph(spark, d)
    first = g.edges.agg(F.min("src")).first()[0]
    return flows.outbound(g, traversal.bfs(g, first, max_depth=4), ["USES", "IMPORTS"])
