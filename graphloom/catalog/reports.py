"""Overviews, pages, file trees and validation reports."""

from pyspark.sql import functions as F

from ..functions import text as X
from ..graph import Graph
from ..operators import analytics, indexes, quality, reports, search
from ..sources.derived import order_graph, part_graph, part_nodes, table
from ..sources.store import from_payload
from . import GRAPH, NODES, PAIRS, WHOLE, query
from .building import GRAMS

C = F.col
URLS = "u AS (SELECT page_id, trim(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/') AS path FROM pages)"


def urls(spark, d):
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, d, "pages").select("page_id", p.alias("path"))


@query("architecture_overview", f"WITH {NODES} SELECT node_type, ['javascript','python','css'][size % 3 + 1] IN ('javascript', 'typescript', 'html', 'css') AS frontend, count(*) AS n FROM nodes GROUP BY 1, 2")
def architecture_overview(spark, d):
    language = F.element_at(F.array(F.lit("javascript"), F.lit("python"), F.lit("css")), (C("size") % 3 + 1).cast("int"))
    return reports.overview(part_nodes(spark, d).withColumn("language", language))


@query("repository_stats", f"WITH {WHOLE} SELECT 'node_type' AS section, node_type AS key, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge_type', type, count(*) FROM edges GROUP BY 2 UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes UNION ALL SELECT 'total', 'edges', count(*) FROM edges")
def repository_stats(spark, d):
    return reports.repository_stats(order_graph(spark, d))


@query("file_tree", f"WITH {URLS}, p AS (SELECT string_split(path, '/') AS parts FROM u), e AS (SELECT unnest(list_transform(range(1, len(parts) + 1), lambda k: array_to_string(parts[1:k], '/'))) AS path, unnest(list_transform(range(1, len(parts) + 1), lambda k: k < len(parts))) AS folder FROM p), f AS (SELECT path, max(folder) AS folder FROM e GROUP BY 1) SELECT path, CASE WHEN folder THEN 'folder' ELSE 'file' END AS kind, (len(string_split(path, '/')) - 1)::BIGINT AS depth, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS parent FROM f")
def file_tree(spark, d):
    return reports.file_tree(urls(spark, d)).select("path", "kind", "depth", "parent")


@query("page_with_total", f"WITH {NODES} SELECT id, name, (SELECT count(*) FROM nodes) AS total, 60 < (SELECT count(*) FROM nodes) AS has_more FROM nodes ORDER BY name, id LIMIT 20 OFFSET 40")
def page_with_total(spark, d):
    return reports.page(part_nodes(spark, d).select("id", "name"), 3, 20, "name", "id")


@query("components_detail", f"WITH {WHOLE} SELECT n.id, n.name, coalesce(array_to_string(list_sort(list_distinct((SELECT list(m.name) FROM edges e JOIN nodes m ON m.id = e.dst WHERE e.src = n.id))), ','), '') AS calls, coalesce(array_to_string(list_sort(list_distinct((SELECT list(m.name) FROM edges e JOIN nodes m ON m.id = e.src WHERE e.dst = n.id))), ','), '') AS called_by FROM nodes n WHERE node_type = 'service' ORDER BY n.id LIMIT 500")
def components_detail(spark, d):
    return reports.components_detail(order_graph(spark, d), "service").select("id", "name", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


@query("importance", f"WITH {URLS} SELECT path, CASE WHEN lower(regexp_extract(path, '([^/]*)/*$', 1)) IN ('main.py', 'app.py', 'index.js', 'index.ts', 'main.ts') THEN 1.0::DOUBLE WHEN contains(path, 'router') OR contains(path, 'route') OR contains(path, 'api') THEN 0.9 WHEN starts_with(path, 'test') OR contains(path, '/test') THEN 0.3 ELSE 0.5 END AS importance FROM u")
def importance(spark, d):
    return urls(spark, d).select(F.trim("path", F.lit("/")).alias("path"), X.importance(F.trim("path", F.lit("/"))).alias("importance"))


@query("search_by_blast", f"WITH RECURSIVE {PAIRS}, b AS (SELECT target, count(*) AS blast_radius FROM pairs GROUP BY 1) SELECT n.id, coalesce(blast_radius, 0) AS blast_radius FROM nodes n LEFT JOIN b ON b.target = n.id WHERE n.name ILIKE '%ring%' ORDER BY 2 DESC, 1 LIMIT 20")
def search_by_blast(spark, d):
    g = part_graph(spark, d)
    found = g.nodes.where(C("name").ilike("%ring%")).select("id")
    return analytics.blast_radius(g).join(found, "id", "left_semi").orderBy(F.desc("blast_radius"), "id").limit(20)


@query("last_history", "SELECT event_id, event_type, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def last_history(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type", "value")


@query("top_files", "SELECT page_id, length(html)::BIGINT AS size FROM pages ORDER BY 2 DESC, 1 LIMIT 10")
def top_files(spark, d):
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("size")).orderBy(F.desc("size"), "page_id").limit(10)


@query("adapter_kinds", "SELECT ['CALLS','IMPORTS','INHERITS','USES','REFERENCES'][(l_linenumber % 5 + 1)::INT] AS type, count(*) AS n FROM lineitem GROUP BY 1")
def adapter_kinds(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("call", "import", "inheritance", "strange", "reference"))), C("l_linenumber") % 5 + 1)
    edges = table(spark, d, "lineitem").select(C("l_orderkey").alias("source_id"), C("l_partkey").alias("target_id"), kind.alias("kind"))
    symbols = table(spark, d, "part").select(C("p_partkey").alias("id"), C("p_name").alias("name"), F.lit(None).cast("string").alias("kind"))
    return indexes.by_type(from_payload(symbols, edges).edges)


@query("callers_detail", f"WITH {WHOLE} SELECT c.name AS caller, b.name AS callee, count(*) AS n FROM edges e JOIN nodes c ON c.id = e.src JOIN nodes b ON b.id = e.dst WHERE e.type = 'CALLS' GROUP BY 1, 2")
def callers_detail(spark, d):
    g = order_graph(spark, d)
    a, b = g.nodes.select(C("id").alias("src"), C("name").alias("caller")), g.nodes.select(C("id").alias("dst"), C("name").alias("callee"))
    return g.edges.where("type = 'CALLS'").join(a, "src").join(b, "dst").groupBy("caller", "callee").agg(F.count("*").alias("n"))


@query("violations", f"WITH {WHOLE}, n AS (SELECT id FROM nodes WHERE id % 10 > 0 UNION ALL SELECT id FROM nodes WHERE id % 100 = 1), v AS (SELECT 'DUPLICATE_NODE_ID' AS code, id::VARCHAR AS id FROM n GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'DANGLING_SOURCE', src::VARCHAR FROM edges WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT 'UNRESOLVED_TARGET', dst::VARCHAR FROM edges WHERE dst NOT IN (SELECT id FROM n)) SELECT code, count(*) AS n FROM v GROUP BY 1")
def violations(spark, d):
    g = order_graph(spark, d)
    ids = g.nodes.select("id")
    nodes = ids.where("id % 10 > 0").union(ids.where("id % 100 = 1"))
    return quality.violations(Graph(nodes, g.edges)).where("code <> 'ORPHAN_NODE'").groupBy("code").agg(F.count("*").alias("n"))


@query("search_names", f"WITH {NODES} SELECT id, name FROM nodes WHERE name ILIKE '%Widget%' AND node_type IN ('class', 'function')")
def search_names(spark, d):
    return part_nodes(spark, d).where(C("name").ilike("%Widget%") & C("node_type").isin("class", "function")).select("id", "name")


@query("fuzzy_35", f"WITH t AS (SELECT p_partkey, {GRAMS.format('p_name')} AS a, {GRAMS.format(chr(39) + 'smal rings' + chr(39))} AS b FROM part), s AS (SELECT p_partkey, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS x FROM t) SELECT p_partkey AS id, ROUND(x, 6) AS similarity FROM s WHERE x >= 0.35")
def fuzzy_35(spark, d):
    return search.fuzzy(part_nodes(spark, d), "smal rings", 0.35).select("id", F.round("similarity", 6).alias("similarity"))
