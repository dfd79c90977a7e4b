"""Indexes and verbs of the engine over the part graph, relationship conditions, and a named flow."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions import text as X
from ..graph import Graph
from ..operators import flows, indexes
from ..plans import expressions as P
from ..plans.query import Builder, Context
from ..plans.verbs import GraphEngine
from ..scratch import Scratch
from ..sources.postings import TrigramIndex
from ..sources.derived import order_graph, part_graph, part_nodes, table
from . import ALL_EDGES, EDGES, GRAPH, NODES, WHOLE, query
from .building import GRAMS
from .graphs import OUTGOING, START, _reach, start

C = F.col
HUB = "(SELECT dst FROM edges GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1)"


def _hub(g):
    return g.edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first().dst


def _with_ids(g):
    return Graph(g.nodes, g.edges.withColumn("edge_id", F.concat_ws("-", C("src").cast("string"), C("dst").cast("string"))))


for _name, _at, _reverse in (("outgoing_edge_lists", "src", False), ("incoming_edge_lists", "dst", True)):

    def _edge_lists(spark, d, reverse=_reverse):
        found = indexes.edge_lists(_with_ids(order_graph(spark, d)), reverse)
        return found.select("node", F.array_join("edge_ids", ",").alias("edge_ids"), C("n").cast("long").alias("n"))

    query(_name, f"WITH {WHOLE}, l AS (SELECT {_at} AS node, string_agg(src || '-' || dst, ',' ORDER BY src || '-' || dst) AS edge_ids, count(*) AS n FROM edges GROUP BY 1) SELECT id AS node, coalesce(edge_ids, '') AS edge_ids, coalesce(n, 0)::BIGINT AS n FROM nodes LEFT JOIN l ON node = id")(_edge_lists)


@query("node_relations", f"WITH {ALL_EDGES} SELECT src, dst, type FROM edges WHERE src = {HUB} OR dst = {HUB}")
def node_relations(spark, d):
    g = order_graph(spark, d)
    return indexes.node_relations(g.edges, _hub(g)).select("src", "dst", "type")


@query("edges_of_type", f"WITH {ALL_EDGES} SELECT src, dst FROM edges WHERE type = 'USES'")
def edges_of_type(spark, d):
    return indexes.of_type(order_graph(spark, d).edges, "uses").select("src", "dst")


@query("edge_by_id", f"WITH {ALL_EDGES} SELECT src, dst, type FROM edges WHERE dst = {HUB} AND src = (SELECT min(src) FROM edges WHERE dst = {HUB})")
def edge_by_id(spark, d):
    g = _with_ids(order_graph(spark, d))
    hub = _hub(g)
    first = indexes.incoming(g.edges, hub).agg(F.min("src")).first()[0]
    return indexes.edge_by_id(g.edges, f"{first}-{hub}").select("src", "dst", "type")


@query("namespace_index", f"WITH {NODES} SELECT CASE WHEN size % 9 = 0 THEN 'none' ELSE string_split(qualified_name, '.')[1] END AS key, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS node_ids FROM nodes GROUP BY 1")
def namespace_index(spark, d):
    n = part_nodes(spark, d).withColumn("namespace", F.when(C("size") % 9 == 0, F.when(C("id") % 2 == 0, " ")).otherwise(F.substring_index("qualified_name", ".", 1)))
    return indexes.grouped(n, "namespace", "none").select("key", "n", F.array_join(F.transform("node_ids", lambda x: x.cast("string")), ",").alias("node_ids"))


@query("language_index", "WITH u AS (SELECT page_id, lower(regexp_extract(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '\\.([A-Za-z0-9]+)$', 1)) AS e FROM pages) SELECT CASE e WHEN 'html' THEN 'html' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'php' THEN 'php' ELSE 'unknown' END AS key, count(*) AS n FROM u GROUP BY 1")
def language_index(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    n = table(spark, d, "pages").select(C("page_id").alias("id"), X.language(path).alias("language"))
    return indexes.grouped(n, "language", "unknown").select("key", "n")


@query("implementations", f"WITH {WHOLE} SELECT dst AS interface, src AS implementation FROM edges JOIN nodes ON id = dst WHERE type = 'INHERITS' AND node_type = 'class'")
def implementations(spark, d):
    g = order_graph(spark, d)
    classes = g.nodes.where("node_type = 'class'").select(C("id").alias("dst"), F.lit(True).alias("is_class"))
    e = g.edges.join(classes, "dst", "left").withColumn("type", F.when((C("type") == "INHERITS") & C("is_class"), "IMPLEMENTS").otherwise(C("type")))
    return indexes.implementations(e)


@query("attribute_groups", f"WITH {NODES}, a AS (SELECT 'visibility:' || CASE size % 3 WHEN 0 THEN 'private' ELSE 'public' END AS attribute FROM nodes UNION ALL SELECT 'async' FROM nodes WHERE size % 4 = 0 UNION ALL SELECT 'static' FROM nodes WHERE size % 5 = 0 UNION ALL SELECT 'test' FROM nodes WHERE size % 6 = 0) SELECT attribute, count(*) AS n FROM a GROUP BY 1")
def attribute_groups(spark, d):
    flag = lambda by: (C("size") % by == 0).cast("string")
    a = F.create_map(F.lit("visibility"), F.when(C("size") % 3 == 0, "PRIVATE"), F.lit("is_async"), flag(4), F.lit("is_static"), flag(5), F.lit("is_test"), flag(6))
    return indexes.attribute_groups(part_nodes(spark, d).withColumn("attributes", a))


def _verb(name, sql, call):
    query(name, f"WITH {WHOLE} {sql}")(lambda spark, d: call(GraphEngine(g := order_graph(spark, d)), _hub(g)))


_verb("find_callers", f"SELECT id, name FROM nodes WHERE id IN (SELECT src FROM edges WHERE dst = {HUB} AND type = 'CALLS')", lambda e, hub: e.find_callers(hub).select("id", "name"))
_verb("find_callees", f"SELECT id, name FROM nodes WHERE id IN (SELECT dst FROM edges WHERE src = {HUB} AND type = 'CALLS')", lambda e, hub: e.find_callees(hub).select("id", "name"))
_verb("find_imports", f"SELECT id, name FROM nodes WHERE id IN (SELECT dst FROM edges WHERE src = {HUB} AND type = 'IMPORTS')", lambda e, hub: e.find_imports(hub).select("id", "name"))
_verb("find_dependencies", f", a AS (SELECT DISTINCT dst AS node FROM edges WHERE src = {HUB}), b AS (SELECT DISTINCT dst AS node FROM edges WHERE src IN (FROM a)) SELECT node, min(depth)::INT AS depth FROM (SELECT node, 1 AS depth FROM a UNION ALL SELECT node, 2 FROM b) WHERE node <> {HUB} GROUP BY 1", lambda e, hub: e.find_dependencies(hub, 2))
_verb("find_dependents", f", a AS (SELECT DISTINCT src AS node FROM edges WHERE dst = {HUB}), b AS (SELECT DISTINCT src AS node FROM edges WHERE dst IN (FROM a)) SELECT node, min(depth)::INT AS depth FROM (SELECT node, 1 AS depth FROM a UNION ALL SELECT node, 2 FROM b) WHERE node <> {HUB} GROUP BY 1", lambda e, hub: e.find_dependents(hub, 2))


@query("find_reachable", f"WITH RECURSIVE {EDGES}, {_reach(OUTGOING, 4)} SELECT node, min(depth)::INT AS depth FROM walk WHERE node % 3 = 0 GROUP BY 1")
def find_reachable(spark, d):
    g = part_graph(spark, d)
    targets = g.nodes.where("id % 3 = 0").select(C("id").alias("node"))
    return GraphEngine(g).find_reachable_nodes(start(g), targets, 4)


@query("search_metadata", f"WITH {NODES} SELECT id FROM nodes WHERE size % 10 = 3")
def search_metadata(spark, d):
    n = part_nodes(spark, d).withColumn("attributes", F.create_map(F.lit("digit"), (C("size") % 10).cast("string")))
    return GraphEngine(Graph(n, order_graph(spark, d).edges)).search_by_metadata("digit", "3").select("id")


@query("search_annotation", f"WITH {NODES} SELECT id FROM nodes WHERE size % 4 = 0")
def search_annotation(spark, d):
    n = part_nodes(spark, d).withColumn("decorators", F.array(F.concat(F.when(C("id") % 2 == 0, "@").otherwise(""), F.lit("d"), (C("size") % 4).cast("string")), F.lit("@other")))
    return GraphEngine(Graph(n, order_graph(spark, d).edges)).search_by_annotation("@d0").select("id")


@query("filter_relationship", f"WITH {WHOLE} SELECT id FROM nodes WHERE (id IN (SELECT src FROM edges WHERE type = 'USES') AND node_type = 'class') OR id NOT IN (SELECT dst FROM edges WHERE type = 'CALLS')")
def filter_relationship(spark, d):
    g = order_graph(spark, d)
    condition = P.Or((P.And((P.Related("USES"), P.NodeIs("class"))), P.Not(P.Related("CALLS", "INCOMING"))))
    return Builder().table("nodes").filter(condition).project("id").build().compile(Context(g))


@query("scenario_direction", f"WITH {NODES} SELECT id, CASE WHEN size % 3 = 0 THEN 'upstream' WHEN size % 3 = 1 AND size % 2 = 0 THEN 'downstream' WHEN size % 2 = 0 THEN 'both' ELSE 'downstream' END AS direction FROM nodes")
def scenario_direction(spark, d):
    scenario = F.element_at(F.array(F.lit("delete"), F.lit("refactor"), F.lit("modify")), (C("size") % 3 + 1).cast("int"))
    asked = F.when(C("size") % 2 == 0, "both").otherwise("downstream")
    return part_nodes(spark, d).select("id", S.scenario_direction(scenario, asked).alias("direction"))


@query("named_flow", f"WITH RECURSIVE {GRAPH}, allowed AS (SELECT src, dst FROM edges WHERE type IN ('CALLS', 'USES', 'INHERITS')), walk(node, depth) AS (SELECT {START}, 0 UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN allowed e ON e.src = w.node WHERE w.depth < 6) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1 ORDER BY 2, 1 LIMIT 60")
def named_flow(spark, d):
    g = part_graph(spark, d)
    kind = F.element_at(F.create_map(*map(F.lit, ("CALLS", "calls", "USES", "uses_service", "INHERITS", "reads_table", "IMPORTS", "imports"))), C("type"))
    nodes, _ = flows.named_flow(Graph(g.nodes, g.edges.withColumn("type", kind)), start(g), "api_request")
    return nodes.select("node", "depth")


@query("trigram_postings", f"WITH t AS (SELECT p_partkey AS id, {GRAMS.format('p_name')} AS a, {GRAMS.format(chr(39) + 'smal red ring' + chr(39))} AS b FROM part), s AS (SELECT id, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS x FROM t) SELECT id, ROUND(x, 6) AS similarity FROM s WHERE x >= 0.3")
def trigram_postings(spark, d):
    index = TrigramIndex(spark, Scratch(spark, "postings").root, 16).build(part_nodes(spark, d))
    return index.find("smal red ring", 0.3).select("id", F.round("similarity", 6).alias("similarity"))
