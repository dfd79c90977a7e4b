"""Relational operators, by the query tree, over the order tables."""

from pyspark.sql import functions as F

from ..operators import search
from ..plans import expressions as X
from ..plans.query import Builder, Context
from ..sources.derived import order_graph, part_graph, part_nodes, table
from . import GRAPH, NODES, WHOLE, query

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def run(spark, d, builder: Builder, **more):
    return builder.build().compile(Context(None, {t: table(spark, d, t) for t in TABLES} | more))


T = lambda name: Builder().table(name)


@query("scan_type", f"WITH {NODES} SELECT id, name FROM nodes WHERE node_type = 'class'")
def scan_type(spark, d):
    return part_nodes(spark, d).where("node_type = 'class'").select("id", "name")


@query("lookup_id", f"WITH {NODES} SELECT id, name, node_type FROM nodes WHERE id = 17")
def lookup_id(spark, d):
    return part_nodes(spark, d).where("id = 17").select("id", "name", "node_type")


@query("project_alias", "SELECT c_custkey AS id, c_name AS label, c_acctbal * 2 AS doubled FROM customer")
def project_alias(spark, d):
    return run(spark, d, T("customer").project("c_custkey", "c_name", aliases={"c_custkey": "id", "c_name": "label"}, doubled=X.Arithmetic("*", X.Property("c_acctbal"), 2)))


@query("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 400000) AND NOT o_orderpriority = '5-LOW'")
def filter_and_or_not(spark, d):
    p = X.And((X.Or((X.Equals("o_orderstatus", "F"), X.Compare(">", X.Property("o_totalprice"), 400000))), X.Not(X.Equals("o_orderpriority", "5-LOW"))))
    return run(spark, d, T("orders").filter(p).project("o_orderkey"))


@query("filter_range", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice <= 1000")
def filter_range(spark, d):
    return run(spark, d, T("part").filter(X.Between("p_size", 10, 20)).filter(X.Between("p_retailprice", None, 1000)).project("p_partkey"))


@query("filter_contains", "SELECT p_partkey FROM part WHERE contains(p_name, 'bolt')")
def filter_contains(spark, d):
    return run(spark, d, T("part").filter(X.Contains("p_name", "bolt")).project("p_partkey"))


@query("filter_prefix", "SELECT p_partkey, p_brand FROM part WHERE starts_with(p_brand, 'Brand#1')")
def filter_prefix(spark, d):
    return run(spark, d, T("part").filter(X.StartsWith("p_brand", "Brand#1")).project("p_partkey", "p_brand"))


@query("filter_suffix", "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'ring')")
def filter_suffix(spark, d):
    return run(spark, d, T("part").filter(X.EndsWith("p_name", "ring")).project("p_partkey", "p_name"))


@query("filter_exists", "SELECT event_id FROM events WHERE props IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL")
def filter_exists(spark, d):
    e = table(spark, d, "events").withColumn("attributes", F.from_json("props", "map<string,string>"))
    return run(spark, d, T("parsed").filter(X.And((X.Exists("props"), X.Exists("attributes", "k")))).project("event_id"), parsed=e)


@query("filter_attribute", "SELECT event_id, event_type FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) >= 90")
def filter_attribute(spark, d):
    e = table(spark, d, "events").withColumn("attributes", F.from_json("props", "map<string,int>"))
    return run(spark, d, T("parsed").filter(X.Attribute("k", ">=", 90)).project("event_id", "event_type"), parsed=e)


@query("filter_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 450000")
def filter_pruned_scan(spark, d):
    return run(spark, d, T("orders").filter(X.Between("o_totalprice", 450000)).project("o_orderkey", "o_totalprice"))


@query(
    "expr_arith_collection",
    """SELECT l_orderkey, l_linenumber, l_partkey, ROUND(l_extendedprice * (1 - l_discount) / (1 + l_tax), 6) AS net FROM lineitem
    WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 45""",
)
def expr_arith_collection(spark, d):
    price = X.Arithmetic("/", X.Arithmetic("*", X.Property("l_extendedprice"), X.Arithmetic("-", 1, X.Property("l_discount"))), X.Arithmetic("+", 1, X.Property("l_tax")))
    b = T("lineitem").filter(X.And((X.Membership("IN", X.Property("l_returnflag"), ("A", "R")), X.Compare(">=", X.Property("l_quantity"), 45)))).project("l_orderkey", "l_linenumber", "l_partkey", net=price)
    return run(spark, d, b).withColumn("net", F.round("net", 6))


@query("expr_contains_any_all", "SELECT p_partkey, list_has_any(string_split(p_name, ' '), ['red', 'blue']) AS any_of, list_has_all(string_split(p_name, ' '), ['red', 'widget']) AS all_of FROM part")
def expr_contains_any_all(spark, d):
    p = table(spark, d, "part").withColumn("words", F.split("p_name", " "))
    w = X.Property("words")
    return run(spark, d, T("p").project("p_partkey", any_of=X.Membership("CONTAINS_ANY", w, ("red", "blue")), all_of=X.Membership("CONTAINS_ALL", w, ("red", "widget"))), p=p)


def _join(name, how, strategy=None):
    sql = f"SELECT c_custkey, o_orderkey FROM customer {how} JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000"

    @query(name, sql)
    def join(spark, d):
        rich = T("orders").filter(X.Compare(">", X.Property("o_totalprice"), 300000)).project("o_orderkey", "o_custkey")
        some = T("customer").project("c_custkey")
        out = run(spark, d, some.join(rich, (("c_custkey", "o_custkey"),), how, strategy))
        return out.select("c_custkey", "o_orderkey")


for _name, _how, _s in (("join_inner", "INNER", None), ("join_left", "LEFT", None), ("join_hash", "INNER", "HASH"), ("join_merge", "INNER", "MERGE")):
    _join(_name, _how, _s)


@query("join_right", "SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000")
def join_right(spark, d):
    rich = T("supplier").filter(X.Compare(">", X.Property("s_acctbal"), 5000)).project("s_suppkey", "s_nationkey")
    return run(spark, d, rich.join(T("nation"), (("s_nationkey", "n_nationkey"),), "RIGHT").project("n_name", "s_suppkey"))


@query(
    "join_full",
    """SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0)::BIGINT AS n_orders, coalesce(b.n, 0)::BIGINT AS n_rich FROM
    (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) a FULL JOIN (SELECT c_custkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) b ON a.k = b.k""",
)
def join_full(spark, d):
    a = T("orders").filter(X.Equals("o_orderstatus", "P")).aggregate(("COUNT", None, "n_orders"), keys=("o_custkey",)).project("o_custkey", "n_orders", aliases={"o_custkey": "k"})
    b = T("customer").filter(X.Compare(">", X.Property("c_acctbal"), 9000)).aggregate(("COUNT", None, "n_rich"), keys=("c_custkey",)).project("c_custkey", "n_rich", aliases={"c_custkey": "k"})
    return run(spark, d, a.join(b, ("k",), "FULL")).fillna(0)


@query("join_theta", "SELECT a.s_suppkey AS a, b.r_regionkey AS b FROM supplier a JOIN region b ON a.s_acctbal > 2000 * (b.r_regionkey + 1)")
def join_theta(spark, d):
    bigger = X.Compare(">", X.Property("s_acctbal"), X.Arithmetic("*", 2000, X.Arithmetic("+", X.Property("r_regionkey"), 1)))
    return run(spark, d, T("supplier").join(T("region"), bigger, "INNER", "NESTED_LOOP").project("s_suppkey", "r_regionkey", aliases={"s_suppkey": "a", "r_regionkey": "b"}))


@query("semi_join", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)")
def semi_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("or_join", f"WITH {WHOLE} SELECT DISTINCT e.src, e.dst FROM edges e WHERE EXISTS (SELECT 1 FROM nodes n WHERE n.node_type = 'service' AND n.size < 10 AND (n.id = e.src OR n.id = e.dst))")
def or_join(spark, d):
    g = order_graph(spark, d)
    ids = g.nodes.where("node_type = 'service' and size < 10").select("id")
    touch = lambda end: g.edges.join(ids.withColumnRenamed("id", end), end, "left_semi").select("src", "dst")
    return touch("src").union(touch("dst")).distinct()


@query("agg_all", "SELECT count(*) AS n, ROUND(sum(l_quantity), 2) AS total, ROUND(avg(l_quantity), 6) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def agg_all(spark, d):
    q, p = X.Property("l_quantity"), X.Property("l_extendedprice")
    out = run(spark, d, T("lineitem").aggregate(("COUNT", None, "n"), ("SUM", q, "total"), ("AVG", q, "mean"), ("MIN", p, "low"), ("MAX", p, "high")))
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 6))


@query("group_agg", "SELECT l_returnflag, l_linestatus, count(*) AS n, ROUND(sum(l_extendedprice), 0) AS revenue FROM lineitem GROUP BY 1, 2")
def group_agg(spark, d):
    out = run(spark, d, T("lineitem").aggregate(("COUNT", None, "n"), ("SUM", X.Property("l_extendedprice"), "revenue"), keys=("l_returnflag", "l_linestatus")))
    return out.withColumn("revenue", F.round("revenue", 0))


@query("count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def count_distinct(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("n"))


@query("conditional_counts", "SELECT sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS f, sum(CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END)::BIGINT AS rich, max(o_totalprice) AS top FROM orders")
def conditional_counts(spark, d):
    n = lambda c, a: F.sum(F.when(c, 1).otherwise(0)).alias(a)
    return table(spark, d, "orders").agg(n(F.col("o_orderstatus") == "F", "f"), n(F.col("o_totalprice") > 250000, "rich"), F.max("o_totalprice").alias("top"))


@query("group_flag", f"WITH {NODES} SELECT node_type, package = 'ECONOMY' AS frontend, count(*) AS n FROM nodes GROUP BY 1, 2")
def group_flag(spark, d):
    return part_nodes(spark, d).groupBy("node_type", (F.col("package") == "ECONOMY").alias("frontend")).agg(F.count("*").alias("n"))


@query("dedup_first", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def dedup_first(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"))


@query("dedup_fields", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def dedup_fields(spark, d):
    return run(spark, d, T("lineitem").project("l_returnflag", "l_linestatus").deduplicate())


@query("distinct_on_min", "SELECT DISTINCT ON (o_custkey) o_custkey, o_totalprice, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice, o_orderkey")
def distinct_on_min(spark, d):
    least = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_totalprice", "o_orderkey")).alias("m"))
    return least.select("o_custkey", "m.o_totalprice", "m.o_orderkey")


@query("sort_nulls", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance ASC NULLS LAST, c_custkey LIMIT 50")
def sort_nulls(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    return run(spark, d, T("c").sort("balance").sort("c_custkey").limit(50), c=c)


@query("limit_offset", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 20 OFFSET 30")
def limit_offset(spark, d):
    return run(spark, d, T("part").project("p_partkey", "p_name").sort("p_partkey").limit(20, 30))


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk(spark, d):
    return run(spark, d, T("orders").project("o_orderkey", "o_totalprice").sort("o_totalprice", False).sort("o_orderkey").limit(10))


@query(
    "relevance_order",
    f"""WITH {NODES} SELECT id, CASE WHEN lower(name) = 'bolt' THEN 1 WHEN starts_with(lower(name), 'bolt') THEN 2 WHEN contains(lower(name), 'bolt') THEN 3 WHEN contains(lower(file), 'bolt') THEN 4 ELSE 6 END AS relevance
    FROM nodes WHERE contains(lower(name), 'bolt') OR contains(lower(file), 'bolt') ORDER BY relevance, name, id LIMIT 10""",
)
def relevance_order(spark, d):
    return search.by_name(part_nodes(spark, d), "bolt", 10).select("id", "relevance")


def _sets(name, op, sql):
    @query(name, f"SELECT k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9500 {sql} SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)")
    def combined(spark, d):
        a = T("customer").filter(X.Compare(">", X.Property("c_acctbal"), 9500)).project("c_nationkey", aliases={"c_nationkey": "k"})
        b = T("supplier").filter(X.Compare(">", X.Property("s_acctbal"), 5000)).project("s_nationkey", aliases={"s_nationkey": "k"})
        return run(spark, d, a.combine(op, b))


for _name, _op, _sql in (("merge_all", "MERGE", "UNION ALL"), ("union_set", "UNION", "UNION"), ("intersect_set", "INTERSECT", "INTERSECT"), ("except_set", "EXCEPT", "EXCEPT")):
    _sets(_name, _op, _sql)


@query("stats_by_type", f"WITH {NODES} SELECT node_type, count(*) AS n, ROUND(avg(price), 4) AS mean_price FROM nodes GROUP BY 1")
def stats_by_type(spark, d):
    return part_nodes(spark, d).groupBy("node_type").agg(F.count("*").alias("n"), F.round(F.avg("price"), 4).alias("mean_price"))


@query(
    "three_way_join",
    """SELECT n_name, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1""",
)
def three_way_join(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(table(spark, d, "nation"), "n_nationkey").groupBy("n_name").agg(F.countDistinct("o_orderkey").alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"))
