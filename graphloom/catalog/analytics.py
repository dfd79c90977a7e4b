"""Degrees, blast radius and scores over the part graph."""

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import analytics
from ..sources.derived import node_metrics, order_graph, part_graph, table
from . import DEGREES, EDGES, GRAPH, METRICS, NODES, PAIRS, WHOLE, query

C = F.col


@query("fan_in_out", f"WITH {DEGREES} SELECT id, fan_in, fan_out FROM degrees")
def fan_in_out(spark, d):
    return analytics.degrees(order_graph(spark, d))


@query("coupling", f"WITH {DEGREES} SELECT id, ROUND(CASE WHEN fan_in + fan_out = 0 THEN 0 ELSE fan_in * fan_out / ((fan_in + fan_out) * (fan_in + fan_out))::DOUBLE END, 6) AS coupling FROM degrees")
def coupling(spark, d):
    return analytics.coupling(order_graph(spark, d)).select("id", F.round("coupling", 6).alias("coupling"))


@query("blast_radius", f"WITH RECURSIVE {PAIRS} SELECT n.id, count(p.affected) AS blast_radius FROM nodes n LEFT JOIN pairs p ON p.target = n.id GROUP BY 1")
def blast_radius(spark, d):
    return analytics.blast_radius(part_graph(spark, d))


LEVELS = """levels AS (SELECT id, fan_in, blast, CASE WHEN fan_in >= 20 OR blast >= 50 THEN 'critical' WHEN fan_in >= 10 OR blast >= 20 THEN 'high' WHEN fan_in >= 3 OR blast >= 5 THEN 'medium' ELSE 'low' END AS risk_level
 FROM (SELECT n.id, (SELECT count(*) FROM edges WHERE dst = n.id) AS fan_in, count(p.affected) AS blast FROM nodes n LEFT JOIN pairs p ON p.target = n.id GROUP BY 1))"""


@query("risk_level", f"WITH RECURSIVE {PAIRS}, {LEVELS} SELECT id, risk_level FROM levels")
def risk_level(spark, d):
    return analytics.scored(part_graph(spark, d)).select("id", "risk_level")


@query(
    "risk_summary",
    f"""WITH RECURSIVE {PAIRS}, {LEVELS} SELECT count(*) AS total, count(*) FILTER (risk_level = 'critical') AS critical, count(*) FILTER (risk_level = 'high') AS high, count(*) FILTER (risk_level = 'medium') AS medium,
    count(*) FILTER (risk_level = 'low') AS low, max(blast) AS max_blast, max(fan_in) AS max_fan_in FROM levels""",
)
def risk_summary(spark, d):
    return analytics.score_summary(analytics.scored(part_graph(spark, d)))


@query("top_blast", f"WITH RECURSIVE {PAIRS} SELECT target AS id, count(*) AS blast_radius FROM pairs GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_blast(spark, d):
    return analytics.blast_radius(part_graph(spark, d)).where("blast_radius > 0").orderBy(F.desc("blast_radius"), "id").limit(20)


@query("node_impact", f"WITH RECURSIVE {GRAPH}, hub AS (SELECT dst AS node FROM edges GROUP BY 1 ORDER BY count(*) DESC, dst LIMIT 1), walk(node, depth) AS (SELECT node, 0 FROM hub UNION SELECT e.src, w.depth + 1 FROM walk w JOIN edges e ON e.dst = w.node WHERE w.depth < 8) SELECT w.node, min(depth)::INT AS depth, node_type FROM walk w JOIN nodes ON id = w.node GROUP BY 1, 3 HAVING min(depth) > 0 ORDER BY depth, node LIMIT 200")
def node_impact(spark, d):
    g = part_graph(spark, d)
    hub = g.edges.groupBy("dst").count().orderBy(F.desc("count"), "dst").first().dst
    return analytics.node_impact(g, hub)


def _metric(name, sql, make):
    """A query of score expressions over the metrics of every node; ``make`` gives the columns by name."""

    @query(name, f"WITH {METRICS} SELECT id, {sql} FROM metrics")
    def scored(spark, d):
        return node_metrics(spark, d).select("id", *(c.alias(n) for n, c in make().items()))


def DEP():
    return C("fan_in") + C("fan_out")

def _ten():
    return S.risk_score_10(C("fan_in") * 3, C("fan_in"), C("api"), C("wf"))

TEN = "round_even(round(least(fan_in * 3 / 10, 5.0) + least(fan_in / 10, 2.0) + least(api * 0.5, 2.0) + least(wf * 0.1, 1.0), 9)::DOUBLE, 1)"
_metric(
    "risk_score_10",
    f"ROUND({TEN}, 4) AS score, CASE WHEN {TEN} >= 7.5 THEN 'critical' WHEN {TEN} >= 5 THEN 'high' WHEN {TEN} >= 2.5 THEN 'medium' ELSE 'low' END AS label",
    lambda: dict(score=F.round(_ten(), 4), label=S.risk_label_10(_ten())),
)
def _hours():
    return S.effort_hours(C("fan_in") * 3, S.risk_label_10(_ten()))

HOURS = f"round_even((greatest(fan_in * 3 * 0.5, 0.5) * CASE WHEN {TEN} >= 7.5 THEN 4.0 WHEN {TEN} >= 5 THEN 2.5 WHEN {TEN} >= 2.5 THEN 1.5 ELSE 1.0 END)::DOUBLE, 1)"
_metric(
    "effort_hours",
    f"ROUND(({HOURS})::DOUBLE, 4) AS hours, CASE WHEN {HOURS} < 2 THEN 'minutes' WHEN {HOURS} < 8 THEN 'hours' WHEN {HOURS} < 40 THEN 'days' ELSE 'weeks' END AS unit",
    lambda: dict(hours=F.round(_hours(), 4), unit=S.effort_unit(_hours())),
)
_metric(
    "impact_metrics",
    "fan_in + fan_out AS dependencies, least(3, wf) AS journeys, least(100, 2 * (fan_in + fan_out) + 5 * wf + 10 * cp + 8 * api) AS blast_hint",
    lambda: dict(dependencies=DEP(), journeys=F.least(F.lit(3), C("wf")), blast_hint=S.blast_hint(DEP(), C("wf"), C("cp"), C("api"))),
)

CENTRAL = "ROUND(100 * (0.40 * least(1.0, 0.55 * fan_in / greatest((SELECT max(fan_in) FROM metrics), 1) + 0.45 * fan_out / greatest((SELECT max(fan_out) FROM metrics), 1)) + 0.20 * least(1.0, wf / 3) + 0.15 * least(1.0, svc / 2) + 0.25 * least(1.0, cp / 2)), 2)"


def _central(rows):
    return analytics.with_maxima(rows).withColumn("central", S.centrality(C("fan_in"), C("fan_out"), C("max_in"), C("max_out"), C("wf"), C("svc"), C("cp")))


@query("centrality", f"WITH {METRICS} SELECT id, ROUND({CENTRAL}, 1) AS centrality FROM metrics")
def centrality(spark, d):
    return _central(node_metrics(spark, d)).select("id", F.round("central", 1).alias("centrality"))


@query("top_centrality", f"WITH {METRICS}, c AS (SELECT id, ROUND({CENTRAL}, 1) AS centrality FROM metrics) SELECT * FROM c ORDER BY centrality DESC, id LIMIT 25")
def top_centrality(spark, d):
    return centrality(spark, d).orderBy(F.desc("centrality"), "id").limit(25)


@query("subgraph_centrality", f"WITH {DEGREES} SELECT id, ROUND((fan_in + fan_out) / greatest((SELECT max(fan_in + fan_out) FROM degrees), 1), 3) AS centrality FROM degrees")
def subgraph_centrality(spark, d):
    return analytics.subgraph_centrality(order_graph(spark, d))


BLAST = "floor(30 * least(1.0, (fan_in * 7) / 50) + 1e-9)::BIGINT + floor(20 * least(1.0, wf / 5) + 1e-9)::BIGINT + floor(20 * least(1.0, svc / 4) + 1e-9)::BIGINT + floor(10 * least(1.0, api / 8) + 1e-9)::BIGINT + floor(20 * least(1.0, cp / 3) + 1e-9)::BIGINT"
def _blast():
    return S.blast_score(C("fan_in") * 7, C("wf"), C("svc"), C("api"), C("cp"))

_metric(
    "blast_score",
    f"{BLAST} AS score, CASE WHEN {BLAST} <= 20 THEN 'safe' WHEN {BLAST} <= 40 THEN 'low' WHEN {BLAST} <= 60 THEN 'medium' WHEN {BLAST} <= 80 THEN 'high' ELSE 'critical' END AS band",
    lambda: dict(score=_blast(), band=S.band(_blast())),
)
_metric(
    "profile_risk",
    """least(100, least(20, 2 * (fan_in + fan_out) + greatest(1, least(10, floor((fan_in + fan_out) / 2)::BIGINT))) + least(15, 5 * wf) + least(15, 5 * svc) + least(10, 3 * api) + least(10, 4 * jr) + least(10, 2 * jr + svc)
    + least(10, floor(10 * (cp / 4) + 1e-9)::BIGINT) + least(10, 5 * cp))::BIGINT AS risk""",
    lambda: dict(risk=S.profile_risk(DEP(), C("wf"), C("svc"), C("api"), C("jr"), C("cp") / 4, C("cp"))),
)
_metric(
    "context_risk",
    """least(100, least(20, 2 * fan_in + wf) + least(15, 5 * wf + 2 * cp) + least(15, 5 * svc) + least(10, 2 * api + cp) + least(10, 4 * jr + 2 * cp) + least(10, 3 * svc + wf) + least(10, floor(10 * (api / 8) + 1e-9)::BIGINT)
    + least(10, 5 * cp) + CASE WHEN tbl > 4 THEN 8 ELSE 0 END)::BIGINT AS risk""",
    lambda: dict(risk=S.context_risk(C("fan_in"), C("wf"), C("wf"), C("cp"), C("svc"), C("api"), C("cp"), C("jr"), C("cp"), C("svc"), C("wf"), C("api") / 8, C("cp"), F.when(C("tbl") > 4, 1).otherwise(0))),
)
_metric(
    "older_risk",
    """least(100, least(15, 3 * wf) + least(25, 8 * api) + least(15, 2 * fan_in) + least(10, 2 * fan_out) + least(13, floor(15 * (cp / 4) + 1e-9)::BIGINT) + least(12, 4 * svc)
     + CASE WHEN regexp_matches(lower(name), 'auth|oauth|login|session|token|jwt|github') THEN 20 ELSE 0 END + CASE WHEN regexp_matches(lower(node_type), 'database|db_|postgres|sqlalchemy|redis|migrate') THEN 12 ELSE 0 END
     + CASE WHEN regexp_matches(lower(name), 'main\\.py|router|middleware|connect|analyze|oauth') THEN 15 ELSE 0 END + CASE WHEN jr = 1 THEN 8 ELSE 0 END + CASE WHEN api = 0 AND fan_in > 3 THEN 10 ELSE 0 END)::BIGINT AS risk""",
    lambda: dict(
        risk=S.older_risk(
            C("wf"), C("api"), C("fan_in"), C("fan_out"), C("cp") / 4, C("svc"),
            F.concat_ws(" ", "name", "node_type"), F.when(C("jr") == 1, F.array(F.lit("Hotfix"))).otherwise(F.array(F.lit("calm"))),
            F.when(C("api") == 0, "delete").otherwise("modify"), C("fan_in"),
        )
    ),
)


@query("repository_risk", f"""WITH {METRICS}, s AS (SELECT sum(fan_in + fan_out)::BIGINT AS dep, sum(wf)::BIGINT AS wf, sum(svc)::BIGINT AS svc, sum(api)::BIGINT AS api, sum(jr)::BIGINT AS jr, avg(cp / 4) AS central, sum(cp)::BIGINT AS cp FROM metrics)
 SELECT least(100, least(20, floor(dep * 1.2 + 1e-9)::BIGINT) + least(15, 4 * wf) + least(15, 4 * svc) + least(10, 2 * api) + least(10, 3 * jr) + least(10, 2 * jr + svc) + least(10, floor(10 * central + 1e-9)::BIGINT) + least(10, 4 * cp))::BIGINT AS risk FROM s""")
def repository_risk(spark, d):
    s = node_metrics(spark, d).agg(F.sum(DEP()).alias("dep"), *(F.sum(c).alias(c) for c in ("wf", "svc", "api", "jr", "cp")), F.avg(C("cp") / 4).alias("central"))
    return s.select(S.repository_risk(C("dep"), C("wf"), C("svc"), C("api"), C("jr"), C("central"), C("cp")).alias("risk"))


SCEN = "['delete','modify','rename','move','other'][api + 1]"
def _scen():
    return F.element_at(F.array(*map(F.lit, ("delete", "modify", "rename", "move", "other"))), (C("api") + 1).cast("int"))

_metric(
    "scenario_risk",
    f"""{SCEN} AS scenario, greatest(0, least(100, CASE {SCEN} WHEN 'delete' THEN 5 * fan_in + 2 * fan_out + 10 * svc + 8 * tbl + 10 * jr WHEN 'modify' THEN 3 * fan_in + fan_out + 6 * svc + 5 * tbl WHEN 'rename' THEN 2 * fan_in + 5 * svc
    WHEN 'move' THEN 3 * fan_in + 5 * wf ELSE 5 * fan_in + 10 * svc END))::BIGINT AS risk""",
    lambda: dict(scenario=_scen(), risk=S.scenario_risk(_scen(), C("fan_in"), C("fan_out"), C("svc"), C("tbl"), C("jr"), C("wf"))),
)
def _kinds():
    return sum(((C(c) > 0).cast("int") for c in ("fan_in", "fan_out", "svc", "tbl", "api", "wf")), F.lit(0))

CX = "greatest(1, least(10, round_even(1 + 9 * (0.45 * least(1.0, (fan_out + svc + tbl) / 15.0) + 0.35 * least(1.0, (fan_out + svc) / 12.0) + 0.20 * least(1.0, ((fan_in > 0)::INT + (fan_out > 0)::INT + (svc > 0)::INT + (tbl > 0)::INT + (api > 0)::INT + (wf > 0)::INT) / 6.0)), 0)))::BIGINT"
CP = "greatest(1, least(10, round_even(1 + 9 * (0.5 * least(1.0, fan_in / 12.0) + 0.5 * least(1.0, fan_out / 12.0)), 0)))::BIGINT"
def _cx():
    return S.complexity(C("fan_out") + C("svc") + C("tbl"), C("fan_out") + C("svc"), _kinds())


def _cp():
    return S.coupling_10(C("fan_in"), C("fan_out"))

_metric(
    "complexity_score",
    f"{CX} AS complexity",
    lambda: dict(complexity=_cx()),
)
_metric(
    "coupling_1_10",
    f"{CP} AS coupling",
    lambda: dict(coupling=_cp()),
)
INDEX = f"greatest(0.0, least(10.0, 0.35 * {CX} + 0.45 * {CP} + CASE WHEN tbl > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN api > 2 THEN 0.8 ELSE 0.0 END + CASE WHEN fan_in >= 12 THEN 0.8 ELSE 0.0 END))"
def _index():
    return S.risk_index(_cx(), _cp(), C("tbl"), C("api") > 2, C("fan_in"))

_metric(
    "risk_health",
    f"ROUND(({INDEX})::DOUBLE, 2) AS risk_index, CASE WHEN ROUND(({INDEX})::DOUBLE, 6) >= 6.5 THEN 'High' WHEN ROUND(({INDEX})::DOUBLE, 6) >= 3.5 THEN 'Medium' ELSE 'Low' END AS risk",
    lambda: dict(risk_index=F.round(_index(), 2), risk=S.risk_of_index(F.round(_index(), 6))),
)
_metric(
    "flow_scores",
    """greatest(1, least(10, round_even(1 + 9 * (0.5 * least(1.0, fan_in / 25.0) + 0.3 * least(1.0, fan_out / 25.0) + 0.2 * least(1.0, wf / 8.0)), 0)))::BIGINT AS flow_complexity,
    greatest(1, least(10, round_even(1 + 9 * (0.5 * least(1.0, wf / 8.0) + 0.5 * least(1.0, tbl / 10.0)), 0)))::BIGINT AS flow_coupling""",
    lambda: dict(flow_complexity=S.flow_complexity(C("fan_in"), C("fan_out"), C("wf")), flow_coupling=S.flow_coupling(C("wf"), C("tbl"))),
)
_metric(
    "recommendations",
    f"""array_to_string(CASE WHEN (fan_out * 4 >= 12) OR (fan_out * 5 >= 15) OR (fan_in * 4 >= 12) OR (wf >= 3 AND tbl >= 3) OR svc >= 2 THEN list_filter([CASE WHEN fan_out * 4 >= 12 THEN 'split_responsibilities' END, CASE WHEN fan_out * 5 >= 15 THEN 'reduce_dependencies' END,
    CASE WHEN fan_in * 4 >= 12 THEN 'add_abstraction' END, CASE WHEN wf >= 3 AND tbl >= 3 THEN 'improve_cohesion' END, CASE WHEN svc >= 2 THEN 'isolate_writes' END], lambda x: x IS NOT NULL)
    ELSE [CASE WHEN {CP} >= 8 THEN 'reduce_coupling' WHEN api = 0 THEN 'no_action' ELSE 'monitor' END] END, ',') AS codes""",
    lambda: dict(codes=F.array_join(S.recommendations(C("fan_in") * 4, C("fan_out") * 4, C("fan_out") * 5, C("wf"), C("tbl"), C("svc"), _cp(), F.when(C("api") == 0, "Low").otherwise("High")), ",")),
)
FAIL = "(LEAST(100, floor(greatest(0.0, least(100.0, 100 * (0.35 * least(1.0, tbl / 7.0) + 0.25 * least(1.0, fan_in * 20 / 100.0) + 0.2 * least(1.0, fan_out * 20 / 100.0) + 0.12 * least(1.0, cp / 3.0) + 0.08 * least(1.0, wf / 5.0) + 0.05 * least(1.0, api / 10.0)))) + 1e-9)::BIGINT + CASE WHEN cp >= 2 THEN 8 ELSE 0 END))"
def _fail():
    return S.failure_probability(C("tbl") / 7, C("fan_in") * 20, C("cp"), C("fan_out") * 20, C("wf"), C("api"))

_metric(
    "failure_probability",
    f"{FAIL} AS failure, floor(greatest(0.0, least(100.0, {FAIL} * 0.7 + (tbl / 7.0) * 20)) + 1e-9)::BIGINT AS degradation",
    lambda: dict(failure=_fail(), degradation=S.degradation_probability(_fail(), C("tbl") / 7)),
)
_metric(
    "recovery_complexity",
    "CASE WHEN p >= 12 THEN 'CRITICAL' WHEN p >= 9 THEN 'HIGH' WHEN p >= 6 THEN 'MEDIUM' ELSE 'LOW' END AS recovery FROM (SELECT id, least(5, floor((fan_in + fan_out) * 3 / 4)) + least(5, 2 * cp) + least(4, wf) + least(3, svc) AS p FROM metrics) AS q, (SELECT 1) AS one --",
    lambda: dict(recovery=S.recovery_complexity(DEP() * 3, C("cp"), C("wf"), C("svc"))),
)
_metric(
    "deployment_safety",
    f"""CASE WHEN api = 0 AND {FAIL} >= 60 THEN 'BLOCK_DEPLOYMENT' WHEN {FAIL} >= 80 OR tbl / 7.0 >= 0.8 THEN 'ROLLBACK_REQUIRED' WHEN {FAIL} >= 60 THEN 'CANARY_REQUIRED' WHEN {FAIL} >= 35 THEN 'FEATURE_FLAG_RECOMMENDED' ELSE 'SAFE_TO_DEPLOY' END AS safety,
    CASE WHEN {FAIL} >= 90 THEN 'CRITICAL' WHEN {FAIL} >= 75 THEN 'FAIL' WHEN {FAIL} >= 60 THEN 'HIGH_RISK' WHEN {FAIL} >= 40 THEN 'MEDIUM_RISK' WHEN {FAIL} >= 20 THEN 'LOW_RISK' ELSE 'SAFE' END AS class,
    CASE WHEN {FAIL} >= 85 AND wf >= 2 THEN 'FAIL' WHEN {FAIL} >= 65 THEN 'DEGRADED' WHEN {FAIL} >= 40 THEN 'HIGH_RISK' WHEN {FAIL} >= 20 THEN 'MEDIUM_RISK' ELSE 'SAFE' END AS service_class,
    CASE WHEN {FAIL} >= 85 AND wf >= 2 THEN 'FAIL' WHEN {FAIL} >= 60 THEN 'DEGRADED' WHEN {FAIL} >= 40 THEN 'HIGH_RISK' WHEN {FAIL} >= 20 THEN 'MEDIUM_RISK' ELSE 'SAFE' END AS journey_class,
    CASE WHEN {FAIL} >= 85 OR tbl / 8.0 >= 0.85 THEN 'FAIL' WHEN {FAIL} >= 65 OR tbl / 8.0 >= 0.7 THEN 'HIGH_RISK' WHEN {FAIL} >= 45 OR tbl / 8.0 >= 0.55 THEN 'MEDIUM_RISK' WHEN {FAIL} >= 25 THEN 'LOW_RISK' ELSE 'SAFE' END AS workflow_class""",
    lambda: dict(safety=S.deployment_safety(_fail(), C("tbl") / 7, F.when(C("api") == 0, "delete").otherwise("modify")), **{"class": S.failure_class(_fail())}, service_class=S.service_failure_class(_fail(), C("wf")), journey_class=S.journey_failure_class(_fail(), C("wf")), workflow_class=S.workflow_failure_class(C("tbl") / 8, _fail())),
)
NS = "CASE node_type WHEN 'api_route' THEN 1.0 WHEN 'class' THEN 0.75 WHEN 'method' THEN 0.65 WHEN 'function' THEN 0.55 ELSE 0.45 END + CASE WHEN regexp_matches(name, '(?i)main\\.py|app\\.py|router|middleware|config|settings|connect|analyze') THEN 0.15 ELSE 0.0 END + CASE WHEN regexp_matches(name, '(?i)auth|login|session|token|oauth|password') THEN 0.12 ELSE 0.0 END + CASE WHEN regexp_matches(name, '(?i)database|db|sql|postgres|model|migration') THEN 0.08 ELSE 0.0 END"
_metric(
    "node_score",
    f"ROUND(least(1.0, ({NS}) * greatest(0.2, 1 - wf / 4.0 * 0.5))::DOUBLE, 2) AS score",
    lambda: dict(score=F.round(S.node_score(C("node_type"), C("name"), C("wf"), F.lit(4)), 2)),
)
OV = "floor(least(100.0, least(30, 10 * api) * 0.3 + least(20, 2 * fan_in) * 0.2 + least(20, 4 * wf) * 0.1 + (CASE WHEN jr = 1 THEN 0.4 ELSE 0.0 END + CASE WHEN tbl > 3 THEN 0.25 ELSE 0.0 END + CASE WHEN cp = 2 THEN 0.35 ELSE 0.0 END) * 40) + 1e-9)::BIGINT"
_metric(
    "overall_impact",
    f"(CASE WHEN fan_in = 0 AND api = 0 THEN least(25, CASE WHEN api >= 3 THEN least(100, {OV} + 10) ELSE {OV} END) WHEN api >= 3 THEN least(100, {OV} + 10) ELSE {OV} END)::BIGINT AS score",
    lambda: dict(score=S.overall_impact(C("api"), C("fan_in"), C("wf"), C("jr") == 1, C("tbl") > 3, C("cp") == 2)),
)
_metric(
    "discovery_confidence",
    """ROUND(greatest(0.55, least(0.98, 0.95 * (0.30 * least(1.0, tbl * 3 / 20.0) + 0.30 * least(1.0, fan_in / greatest(tbl * 3, 1)::DOUBLE) + 0.20 * least(1.0, api / 3.0) + 0.10 * CASE WHEN wf + svc <= 3 THEN 1.0 ELSE greatest(0.4, 3.0 / (wf + svc)) END
    + 0.10 * least(1.0, cp / greatest(1.0, tbl * 3 * 0.5))) + 0.05))::DOUBLE + 1e-9, 4) AS confidence""",
    lambda: dict(confidence=S.discovery_confidence(C("tbl") * 3, C("fan_in"), C("api"), C("wf") + C("svc"), C("cp"))),
)


@query("graph_health", f"WITH {WHOLE}, s AS (SELECT (SELECT count(DISTINCT type) FROM edges) AS types, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges) SELECT types, nodes, edges, ROUND(edges / nodes, 2) AS density, ROUND(40 * least(1.0, types / 15.0) + 40 * least(1.0, ROUND(edges / nodes, 2) / 5) + 20 * least(1.0, edges / 800.0), 2) AS score FROM s")
def graph_health(spark, d):
    return analytics.graph_health(order_graph(spark, d))


@query("density", f"WITH {WHOLE}, s AS (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS m) SELECT n AS node_count, m AS edge_count, ROUND(m / (n * (n - 1)), 8) AS density FROM s")
def density(spark, d):
    return order_graph(spark, d).statistics().withColumn("density", F.round("density", 8))


@query(
    "architecture_health",
    f"""WITH {DEGREES}, s AS (SELECT count(*) AS n, sum((fan_out > 10)::INT) AS wide, avg(fan_in * fan_out) AS bt, sum((fan_in * fan_out > 50)::INT) AS tight FROM degrees), t AS (SELECT s.*, (SELECT count(*) FROM edges) AS m, (SELECT count(*) FROM nodes WHERE node_type = 'api_route') AS apis FROM s),
    u AS (SELECT greatest(0, least(100, floor(100 - (10 * m / n + 20 * apis / n) + 1e-9)))::BIGINT AS complexity_score, greatest(0, least(100, floor(100 - 5 * m / n + 1e-9)))::BIGINT AS coupling_score,
    greatest(0, least(100, floor(100 - (1000 * (m / (n * (n - 1))) + 500 * wide / n) + 1e-9)))::BIGINT AS maintainability_score, greatest(0, least(100, floor(100 - (2 * bt + 200 * tight / n) + 1e-9)))::BIGINT AS risk_score FROM t),
    v AS (SELECT *, floor((complexity_score + coupling_score + maintainability_score + risk_score) / 4)::BIGINT AS overall_score FROM u)
    SELECT *, CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 75 THEN 'Healthy' WHEN overall_score >= 60 THEN 'Moderate Risk' WHEN overall_score >= 40 THEN 'High Risk' ELSE 'Critical' END AS health FROM v""",
)
def architecture_health(spark, d):
    return analytics.architecture_health(order_graph(spark, d))


@query("hotspots", f"WITH {DEGREES} SELECT id, level FROM (SELECT id, CASE WHEN fan_out * 6 > 15 THEN 'High Risk' WHEN fan_in * 6 > 25 THEN 'Moderate Risk' WHEN fan_in * fan_out * 36 > 100 THEN 'Critical' END AS level FROM degrees) WHERE level IS NOT NULL ORDER BY CASE level WHEN 'Critical' THEN 4 WHEN 'High Risk' THEN 3 ELSE 2 END DESC, id LIMIT 15")
def hotspots(spark, d):
    g = order_graph(spark, d)
    six = g.edges.crossJoin(spark.range(6).select(F.lit(1).alias("k"))).drop("k")  # six parallel edges for each
    return analytics.hotspots(type(g)(g.nodes, six))


@query("dependency_risk", f"""WITH {WHOLE}, b AS (SELECT src, count(*) FILTER (node_type = 'function') AS f, count(*) FILTER (node_type = 'api_route') AS a, count(*) FILTER (node_type = 'database_table') AS t FROM edges JOIN nodes ON dst = id GROUP BY 1)
 SELECT src, f AS functions, a AS apis, t AS tables, CASE WHEN 5*f + 10*a + 2*t > 50 THEN 'critical' WHEN 5*f + 10*a + 2*t > 20 THEN 'high' WHEN 5*f + 10*a + 2*t > 5 THEN 'medium' ELSE 'low' END AS risk FROM b""")
def dependency_risk(spark, d):
    g = order_graph(spark, d)
    n = lambda k: F.sum((C("node_type") == k).cast("long"))
    b = g.edges.join(g.nodes.select(C("id").alias("dst"), "node_type"), "dst").groupBy("src").agg(n("function").alias("functions"), n("api_route").alias("apis"), n("database_table").alias("tables"))
    return b.withColumn("risk", S.bucket_risk(C("functions"), C("apis"), C("tables")))


@query("risk_history", "SELECT p_partkey AS id, CASE WHEN p_partkey % 7 > 0 THEN p_size::BIGINT END AS old_score, (p_size + p_partkey % 2)::BIGINT AS new_score FROM part WHERE p_partkey % 7 = 0 OR p_partkey % 2 = 1")
def risk_history(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_partkey % 7 > 0").select(C("p_partkey").alias("id"), C("p_size").cast("long").alias("risk_score"))
    return analytics.risk_history(old, p.select(C("p_partkey").alias("id"), (C("p_size") + C("p_partkey") % 2).cast("long").alias("risk_score")))


@query("critical_paths_hit", "WITH steps AS (SELECT DISTINCT l_orderkey AS path_id, l_partkey AS id FROM lineitem) SELECT path_id, count(*) AS n_hit FROM steps WHERE id IN (SELECT p_partkey FROM part WHERE p_size = 5) GROUP BY 1")
def critical_paths_hit(spark, d):
    paths = table(spark, d, "lineitem").groupBy(C("l_orderkey").alias("path_id")).agg(F.collect_list("l_partkey").alias("nodes"))
    return analytics.critical_paths_hit(paths, table(spark, d, "part").where("p_size = 5").select(C("p_partkey").alias("id")))


@query("related_workflows", f"WITH {WHOLE}, own AS (SELECT id FROM nodes WHERE file = 'Brand#1'), near AS (SELECT id FROM own UNION SELECT dst FROM edges WHERE src IN (FROM own) UNION SELECT src FROM edges WHERE dst IN (FROM own)) SELECT DISTINCT file AS workflow FROM nodes WHERE id IN (FROM near) AND file <> 'Brand#1' ORDER BY 1 LIMIT 8")
def related_workflows(spark, d):
    g = order_graph(spark, d)
    return analytics.related_workflows(g.nodes.select("id", C("file").alias("workflow")), g.edges, "Brand#1")


@query("journeys_hit", "SELECT CASE WHEN p_size = 7 THEN 'user_login' ELSE p_type END AS journey, count(DISTINCT p_brand) AS n_hit, CASE WHEN count(DISTINCT p_brand) >= 2 OR max(p_size = 7) THEN 'high' ELSE 'medium' END AS severity FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') GROUP BY 1")
def journeys_hit(spark, d):
    journeys = table(spark, d, "part").select(F.when(C("p_size") == 7, "user_login").otherwise(C("p_type")).alias("journey"), C("p_brand").alias("workflow"))
    return analytics.journeys_hit(journeys, spark.createDataFrame([("Brand#1",), ("Brand#2",), ("Brand#3",)], "workflow string"))
