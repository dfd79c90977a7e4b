"""Risk, impact and architecture scores as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def cap(x: Column, most) -> Column:
    return F.least(x, F.lit(most))


def share(x: Column, whole: float) -> Column:
    """x / whole, at most 1."""
    return F.least(F.lit(1.0), x / F.lit(float(whole)))


def whole(x: Column) -> Column:
    """Cut to an integer, as for values that aren't negative."""
    return F.floor(x + F.lit(1e-9)).cast("long")


def clamp(x: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def coupling(fan_in: Column, fan_out: Column) -> Column:
    both = fan_in + fan_out
    return F.when(both == 0, 0.0).otherwise(fan_in * fan_out / (both * both))


def risk_level(fan_in: Column, blast: Column) -> Column:
    return F.when((fan_in >= 20) | (blast >= 50), "critical").when((fan_in >= 10) | (blast >= 20), "high").when((fan_in >= 3) | (blast >= 5), "medium").otherwise("low")


def blast_or_fan_in(blast: Column, fan_in: Column) -> Column:
    """The blast radius; where it has not been computed, the number of direct callers."""
    return F.coalesce(blast, fan_in, F.lit(0))


def band(score: Column) -> Column:
    """safe, low, medium, high, critical at 20, 40, 60, 80."""
    return F.when(score <= 20, "safe").when(score <= 40, "low").when(score <= 60, "medium").when(score <= 80, "high").otherwise("critical")


def risk_score_10(blast: Column, fan_in: Column, apis: Column, depth: Column) -> Column:
    """0 to 10 with one digit, which is what the label is of."""
    total = cap(blast / 10, 5.0) + cap(fan_in / 10, 2.0) + cap(apis * 0.5, 2.0) + cap(depth * 0.1, 1.0)
    return F.bround(F.round(total, 9), 1)


def risk_label_10(score: Column) -> Column:
    return F.when(score >= 7.5, "critical").when(score >= 5, "high").when(score >= 2.5, "medium").otherwise("low")


def effort_hours(blast: Column, label: Column) -> Column:
    factor = F.when(label == "critical", 4.0).when(label == "high", 2.5).when(label == "medium", 1.5).otherwise(1.0)
    return F.bround(F.greatest(blast * 0.5, F.lit(0.5)) * factor, 1)


def effort_unit(hours: Column) -> Column:
    """Of hours with one digit, as ``effort_hours`` gives them."""
    return F.when(hours < 2, "minutes").when(hours < 8, "hours").when(hours < 40, "days").otherwise("weeks")


def dependency_count(fan_in: Column, fan_out: Column) -> Column:
    return fan_in + fan_out


def blast_hint(dependencies: Column, workflows: Column, critical_paths: Column, apis: Column) -> Column:
    return cap(2 * dependencies + 5 * workflows + 10 * critical_paths + 8 * apis, 100)


def centrality(fan_in: Column, fan_out: Column, max_in: Column, max_out: Column, workflows: Column, services: Column, critical_paths: Column) -> Column:
    """0 to 100, from degrees relative to the largest ones and what the node takes part in."""
    degree = F.least(F.lit(1.0), 0.55 * fan_in / F.greatest(max_in, F.lit(1)) + 0.45 * fan_out / F.greatest(max_out, F.lit(1)))
    return F.round(100 * (0.40 * degree + 0.20 * share(workflows, 3) + 0.15 * share(services, 2) + 0.25 * share(critical_paths, 2)), 2)


def blast_score(n: Column, workflows: Column, services: Column, apis: Column, critical_paths: Column) -> Column:
    return whole(30 * share(n, 50)) + whole(20 * share(workflows, 5)) + whole(20 * share(services, 4)) + whole(10 * share(apis, 8)) + whole(20 * share(critical_paths, 3))


def profile_risk(dependencies: Column, workflows: Column, services: Column, apis: Column, journeys: Column, central: Column, critical_paths: Column) -> Column:
    depth = clamp(F.floor(dependencies / 2), 1, 10)
    parts = [cap(2 * dependencies + depth, 20), cap(5 * workflows, 15), cap(5 * services, 15), cap(3 * apis, 10), cap(4 * journeys, 10), cap(2 * journeys + services, 10), cap(whole(10 * central), 10), cap(5 * critical_paths, 10)]
    return cap(sum(parts[1:], parts[0]), 100).cast("long")


def context_risk(nodes: Column, depth: Column, workflows: Column, critical_workflows: Column, services: Column, public_apis: Column, internal_apis: Column, journeys: Column, severe_journeys: Column, business: Column, business_points: Column, central: Column, critical_paths: Column, incidents: Column) -> Column:
    """Sum of nine capped factors of one change, at most 100."""
    parts = [cap(2 * nodes + depth, 20), cap(5 * workflows + 2 * critical_workflows, 15), cap(5 * services, 15), cap(2 * public_apis + internal_apis, 10), cap(4 * journeys + 2 * severe_journeys, 10), cap(3 * business + business_points, 10), cap(whole(10 * central), 10), cap(5 * critical_paths, 10), F.when(incidents > 0, 8).otherwise(0)]
    return cap(sum(parts[1:], parts[0]), 100).cast("long")


def repository_risk(dependencies: Column, workflows: Column, services: Column, apis: Column, journeys: Column, mean_central: Column, critical_paths: Column) -> Column:
    """As profile_risk, from the sums over all nodes."""
    parts = [cap(whole(dependencies * 1.2), 20), cap(4 * workflows, 15), cap(4 * services, 15), cap(2 * apis, 10), cap(3 * journeys, 10), cap(2 * journeys + services, 10), cap(whole(10 * mean_central), 10), cap(4 * critical_paths, 10)]
    return cap(sum(parts[1:], parts[0]), 100).cast("long")


#: What the text about a change is searched for, and tags of nodes that had incidents.
AUTH_WORDS = r"(?i)auth|oauth|login|session|token|jwt|github"
DATABASE_WORDS = r"(?i)database|db_|postgres|sqlalchemy|redis|migrate"
CRITICAL_WORDS = r"(?i)main\.py|router|middleware|connect|analyze|oauth"
INCIDENT_TAGS = ("incident", "outage", "hotfix", "production-bug")


def older_risk(depth: Column, apis: Column, functions: Column, files: Column, mean_central: Column, workflows: Column, text: Column, tags: Column, scenario: Column, nodes: Column) -> Column:
    """Capped points of depth, interfaces, functions, files, centrality and workflows; for words in ``text`` and tags (an
    array) of incidents; and 10 for a deletion of more than three nodes."""
    points = [cap(3 * depth, 15), cap(8 * apis, 25), cap(2 * functions, 15), cap(2 * files, 10), cap(whole(15 * mean_central), 13), cap(4 * workflows, 12)]
    for words, worth in ((AUTH_WORDS, 20), (DATABASE_WORDS, 12), (CRITICAL_WORDS, 15)):
        points.append(F.when(text.rlike(words), worth).otherwise(0))
    points.append(F.when(F.arrays_overlap(F.transform(tags, F.lower), F.array(*map(F.lit, INCIDENT_TAGS))), 8).otherwise(0))
    points.append(F.when((scenario == "delete") & (nodes > 3), 10).otherwise(0))
    return cap(sum(points[1:], points[0]), 100).cast("long")


def scenario_risk(scenario: Column, direct: Column, indirect: Column, apis: Column, db: Column, auth: Column, imports: Column) -> Column:
    raw = (
        F.when(scenario == "delete", 5 * direct + 2 * indirect + 10 * apis + 8 * db + 10 * auth)
        .when(scenario == "modify", 3 * direct + indirect + 6 * apis + 5 * db)
        .when(scenario == "rename", 2 * direct + 5 * apis)
        .when(scenario == "move", 3 * direct + 5 * imports)
        .otherwise(5 * direct + 10 * apis)
    )
    return clamp(raw, 0, 100).cast("long")


def scenario_direction(scenario: Column, direction: Column) -> Column:
    """Deleting looks upstream; a refactoring that asks for both ways looks downstream."""
    return F.when(scenario == "delete", "upstream").when((scenario == "refactor") & (direction == "both"), "downstream").otherwise(direction)


def _one_to_ten(x: Column) -> Column:
    return clamp(F.bround(x), 1, 10).cast("long")


def complexity(dependencies: Column, fan_out: Column, kinds: Column) -> Column:
    return _one_to_ten(1 + 9 * (0.45 * share(dependencies, 15) + 0.35 * share(fan_out, 12) + 0.20 * share(kinds, 6)))


def coupling_10(fan_in: Column, fan_out: Column, central: Column | None = None) -> Column:
    raw = 0.5 * share(fan_in, 12) + 0.5 * share(fan_out, 12)
    return _one_to_ten(1 + 9 * (raw if central is None else 0.65 * raw + 0.35 * central / 100))


def risk_index(complex_: Column, coupled: Column, writes: Column, external: Column, fan_in: Column) -> Column:
    bonus = F.when(writes > 0, 1.0).otherwise(0.0) + F.when(external, 0.8).otherwise(0.0) + F.when(fan_in >= 12, 0.8).otherwise(0.0)
    return clamp(0.35 * complex_ + 0.45 * coupled + bonus, 0.0, 10.0)


def risk_of_index(index: Column) -> Column:
    return F.when(index >= 6.5, "High").when(index >= 3.5, "Medium").otherwise("Low")


def flow_complexity(edges: Column, nodes: Column, critical: Column) -> Column:
    return _one_to_ten(1 + 9 * (0.5 * share(edges, 25) + 0.3 * share(nodes, 25) + 0.2 * share(critical, 8)))


def flow_coupling(critical: Column, dependencies: Column) -> Column:
    return _one_to_ten(1 + 9 * (0.5 * share(critical, 8) + 0.5 * share(dependencies, 10)))


def recommendations(fan_in: Column, fan_out: Column, dependencies: Column, services: Column, tables: Column, writes: Column, coupled: Column, risk: Column) -> Column:
    """Codes of what to do, by thresholds; one general code where none applies."""
    found = F.array_compact(
        F.array(
            F.when(fan_out >= 12, "split_responsibilities"),
            F.when(dependencies >= 15, "reduce_dependencies"),
            F.when(fan_in >= 12, "add_abstraction"),
            F.when((services >= 3) & (tables >= 3), "improve_cohesion"),
            F.when(writes >= 2, "isolate_writes"),
        )
    )
    general = F.when(coupled >= 8, "reduce_coupling").when(risk == "Low", "no_action").otherwise("monitor")
    return F.when(F.size(found) > 0, found).otherwise(F.array(general))


def graph_health(types: Column, nodes: Column, edges: Column) -> Column:
    density = F.when(nodes > 0, F.round(edges / nodes, 2)).otherwise(0.0)
    return F.round(40 * share(types, 15) + 40 * share(density, 5) + 20 * share(edges, 800), 2)


def bucket_risk(functions: Column, apis: Column, tables: Column) -> Column:
    points = 5 * functions + 10 * apis + 2 * tables
    return F.when(points > 50, "critical").when(points > 20, "high").when(points > 5, "medium").otherwise("low")


def node_score(node_type: Column, text: Column, depth: Column, max_depth: Column) -> Column:
    """0 to 1 for the colour of a node, from its type, its name and its distance."""
    from .text import AUTH, CRITICAL, DATABASE

    weight = F.when(node_type == "api_route", 1.0).when(node_type == "class", 0.75).when(node_type == "method", 0.65).when(node_type == "function", 0.55).otherwise(0.45)
    bonus = F.when(text.rlike(CRITICAL), 0.15).otherwise(0.0) + F.when(text.rlike(AUTH), 0.12).otherwise(0.0) + F.when(text.rlike(DATABASE), 0.08).otherwise(0.0)
    factor = F.greatest(F.lit(0.2), 1 - depth / F.greatest(max_depth, F.lit(1)) * 0.5)
    return F.round(F.least(F.lit(1.0), (weight + bonus) * factor), 3)


def overall_impact(apis: Column, functions: Column, depth: Column, auth: Column, db: Column, critical: Column) -> Column:
    """0 to 100 from what a change reaches; flags tell whether names of these kinds are among it."""
    flags = F.when(auth, 0.4).otherwise(0.0) + F.when(db, 0.25).otherwise(0.0) + F.when(critical, 0.35).otherwise(0.0)
    raw = whole(F.least(F.lit(100.0), cap(10 * apis, 30) * 0.3 + cap(2 * functions, 20) * 0.2 + cap(4 * depth, 20) * 0.1 + flags * 40))
    raised = F.when(apis >= 3, cap(raw + 10, 100)).otherwise(raw)
    return F.when((functions == 0) & (apis == 0), cap(raised, 25)).otherwise(raised).cast("long")


def failure_probability(risk: Column, blast: Column, critical_paths: Column, central: Column, workflows: Column, apis: Column) -> Column:
    raw = 0.35 * F.least(F.lit(1.0), risk) + 0.25 * share(blast, 100) + 0.2 * share(central, 100) + 0.12 * share(critical_paths, 3) + 0.08 * share(workflows, 5) + 0.05 * share(apis, 10)
    p = whole(clamp(raw * 100, 0.0, 100.0))
    return F.when(critical_paths >= 2, cap(p + 8, 100)).otherwise(p).cast("long")


def degradation_probability(failure: Column, risk: Column) -> Column:
    return whole(clamp(failure * 0.7 + risk * 20, 0.0, 100.0))


def recovery_complexity(dependencies: Column, critical_paths: Column, workflows: Column, services: Column) -> Column:
    points = cap(F.floor(dependencies / 4), 5) + cap(2 * critical_paths, 5) + cap(workflows, 4) + cap(services, 3)
    return F.when(points >= 12, "CRITICAL").when(points >= 9, "HIGH").when(points >= 6, "MEDIUM").otherwise("LOW")


def deployment_safety(failure: Column, risk: Column, scenario: Column) -> Column:
    return (
        F.when((scenario == "delete") & (failure >= 60), "BLOCK_DEPLOYMENT")
        .when((failure >= 80) | (risk >= 0.8), "ROLLBACK_REQUIRED")
        .when(failure >= 60, "CANARY_REQUIRED")
        .when(failure >= 35, "FEATURE_FLAG_RECOMMENDED")
        .otherwise("SAFE_TO_DEPLOY")
    )


def failure_class(p: Column) -> Column:
    return F.when(p >= 90, "CRITICAL").when(p >= 75, "FAIL").when(p >= 60, "HIGH_RISK").when(p >= 40, "MEDIUM_RISK").when(p >= 20, "LOW_RISK").otherwise("SAFE")


def workflow_failure_class(confidence: Column, p: Column) -> Column:
    return F.when((p >= 85) | (confidence >= 0.85), "FAIL").when((p >= 65) | (confidence >= 0.7), "HIGH_RISK").when((p >= 45) | (confidence >= 0.55), "MEDIUM_RISK").when(p >= 25, "LOW_RISK").otherwise("SAFE")


def service_failure_class(p: Column, workflows: Column) -> Column:
    return F.when((p >= 85) & (workflows >= 2), "FAIL").when(p >= 65, "DEGRADED").when(p >= 40, "HIGH_RISK").when(p >= 20, "MEDIUM_RISK").otherwise("SAFE")


def journey_failure_class(p: Column, workflows: Column) -> Column:
    return F.when((p >= 85) & (workflows >= 2), "FAIL").when(p >= 60, "DEGRADED").when(p >= 40, "HIGH_RISK").when(p >= 20, "MEDIUM_RISK").otherwise("SAFE")


def discovery_confidence(nodes: Column, inner_edges: Column, apis: Column, folders: Column, name_hits: Column) -> Column:
    n = F.greatest(nodes, F.lit(1))
    folder = F.when(folders <= 3, 1.0).otherwise(F.greatest(F.lit(0.4), 3.0 / folders))
    raw = 0.30 * share(nodes, 20) + 0.30 * F.least(F.lit(1.0), inner_edges / n) + 0.20 * share(apis, 3) + 0.10 * folder + 0.10 * F.least(F.lit(1.0), name_hits / F.greatest(F.lit(1.0), nodes * 0.5))
    # Halves go up, whatever the last bit of the sum is.
    return F.round(clamp(raw * 0.95 + 0.05, 0.55, 0.98) + 1e-9, 4)


def hotspot(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_out > 15, "High Risk").when(fan_in > 25, "Moderate Risk").when(fan_in * fan_out > 100, "Critical")


def severity(level: Column) -> Column:
    return F.when(level == "Critical", 4).when(level == "High Risk", 3).when(level == "Moderate Risk", 2).otherwise(1)


def health_band(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 75, "Healthy").when(score >= 60, "Moderate Risk").when(score >= 40, "High Risk").otherwise("Critical")
