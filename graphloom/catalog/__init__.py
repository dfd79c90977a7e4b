"""Queries over the driver's tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

KIND = "['CALLS','IMPORTS','USES','INHERITS'][((src + dst) % 4 + 1)::INT] AS type"
FOLLOWERS = """followers AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, a.l_orderkey AS o, b.l_linenumber AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey)"""
ALL_EDGES = f"{FOLLOWERS}, edges AS (SELECT DISTINCT src, dst, {KIND} FROM followers)"
EDGES = f"""{FOLLOWERS}, firsts AS (SELECT DISTINCT ON (src) src, dst FROM followers ORDER BY src, o, n, dst), lasts AS (SELECT DISTINCT ON (src) src, dst FROM followers ORDER BY src, o DESC, n DESC, dst DESC),
 edges AS MATERIALIZED (SELECT src, dst, {KIND} FROM (SELECT * FROM firsts UNION SELECT * FROM lasts))"""
NODES = """nodes AS (SELECT p_partkey AS id, p_name AS name, p_brand || '.' || p_name || '.' || p_partkey AS qualified_name, ['function','class','api_route','service','database_table'][p_size % 5 + 1] AS node_type,
 p_brand AS file, p_type AS package, p_size::BIGINT AS size, p_retailprice AS price FROM part)"""
GRAPH = f"{EDGES}, {NODES}"
WHOLE = f"{ALL_EDGES}, {NODES}"
DEGREES = f"""{WHOLE}, ins AS (SELECT dst AS id, count(*) AS fan_in FROM edges GROUP BY 1), outs AS (SELECT src AS id, count(*) AS fan_out FROM edges GROUP BY 1),
 degrees AS (SELECT id, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::BIGINT AS fan_out FROM nodes LEFT JOIN ins USING (id) LEFT JOIN outs USING (id))"""
METRICS = f"""{DEGREES}, metrics AS (SELECT id, name, node_type, fan_in, fan_out, size % 4 AS wf, size % 3 AS svc, id % 3 AS cp, id % 5 AS api, id % 2 AS jr, size % 7 AS tbl FROM degrees JOIN nodes USING (id))"""
PAIRS = f"""{GRAPH}, walks(target, affected, depth) AS (SELECT dst, src, 1 FROM edges UNION SELECT w.target, e.src, w.depth + 1 FROM walks w JOIN edges e ON e.dst = w.affected WHERE w.depth < 8 AND e.src <> w.target),
 pairs AS (SELECT DISTINCT target, affected FROM walks)"""


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql.strip()
        return f

    return register


def load() -> tuple[dict, dict]:
    from . import analytics, building, graphs, lookups, relational, reports, symbols  # noqa: F401

    return QUERIES, ORACLES
