"""The query tree: each node compiles to a DataFrame over those of its children; Catalyst takes the rest."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..operators import traversal
from . import expressions as X


class Context:
    """What leaves of a query read: a graph, and further tables by name."""

    def __init__(self, graph: Graph | None = None, tables: dict[str, DataFrame] | None = None):
        self.graph, self.tables = graph, dict(tables or {})
        if graph is not None:
            self.tables.setdefault("nodes", graph.nodes)
            self.tables.setdefault("edges", graph.edges)


class Query:
    def compile(self, at: Context) -> DataFrame:
        raise NotImplementedError


@dataclass(frozen=True)
class Table(Query):
    name: str = "nodes"

    def compile(self, at):
        if self.name not in at.tables:
            raise ValueError(f"unknown table: {self.name}")
        return at.tables[self.name]


@dataclass(frozen=True)
class Lookup(Query):
    reference: X.Reference

    def compile(self, at):
        nodes = at.tables["nodes"]
        return nodes.where(self.reference.column(nodes))


@dataclass(frozen=True)
class Expand(Query):
    """Nodes within reach of the child's nodes, at their least depth."""

    child: Query
    direction: str = "OUTGOING"
    types: tuple = ()
    node_types: tuple = ()
    min_depth: int = 1
    max_depth: int = 1

    def compile(self, at):
        starts = self.child.compile(at).select(F.lit(0).alias("source"), F.col("id").alias("node"))
        found = traversal.walk(at.graph.directed(self.direction, list(self.types) or None), starts, self.max_depth).where(F.col("depth") >= self.min_depth)
        out = at.tables["nodes"].join(found.select(F.col("node").alias("id"), "depth"), "id")
        return out.where(F.col("node_type").isin(*self.node_types)) if self.node_types else out


@dataclass(frozen=True)
class Filter(Query):
    child: Query
    predicate: X.Expr

    def compile(self, at):
        df, p = self.child.compile(at), self.predicate
        ends = lambda r: at.graph.directed(r.direction, [r.type] if r.type else None).select(F.col("at").alias("id")).distinct()
        if isinstance(p, X.Related):
            return df.join(ends(p), "id", "left_semi")
        columns = df.columns
        for r in sorted(X.related_in(p), key=lambda r: r.flag):
            # One row for each node that has such an edge: a flag that conditions can combine.
            df = df.join(ends(r).withColumn(r.flag, F.lit(True)), "id", "left").withColumn(r.flag, F.coalesce(r.flag, F.lit(False)))
        return df.where(p.column(df)).select(*columns)


@dataclass(frozen=True)
class Project(Query):
    """Named columns, or expressions by name; none keeps all. Aliases rename."""

    child: Query
    fields: tuple = ()
    aliases: dict = field(default_factory=dict)
    computed: dict = field(default_factory=dict)

    def compile(self, at):
        df = self.child.compile(at)
        names = self.fields or tuple(df.columns)
        return df.select(*(F.col(n).alias(self.aliases.get(n, n)) for n in names), *(e.column(df).alias(n) for n, e in self.computed.items()))


@dataclass(frozen=True)
class Aggregate(Query):
    """COUNT, SUM, AVG, MIN, MAX of an expression by keys; measures are (function, expression or None, alias or None)."""

    child: Query
    measures: tuple
    keys: tuple = ()

    def compile(self, at):
        df, made = self.child.compile(at), []
        kinds = {"COUNT": F.count, "SUM": F.sum, "AVG": F.avg, "MIN": F.min, "MAX": F.max}
        for name, expression, alias in self.measures:
            if name not in kinds:
                raise ValueError(f"unknown aggregate: {name}")
            inner = F.lit(1) if expression is None else expression.column(df)
            made.append(kinds[name](inner).alias(alias or f"{name.lower()}_val"))
        return (df.groupBy(*self.keys) if self.keys else df).agg(*made)


@dataclass(frozen=True)
class Sort(Query):
    child: Query
    keys: tuple  # (field, ascending, nulls first)

    def compile(self, at):
        order = []
        for name, up, nulls_first in self.keys:
            c = F.col(name)
            order.append((c.asc_nulls_first() if nulls_first else c.asc_nulls_last()) if up else (c.desc_nulls_first() if nulls_first else c.desc_nulls_last()))
        return self.child.compile(at).orderBy(*order)


@dataclass(frozen=True)
class Deduplicate(Query):
    child: Query
    fields: tuple = ()

    def compile(self, at):
        df = self.child.compile(at)
        return df.dropDuplicates(list(self.fields)) if self.fields else df.distinct()


@dataclass(frozen=True)
class Limit(Query):
    child: Query
    limit: int
    offset: int = 0

    def __post_init__(self):
        if self.limit < 0 or self.offset < 0:
            raise ValueError("limit and offset must not be negative")

    def compile(self, at):
        df = self.child.compile(at)
        return (df.offset(self.offset) if self.offset else df).limit(self.limit)


@dataclass(frozen=True)
class Join(Query):
    """INNER, LEFT, RIGHT or FULL on equal keys, or on a predicate over both sides' columns; with an optional strategy."""

    left: Query
    right: Query
    how: str = "INNER"
    on: Any = ()
    strategy: str | None = None

    HINTS = {"HASH": "shuffle_hash", "MERGE": "merge", "BROADCAST": "broadcast", "NESTED_LOOP": None}

    def compile(self, at):
        a, b = self.left.compile(at), self.right.compile(at)
        hint = self.HINTS.get(self.strategy) if self.strategy else None
        b = b.hint(hint) if hint else b
        if isinstance(self.on, X.Expr):
            return a.join(b, self.on.column(a), self.how.lower())
        keys = [(k, k) if isinstance(k, str) else tuple(k) for k in self.on]
        if all(x == y for x, y in keys):
            return a.join(b, [x for x, _ in keys], self.how.lower())
        condition = None
        for x, y in keys:
            condition = (a[x] == b[y]) if condition is None else condition & (a[x] == b[y])
        return a.join(b, condition, self.how.lower())


@dataclass(frozen=True)
class SetOperation(Query):
    """MERGE keeps repeated rows; UNION, INTERSECT and EXCEPT work on sets."""

    op: str
    left: Query
    right: Query

    def compile(self, at):
        a, b = self.left.compile(at), self.right.compile(at)
        made = {"MERGE": a.unionByName, "UNION": lambda x: a.unionByName(x).distinct(), "INTERSECT": a.intersect, "EXCEPT": a.subtract}
        if self.op not in made:
            raise ValueError(f"unknown set operation: {self.op}")
        return made[self.op](b)


class Builder:
    """Builds a query from its leaf upwards; every call gives a new builder."""

    def __init__(self, root: Query | None = None):
        self.root = root

    def _with(self, root: Query) -> Builder:
        return Builder(root)

    def table(self, name: str) -> Builder:
        return self._with(Table(name))

    def lookup(self, kind: str, value: str, method: str | None = None) -> Builder:
        return self._with(Lookup(X.Reference(kind, value, method)))

    def expand(self, **how) -> Builder:
        return self._with(Expand(self.root, **how))

    def filter(self, predicate: X.Expr) -> Builder:
        return self._with(Filter(self.root, predicate))

    def project(self, *fields: str, aliases: dict | None = None, **computed: X.Expr) -> Builder:
        return self._with(Project(self.root, fields, aliases or {}, computed))

    def aggregate(self, *measures: tuple, keys: tuple = ()) -> Builder:
        return self._with(Aggregate(self.root, measures, tuple(keys)))

    def sort(self, name: str, ascending: bool = True, nulls_first: bool = False) -> Builder:
        if isinstance(self.root, Sort):
            return self._with(Sort(self.root.child, (*self.root.keys, (name, ascending, nulls_first))))
        return self._with(Sort(self.root, ((name, ascending, nulls_first),)))

    def deduplicate(self, *fields: str) -> Builder:
        return self._with(Deduplicate(self.root, fields))

    def limit(self, limit: int, offset: int = 0) -> Builder:
        return self._with(Limit(self.root, limit, offset))

    def join(self, other: Builder, on, how: str = "INNER", strategy: str | None = None) -> Builder:
        return self._with(Join(self.root, other.root, how, on, strategy))

    def combine(self, op: str, other: Builder) -> Builder:
        return self._with(SetOperation(op, self.root, other.root))

    def build(self) -> Query:
        if self.root is None:
            raise ValueError("an empty query")
        return self.root


_KINDS = {c.__name__: c for c in (Table, Lookup, Expand, Filter, Project, Aggregate, Sort, Deduplicate, Limit, Join, SetOperation, X.Literal, X.Property, X.Compare, X.Arithmetic, X.Membership, X.And, X.Or, X.Not, X.Equals, X.Between, X.Contains, X.StartsWith, X.EndsWith, X.Exists, X.NodeIs, X.RelationshipIs, X.Attribute, X.Related, X.Reference)}


def to_json(query: Query) -> str:
    def plain(x):
        if dataclasses.is_dataclass(x):
            return {"@": type(x).__name__, **{f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}}
        if isinstance(x, (tuple, list)):
            return [plain(y) for y in x]
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return x

    return json.dumps(plain(query))


def from_json(text: str) -> Query:
    def back(x):
        if isinstance(x, dict) and "@" in x:
            return _KINDS[x["@"]](**{k: back(v) for k, v in x.items() if k != "@"})
        if isinstance(x, list):
            return tuple(back(y) for y in x)
        return {k: back(v) for k, v in x.items()} if isinstance(x, dict) else x

    return back(json.loads(text))


#: Declared shares of rows that predicates keep, for estimates.
SELECTIVITY = {"Equals": 0.05, "Between": 0.25, "Contains": 0.15, "StartsWith": 0.10, "EndsWith": 0.10, "Exists": 0.80, "NodeIs": 0.20, "RelationshipIs": 0.30, "Related": 0.30}


def selectivity(p: X.Expr) -> float:
    if isinstance(p, X.And):
        return max(0.0001, math.prod(map(selectivity, p.parts)))
    if isinstance(p, X.Or):
        return max(0.0001, 1 - math.prod(1 - selectivity(q) for q in p.parts))
    if isinstance(p, X.Not):
        return max(0.0001, 1 - selectivity(p.part))
    if isinstance(p, X.Equals) and p.name in ("id", "node_id", "symbol_id"):
        return 0.001
    return SELECTIVITY.get(type(p).__name__, 0.5)


def estimate(query: Query, nodes: int = 10_000, degree: float = 5.0) -> float:
    """Estimated rows, from declared shares only; Spark plans by its own statistics."""
    e = lambda q: estimate(q, nodes, degree)
    if isinstance(query, Lookup):
        return 1.0
    if isinstance(query, Table):
        return float(nodes)
    if isinstance(query, Join):
        return max(1.0, e(query.left) * e(query.right) * (selectivity(query.on) if isinstance(query.on, X.Expr) else 0.05))
    if isinstance(query, SetOperation):
        return e(query.left) + e(query.right)
    rows = e(query.child)
    if isinstance(query, Expand):
        return rows * degree ** min(query.max_depth, 3)
    if isinstance(query, Filter):
        return rows * selectivity(query.predicate)
    if isinstance(query, Aggregate):
        return min(rows, 20.0) if query.keys else 1.0
    if isinstance(query, Deduplicate):
        return 0.8 * rows
    return min(rows, float(query.limit)) if isinstance(query, Limit) else rows
