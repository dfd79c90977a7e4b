"""Predicates and expressions as small data classes that become columns."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Expr:
    """Anything that ``column(df)`` turns into a column of a table."""

    def column(self, df: DataFrame) -> Column:
        raise NotImplementedError


def _of(x: Any, df: DataFrame) -> Column:
    return x.column(df) if isinstance(x, Expr) else F.lit(x)


@dataclass(frozen=True)
class Literal(Expr):
    value: Any

    def column(self, df):
        return F.lit(self.value)


@dataclass(frozen=True)
class Property(Expr):
    """A column, or with dots a field of a struct or an entry of a map."""

    name: str

    def column(self, df):
        return F.col(self.name)


@dataclass(frozen=True)
class Compare(Expr):
    op: str
    left: Any
    right: Any

    def column(self, df):
        a, b = _of(self.left, df), _of(self.right, df)
        made = {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}
        if self.op not in made:
            raise ValueError(f"unknown comparison: {self.op}")
        return made[self.op]


@dataclass(frozen=True)
class Arithmetic(Expr):
    op: str
    left: Any
    right: Any

    def column(self, df):
        a, b = _of(self.left, df), _of(self.right, df)
        if self.op == "/":
            return F.try_divide(a, b)
        made = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b}
        if self.op not in made:
            raise ValueError(f"unknown arithmetic: {self.op}")
        return made[self.op]()


@dataclass(frozen=True)
class Membership(Expr):
    """IN for a value in a list; CONTAINS_ANY and CONTAINS_ALL for an array and a list."""

    op: str
    target: Expr
    values: tuple

    def column(self, df):
        target, values = _of(self.target, df), F.array(*map(F.lit, self.values))
        if self.op == "IN":
            return target.isin(*self.values)
        if self.op == "CONTAINS_ANY":
            return F.arrays_overlap(target, values)
        if self.op == "CONTAINS_ALL":
            return F.size(F.array_except(values, target)) == 0
        raise ValueError(f"unknown membership: {self.op}")


@dataclass(frozen=True)
class And(Expr):
    parts: tuple = ()

    def column(self, df):
        return reduce(Column.__and__, (p.column(df) for p in self.parts), F.lit(True))


@dataclass(frozen=True)
class Or(Expr):
    parts: tuple = ()

    def column(self, df):
        return reduce(Column.__or__, (p.column(df) for p in self.parts), F.lit(False))


@dataclass(frozen=True)
class Not(Expr):
    part: Expr

    def column(self, df):
        return ~self.part.column(df)


@dataclass(frozen=True)
class Equals(Expr):
    name: str
    value: Any = None

    def column(self, df):
        return F.col(self.name).isNull() if self.value is None else F.col(self.name) == F.lit(self.value)


@dataclass(frozen=True)
class Between(Expr):
    """Both ends belong to the range; either may be left open."""

    name: str
    low: Any = None
    high: Any = None

    def column(self, df):
        out = F.lit(True)
        if self.low is not None:
            out = out & (F.col(self.name) >= F.lit(self.low))
        return out if self.high is None else out & (F.col(self.name) <= F.lit(self.high))


@dataclass(frozen=True)
class Contains(Expr):
    """Part of a string, or an element of an array."""

    name: str
    value: Any

    def column(self, df):
        if isinstance(df.select(self.name).schema[0].dataType, T.ArrayType):
            return F.array_contains(self.name, F.lit(self.value))
        return F.col(self.name).contains(self.value)


@dataclass(frozen=True)
class StartsWith(Expr):
    name: str
    value: str

    def column(self, df):
        return F.col(self.name).startswith(self.value)


@dataclass(frozen=True)
class EndsWith(Expr):
    name: str
    value: str

    def column(self, df):
        return F.col(self.name).endswith(self.value)


@dataclass(frozen=True)
class Exists(Expr):
    """A column that isn't null; with a key, an entry of a map column."""

    name: str
    key: str | None = None

    def column(self, df):
        return F.col(self.name).isNotNull() if self.key is None else F.coalesce(F.map_contains_key(self.name, F.lit(self.key)), F.lit(False))


@dataclass(frozen=True)
class NodeIs(Expr):
    node_type: str | None = None
    inner: Expr | None = None

    def column(self, df):
        out = F.lit(True) if self.node_type is None else F.col("node_type") == self.node_type
        return out if self.inner is None else out & self.inner.column(df)


@dataclass(frozen=True)
class RelationshipIs(Expr):
    """For tables of edges or steps."""

    type: str | None = None

    def column(self, df):
        return F.lit(True) if self.type is None else F.col("type") == self.type


@dataclass(frozen=True)
class Attribute(Expr):
    """An entry of the attribute map, compared."""

    name: str
    op: str
    value: Any

    def column(self, df):
        return Compare(self.op, Property(f"attributes.{self.name}"), self.value).column(df)


@dataclass(frozen=True)
class Related(Expr):
    """For nodes: an edge of a type (or any) goes out of it, comes in, or either. A filter makes the column that it reads."""

    type: str | None = None
    direction: str = "OUTGOING"

    @property
    def flag(self) -> str:
        return f"_related_{self.type}_{self.direction}"

    def column(self, df):
        if self.flag not in df.columns:
            raise ValueError("a relationship predicate belongs in a filter")
        return F.col(self.flag)


def related_in(expr) -> set[Related]:
    """The relationship predicates anywhere in an expression."""
    if isinstance(expr, Related):
        return {expr}
    inner = expr if isinstance(expr, (list, tuple)) else vars(expr).values() if isinstance(expr, Expr) else ()
    return set().union(*map(related_in, inner))


@dataclass(frozen=True)
class Reference:
    """What addresses nodes: a kind, and an id, a name, a qualified name or a route."""

    kind: str
    value: str
    method: str | None = None

    #: Kind of reference to node type; kinds without one address by another column.
    NODE_TYPES = {"function": "function", "class": "class", "method": "method", "interface": "interface", "service": "service", "api": "api_route", "route": "api_route", "module": "module"}
    COLUMNS = {"file": "file", "folder": "file", "package": "package", "namespace": "namespace", "repository": "repository"}

    def column(self, df: DataFrame) -> Column:
        if self.kind == "folder":
            return F.col("file").startswith(self.value.rstrip("/") + "/")
        if self.kind in self.COLUMNS:
            return F.col(self.COLUMNS[self.kind]) == self.value
        if self.kind in ("route", "api") and self.method and "route_path" in df.columns:
            return (F.col("route_path") == self.value) & (F.upper("http_method") == self.method.upper())
        named = F.col("id").cast("string") == F.lit(self.value)
        for c in ("name", "qualified_name"):
            if c in df.columns:
                named = named | (F.col(c) == F.lit(self.value))
        wanted = self.NODE_TYPES.get(self.kind)
        return named if wanted is None else named & (F.lower("node_type") == wanted)
