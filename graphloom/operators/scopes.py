"""Lexical scopes and symbol tables: hierarchies by interval labels, names seen from a scope, shadowing, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .forest import enclosing, intervals
from .skew import lookup


def scope_intervals(scopes: DataFrame) -> DataFrame:
    """Labels of ``scopes(id, parent)``: id, parent, root, depth, start, stop and state.

    ``state`` is ok, dangling (the parent is no scope; the scope counts as a root) or ring (on or below a ring of parents;
    no labels). Of rows with one id the one with the smallest parent counts; rows without id are left out. The same
    labels serve symbols with parents.
    """
    scratch = Scratch(scopes.sparkSession, "scopes")
    ids = scratch.save(scopes.where("id is not null").groupBy("id").agg(F.min("parent").alias("parent")), "ids")
    kids = ids.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_kids"))
    marked = scratch.save(ids.join(kids, "id", "left"), "kids")
    parents = marked.where("_kids is not null").select(F.col("id").alias("parent"), F.lit(True).alias("_known"), F.col("_kids").alias("_n"))
    known = lookup(marked, parents, ["parent"], "_n")
    forest = scratch.save(known.select("id", F.col("parent").alias("said"), F.when(F.col("_known"), F.col("parent")).alias("parent"), "_kids"), "known")
    state = F.when(F.col("start").isNull(), "ring").when(F.col("said").isNotNull() & F.col("parent").isNull(), "dangling").otherwise("ok")
    return intervals(forest, scratch).select("id", F.col("said").alias("parent"), "root", "depth", "start", "stop", state.alias("state"))


def children(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, child) of ``ids(id)``."""
    return labels.where("parent is not null").select(F.col("parent").alias("id"), F.col("id").alias("child")).join(ids.select("id").distinct(), "id", "left_semi")


def _same(df: DataFrame, label: str) -> DataFrame:
    return df.where("start is not null").select(F.lit("").alias("key"), "start", "stop", F.col("id").alias(label))


def ancestors(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, ancestor, distance) of ``ids(id)``, the parent at distance 1. One sweep over all labels."""
    scratch = Scratch(labels.sparkSession, "ancestors")
    asked = labels.join(ids.select("id").distinct(), "id", "left_semi").where("start is not null")
    outer = labels.where("start is not null").select(F.lit("").alias("key"), "start", "stop", F.struct("id", "depth").alias("label"))
    points = asked.select(F.lit("").alias("key"), "start", F.struct("id", "depth").alias("point"))
    found = enclosing(outer, points, scratch, innermost=False, strict=True)
    return found.select(F.col("point.id").alias("id"), F.col("label.id").alias("ancestor"), (F.col("point.depth") - F.col("label.depth")).alias("distance"))


def descendants(labels: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, descendant, distance) of ``ids(id)``."""
    scratch = Scratch(labels.sparkSession, "descendants")
    asked = labels.join(ids.select("id").distinct(), "id", "left_semi").where("start is not null")
    outer = asked.select(F.lit("").alias("key"), "start", "stop", F.struct("id", "depth").alias("label"))
    points = labels.where("start is not null").select(F.lit("").alias("key"), "start", F.struct("id", "depth").alias("point"))
    found = enclosing(outer, points, scratch, innermost=False, strict=True)
    return found.select(F.col("label.id").alias("id"), F.col("point.id").alias("descendant"), (F.col("point.depth") - F.col("label.depth")).alias("distance"))


def _declared(labels: DataFrame, declarations: DataFrame, scratch: Scratch) -> DataFrame:
    """``declarations(scope, name, symbol, ordinal)``: the first of each name in a scope, with the scope's labels."""
    first = declarations.where("scope is not null and name is not null").groupBy("scope", "name").agg(F.min(F.struct("ordinal", "symbol")).alias("d"))
    first = scratch.save(first.select("scope", "name", F.col("d.symbol").alias("symbol")), "first")
    return lookup(first, labels.select(F.col("id").alias("scope"), "start", "stop"), ["scope"], among=first)


def resolve_in_scope(labels: DataFrame, declarations: DataFrame, uses: DataFrame) -> DataFrame:
    """``uses(..., scope, name)`` with ``symbol`` and ``declared_in`` of the nearest scope that declares the name.

    The search goes from the use's own scope up to its root; in one scope the first declaration by ``ordinal`` counts.
    Nulls where no scope declares the name; in scopes on or below a ring only their own names are seen. Every use
    gives one row.
    """
    scratch = Scratch(labels.sparkSession, "in-scope")
    declared = scratch.save(_declared(labels, declarations, scratch), "declared")
    asked = scratch.save(uses.where("scope is not null and name is not null").groupBy("scope", "name").agg(F.count("*").alias("_n")), "pairs")
    asked = scratch.save(lookup(asked, labels.select(F.col("id").alias("scope"), "start"), ["scope"], among=asked), "asked")
    outer = declared.where("start is not null").select(F.col("name").alias("key"), "start", "stop", F.struct("symbol", F.col("scope").alias("declared_in")).alias("label"))
    points = asked.where("start is not null").select(F.col("name").alias("key"), "start", F.struct("scope", "name", "_n").alias("point"))
    found = enclosing(outer, points, scratch).select("point.scope", "point.name", "point._n", "label.symbol", "label.declared_in")
    own = asked.where("start is null").join(declared.where("start is null").select("scope", "name", "symbol"), ["scope", "name"]).select("scope", "name", "_n", "symbol", F.col("scope").alias("declared_in"))
    return lookup(uses, scratch.save(found.unionByName(own), "answers"), ["scope", "name"], "_n").drop("_n")


def shadowed_names(labels: DataFrame, declarations: DataFrame) -> DataFrame:
    """Each name that a scope declares again: name, inner_scope, shadowing_symbol, outer_scope, shadowed_symbol.

    The outer scope is the nearest one around it that declares the name.
    """
    scratch = Scratch(labels.sparkSession, "shadowed")
    declared = scratch.save(_declared(labels, declarations, scratch).where("start is not null"), "declared")
    end = F.struct("scope", "symbol")
    outer = declared.select(F.col("name").alias("key"), "start", "stop", end.alias("label"))
    points = declared.select(F.col("name").alias("key"), "start", F.struct("name", "scope", "symbol").alias("point"))
    found = enclosing(outer, points, scratch, strict=True)
    return found.select("point.name", F.col("point.scope").alias("inner_scope"), F.col("point.symbol").alias("shadowing_symbol"), F.col("label.scope").alias("outer_scope"), F.col("label.symbol").alias("shadowed_symbol"))


def visible_symbols(labels: DataFrame, declarations: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, name, symbol, declared_in): every name seen from the scopes ``ids(id)``, the nearest declaration of each."""
    scratch = Scratch(labels.sparkSession, "visible")
    above = ancestors(labels, ids).select("id", F.col("ancestor").alias("scope"), "distance")
    own = labels.join(ids.select("id").distinct(), "id", "left_semi").select("id", F.col("id").alias("scope"), F.lit(0).cast("long").alias("distance"))
    around = scratch.save(above.unionByName(own), "around")
    declared = _declared(labels, declarations, scratch).select("scope", "name", "symbol")
    nearest = around.join(declared, "scope").groupBy("id", "name").agg(F.min(F.struct("distance", "symbol", "scope")).alias("d"))
    return nearest.select("id", "name", F.col("d.symbol").alias("symbol"), F.col("d.scope").alias("declared_in"))


def scope_violations(scopes: DataFrame, declarations: DataFrame, symbols: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(severity, code, scope, symbol) of what is wrong with ``scopes(id, parent, start_line, end_line, start_column, end_column)``.

    DANGLING_PARENT, CIRCULAR_SCOPE, UNOWNED_SYMBOL (a declared symbol that ``symbols(id)`` lacks) are errors, INVALID_LOCATION
    (a range that ends before it starts; where the columns exist) is a warning.
    """
    labels = scope_intervals(scopes.select("id", "parent")) if labels is None else labels
    no = F.lit(None).cast(declarations.schema["symbol"].dataType).alias("symbol")
    say = lambda df, severity, code, symbol=no: df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col("id").alias("scope"), symbol)
    owned = declarations.where("symbol is not null").select(F.col("scope").alias("id"), "symbol").distinct().join(symbols.select(F.col("id").alias("symbol")).distinct(), "symbol", "left_anti")
    out = say(labels.where("state = 'dangling'"), "error", "DANGLING_PARENT").union(say(labels.where("state = 'ring'"), "error", "CIRCULAR_SCOPE")).union(say(owned, "error", "UNOWNED_SYMBOL", F.col("symbol")))
    if "start_line" in scopes.columns:
        backward = (F.col("start_line") > F.col("end_line")) | (F.col("start_line") == F.col("end_line")) & (F.col("start_column") > F.col("end_column"))
        out = out.union(say(scopes.where(backward), "warning", "INVALID_LOCATION"))
    return out
