"""Building edges: resolving names to symbols by ranked strategies, merging, weighting, deduplicating."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import posix_path, sql_tables, stable_id
from ..graph import Graph
from ..scratch import Scratch
from .skew import lookup


#: Kinds of symbols that calls, bases and type references can mean, and names of primitive types.
CALLABLE = ("function", "method")
BASES = ("class", "interface", "struct")
TYPES = (*BASES, "enum", "type_alias")
PRIMITIVE_TYPES = ("int", "float", "str", "string", "bool", "boolean", "void", "bytes", "number", "any", "unknown", "never", "object", "dict", "list", "tuple", "set", "i32", "i64", "f32", "f64", "u32", "u64", "usize", "isize")


def _first(symbols: DataFrame, keys: dict[str, str], out: str, *more: str) -> DataFrame:
    """The symbol with the smallest id for each key; ``keys`` names the columns of the rows that look it up."""
    best = symbols.groupBy(*(F.col(c).alias(k) for k, c in keys.items())).agg(F.min(F.struct("id", *more)).alias("_b"))
    return best.select(*keys, F.col("_b.id").alias(out), *(F.col(f"_b.{m}").alias(f"{out}_{m}") for m in more))


def _alone(symbols: DataFrame, key: str, out: str, *more: str) -> DataFrame:
    """The symbol of each name that one symbol alone has."""
    best = symbols.where("name is not null").groupBy(F.col("name").alias(key)).agg(F.min(F.struct("id", *more)).alias("_b"), F.count("*").alias("_n")).where("_n = 1")
    return best.select(key, F.col("_b.id").alias(out), *(F.col(f"_b.{m}").alias(f"{out}_{m}") for m in more))


def _ranked(rows: DataFrame, found: list[tuple[Column, str, float]], name: Column) -> DataFrame:
    """Target, confidence and strategy by the first strategy that gives one; else an external symbol of that name."""
    target = F.coalesce(*(c for c, _, _ in found), F.concat(F.lit("external:"), name))
    confidence, strategy = F.lit(0.5), F.lit("external")
    for c, label, sure in reversed(found):
        confidence, strategy = F.when(c.isNotNull(), sure).otherwise(confidence), F.when(c.isNotNull(), label).otherwise(strategy)
    return rows.withColumn("target", target).withColumn("confidence", confidence).withColumn("strategy", strategy)


def _candidates(target: Column, path: Column, repository: str | None) -> list[Column]:
    """Qualified names that a written name may stand for, in the order in which they are tried."""
    lead = "" if repository is None else f"{repository}."
    folder = F.regexp_replace(F.regexp_extract(F.translate(path, "\\", "/"), "^(.*)/[^/]*$", 1), "/", ".")
    beside = F.when(path.rlike(r"[/\\]"), F.concat(F.lit(lead), folder, F.lit("."), target))
    return [F.concat(F.lit(lead), target), target, F.concat(F.lit(f"{lead}src."), target), beside]


def _look_up(rows: DataFrame, scratch: Scratch, tables: list[tuple[list[str], DataFrame]]) -> DataFrame:
    """Rows, saved once, with the columns of each table by its keys; keys of very many rows are looked up in place."""
    held = out = scratch.save(rows, "rows")
    for keys, table in tables:
        out = lookup(out, table, keys, among=held)
    return out


def _tries(symbols: DataFrame, n: int, *more: str) -> list[tuple[list[str], DataFrame]]:
    """Tables that give ``_try<k>`` by the qualified name in ``_key<k>``."""
    return [([f"_key{k}"], _first(symbols.where("qualified_name is not null"), {f"_key{k}": "qualified_name"}, f"_try{k}", *more)) for k in range(n)]


def _keyed(rows: DataFrame, candidates: list[Column]) -> DataFrame:
    return rows.withColumns({f"_key{k}": c for k, c in enumerate(candidates)})


def _tried(n: int) -> Column:
    return F.coalesce(*(F.col(f"_try{k}") for k in range(n)))


def resolve_calls(calls: DataFrame, symbols: DataFrame, repository: str | None = None) -> DataFrame:
    """``calls(caller, name, namespace, file)`` against ``symbols(id, name, qualified_name, namespace, file, kind)``.

    ``name`` is the whole callee expression. In order: the exact qualified name, with the repository's name before it or
    without (1.0); where the receiver is just ``self`` or ``this``, a function or method in the caller's namespace (1.0);
    one in the same file (0.95); one whose simple name no other one has (0.85); else external (0.5). Among several the
    smallest id. ``recursive`` tells calls of the caller itself.
    """
    name = F.trim("name")
    rows = calls.withColumn("_simple", F.regexp_extract(name, r"([^.]+)$", 1)).withColumn("_own", F.when(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).isin("self", "this"), F.col("_simple")))
    candidates = [name] if repository is None else [F.concat(F.lit(f"{repository}."), name), name]
    able = symbols.where(F.lower("kind").isin(*CALLABLE))
    near = [(["namespace", "_own"], _first(able, {"namespace": "namespace", "_own": "name"}, "_local")), (["file", "_simple"], _first(able, {"file": "file", "_simple": "name"}, "_near")), (["_simple"], _alone(able, "_simple", "_alone"))]
    rows = _look_up(_keyed(rows, candidates), Scratch(calls.sparkSession, "calls"), [*_tries(symbols, len(candidates)), *near])
    out = _ranked(rows, [(_tried(len(candidates)), "exact", 1.0), (F.col("_local"), "self", 1.0), (F.col("_near"), "file", 0.95), (F.col("_alone"), "name", 0.85)], name)
    return out.select("caller", "name", "target", "confidence", "strategy", F.coalesce(F.col("target") == F.col("caller").cast("string"), F.lit(False)).alias("recursive"))


def resolve_imports(imports: DataFrame, symbols: DataFrame, repository: str | None = None) -> DataFrame:
    """``imports(file, module, name)`` against ``symbols(id, qualified_name)``; dots before the module are relative levels.

    The target is the module without its dots, and the name where there is one. In order: the target itself, with the
    repository's name before it, without, below ``src`` and below the importing file's folder (1.0); for relative
    imports, from the folder so many levels above the file (1.0; none if the path is too short); the target's parent in
    the repository (0.9); else external (0.5).
    """
    level = F.length(F.regexp_extract("module", r"^(\.*)", 1))
    module = F.regexp_replace(F.trim("module"), r"^\.+", "")
    target = F.concat_ws(".", F.when(module != "", module), F.when(F.col("name") != "", F.col("name")))
    rows = imports.withColumns({"_level": level, "_target": target})
    lead = "" if repository is None else f"{repository}."
    parts = F.split(F.translate("file", "\\", "/"), "/")
    base = F.slice(parts, F.lit(1), F.size(parts) - F.col("_level"))
    relative = F.when((F.col("_level") > 0) & (F.size(parts) > F.col("_level")), F.concat(F.lit(lead), F.array_join(F.concat(base, F.array(F.when(F.col("_target") != "", F.col("_target")))), ".")))
    parent = F.when(F.col("_target").contains("."), F.concat(F.lit(lead), F.regexp_replace("_target", r"\.[^.]*$", "")))
    # Four candidates, then the relative name and the parent, all by qualified name.
    rows = _look_up(_keyed(rows, [*_candidates(F.col("_target"), F.col("file"), repository), relative, parent]), Scratch(imports.sparkSession, "imports"), _tries(symbols, 6))
    out = _ranked(rows, [(_tried(4), "exact", 1.0), (F.col("_try4"), "relative", 1.0), (F.col("_try5"), "parent", 0.9)], F.col("_target"))
    return out.select("file", "module", "name", "target", "confidence", "strategy")


def _resolve_kinds(rows: DataFrame, symbols: DataFrame, kinds: tuple, repository: str | None) -> DataFrame:
    """``rows(name, file, ...)`` with target, confidence, strategy and ``target_kind``: exact (1.0), the same file (1.0), the only one of the name (0.9), external (0.5)."""
    able = symbols.where(F.lower("kind").isin(*kinds)).withColumn("kind", F.lower("kind"))
    near = [(["file", "name"], _first(able, {"file": "file", "name": "name"}, "_near", "kind")), (["name"], _alone(able, "name", "_alone", "kind"))]
    rows = _look_up(_keyed(rows, _candidates(F.col("name"), F.col("file"), repository)), Scratch(rows.sparkSession, "kinds"), [*_tries(able, 4, "kind"), *near])
    out = _ranked(rows, [(_tried(4), "exact", 1.0), (F.col("_near"), "file", 1.0), (F.col("_alone"), "name", 0.9)], F.col("name"))
    return out.withColumn("target_kind", F.coalesce(*(F.col(f"_try{k}_kind") for k in range(4)), "_near_kind", "_alone_kind"))


def resolve_bases(rows: DataFrame, symbols: DataFrame, repository: str | None = None) -> DataFrame:
    """``rows(child, name, file[, is_interface])`` to base classes, interfaces and structs of ``symbols(id, name, qualified_name, file, kind)``.

    Candidates as for imports; ``is_interface`` where the row says so or an interface was found.
    """
    said = F.coalesce(F.col("is_interface"), F.lit(False)) if "is_interface" in rows.columns else F.lit(False)
    found = _resolve_kinds(rows.withColumns({"_said": said, "name": F.trim("name")}), symbols, BASES, repository)
    return found.select("child", "name", "target", "confidence", "strategy", (F.col("_said") | F.coalesce(F.col("target_kind") == "interface", F.lit(False))).alias("is_interface"))


def resolve_types(rows: DataFrame, symbols: DataFrame, repository: str | None = None) -> DataFrame:
    """``rows(owner, type_name, file)`` to types: (owner, name, target, confidence, strategy).

    Pointer and reference marks are taken off, and a plain name in brackets stands for the whole type. Primitive types
    stay external at 0.5; else as for bases, with enums and aliases.
    """
    bare = F.regexp_replace(F.trim("type_name"), r"^[*&]+", "")
    inner = F.regexp_extract(bare, r"[\[<]([A-Za-z0-9_.]+)[\]>]", 1)
    named = rows.withColumn("name", F.trim(F.when(inner != "", inner).otherwise(bare)))
    primitive = F.lower("name").isin(*PRIMITIVE_TYPES)
    found = _resolve_kinds(named.where(~primitive), symbols, TYPES, repository).select("owner", "name", "target", "confidence", "strategy")
    own = named.where(primitive).select("owner", "name", F.concat(F.lit("external:"), "name").alias("target"), F.lit(0.5).alias("confidence"), F.lit("primitive").alias("strategy"))
    return found.unionByName(own)


def _sortable(df: DataFrame, columns: list[str]) -> Column:
    """The columns as one value that can be compared; those that hold maps as JSON."""
    return F.struct(*((F.to_json(c) if "map<" in df.schema[c].dataType.simpleString() else F.col(c)).alias(c) for c in columns))


def merge_edges(*edges: DataFrame) -> DataFrame:
    """Union by edge_id, the earlier collection wins."""
    ranked = reduce(DataFrame.unionByName, (e.withColumn("_rank", F.lit(k)) for k, e in enumerate(edges)))
    columns = [c for c in edges[0].columns if c != "edge_id"]
    best = ranked.groupBy("edge_id").agg(F.min_by(F.struct(*columns), F.struct("_rank", _sortable(ranked, columns).alias("_rest"))).alias("b"))
    return best.select("edge_id", *(F.col(f"b.{c}").alias(c) for c in columns))


def call_graph(calls: DataFrame, symbols: DataFrame) -> Graph:
    """``calls(caller, callee, callee_name)`` to a graph: repeated calls add up to a weight, rows without a caller are
    left out, a missing callee becomes ``external:<name>``; nodes that no symbol describes are made up."""
    callee = F.coalesce("callee", F.concat(F.lit("external:"), F.col("callee_name")))
    rows = calls.select(F.col("caller").alias("src"), callee.alias("dst")).where("src is not null and dst is not null")
    edges = rows.groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("type", F.lit("CALLS"))
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    nodes = ends.join(symbols.select("id", "name"), "id", "left").withColumn("is_external", F.col("id").startswith("external:"))
    return Graph(nodes.withColumn("name", F.coalesce("name", F.regexp_replace("id", "^external:", ""))), edges)


def weighted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def name_edges(records: DataFrame, cap: int | None = None) -> DataFrame:
    """``records(id, name, calls, imports, code)`` to distinct (src, dst, type) by short names and by SQL in the code.

    Several nodes of one name all become targets; a loop is left out. ``cap`` keeps the first edges by src, dst and type.
    """
    names = records.select(F.col("id").alias("dst"), F.col("name").alias("_name"))
    parts = []
    for column, kind in (("calls", "calls"), ("imports", "imports")):
        said = records.select(F.col("id").alias("src"), F.explode(column).alias("said")).withColumn("_name", F.regexp_extract("said", r"([^./]+)$", 1))
        parts.append(said.join(names, "_name").where("src <> dst").select("src", "dst", F.lit(kind).alias("type")))
    tables = records.select(F.col("id").alias("src"), F.explode(sql_tables(F.col("code"))).alias("t"))
    parts.append(tables.select("src", F.concat(F.lit("table:"), F.col("t.table")).alias("dst"), F.concat(F.col("t.operation"), F.lit("_table")).alias("type")))
    out = reduce(DataFrame.union, parts).distinct()
    return out if cap is None else out.orderBy("src", "dst", "type").limit(cap)


def keep_last(nodes: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in order; of equal ones the largest of the other columns, maps compared as JSON."""
    columns = [c for c in nodes.columns if c != key]
    others = [c for c in columns if c != order]
    rank = F.struct(order, _sortable(nodes, others).alias("_rest")) if others else F.struct(order)
    best = nodes.groupBy(key).agg(F.max_by(F.struct(*columns), rank).alias("b"))
    return best.select(key, F.col(f"b.{order}").alias(order), *(F.col(f"b.{c}").alias(c) for c in others))


def edge_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_id", stable_id("edge_", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("type")))


def in_file(edges: DataFrame, path: str) -> DataFrame:
    """Edges recorded in a file, whichever way its path is written."""
    return edges.where(posix_path(F.col("file")) == posix_path(F.lit(path)))
