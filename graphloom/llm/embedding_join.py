"""Near-duplicate vectors by an epsilon grid order join (operator 3)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches
from .components import components, smallest_labels

#: Leading principal dimensions that make the grid cells, vectors of a sequence interval, intervals of a superinterval.
GRID_DIMS, UNIT, GROUP = 4, 1024, 32
#: Principal axes are found for vectors of up to so many components and for so many different lengths (the most frequent
#: ones); others are sorted by their own first components. Results don't depend on the axes.
AXES_DIMS, AXES_LENGTHS = 1024, 8
#: Superintervals of a label that one task compares with all others of it.
CHUNK = 64
#: Intervals up to this size are compared by a matrix product.
LEAF = 256


def _usable(vector) -> np.ndarray | None:
    if vector is None or not len(vector) or any(x is None for x in vector):
        return None
    out = np.array(vector, dtype=np.float64)
    return out if np.isfinite(out).all() and out.any() else None


def _read_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("digest", pa.binary()), ("raw", pa.binary())])
    for batch in batches:
        raw = []
        for vec_id, label, vector in zip(*(c.to_pylist() for c in batch.columns)):
            x = _usable(vector) if label is not None and vec_id is not None else None
            raw.append(None if x is None else x.astype("<f8").tobytes())
        digest = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, type=pa.binary()), pa.array(raw, type=pa.binary())], schema=schema)


def _unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype="<f8").reshape(len(raw), -1)
    top = np.abs(x).max(axis=1, keepdims=True)
    x = x / top
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(lengths: list[int]):
    """Sums of the unit vectors (first row) and of their products, for each of the given lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            by: dict[int, list[bytes]] = {}
            for x in batch.column(0).to_pylist():
                by.setdefault(len(x) // 8, []).append(x)
            for d in set(by) & set(lengths):
                u = _unit_rows(by[d])
                sums[d] = sums.get(d, 0) + np.vstack([u.sum(axis=0), u.T @ u])
        for d, s in sums.items():
            at = np.arange(s.size)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, d)), pa.array(at), pa.array(s.reshape(-1))], names=["d", "at", "value"])

    return run


class Axes(dict):
    """An orthonormal basis for each length: the principal axes by falling spread, or the vectors' own."""

    def __missing__(self, d: int) -> np.ndarray:
        self[d] = np.eye(d)
        return self[d]


def _axes(raws: DataFrame) -> Axes:
    """Axes of the covariance over all vectors of a length: AXES_LENGTHS times AXES_DIMS squared numbers at most."""
    counts = raws.groupBy((F.octet_length("raw") / 8).cast("int").alias("d")).agg(F.count("*").alias("n"))
    counts = {r.d: r.n for r in counts.where(F.col("d") <= AXES_DIMS).orderBy(F.desc("n"), "d").limit(AXES_LENGTHS).collect()}
    found = raws.mapInArrow(_moments(list(counts)), "d long, at long, value double").groupBy("d", "at").agg(F.sum("value").alias("value")).toArrow().to_pydict()
    d_all, at, value = (np.array(found[k]) for k in ("d", "at", "value"))
    out = Axes()
    for d, n in counts.items():
        s = np.zeros((d + 1) * d)
        s[at[d_all == d]] = value[d_all == d]
        s = s.reshape(d + 1, d)
        mean = s[0] / n
        out[d] = np.linalg.eigh(s[1:] / n - np.outer(mean, mean))[1][:, ::-1].copy()
    return out


def _cells(axes: Axes, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for x in batch.column("raw").to_pylist():
                d = len(x) // 8
                y = (_unit_rows([x]) @ axes[d][:, :GRID_DIMS])[0]
                cells.append([d, *np.floor(y / epsilon).astype(int).tolist()])
            yield pa.RecordBatch.from_pydict({n: batch.column(n) for n in batch.schema.names} | {"cells": pa.array(cells, type=pa.list_(pa.int32()))})

    return run


def _units(axes: Axes):
    schema = pa.schema([("unit", pa.int64()), ("label", pa.int64()), ("d", pa.int32()), ("ids", pa.binary()), ("weights", pa.binary()), ("raw", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, n = [], None, 0

        def close():
            nonlocal held, n
            y = _unit_rows([r[2] for r in held]) @ axes[key[1]]
            row = [TaskContext.get().partitionId() * (1 << 32) + n, *key, np.array([r[0] for r in held]).tobytes(), np.array([r[1] for r in held]).tobytes(), b"".join(r[2] for r in held), y.min(axis=0), y.max(axis=0)]
            held, n = [], n + 1
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for label, node, weight, raw in zip(*(batch.column(c).to_pylist() for c in ("label", "node", "weight", "raw"))):
                if held and (len(held) >= UNIT or key != (label, len(raw) // 8)):
                    yield close()
                key = (label, len(raw) // 8)
                held.append((node, weight, raw))
        if held:
            yield close()

    return run


def _gap(a: str, b: str):
    """Squared distance of two boxes with columns ``{a}_low`` and so on: no pair across them is nearer."""
    apart = F.zip_with(F.zip_with(F.col(f"{b}_low"), F.col(f"{a}_high"), lambda x, y: x - y), F.zip_with(F.col(f"{a}_low"), F.col(f"{b}_high"), lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)


def _pair_links(a: np.ndarray, b: np.ndarray, same: bool, ya: np.ndarray, yb: np.ndarray, least: float, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least ``least``; intervals are halved until small, distant ones skipped."""
    out_a, out_b, todo = [], [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if same and b1 <= a0:
            continue
        gap = np.maximum(0, np.maximum(yb[b0:b1].min(axis=0) - ya[a0:a1].max(axis=0), ya[a0:a1].min(axis=0) - yb[b0:b1].max(axis=0)))
        if gap @ gap > reach:
            continue
        if max(a1 - a0, b1 - b0) > LEAF:
            am, bm = (a0 + a1 + 1) // 2, (b0 + b1 + 1) // 2
            todo += [(s, e, t, f) for s, e in ((a0, am), (am, a1)) for t, f in ((b0, bm), (bm, b1)) if s < e and t < f]
            continue
        cosine = a[a0:a1] @ b[b0:b1].T
        i, j = np.nonzero(cosine >= least - 1e-9)
        if same:
            i, j = i[i + a0 < j + b0], j[i + a0 < j + b0]
        close = np.flatnonzero(cosine[i, j] < least + 1e-9)
        if len(close):  # within rounding of the limit: sum exactly
            keep = np.ones(len(i), dtype=bool)
            for k in close:
                x, y = a[a0 + i[k]].tolist(), b[b0 + j[k]].tolist()
                dot, xx, yy = (math.fsum(p * q for p, q in zip(s, t)) for s, t in ((x, y), (x, x), (y, y)))
                keep[k] = dot / math.sqrt(xx * yy) >= least
            i, j = i[keep], j[keep]
        out_a.append(i + a0)
        out_b.append(j + b0)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


def _joined(axes: Axes, least: float, reach: float):
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, weights, unit = {}, {}, {}
                for k in "ab":
                    ids[k], weights[k] = (np.frombuffer(row[f"{k}_{n}"], dtype=np.int64) for n in ("ids", "weights"))
                    size = len(row[f"{k}_raw"]) // len(ids[k])
                    unit[k] = _unit_rows([row[f"{k}_raw"][p : p + size] for p in range(0, len(row[f"{k}_raw"]), size)])
                basis = axes[size // 8]
                same = row["a_unit"] == row["b_unit"]
                i, j = _pair_links(unit["a"], unit["b"], same, unit["a"] @ basis, unit["b"] @ basis, least, reach)
                if not len(i):
                    continue
                shift = 0 if same else len(ids["a"])
                node = ids["a"] if same else np.concatenate([ids["a"], ids["b"]])
                links = np.bincount(i, weights["b"][j], len(node)) + np.bincount(j + shift, weights["a"][i], len(node))
                order = np.argsort(node, kind="stable")
                rank = np.empty_like(order)
                rank[order] = np.arange(len(order))
                root = node[order][smallest_labels(len(node), rank[i], rank[j + shift])[rank]]
                keep = links > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(links[keep].astype(np.int64)), pa.array(root[keep])], schema=schema)

    return run


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """``vectors(vec_id, embedding, label)`` to vec_id, n_links, component_id, kept; one row for each input row.

    Vectors of equal, non-null labels (and equal length) link at a cosine of at least ``least``, in double
    precision. Null, zero or empty vectors, those with null or non-finite components, and rows with a null vec_id
    link with nothing; the component of a null vec_id is null, and the row is kept. Rows that share a vec_id but not
    their vector or label are vectors of their own. Other columns are left out.

    Equal vectors of a label are one class, which is compared once and counts as often as it occurs. The classes are
    put in the order of their grid cells and cut into intervals; pairs of intervals whose boxes are further apart
    than the limit allows are skipped, first for superintervals, then for intervals, then inside the tasks. Each
    interval pair gives link counts and a spanning forest, never its pairs of vectors.
    """
    spark = vectors.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "near-vectors")
    reach = 2 - 2 * least + 1e-9
    slim = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = scratch.save(slim.mapInArrow(_read_vectors, "vec_id long, label long, digest binary, raw binary"), "rows")
    usable = rows.where("raw is not null")
    classes = usable.groupBy("label", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("raw").alias("raw"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers are fixed once written
    axes = _axes(classes.select("raw"))
    cells = classes.select("label", "node", "weight", "raw").mapInArrow(_cells(axes, math.sqrt(reach)), "label long, node long, weight long, raw binary, cells array<int>")
    cells = scratch.save(cells, "cells")
    key = ["label", *(F.get("cells", F.lit(k)) for k in range(GRID_DIMS + 1)), "node"]
    units = cells.repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(_units(axes), "unit long, label long, d int, ids binary, weights binary, raw binary, low array<double>, high array<double>")
    units = scratch.save(units, "units")
    # Superintervals: boxes around runs of intervals of one label.
    boxes = units.select("unit", "label", "d", "low", "high").withColumn("super", F.floor(F.col("unit") / (1 << 32)) * (1 << 32) + F.floor(F.col("unit") % (1 << 32) / GROUP))
    grouped = boxes.groupBy("label", "d", "super").agg(F.array_agg(F.struct("unit", "low", "high")).alias("units"))
    dims = F.sequence(F.lit(0), F.col("d") - 1)
    grouped = grouped.withColumn("low", F.transform(dims, lambda k: F.array_min(F.transform("units", lambda u: F.get(u["low"], k)))))
    grouped = grouped.withColumn("high", F.transform(dims, lambda k: F.array_max(F.transform("units", lambda u: F.get(u["high"], k)))))
    supers = scratch.save(grouped, "supers")
    # The pairs of a label's superintervals are dealt out by chunks of one side; their intervals' boxes follow only where
    # the outer boxes are near.
    chunks = supers.groupBy("label", "d").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    side = lambda k, *more: supers.select("label", "d", *(F.col(c).alias(f"{k}_{c}") for c in ("super", "low", "high", *more)))
    left = side("a").join(chunks, ["label", "d"]).withColumn("chunk", F.pmod(F.xxhash64("a_super"), F.col("chunks")).cast("int")).drop("chunks")
    right = side("b").join(chunks, ["label", "d"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
    upper = left.join(right, ["label", "d", "chunk"]).where("a_super <= b_super").where(_gap("a", "b") <= reach)
    upper = upper.select("label", "d", "a_super", "b_super")
    lower = upper.join(side("a", "units"), ["label", "d", "a_super"]).join(side("b", "units"), ["label", "d", "b_super"])
    lower = lower.select(F.explode("a_units").alias("a"), "b_units").select("a", F.explode("b_units").alias("b"))
    lower = lower.select(*(F.col(f"{k}.{c}").alias(f"{k}_{c}") for k in "ab" for c in ("unit", "low", "high"))).where("a_unit <= b_unit").where(_gap("a", "b") <= reach)
    pairs = scratch.save(lower.select("a_unit", "b_unit"), "pairs")
    data = lambda k: units.select(*(F.col(c).alias(f"{k}_{c}") for c in ("unit", "ids", "weights", "raw")))
    limit_batches(spark, 4)
    full = pairs.join(data("a"), "a_unit").join(data("b"), "b_unit")
    links = scratch.save(full.mapInArrow(_joined(axes, least, reach), "node long, links long, root long"), "links")
    limit_batches(spark)
    degrees = links.groupBy("node").agg(F.sum("links").alias("links"))
    found = scratch.save(components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "components")
    slim = classes.select("label", "digest", "node", "rep", "weight")
    lowest = slim.join(found, "node").groupBy("component").agg(F.min("rep").alias("least"))
    named = found.join(lowest, "component").select("node", "least")
    own = slim.join(degrees, "node", "left").join(named, "node", "left")
    own = own.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), F.coalesce("least", "rep").alias("component_id"))
    own = scratch.save(own, "own")
    out = usable.select("vec_id", "label", "digest").join(own, ["label", "digest"]).select("vec_id", F.col("links").cast("long").alias("n_links"), "component_id")
    # Unusable rows have no digest; in the join they would all be one key.
    out = out.unionByName(rows.where("raw is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
