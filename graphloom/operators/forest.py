"""Forests given by parents: sums along paths and over subtrees, interval labels, and joins by containment.

Paths are followed by doubling: after k rounds a node points 2^k steps up, so rounds grow with the logarithm of the
depth. A node whose way up never ends is on a ring of parents or below one; it is told by its pointer, which stays when
all others have ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import lookup


def _sum(a, b):
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _doubling(now: DataFrame, scratch: Scratch, name: str, climb, up: list[str]) -> DataFrame:
    """Rounds over ``now(id, anc, ...)``: ``climb`` makes the next table from one with the columns of the ancestor.

    Only rows that another one points to take part in the rounds; all others climb once, from the final table of
    these. A round writes the rows that still climb, those that have ended stay where they are.
    """
    held = scratch.save(now.where("anc is not null").groupBy(F.col("anc").alias("id")).agg(F.count("*").alias("_n")), f"{name}-held")
    marked = scratch.save(now.join(held, "id", "left"), f"{name}-marked")
    inner = scratch.save(marked.where("_n is not null").drop("_n"), f"{name}-0")
    above_of = lambda rows, held: rows.join(held, "id").select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), *(F.col(c).alias(f"_{c}") for c in up), "_n")
    names, last, open_before = [f"{name}-0"], inner, None
    for k in range(1, 64):
        waiting = last.where("anc is not null")
        n = waiting.count()
        if n == 0 or n == open_before:
            break
        open_before = n
        now = scratch.together(names, last).where("anc is null").unionByName(waiting)
        pointed = waiting.groupBy(F.col("anc").alias("id")).agg(F.count("*").alias("_n"))
        last = scratch.save(climb(lookup(waiting, above_of(now, pointed), ["anc"], "_n")), f"{name}-{k}")
        names.append(f"{name}-{k}")
    done = scratch.together(names, inner).where("anc is null").unionByName(last.where("anc is not null"))
    done = done.select(*inner.columns)
    leaves = marked.where("_n is null").drop("_n")
    below = climb(lookup(leaves.where("anc is not null"), above_of(done, held), ["anc"], "_n"))
    return done.unionByName(scratch.save(below.select(*inner.columns), f"{name}-leaves")).unionByName(leaves.where("anc is null"))


def path_sums(forest: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """``forest(id, parent, *values)``: id, root, hops and the sums of the values over a node and all above it.

    Each parent is null or an id, each id stands once. Nodes on or below a ring have a null root and null sums.
    """
    one = forest.select("id", F.col("parent").alias("anc"), F.when(F.col("parent").isNull(), F.col("id")).alias("root"), F.col("parent").isNotNull().cast("long").alias("hops"), *(F.col(v).cast("long").alias(v) for v in values))
    sums = ["hops", *values]

    def climb(rows: DataFrame) -> DataFrame:
        return rows.select("id", F.col("_anc").alias("anc"), F.col("_root").alias("root"), *(_sum(F.col(c), F.col(f"_{c}")).alias(c) for c in sums))

    done = _doubling(scratch.save(one, "paths"), scratch, "paths", climb, ["root", *sums])
    return done.select("id", "root", *(F.when(F.col("anc").isNull(), F.col(c)).alias(c) for c in sums))


def subtree_sums(forest: DataFrame, values: list[str], scratch: Scratch) -> DataFrame:
    """``forest(id, parent, *values)``: id and the sums of the values over a node and all below it, for nodes off rings.

    In each round a node gives what it has to its ancestor at the distance that it has summed up so far.
    """
    now = scratch.save(forest.select("id", F.col("parent").alias("anc"), *(F.col(v).cast("long").alias(v) for v in values)), "subtrees")
    before = None
    for k in range(64):
        waiting = now.where("anc is not null")
        n = waiting.count()
        if n == 0 or n == before:
            break
        before = n
        given = waiting.groupBy(F.col("anc").alias("id")).agg(*(F.sum(v).alias(f"_{v}") for v in values), F.count("*").alias("_n"))
        added = now.join(given, "id", "left").select("id", "anc", "_n", *(_sum(F.col(v), F.col(f"_{v}")).alias(v) for v in values))
        added = scratch.save(added, f"subtrees-added-{k}")
        above = added.where("_n is not null").select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), "_n")
        moved = lookup(added.where("anc is not null").drop("_n"), above, ["anc"], "_n").select("id", F.col("_anc").alias("anc"), *values)
        now = scratch.save(moved.unionByName(added.where("anc is null").drop("_n")), f"subtrees-{k}")
    return now.where("anc is null").select("id", *values)


def _earlier(rows: DataFrame, value: str, scratch: Scratch) -> DataFrame:
    """``rows(id, parent, value)`` with ``earlier``: the sum of the values of siblings with smaller ids.

    Siblings are dealt by ranges of their ids, so any number of them is split; a shard begins with what the shards
    before it have of its first parent.
    """
    held = scratch.save(rows.repartitionByRange("parent", "id").withColumn("shard", F.spark_partition_id()), "siblings")
    runs = held.groupBy("parent", "shard").agg(F.sum(value).alias("_t"))
    order = Window.partitionBy("parent").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    carried = runs.select(F.col("parent").alias("_parent"), F.col("shard").alias("_shard"), F.sum("_t").over(order).alias("_before")).where("_before is not null")
    here = Window.partitionBy("shard", "parent").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    local = held.withColumn("_here", F.sum(value).over(here))
    # One row a shard at most: only a shard's first parent has children in shards before it.
    both = local.join(F.broadcast(carried), F.col("parent").eqNullSafe(F.col("_parent")) & (F.col("shard") == F.col("_shard")), "left")
    return both.select(*rows.columns, _sum(F.col("_here"), F.col("_before")).alias("earlier"))


def intervals(forest: DataFrame, scratch: Scratch) -> DataFrame:
    """``forest(id, parent, ...)``: the same with root, depth, start and stop, in the order of a walk that takes siblings by id.

    A node is below another one exactly if its start lies after the other's and not after its stop. Nodes on or below
    a ring of parents have nulls. A column ``_kids``, of how many nodes are children of each (null: none), is counted
    where the forest lacks it. Nodes without children, most of a flat forest, take no part in the rounds.
    """
    if "_kids" not in forest.columns:
        forest = scratch.save(forest, "forest")
        kids = forest.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_kids"))
        forest = scratch.save(forest.join(kids, "id", "left"), "marked")
    leaf = F.col("_kids").isNull()
    own = forest.where(leaf & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count("*").alias("_own"))
    inner = scratch.save(forest.where(~leaf), "inner")
    sized = subtree_sums(inner.select("id", "parent").join(own, "id", "left").select("id", "parent", _sum(F.lit(1), F.col("_own")).alias("size")), ["size"], scratch)
    sized = scratch.save(inner.join(sized, "id"), "sized")
    placed = _earlier(sized.unionByName(forest.where(leaf).withColumn("size", F.lit(1).cast("long"))), "size", scratch)
    # A child starts one after its parent, behind its earlier siblings.
    steps = placed.withColumn("start", F.col("earlier") + F.col("parent").isNotNull().cast("long")).drop("earlier")
    steps = scratch.save(steps, "steps")
    sums = path_sums(steps.where(~leaf).select("id", "parent", "start"), ["start"], scratch).select("id", "root", "hops", F.col("start").alias("_start"))
    done = scratch.save(steps.where(~leaf).join(sums, "id"), "placed")
    above = done.select(F.col("id").alias("parent"), F.col("root").alias("_root"), F.col("hops").alias("_hops"), F.col("_start").alias("_above"), F.col("_kids").alias("_weight"))
    below = lookup(steps.where(leaf), above, ["parent"], "_weight")
    top = F.col("parent").isNull()
    below = below.select(*steps.columns, F.when(top, F.col("id")).otherwise(F.col("_root")).alias("root"), F.when(top, 0).otherwise(F.col("_hops") + 1).cast("long").alias("hops"), F.when(top, F.col("start")).otherwise(F.col("start") + F.col("_above")).alias("_start"))
    stop = F.col("_start") + F.col("size") - 1
    kept = [c for c in forest.columns if c != "_kids"]
    out = done.unionByName(below).select(*kept, "root", F.col("hops").alias("depth"), F.col("_start").alias("start"), stop.alias("stop"))
    ringed = inner.join(sized.select("id"), "id", "left_anti")
    none = [F.lit(None).cast(out.schema[c].dataType).alias(c) for c in ("root", "depth", "start", "stop")]
    return scratch.save(out.unionByName(ringed.select(*kept, *none)), "labels")


def enclosing(outer: DataFrame, points: DataFrame, scratch: Scratch, innermost: bool = True, strict: bool = False) -> DataFrame:
    """(point, label): which of ``outer(key, start, stop, label)`` hold the start of each of ``points(key, start, point)``.

    Intervals of a key lie side by side or within each other. All that hold a point, or the ``innermost`` only; ``strict``
    leaves out intervals that begin at the point. Points that none holds don't appear. Rows are dealt by ranges of key and
    start, so a key of any size is split; a shard begins with the intervals that are open there, no more than the
    forest is deep. Each task sweeps its rows once with a stack.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    nothing = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    kinds = (1, 0) if strict else (0, 1)
    a = outer.select("key", "start", "stop", F.lit(kinds[0]).alias("kind"), "label", nothing(points, "point"))
    b = points.select("key", "start", F.lit(None).cast("long").alias("stop"), F.lit(kinds[1]).alias("kind"), nothing(outer, "label"), "point")
    held = scratch.save(a.unionByName(b).repartitionByRange("key", "start").withColumn("shard", F.spark_partition_id()), f"dealt-{innermost}-{strict}")
    first = held.groupBy("shard").agg(F.min(F.struct("key", "start")).alias("f")).select("shard", F.col("f.key").alias("key"), F.col("f.start").alias("_first"))
    # One row a shard is sent to all tasks.
    carried = a.join(F.broadcast(first), "key").where("start < _first and stop >= _first").select(*held.columns)
    schema = pa.schema([("point", to_arrow_type(points.schema["point"].dataType)), ("label", to_arrow_type(outer.schema["label"].dataType))])
    opens = kinds[0]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows are walked by numbers alone; points and labels stay in Arrow and are taken by their places.
        before, stack, open_labels = None, [], pa.nulls(0, schema.field("label").type)
        for batch in batches:
            shard, key, start, stop, kind, label, point = batch.columns
            if not len(batch):
                continue
            new = pc.or_kleene(pc.not_equal(shard[1:], shard[:-1]), pc.not_equal(key[1:], key[:-1])).to_pylist()
            new.insert(0, before != (shard[0], key[0]))
            before = (shard[-1], key[-1])
            held_labels = pa.concat_arrays([open_labels, label])
            points, labels = [], []
            at = len(open_labels)
            for place, (fresh, start, stop, kind) in enumerate(zip(new, start.to_numpy().tolist(), stop.fill_null(-1).to_numpy().tolist(), kind.to_numpy().tolist())):
                if fresh:
                    stack.clear()
                while stack and stack[-1][0] < start:
                    stack.pop()
                if kind == opens:
                    stack.append((stop, at + place))
                elif stack and innermost:
                    points.append(place)
                    labels.append(stack[-1][1])
                else:
                    points += [place] * len(stack)
                    labels += [k for _, k in stack]
            yield pa.RecordBatch.from_arrays([point.take(pa.array(points, type=pa.int64())), held_labels.take(pa.array(labels, type=pa.int64()))], schema=schema)
            open_labels = held_labels.take(pa.array([k for _, k in stack], type=pa.int64()))
            stack = [(stop, k) for k, (stop, _) in enumerate(stack)]

    rows = held.unionByName(carried).repartition("shard").sortWithinPartitions("shard", "key", "start", "kind")
    out = f"point {points.schema['point'].dataType.simpleString()}, label {outer.schema['label'].dataType.simpleString()}"
    return rows.select("shard", "key", "start", "stop", "kind", "label", "point").mapInArrow(sweep, out)
