"""The prefix trie of conversations (operator 12).

A node is a sequence of turns; its key is its depth and a sum of digests of (place, turn), so that all keys of a
conversation are running sums. Conversations lie in shards by id. Every shard makes its own partial trie, a table of
its nodes with members and end lists; tables merge by node key, first those of neighbouring shards, then all, where
members add up and end lists, being of successive ids, follow each other. Sums over subtrees then rise in rounds: in each,
every node hands what it has to its ancestor at twice the distance of the round before, so a trie of depth d takes
log2(d) rounds.

No step gathers a conversation, a node's members or a node's children: running sums carry over from shard to shard, and
rows that look up a node of very many rows are joined in place.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, lookup

#: Key sums are kept modulo 2^60, twice.
_MODULUS = 1 << 60
#: Shards whose partial tries are merged in the first of the two merges.
FAN_IN = 16
KEY = ["depth", "h1", "h2"]


def running_sums(rows: DataFrame, key: str, order: list, sums: dict, scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with the running sums of columns over the rows of a key in order, and the shard of each row.

    Rows are dealt by ranges of key and order, so a key of any size is split; a shard begins with what the shards
    before have of its first key: at most one row a shard is sent to all tasks. ``sums`` gives each sum's name and
    column; rows that are equal in key and order may swap places.
    """
    at = rows.select("*", *(column.alias(f"_v_{s}") for s, column in sums.items()))
    held = scratch.save(at.repartitionByRange(key, *order).withColumn("shard", F.spark_partition_id()), name)
    total = held.groupBy(key, "shard").agg(*(F.sum(f"_v_{s}").alias(f"_t_{s}") for s in sums))
    before = Window.partitionBy(key).orderBy("shard")
    earlier = total.select(key, "shard", F.row_number().over(before).alias("_k"), *(F.sum(f"_t_{s}").over(before.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_b_{s}") for s in sums))
    carried = earlier.where("_k > 1").drop("_k")
    here = Window.partitionBy("shard", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = held.select("*", *(F.sum(f"_v_{s}").over(here).alias(f"_l_{s}") for s in sums)).join(F.broadcast(carried), [key, "shard"], "left")
    done = [(F.col(f"_l_{s}") + F.coalesce(F.col(f"_b_{s}"), F.lit(0))).alias(s) for s in sums]
    return local.select(*rows.columns, "shard", *done)


def turns_of(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row of ``conversations(conv_id, turn, role, text)`` as conv_id, pos (from 1), digest and n_chars.

    Rows of a conversation stand in the order of ``turn``, null first; rows of one turn in the order of the SHA-256 of
    role and text. Null roles and texts count as empty; rows without conv_id are left out; repeated rows count each.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256)
    slim = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("n_chars"))
    ranked = running_sums(slim, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest")], {"pos": F.lit(1).cast("long")}, scratch, "dealt")
    return scratch.save(ranked.select("conv_id", "pos", "digest", "n_chars"), "turns")


def rebuild(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: each begins with the first turns of its hundred's first.

    From ``turns(conv_id, pos, digest, n_chars)`` conversation c takes the first h turns of c - c % 100 (with the sign
    of c; all if fewer, none if absent), h being the CRC-32 of c in decimal modulo 6, then its own after its first h.
    Returns all conv_ids, and the rebuilt turns as conv_id, depth, digest and n_chars.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    first = turns.where("conv_id % 100 = 0 and pos <= 5").groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.array_sort(F.collect_list(F.struct("pos", "digest", "n_chars"))).alias("first"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    convs = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "h": h}).join(first, "base", "left")
    head = F.when(F.col("first").isNull(), F.array().cast(first.schema["first"].dataType)).otherwise(F.slice("first", F.lit(1), F.col("h")))
    convs = scratch.save(convs.select("conv_id", "n", "h", head.alias("head")), "convs")
    heads = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.n_chars")
    later = lookup(turns, convs.select("conv_id", "n", "h", F.size("head").alias("taken")), ["conv_id"], "n").where("pos > h")
    rest = later.select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "n_chars")
    return convs.select("conv_id"), heads.unionByName(rest)


def _part(column, start: int):
    """Sixty bits of a digest in hexadecimal."""
    return F.conv(F.substring(column, start, 15), 16, 10).cast("decimal(19,0)")


def _wrap(column):
    return F.pmod(column, F.lit(_MODULUS)).cast("long")


def build_trie(convs: DataFrame, turns: DataFrame, scratch: Scratch) -> DataFrame:
    """The trie of sequences: ``convs(conv_id)``, each once, and ``turns(conv_id, depth, digest, n_chars)``.

    ``depth`` counts the turns of a sequence from 1 without gaps; a sequence may have none. Turns are equal if their
    digests are. One row for each distinct prefix: conv_id (its smallest member), depth, parent_conv_id (null for the
    root), n_convs (members), n_children, n_leaves (nodes without children in its subtree), saved_tokens (over its
    subtree, members but one times n_chars of the last turn) and ends_sha256 (of the decimal conv_ids of the members
    that end here, ascending, joined by commas). No sequence, no rows.
    """
    spark = convs.sparkSession
    limit_batches(spark)
    own = F.sha2(F.concat(F.col("depth"), F.lit(":"), F.col("digest")), 256)
    tagged = turns.withColumn("d", own).select("conv_id", "depth", "n_chars", _part("d", 1).alias("v1"), _part("d", 16).alias("v2"))
    summed = running_sums(tagged, "conv_id", [F.col("depth")], {"s1": F.col("v1"), "s2": F.col("v2")}, scratch, "tagged")
    keyed = summed.select("conv_id", "shard", "depth", "n_chars", _wrap(F.col("s1")).alias("h1"), _wrap(F.col("s2")).alias("h2"), _wrap(F.col("s1") - F.col("v1")).alias("p1"), _wrap(F.col("s2") - F.col("v2")).alias("p2"))
    paths = scratch.save(keyed, "paths")
    # Partial tries of the shards, and the two merges. A task's own nodes are combined before they are dealt.
    merged = [F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), *(F.min(c).alias(c) for c in ("n_chars", "p1", "p2"))]
    partial = paths.withColumn("n_convs", F.lit(1).cast("long")).groupBy((F.col("shard") / FAN_IN).cast("int").alias("shard"), *KEY).agg(*merged)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "n_convs", "conv_id", zero.alias("n_chars"), F.lit(-1).cast("long").alias("p1"), F.lit(-1).cast("long").alias("p2"))
    nodes = scratch.save(partial.groupBy(*KEY).agg(*merged).unionByName(root), "nodes")
    below = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(F.count("*").alias("n_children"))
    nodes = scratch.save(nodes.join(below, KEY, "left").fillna(0, ["n_children"]), "nodes-with-children")
    totals = _rollup(nodes, scratch)
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n_rows"))
    named = lookup(nodes, parents, ["depth", "p1", "p2"], "n_rows").drop("n_rows")
    ends = _ends(convs, paths, scratch)
    nothing = F.lit(sha256(b"").hexdigest())
    out = named.join(totals, KEY, "left").join(ends, KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def _rollup(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Sums over subtrees: KEY, n_leaves, saved_tokens.

    After the round with distance s a node has the sums of all within distance 2 s of it; a1 and a2 are the key of its
    ancestor at the distance of the next round.
    """
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    leaf = (F.col("n_children") == 0).cast("long")
    now = nodes.select(*KEY, F.col("p1").alias("a1"), F.col("p2").alias("a2"), leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_chars")).alias("saved_tokens"))
    distance = 1
    while distance <= deepest:
        climbing = now.where(F.col("depth") >= distance)
        given = climbing.groupBy((F.col("depth") - distance).alias("depth"), F.col("a1").alias("h1"), F.col("a2").alias("h2"))
        given = given.agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"), F.count("*").alias("n_rows"))
        added = now.join(given, KEY, "left").fillna(0, ["more_leaves", "more_saved"])
        sums = [(F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"), (F.col("saved_tokens") + F.col("more_saved")).alias("saved_tokens")]
        now = scratch.save(added.select(*KEY, "a1", "a2", *sums, "n_rows"), f"within-{distance}")
        above = now.where("n_rows is not null").select((F.col("depth") + distance).alias("depth"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), F.col("n_rows").alias("n_held"))
        if 2 * distance <= deepest:
            further = lookup(now.where(F.col("depth") >= distance), above, ["depth", "a1", "a2"], "n_held")
            further = further.select(*KEY, F.col("b1").alias("a1"), F.col("b2").alias("a2"), "n_leaves", "saved_tokens")
            now = scratch.save(further.unionByName(now.where(F.col("depth") < distance).drop("n_rows")), f"up-{2 * distance}")
        distance *= 2
    return now.select(*KEY, "n_leaves", "saved_tokens")


def _ends(convs: DataFrame, paths: DataFrame, scratch: Scratch) -> DataFrame:
    """Digest of the end list of each node where a sequence ends: KEY, ends_sha256.

    Ids lie in shards by ranges; a shard's list for a node is one row, and a task hashes a node's lists one after the
    other, holding one at a time.
    """
    last = paths.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("last"))
    zero = F.lit(0).cast("long")
    ended = convs.join(last, "conv_id", "left").select("conv_id", *(F.coalesce(F.col(f"last.{c}"), zero).alias(c) for c in KEY))
    dealt = scratch.save(ended.repartitionByRange("conv_id").withColumn("shard", F.spark_partition_id()), "ends")
    lists = dealt.groupBy(*KEY, "shard").agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    schema = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def flush():
            arrays = zip(*done) if done else [[]] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(list(x), type=f.type) for x, f in zip(arrays, schema)], schema=schema)

        for batch in batches:
            for *found, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if found != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = found, sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield flush()
            done.clear()
        if key is not None:
            done.append((*key, state.hexdigest()))
        yield flush()

    return lists.repartition(*KEY).sortWithinPartitions(*KEY, "shard").select(*KEY, "ids").mapInArrow(digest, "depth long, h1 long, h2 long, ends_sha256 string")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """``build_trie`` of ``rebuild`` of ``conversations(conv_id, turn, role, text)``; columns as ``build_trie`` gives them.

    Nulls, repeated rows and ties in ``turn`` as ``turns_of`` says; other columns are left out, whatever their names.
    An empty table gives no rows. Texts of any length count whole: by their digests and code points.
    """
    scratch = Scratch(conversations.sparkSession, "prefix-trie")
    convs, turns = rebuild(turns_of(conversations, scratch), scratch)
    return build_trie(convs, turns, scratch)
