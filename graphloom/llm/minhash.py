"""Near-duplicate documents by one-permutation hashing (operator 9).

Every distinct set of word shingles is hashed once into bins; empty bins borrow from a bin that their own probe
order finds first (optimal densification). Bands of bins are bucket keys. In each bucket one document, the hub, is
paired with all others, a star, and the pairs are confirmed on the full sets.

A star may leave several components in a bucket: copies of copies, or texts that merely share a passage. Of such buckets
those documents are set aside that have so many shingles which no other one has that none can reach the limit with
them. The rest is resolved in two rounds: first two further hubs for each bucket, those with the fewest shingles that no
other document has, then all members outside its largest component are compared with all those that they aren't
connected to, in chunks of hubs, so that no task has a bucket of its own; a pair is made in one only of the buckets that
it shares. No link between bucket members is lost: pairs are left out only where a bound shows that they cannot reach
the limit, or where sketches of 8,192 bits differ in more places than those of a pair at the limit do, by more than five
standard deviations. Only pairs that pass both are confirmed on the full sets. The number of sketch comparisons of the
last round is at most, for each open bucket, its members times those outside its largest component.

Texts with the same set are one class, which is compared once. Classes have numbers of their own, so rows that share a
doc_id but not their text are different ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, limit_batches, lookup, release_shuffles
from .components import components
from .words import mixed, windows, word_hashes

WORDS = 5
#: Bands, and bins in a band. A pair at the similarity limit of 0.75 shares no bucket with probability
#: (1 - 0.75^5)^48, about 2e-6.
LAYOUT = (48, 5)
#: Bits of a sketch, each of one bin's smallest hash, and the most in which the sketches of a pair may differ. A pair at
#: the limit differs in 1,024 on average, with a standard deviation of 30.
BITS, MOST = 8192, 1190
#: Further hubs of a bucket in the first round.
HUBS = 2
#: Hubs of a bucket that one task compares in the last round, and bytes of sets that leave a task at once.
CHUNK, SET_BYTES = 2048, 16 << 20
#: Probes of an empty bin before its order over all filled bins decides.
PROBES = 48
#: Percent of the union that the intersection must reach.
LEAST = 75


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words has its whole sequence as one."""
    found = word_hashes(text.encode().lower())[0]  # lower-cases A-Z only
    if not len(found):
        return found
    if len(found) < words:
        return windows(np.concatenate([[np.uint64(len(found))], found]), len(found) + 1)
    return np.unique(windows(found, words))


class OneHash:
    """Bins by the leading part of the hash, so that the sorted set has each bin's smallest hash first."""

    def __init__(self, bands: int, rows: int):
        self.shape, n = (bands, rows), bands * rows
        seed = mixed(np.array([n], dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))[0]
        self.seed, self.bounds = seed, np.array([(k << 64) // n for k in range(n)], dtype=np.uint64)
        each = mixed(np.arange(PROBES * n, dtype=np.uint64) ^ seed).reshape(PROBES, n)
        self.probes = (each % np.uint64(n)).astype(np.int64)
        self.rank = mixed(np.arange(n, dtype=np.uint64) + seed)
        self.salt = mixed(np.arange(bands, dtype=np.uint64) + mixed(seed[None])[0])

    def smallest(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest hash of each bin, borrowed for empty ones."""
        shingles = np.sort(mixed(shingles ^ self.seed))
        first = np.searchsorted(shingles, self.bounds)
        full = np.append(first[1:], len(shingles)) > first
        source, empty = np.arange(len(full)), np.flatnonzero(~full)
        for probe in self.probes:
            if not len(empty):
                break
            to = probe[empty]
            hit = full[to]
            source[empty[hit]] = to[hit]
            empty = empty[~hit]
        if len(empty):
            filled = np.flatnonzero(full)
            source[empty] = filled[np.argmin(mixed(self.rank[empty][:, None] ^ self.rank[filled][None, :]), axis=1)]
        return shingles[first[source]]

    def sketch(self, shingles: np.ndarray) -> np.ndarray:
        """One bit of each bin, which depends on the bin and its smallest hash."""
        bits = (mixed(self.smallest(shingles) ^ self.rank) >> np.uint64(63)).astype(np.uint8)
        return np.packbits(bits).view("<i8")

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        values = mixed(self.smallest(shingles)).reshape(self.shape)
        out = self.salt.copy()
        for k in range(self.shape[1]):
            out = mixed(out ^ values[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        return out.astype(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])
    one = OneHash(*LAYOUT)
    for batch in batches:
        sizes, digests, bands = [], [], []
        for text in batch.column(2).to_pylist():
            found = shingle_set(text or "")
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            bands.append(one.bands(found) if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.binary()), pa.array(bands, type=pa.list_(pa.int64()))], schema=schema)


_SIGNATURE = "doc_id long, hash long, n_shingles long, digest binary, bands array<long>"


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingle_set(x or "").view(np.int64) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in found], type=pa.int64()), pa.array(found, type=pa.list_(pa.int64()))], names=["node", "n_shingles", "shingles"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits, one = OneHash(1, BITS), OneHash(*LAYOUT)
    for batch in batches:
        sets = [np.array(x, dtype=np.int64).view(np.uint64) for x in batch.column("shingles").to_pylist()]
        sketches, bands = ([f(x) for x in sets] for f in (bits.sketch, one.bands))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("shared"), *(pa.array(x, type=pa.list_(pa.int64())) for x in (sketches, bands))], names=["rep", "shared", "sketch", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set of each class, once for each hub that it is compared with (its own number: as a hub)."""
    schema = pa.schema([("hub", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])
    for batch in batches:
        for node, text, hubs in zip(*(c.to_pylist() for c in batch.columns)):
            found = shingle_set(text or "").tobytes()
            step = max(1, SET_BYTES // max(1, len(found)))
            for k in range(0, len(hubs), step):
                some = hubs[k : k + step]
                yield pa.RecordBatch.from_arrays([pa.array(some, type=pa.int64()), pa.array([node] * len(some), type=pa.int64()), pa.array([found] * len(some), type=pa.binary())], schema=schema)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, last, known = [], None, None
        for hub, a, b in zip(*(batch.column(c).to_pylist() for c in ("hub", "hub_set", "shingles"))):
            if last != hub:
                last, known = hub, np.frombuffer(a, dtype=np.uint64)
            other = np.frombuffer(b, dtype=np.uint64)
            both = len(np.intersect1d(known, other, assume_unique=True))
            keep.append(100 * both >= LEAST * (len(known) + len(other) - both))
        yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("node")], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))


def _texts(docs: DataFrame, classes: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """``wanted(node, ...)`` with the text of each class: that of its first row, found by doc_id and text hash."""
    named = wanted.join(classes.select("node", F.col("rep").alias("doc_id"), "hash"), "node")
    out = docs.join(named, ["doc_id", "hash"]).select("node", "text", *(c for c in wanted.columns if c != "node"))
    return out.dropDuplicates(["node"]) if repeated else out  # rows that repeat a document have the same text


def _confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, repeated: bool, scratch: Scratch, name: str) -> DataFrame:
    """Of ``pairs(hub, node)`` those that reach the limit on their full sets, as edges (a, b)."""
    wanted = pairs.union(pairs.select("hub", F.col("hub").alias("node"))).groupBy("node").agg(F.collect_set("hub").alias("hubs"))
    wanted = scratch.save(wanted, f"{name}-wanted")
    sets = scratch.save(_texts(docs, classes, wanted, repeated).mapInArrow(_sets, "hub long, node long, shingles binary"), f"{name}-sets", codec="none")
    release_shuffles(scratch.spark)
    hubs = sets.where("hub = node").select("hub", F.col("shingles").alias("hub_set"))
    both = sets.where("hub <> node").join(hubs, "hub").select("hub", "hub_set", "node", "shingles")
    out = scratch.save(both.mapInArrow(_confirm, "a long, b long").distinct(), f"{name}-edges")
    scratch.drop(f"{name}-wanted", f"{name}-sets")
    return out


def _members(signatures: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(bucket, rep, n, hub) of the buckets that more than one class is in; the hub is the smallest."""
    rows = scratch.save(signatures.select(F.col("node").alias("rep"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket")), f"{name}-bands")
    shared = rows.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select("bucket", "hub")
    members = scratch.save(rows.join(shared, "bucket").select("bucket", "rep", "n", "hub"), f"{name}-members")
    del rows, shared
    scratch.drop(f"{name}-bands")
    release_shuffles(scratch.spark)
    return members


def _open_buckets(members: DataFrame, found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(bucket, rep, n, c) of the buckets whose members are in several components."""
    labelled = members.select("bucket", "rep", "n").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("c"))
    labelled = scratch.save(labelled, f"{name}-labelled")
    several = labelled.groupBy("bucket").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("bucket")
    return labelled.join(several, "bucket")


def _classified(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, hash, n_shingles, group, component_id) of each row of ``docs(doc_id, hash, text)``.

    ``component_id`` is the smallest doc_id of the row's group, or its own where it has no words or no id; such rows have
    no group.
    """
    spark = docs.sparkSession
    rows = scratch.save(docs.mapInArrow(_signatures, _SIGNATURE), "rows")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    classes = usable.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("hash", "doc_id").alias("hash")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.save(classes, "classes")  # numbers are fixed once written
    firsts = usable.join(classes.select("digest", F.col("rep").alias("doc_id"), "hash", "node"), ["digest", "doc_id", "hash"])
    repeated = firsts.select("node").count() > classes.count()
    if repeated:  # a first row that occurs again would fill its buckets
        firsts = firsts.dropDuplicates(["node"])
    members = _members(firsts, scratch, "first")
    edges = _confirmed(docs, classes, members.where("rep > hub").select("hub", F.col("rep").alias("node")).distinct(), repeated, scratch, "star")
    found = scratch.save(components(edges, scratch, "cc"), "components")
    # What the stars have left in several components.
    again = scratch.save(_open_buckets(members, found, scratch, "first").select(F.col("rep").alias("node")).distinct(), "again")
    sets = _texts(docs, classes, again, repeated).mapInArrow(_shingles, "node long, n_shingles long, shingles array<long>")
    sets = scratch.save(sets, "sets", codec="none")
    alone = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("m"), F.min("node").alias("node")).where("m = 1").groupBy("node").agg(F.count("*").alias("alone"))
    shared = F.col("n_shingles") - F.coalesce("alone", F.lit(0))
    able = sets.join(alone, "node", "left").withColumn("shared", shared).where(100 * F.col("shared") >= LEAST * F.col("n_shingles"))
    known = scratch.save(able.select(F.col("node").alias("rep"), "shared", "shingles").mapInArrow(_sketches, "rep long, shared long, sketch array<long>, bands array<long>"), "known")
    members = scratch.save(members.join(known.select("rep"), "rep", "left_semi"), "able")
    scratch.drop("first-labelled", "first-members", "sets")
    release_shuffles(spark)
    # At most so many shingles of a pair are common.
    common = F.least("shared", "hub_shared")
    apart = F.aggregate(F.zip_with("sketch", "hub_sketch", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, x: s + x)
    reach = (F.col("c") != F.col("hub_c")) & (100 * common >= LEAST * (F.col("n") + F.col("hub_n") - common))
    for last in (False, True):
        here = scratch.save(_open_buckets(members, found, scratch, f"open-{last}").join(known if last else known.drop("bands"), "rep"), f"rows-{last}")
        hubs = here.select("bucket", F.col("rep").alias("hub"), *(F.col(c).alias(f"hub_{c}") for c in here.columns if c not in ("bucket", "rep")))
        if last:
            # The largest component of each bucket has no hubs; a pair of hubs counts once.
            counts = here.groupBy("bucket", "c").agg(F.count("*").alias("m"))
            largest = counts.groupBy("bucket").agg(F.max_by("c", F.col("m")).alias("top"), (F.sum("m") - F.max("m")).alias("hubs"))
            sized = largest.withColumn("chunks", F.ceil(F.col("hubs") / CHUNK).cast("int"))
            # A bucket with many hubs is cut into chunks of them, each a key of its own that meets all members.
            hubs = hubs.join(sized, "bucket").where("hub_c <> top").withColumn("chunk", F.pmod(F.xxhash64("hub"), F.col("chunks")).cast("int"))
            here = here.join(sized.select("bucket", "chunks"), "bucket").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
            once, keys = (F.col("c") == F.col("top")) | (F.col("rep") > F.col("hub")), ["bucket", "chunk"]
            # All buckets that two components share are open, so one of those that a pair shares, the smallest, makes it.
            reach = reach & (F.array_min(F.array_intersect("bands", "hub_bands")) == F.col("bucket"))
        else:
            # Members with the fewest shingles of their own are what others are copies of, and link with the most of them.
            order = Window.partitionBy("bucket").orderBy(F.col("hub_n") - F.col("hub_shared"), F.xxhash64("hub"), "hub")
            hubs = hubs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HUBS)
            once, keys = F.col("rep") != F.col("hub"), ["bucket"]
        pairs = here.join(hubs, keys).where(once & reach & (apart <= MOST)).select(F.least("hub", "rep").alias("hub"), F.greatest("hub", "rep").alias("node"))
        pairs = scratch.save(pairs if last else pairs.distinct(), f"pairs-{last}")
        more = _confirmed(docs, classes, pairs, repeated, scratch, f"round-{last}")
        if not more.isEmpty():
            # Each node's component stands for the links found so far.
            known_links = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = scratch.save(components(known_links.union(more), scratch, f"cc-{last}"), f"components-{last}")
        scratch.drop(f"open-{last}-labelled", f"rows-{last}", f"pairs-{last}")
    # The smallest doc_id of each component.
    linked = scratch.save(classes.join(found, "node").select("node", "component", "rep"), "linked")
    least = linked.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("members"))
    # A component may hold a third of all classes: large ones are looked up in place.
    grouped = lookup(linked.select("node", "component"), least, ["component"], "members").select("node", "component", "least")
    own = classes.join(grouped, "node", "left").select("digest", F.coalesce("component", "node").alias("group"), F.coalesce("least", "rep").alias("component_id"))
    own = scratch.save(own, "own")
    plain = rows.select("doc_id", "hash", "n_shingles", "digest")
    out = plain.where("doc_id is not null and n_shingles > 0").join(own, "digest").select("doc_id", "hash", "n_shingles", "group", "component_id")
    # Rows without words have no digest; in the join they would all be one key.
    return out.unionByName(plain.where("doc_id is null or n_shingles = 0").select("doc_id", "hash", "n_shingles", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id")))


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"), "text")


def near_documents(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to doc_id, n_shingles, component_id, kept; one row for each input row.

    Texts are lower-cased in A-Z and split at ASCII white space. Null and empty texts have empty sets and link with
    nothing. A null doc_id links with nothing either: its component is null and the row is kept. Repeated rows get a
    row each. Rows that share a doc_id but not their text are documents of their own, linked by their texts only. Other
    columns are left out. Equal sets are linked without being compared.
    """
    limit_batches(docs.sparkSession)
    out = _classified(_hashed(docs), Scratch(docs.sparkSession, "near-documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies, with the same columns: the first by doc_id, then by a hash of the text.

    Rows without an id and rows without words link with nothing and stay, all of them. Of rows that repeat a kept one in
    doc_id and text, one stays, the smallest by a hash of all its columns. Columns may have any names; an empty table
    gives no rows, and texts of any length are compared whole.
    """
    limit_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-documents")
    found = scratch.save(_classified(_hashed(docs), scratch), "classified").where("group is not null")
    own = "_keep_"
    while any(c.startswith(own) for c in docs.columns):
        own = "_" + own
    first = found.where("doc_id = component_id").groupBy("group", "component_id").agg(F.min("hash").alias(f"{own}hash"))
    first = first.select(F.col("component_id").alias(f"{own}id"), f"{own}hash")
    keyed = docs.withColumns({f"{own}key": F.col("doc_id").cast("long"), f"{own}text": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))})
    kept = keyed.join(first, (F.col(f"{own}key") == F.col(f"{own}id")) & (F.col(f"{own}text") == F.col(f"{own}hash")), "left_semi")
    twice = found.groupBy("doc_id", "hash").agg(F.count("*").alias("m")).where("m > 1").limit(1)
    if not twice.isEmpty():
        kept = kept.withColumn(f"{own}row", F.xxhash64(*(f.name for f in docs.schema if not isinstance(f.dataType, T.MapType))))
        least = kept.groupBy(f"{own}key", f"{own}text").agg(F.min(f"{own}row").alias(f"{own}row"))
        kept = kept.join(least, [f"{own}key", f"{own}text", f"{own}row"], "left_semi").dropDuplicates([f"{own}key", f"{own}text"])
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull() | ~has_words))
