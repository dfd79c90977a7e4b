"""What filters remove alone, together and in every order, by a packed bitmap index (operator 13).

Each task packs its rows' failures, marks and parts into bitmaps: the rows of a part are one stretch of whole bytes, and
every filter and mark has one bit a row. For each set of filters that can stand before another, AND-NOT gives the rows
that fail none of it; their bits are counted by part. These counts, 2^filters numbers a part and task, are all that is
shuffled, and every order of the filters follows from their sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, lookup

#: Rows and bytes of part names that one bitmap covers, at most.
INDEX_ROWS, INDEX_BYTES = 1 << 20, 64 << 20
#: Most filters: each set of them is counted.
MOST_FILTERS = 10

#: The five conditions of ``text_failures``.
MIN_WORDS, MIN_DISTINCT, MAX_UPPER = 200, 50, 2
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER, _SYMBOLS, _INSIDE = bytes(range(65, 91)), b"#$%&*|", bytes(range(128, 192))
#: Bytes of a text whose words are not held as one list.
_LONG = 1 << 22


def _failures(text: bytes) -> int:
    """Bits of the conditions A to D of one text in UTF-8."""
    if len(text) < _LONG:
        words = text.split()  # bytes.split() splits at just the six characters that are no part of a word
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for n, found in enumerate(_WORD.finditer(text), 1):
            seen.add(found.group())
        distinct = len(seen)
    upper, points = len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _INSIDE))
    return (n < MIN_WORDS) | (100 * distinct < MIN_DISTINCT * n) << 1 | (100 * upper > MAX_UPPER * points) << 2 | (len(text.translate(None, _SYMBOLS)) < len(text)) << 3


def text_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Parts, failures and marks of every row of ``docs(doc_id, text, source)``: part, A, B, C, D, E, good, toxic.

    A: under 200 words. B: 100 times its distinct words under 50 times its words. C: 100 times its ``[A-Z]`` over twice
    its code points. D: any of ``#$%&*|``. E: a row with a smaller doc_id has the same text (by digests of 128 bits),
    whatever becomes of that row. A null text counts as empty, a null source as the part ``""``. A row without doc_id is
    no later copy and has no marks; rows that share id and text are no copies of each other. ``good`` and ``toxic``:
    some row of ``labels(doc_id, quality, toxic)`` gives the id quality 1, or toxic 1. Every row gives one row, whatever
    its other columns are called; an empty table none. Texts of any length are read whole; beyond 4 MB only their
    distinct words are held. Rows of one text may be any share of the table; those of one doc_id are left to the skew
    split of adaptive execution.
    """
    limit_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "filter-audit")
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failed", pa.int32()), ("digest", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = [], []
            for text in batch.column(2).to_pylist():
                failed.append(_failures(text))
                digests.append(blake2b(text, digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(failed, pa.int32()), pa.array(digests, pa.binary())], schema=schema)

    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), text)
    rows = scratch.save(slim.mapInArrow(read, "doc_id long, part string, failed int, digest binary"), "rows")
    copies = scratch.save(rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1"), "copies")
    judged = lookup(rows, copies, ["digest"], "n").select("doc_id", "part", "failed", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).alias("E"))
    marks = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without id meet no label; they are scattered, so that they are not dealt to one task.
    spread = F.when(F.col("doc_id").isNull(), 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)).cast("long")
    joined = judged.withColumn("_scatter", spread).join(marks.withColumn("_scatter", F.lit(0).cast("long")), ["doc_id", "_scatter"], "left")
    bits = [(F.col("failed").bitwiseAND(1 << k) != 0).alias(name) for k, name in enumerate("ABCD")]
    return joined.select("part", *bits, "E", *(F.coalesce(F.col(m), F.lit(False)).alias(m) for m in ("good", "toxic")))


def bitmap_index(rows: DataFrame, filters: list[str], part: str, marks: list[str] = ()) -> DataFrame:
    """The packed index of ``rows``: boolean columns ``filters`` (true: fails) and ``marks`` by the string column ``part``.

    One row for at most 2^20 rows: parts, starts (the first byte of each part's stretch) and bitmaps, least bit first:
    the rows there are, then one bitmap for each filter and each mark. Bits between stretches are 0. A null counts as
    false, a null part as the empty string; an empty table gives no rows.
    """
    limit_batches(rows.sparkSession)
    names = [*filters, *marks]
    schema = pa.schema([("parts", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("bitmaps", pa.list_(pa.binary()))])

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        coded = table.column(0).combine_chunks().dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        codes, flags = coded.indices.to_numpy(), table.column(1).to_numpy()
        order = np.argsort(codes, kind="stable")
        sizes = np.bincount(codes, minlength=len(coded.dictionary))
        width = (sizes + 7) // 8
        starts = np.concatenate([[0], np.cumsum(width)])
        place = np.arange(len(codes)) + np.repeat(8 * starts[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
        bitmaps = []
        for k in range(-1, len(names)):
            bits = np.zeros(8 * starts[-1], np.uint8)
            bits[place] = 1 if k < 0 else flags[order] >> k & 1
            bitmaps.append(np.packbits(bits, bitorder="little").tobytes())
        arrays = [pa.array([x], type=f.type) for x, f in zip((coded.dictionary.to_pylist(), starts[:-1].tolist(), bitmaps), schema)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and (n + batch.num_rows > INDEX_ROWS or size > INDEX_BYTES):
                yield pack(held)
                held, n, size = [], 0, 0
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
        if held:
            yield pack(held)

    flags = sum((F.coalesce(F.col(c), F.lit(False)).cast("int") * (1 << k) for k, c in enumerate(names)), F.lit(0))
    slim = rows.select(F.coalesce(F.col(part), F.lit("")).alias("part"), flags.cast("int").alias("flags"))
    return slim.mapInArrow(run, "parts array<string>, starts array<int>, bitmaps array<binary>")


def subset_counts(index: DataFrame, n_filters: int, marks: list[str] = ()) -> DataFrame:
    """Rows of each part that fail no filter of a set, for all sets: part, subset (bits of its filters), n and one count
    for each mark. Each task counts its own bitmaps; the sums are hash-keyed by part and subset."""
    if n_filters > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters")
    kinds, n_marks = "".join(f", m{k} long" for k in range(len(marks))), len(marks)
    schema = pa.schema([("part", pa.string()), ("subset", pa.int32()), ("n", pa.int64()), *((f"m{k}", pa.int64()) for k in range(n_marks))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, starts, bitmaps in zip(*(c.to_pylist() for c in batch.columns)):
                maps = [np.frombuffer(x, np.uint8) for x in bitmaps]
                fails, good, alive = maps[1 : n_filters + 1], maps[n_filters + 1 :], [maps[0]]
                counts = np.empty((1 << n_filters, 1 + n_marks, len(parts)), np.int64)
                for subset in range(1 << n_filters):
                    if subset:
                        low = (subset & -subset).bit_length() - 1
                        alive.append(alive[subset & (subset - 1)] & ~fails[low])
                    for k, bits in enumerate([alive[subset], *(alive[subset] & g for g in good)]):
                        counts[subset, k] = np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts)
                for subset in range(1 << n_filters):
                    same = pa.array(np.full(len(parts), subset, np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), same, *map(pa.array, counts[subset])], schema=schema)

    found = index.mapInArrow(run, "part string, subset int, n long" + kinds).groupBy("part", "subset")
    return found.agg(F.sum("n").alias("n"), *(F.sum(f"m{k}").alias(name) for k, name in enumerate(marks)))


def audit_orders(counts: DataFrame, names: str, marks: list[str] = ()) -> DataFrame:
    """Every order of the filters, step by step, from ``subset_counts``; ``names`` has one letter for each filter.

    Columns: part, filter_order, step (from 1), then of the step's filter: kept (rows left after it), removed, redundant
    (fail it, removed earlier), unique_fails (fail it only), ``<mark>_lost`` for each mark (rows with it removed here)
    and shapley (rows it removes, summed over all orders). One group has 2^filters rows.
    """
    full = (1 << len(names)) - 1
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for k, f in enumerate(order):
            steps.append(f"struct('{''.join(names[x] for x in order)}', {k + 1}, {before}, {before | 1 << f}, {f})")
            before |= 1 << f
    every = F.expr(f"array({', '.join(steps)})").cast("array<struct<filter_order:string,step:int,before:int,after:int,filter:int>>")

    def shapley(f: int):
        sets = [s for s in range(full + 1) if not s >> f & 1]
        weights = [factorial(s.bit_count()) * factorial(len(names) - 1 - s.bit_count()) for s in sets]
        return F.expr(" + ".join(f"{w} * (n[{s}] - n[{s | 1 << f}])" for s, w in zip(sets, weights)))

    by_subset = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "n", *marks))).alias("all"))
    columns = [F.expr(f"transform(all, x -> x.`{c}`)").alias(c) for c in ("n", *marks)]
    wide = by_subset.select("part", *columns).withColumn("shares", F.array(*(shapley(f) for f in range(len(names)))))
    rows = wide.withColumn("s", F.explode(every))
    at = lambda column, i: F.get(F.col(column), i)
    before, after, alone = F.col("s.before"), F.col("s.after"), F.col("s.after") - F.col("s.before")
    removed = at("n", before) - at("n", after)
    only = F.get(F.col("n"), F.lit(full) - alone) - F.get(F.col("n"), F.lit(full))
    return rows.select(
        "part",
        "s.filter_order",
        "s.step",
        at("n", after).alias("kept"),
        removed.alias("removed"),
        (at("n", F.lit(0)) - at("n", alone) - removed).alias("redundant"),
        only.alias("unique_fails"),
        *((at(m, before) - at(m, after)).alias(f"{m}_lost") for m in marks),
        at("shares", F.col("s.filter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``audit_orders`` of the five conditions of ``text_failures``, by source."""
    rows = text_failures(docs, labels)
    counts = subset_counts(bitmap_index(rows, list("ABCDE"), "part", ["good", "toxic"]), 5, ["good", "toxic"])
    return audit_orders(counts, "ABCDE", ["good", "toxic"])
