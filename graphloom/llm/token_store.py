"""Token-ID output (operator 1): a table of independent Huffman blocks, read back with a decoding table.

Layout under the given path, all Parquet so that any file system and commit protocol of Spark serves:

* ``codebook``: one row with the code length of every id (canonical codes follow from the lengths) and the end id;
* ``blocks``: one row for each block: shard, block, first id's place in the shard, payload, number of ids, bit
  offset of every 256th id, and the documents (or pieces of very long documents) that it holds;
* ``shards``: number of ids of each shard. Shards follow each other in ascending doc_id order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, release_shuffles, whole_text
from .encoders import JsonEncoder, opened, read_vocabulary
from .huffman import Codebook, code_lengths

#: A block is closed when it holds so many ids; a longer document is cut into pieces of this size.
BLOCK_IDS = 1 << 18

_RAW = "shard int, block long, first_id long, n_ids long, ids binary, doc_ids array<long>, lengths array<long>, pieces array<int>, of array<int>, counts_id array<int>, counts_n array<long>"
_BLOCK = "shard int, block long, first_id long, n_ids long, payload binary, checkpoints array<long>, doc_ids array<long>, lengths array<long>, pieces array<int>, of array<int>"
_DOC = "doc_id long, shard int, at long, n_tokens long, ids_crc32 long, piece int, of int, ids binary"


def _raw_blocks(vocabulary: bytes, end_id: int, block_ids: int):
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("of", pa.list_(pa.int32())), ("counts_id", pa.list_(pa.int32())), ("counts_n", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = opened(JsonEncoder, vocabulary)
        shard, end = TaskContext.get().partitionId(), np.array([end_id], dtype="<u4")
        size = max(encode.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        kind = "<u2" if size <= 1 << 16 else "<u4"
        counts = np.zeros(size, dtype=np.int64)
        held, docs, n, block, first = [], [], 0, 0, 0

        def close():
            nonlocal held, docs, n, block, first
            ids = np.concatenate(held)
            counts[:] += np.bincount(ids, minlength=size)
            row = [shard, block, first, n, ids.astype(kind).tobytes(), *([d[k] for d in docs] for k in range(4)), None, None]
            held, docs, n, block, first = [], [], 0, block + 1, first + n
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), map(encode, batch.column(1).to_pylist())):
                ids = np.append(np.frombuffer(own, dtype="<u4"), end)
                of = -(-len(ids) // block_ids)
                for k in range(of):
                    piece = ids[block_ids * k : block_ids * (k + 1)]
                    held.append(piece)
                    docs.append((doc_id, len(piece), k, of))
                    n += len(piece)
                    if n >= block_ids:
                        yield close()
        if docs:
            yield close()
        found = np.flatnonzero(counts)
        row = [shard, -1, first, 0, b"", [], [], [], [], found, counts[found]]
        yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

    return run


def _pack(book: Codebook, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [book.encode(np.frombuffer(x, dtype=kind)) for x in batch.column("ids").to_pylist()]
            columns = {n: batch.column(n) for n in ("shard", "block", "first_id", "n_ids")}
            columns |= {"payload": pa.array([p for p, _ in packed], type=pa.binary()), "checkpoints": pa.array([c for _, c in packed], type=pa.list_(pa.int64()))}
            columns |= {n: batch.column(n) for n in ("doc_ids", "lengths", "pieces", "of")}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def write_token_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 2, limit: int = 16, block_ids: int = BLOCK_IDS) -> dict:
    """Encode ``docs(doc_id, text)`` and write the store to ``path``; returns totals.

    Null texts are empty and give the end id alone. Null doc_ids come first, rows of one doc_id follow each other
    in an order fixed by their text, repeated rows are stored again; other columns are left out. An empty table
    gives an empty store.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "token-store")
    content = read_vocabulary(vocabulary)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    ranged = slim.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    raw = scratch.save(ranged.mapInArrow(_raw_blocks(content, end_id, block_ids), _RAW), "raw")
    del ranged
    release_shuffles(spark)
    # One row for each id of the vocabulary, and one for each shard, reach the driver.
    rows = raw.where("block = -1").select(F.explode(F.arrays_zip("counts_id", "counts_n")).alias("x")).groupBy(F.col("x.counts_id").alias("id")).agg(F.sum("x.counts_n").alias("n")).collect()
    encoder = JsonEncoder(content)
    size = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    counts = np.zeros(size, dtype=np.int64)
    for r in rows:
        counts[r.id] = r.n
    book = Codebook(code_lengths(counts, limit))
    kind = "<u2" if size <= 1 << 16 else "<u4"
    limit_batches(spark, 16)
    raw.where("block >= 0").mapInArrow(_pack(book, kind), _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")
    raw.where("block = -1").select("shard", F.col("first_id").alias("n_ids")).coalesce(1).write.parquet(f"{path}/shards")
    spark.createDataFrame([(bytearray(book.lengths.tobytes()), end_id, block_ids)], "lengths binary, end_id int, block_ids long").coalesce(1).write.parquet(f"{path}/codebook")
    scratch.drop("raw")
    return {"ids": int(counts.sum()), "bits": int((counts * book.lengths).sum())}


def _unpack(lengths: bytes):
    schema = pa.schema([("doc_id", pa.int64()), ("shard", pa.int32()), ("at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("piece", pa.int32()), ("of", pa.int32()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = Codebook(np.frombuffer(lengths, dtype=np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                ids = book.decode(row["payload"], row["n_ids"], np.array(row["checkpoints"], dtype=np.int64)).astype("<u4").tobytes()
                out, at = [], 0
                for doc_id, n, piece, of in zip(row["doc_ids"], row["lengths"], row["pieces"], row["of"]):
                    own = ids[4 * at : 4 * (at + n)]
                    out.append((doc_id, row["shard"], row["first_id"] + at, n, zlib.crc32(own), piece, of, own))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def read_token_store(spark: SparkSession, path: str) -> DataFrame:
    """Decode all blocks: doc_id, start, n_tokens, ids_crc32, ids (little-endian 32-bit) of each stored document."""
    limit_batches(spark, 16)
    (book,) = spark.read.parquet(f"{path}/codebook").collect()
    base, bases = 0, []
    for r in sorted(spark.read.parquet(f"{path}/shards").collect()):  # one row for each task that wrote
        bases.append((r.shard, base))
        base += r.n_ids
    blocks = spark.read.parquet(f"{path}/blocks")
    starts = spark.createDataFrame(bases, "shard int, base long")
    whole = blocks.mapInArrow(_unpack(bytes(book.lengths)), _DOC).where("of = 1").select("doc_id", "shard", "at", "n_tokens", "ids_crc32", "ids")
    # Only blocks that hold pieces of a longer document are read for those.
    pieces = blocks.where(F.array_max("of") > 1).mapInArrow(_unpack(bytes(book.lengths)), _DOC).where("of > 1")
    both = whole.unionByName(_joined(pieces, book.block_ids)).join(F.broadcast(starts), "shard")
    return both.select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def _joined(parts: DataFrame, block_ids: int) -> DataFrame:
    """Pieces of very long documents, put together again; a group is one document."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("piece")
        ids = b"".join(pdf["ids"])
        return pd.DataFrame({"doc_id": pdf["doc_id"][:1], "shard": pdf["shard"][:1], "at": pdf["at"][:1], "n_tokens": [len(ids) // 4], "ids_crc32": [zlib.crc32(ids)], "ids": [ids]})

    # All pieces but the last hold block_ids ids, so each tells where its document begins in the shard.
    head = parts.withColumn("head", F.col("at") - F.col("piece") * F.lit(block_ids))
    return head.groupBy("shard", "head").applyInPandas(run, "doc_id long, shard int, at long, n_tokens long, ids_crc32 long, ids binary")
