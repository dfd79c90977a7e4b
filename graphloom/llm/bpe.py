"""Byte-level BPE encoding and decoding by a rank file (operator 2)."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, whole_text
from .encoders import RankEncoder, opened, read_vocabulary


def encode_documents(docs: DataFrame, ranks: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Encode every row of ``docs(doc_id, text)`` and decode the ids again.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and with ``keep_ids`` also ids (little-endian 32-bit) and
    decoded (bytes). Null texts count as empty: no tokens, and the digests of no bytes. Every row, repeated or not,
    gives one row; doc_id may be null; other columns are left out. Long texts are cut at safe places only, so the
    ids equal those of the whole text.
    """
    limit_batches(docs.sparkSession)
    content = read_vocabulary(ranks)
    extra = [("ids", pa.binary()), ("decoded", pa.binary())] if keep_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(RankEncoder, content, pattern)
        for batch in batches:
            out = [[] for _ in schema]
            for text in batch.column(1).to_pylist():
                ids = encoder(text)
                packed, decoded = array("I", ids).tobytes(), encoder.decode(ids)
                for column, value in zip(out[1:], (len(ids), sha256(packed).hexdigest(), sha256(decoded).hexdigest(), packed, decoded)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, type=f.type) for v, f in zip(out[1:], list(schema)[1:]))], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    more = ", ids binary, decoded binary" if keep_ids else ""
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Bytes of each row of ``encoded(doc_id, ids)``; null ids give no bytes, unknown ids raise IndexError."""
    limit_batches(encoded.sparkSession)
    content = read_vocabulary(ranks)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = opened(RankEncoder, content, pattern)
        for batch in batches:
            decoded = [encoder.decode(array("I", x or b"").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, type=pa.binary())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, decoded binary")
