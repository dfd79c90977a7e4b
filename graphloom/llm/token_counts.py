"""Token counts without token ids (operator 4).

Two passes over the texts. The first gives every distinct pre-token of the corpus and how often it occurs; its
tokens are counted once, by the library, and the counts are written as a table. The second makes the pre-token
frequencies of each document and joins them to that table: the most frequent pre-tokens, a list of fixed size, are
joined in place, so that neither they nor their many rows are shuffled; all others go through a shuffled join.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches, whole_text
from .encoders import JsonEncoder, PieceEncoder, counted_units, opened, read_vocabulary

#: Bounds of the list that is sent to all executors: entries, and bytes of an entry.
COMMON, COMMON_BYTES = 150_000, 48
#: Distinct units that a task holds before it hands them on, and units whose pre-tokens it remembers.
HELD = 300_000


class JsonCounter:
    """Pre-tokens as the file's own pre-tokenizer gives them, or texts whole where cutting first isn't safe.

    Texts are cut into units, safe to pre-tokenize on their own. A unit's key is its text after a letter: ``b`` if the
    blank that it begins with is left out, ``u`` if not. A pre-token's key is ``p`` and the pre-token in the byte
    alphabet, or ``t`` and a text for the whole tokenizer.
    """

    def __init__(self, content: bytes):
        self.encoder = JsonEncoder(content)

    def units(self, text: str) -> tuple[list[str], list[str]]:
        """Units after a blank, and others."""
        if not self.encoder.by_units:
            return [], [text] if text else []
        return counted_units(text)

    def pretokens(self, word: str, blank: bool) -> tuple[str, ...]:
        e = self.encoder
        if not e.by_units:
            return ("t" + word,)
        if blank:
            if plain := e.plain(word):
                return ("p" + plain,)
            if word[-1:] in (",", ".") and (plain := e.plain(word[:-1])):
                return ("p" + plain, "p" + word[-1])
            word = " " + word
        if e.added_in(word):
            return ("t" + word,)
        return tuple("p" + piece for piece, _ in e.tokenizer.pre_tokenizer.pre_tokenize_str(word))

    def count(self, key: str) -> int:
        if key[0] == "p":
            return len(self.encoder.tokenizer.model.tokenize(key[1:]))
        return len(self.encoder.tokenizer.encode(key[1:], add_special_tokens=False).ids)


class PieceCounter:
    """sentencepiece: its merges may cross no cut only when texts stay whole, so a text is one pre-token."""

    def __init__(self, content: bytes):
        self.encoder = PieceEncoder(content)

    def units(self, text: str) -> tuple[list[str], list[str]]:
        return [], [text] if text else []

    def pretokens(self, word: str, blank: bool) -> tuple[str, ...]:
        return ("t" + word,)

    def count(self, key: str) -> int:
        return len(self.encoder(key[1:])) // 4


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Tokens of every row of ``docs(doc_id, text)``: doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty: 0 bytes, 0 tokens. Rows that share a doc_id are counted apart when their texts differ
    and come back once for each row; a null doc_id stays null; other columns are left out.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "token-counts")
    content = read_vocabulary(vocabulary)
    kind = PieceCounter if vocabulary.endswith(".model") else JsonCounter
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    seen_schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64())])

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = opened(kind, content), (Counter(), Counter())

        def flush():
            found = Counter()
            for blank, units in zip((True, False), held):
                for unit, n in units.items():
                    for key in counter.pretokens(unit, blank):
                        found[key] += n
                units.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.string()), pa.array(list(found.values()), type=pa.int64())], schema=seen_schema)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for units, more in zip(held, counter.units(text)):
                    units.update(more)
                if len(held[0]) + len(held[1]) >= HELD:
                    yield flush()
        yield flush()

    counted_schema = pa.schema([("pretoken", pa.string()), ("n", pa.int64()), ("n_pieces", pa.int32())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = opened(kind, content)
        for batch in batches:
            n = pa.array([counter.count(x) for x in batch.column(0).to_pylist()], type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], schema=counted_schema)

    seen = slim.select("text").mapInArrow(distinct, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    pieces = scratch.save(seen.mapInArrow(count, "pretoken string, n long, n_pieces int"), "pieces")
    # The most frequent ones: bins of a sixteenth of a doubling tell from which frequency on they fit the list.
    short = pieces.where(F.octet_length("pretoken") <= COMMON_BYTES)
    least, total = 2.0, 0
    for r in short.where("n > 1").groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("m")).orderBy(F.desc("bin")).collect():
        total += r.m
        if total > COMMON:
            least = 2.0 ** ((r.bin + 1) / 16)
            break
    top = short.where(F.floor(F.log2("n") * 16) >= round(16 * math.log2(least))).select("pretoken", "n_pieces").toArrow()
    sent = spark.sparkContext.broadcast((top.column(0).to_pylist(), top.column(1).to_pylist()))
    part_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("pretoken", pa.string()), ("times", pa.int64())])

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each document one row with what the common list answers, then one for each other pre-token."""
        counter, known, memo = opened(kind, content), dict(zip(*sent.value)), ({}, {})
        for batch in batches:
            out = [[] for _ in part_schema]
            for row, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                done, rest = 0, {}
                for blank, found, units in zip((True, False), memo, counter.units(text)):
                    if len(found) >= HELD:
                        found.clear()
                    for unit, times in Counter(units).items():
                        answer = found.get(unit)
                        if answer is None:
                            keys = counter.pretokens(unit, blank)
                            n = sum(known.get(k, 0) for k in keys)
                            answer = found[unit] = n if (open_ := tuple(k for k in keys if k not in known)) == () else (n, open_)
                        if type(answer) is int:
                            done += answer * times
                        else:
                            done += answer[0] * times
                            for key in answer[1]:
                                rest[key] = rest.get(key, 0) + times
                for values in ((row, doc_id, len(text.encode()), done, None, 0), *((row, None, None, 0, key, times) for key, times in rest.items())):
                    for column, value in zip(out, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(out, part_schema)], schema=part_schema)

    keyed = slim.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = scratch.save(keyed.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, n_tokens long, pretoken string, times long"), "parts")
    tail = parts.where("pretoken is not null").select("row", "pretoken", "times").join(pieces.select("pretoken", "n_pieces"), "pretoken").select("row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("n_bytes"), (F.col("times") * F.col("n_pieces")).alias("n_tokens"))
    both = parts.where("pretoken is null").select("row", "doc_id", "n_bytes", "n_tokens").unionByName(tail)
    total = both.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return total.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
