"""Removal of repeated lines and passages by global digests (operator 10).

The unit is the line: its words, lower-cased in A-Z and joined by one blank. Digests of lines of LINE_WORDS words or more
are grouped over the whole corpus; the occurrence in the document of the smallest rank (there: the first) stays, all
others go with their words' offsets on record. Shorter lines always stay.

Passages set into a line share no line digest, so windows are units too: from places that the words themselves fix (a cut
follows a word when the hash of it and the one before falls into one residue class) to the first such place that is
PASSAGE_WORDS words away or more. Equal passages have equal windows wherever they stand. A window is removed only where
it stands as a whole, word for word, in one earlier document or earlier in the same one without overlap; so every removed
word lies in an earlier line, or in a stretch of PASSAGE_WORDS words or more of one earlier place. At both ends of
a passage up to one cut's distance (four words on average) stays.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, limit_batches, release_shuffles
from .words import mixed, stretches, word_hashes

#: A cut follows one word of so many on average.
CUT = 4
#: Least words of a window, and of a line that counts as a unit.
PASSAGE_WORDS, LINE_WORDS = 25, 10
#: A digest is hot when it has more than one in so many of all occurrences of repeated digests, so there are fewer hot ones
#: than that, whatever the data. They are sent to all tasks; each of the others has few enough rows for one task. Digests
#: with LEAST_HOT occurrences or fewer never count as hot.
HOT, LEAST_HOT = 20_000, 1000
#: Documents without an id rank behind all others, by a hash of their text.
LAST = 1 << 62


class Units:
    """The units of a text: word ranges [a, b) in order of their places, windows first, and their digests."""

    def __init__(self, text: str, line_words: int):
        self.raw = text.encode()
        h, self.first, self.end = word_hashes(self.raw.lower())
        n = self.n_words = len(h)
        before = np.append(np.uint64(0), h[:-1])[:n]
        cut = (mixed(h + before * np.uint64(31)) >> np.uint64(40)) % np.uint64(CUT) == 0
        # A run of one word has no place of its own inside: it is cut after every eighth.
        place = np.arange(n)
        run = np.maximum.accumulate(np.where(np.append(True, h[1:] != h[:-1])[:n], place, 0)) if n else place
        cut |= (place - run) % 8 == 7
        cuts = np.concatenate([[0], np.flatnonzero(cut) + 1]) if n else np.zeros(0, dtype=np.int64)
        if n and cuts[-1] != n:
            cuts = np.append(cuts, n)
        to = np.searchsorted(cuts, cuts + PASSAGE_WORDS)
        to = to[to < len(cuts)]
        a, b = cuts[: len(to)], cuts[to]
        feeds = np.flatnonzero(np.frombuffer(self.raw, dtype=np.uint8) == 10)
        line = np.searchsorted(feeds, self.first)
        since = np.flatnonzero(np.append(True, line[1:] != line[:-1])[:n])
        until = np.append(since[1:], n)[: len(since)]
        whole = until - since >= line_words
        since, until = since[whole], until[whole]
        self.a, self.b = np.concatenate([a, since]), np.concatenate([b, until])
        self.digests = np.concatenate([stretches(h, a, b), mixed(stretches(h, since, until) ^ np.uint64(1))]).astype(np.int64)

    def repeated(self, elsewhere: np.ndarray) -> np.ndarray:
        """Flags of the words in units that stand in an earlier document, or end earlier in this one than they begin."""
        flags = np.zeros(self.n_words, dtype=bool)
        if not len(self.digests):
            return flags
        _, first, place = np.unique(self.digests, return_index=True, return_inverse=True)
        again = self.a >= self.b[first[place]]
        if len(elsewhere):
            again |= np.isin(self.digests, elsewhere)
        depth = np.zeros(self.n_words + 1, dtype=np.int64)
        np.add.at(depth, self.a[again], 1)
        np.add.at(depth, self.b[again], -1)
        return np.cumsum(depth)[:-1] > 0

    def without(self, flags: np.ndarray) -> tuple[str, list[tuple[int, int]]]:
        """The text without the flagged words and the white space before them (after them at its start), and the
        offsets of what is gone, in code points."""
        edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]]))).tolist()
        kept, gone, at = [], [], 0
        for a, b in zip(edge[::2], edge[1::2]):
            start = int(self.end[a - 1]) if a else 0
            end = int(self.end[b - 1]) if a else int(self.first[b]) if b < self.n_words else len(self.raw)
            kept.append(self.raw[at:start])
            gone.append((start, end))
            at = end
        leads = np.concatenate([[0], np.cumsum(np.frombuffer(self.raw, dtype=np.uint8) & 0xC0 != 0x80)])  # code points before each byte
        return b"".join([*kept, self.raw[at:]]).decode(), [(int(leads[a]), int(leads[b])) for a, b in gone]


def _digests(hot: np.ndarray, line_words: int):
    """Distinct digests of each row with its rank and text hash, without the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks, hashes, digests = [], [], []
            for rank, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.unique(Units(text or "", line_words).digests)
                if len(hot):
                    own = own[~np.isin(own, hot)]
                ranks.append(np.full(len(own), rank, dtype=np.int64))
                hashes.append(np.full(len(own), h, dtype=np.int64))
                digests.append(own)
            if ranks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (digests, ranks, hashes)], names=["digest", "rank", "hash"])

    return run


def _release(spark: SparkSession) -> None:
    """Frees shuffle files before more are written: Python hands its references back in the background, so a second call follows."""
    release_shuffles(spark)
    time.sleep(1)
    release_shuffles(spark)


def remove_repeats(docs: DataFrame, prefix: str = "_dedup_", line_words: int | None = None) -> DataFrame:
    """All rows and columns of ``docs(doc_id, text, ...)``, the text without lines and passages that stand earlier.

    Adds ``_dedup_words``, ``_dedup_removed_words`` and ``_dedup_spans``, an array of (start, end) offsets in code
    points of the original text. Documents rank by doc_id, those with a null doc_id behind all others by a hash of their
    text. Rows of one doc_id, and null ids of one text, rank alike, so they don't empty each other, whether their texts
    are equal or not. Null texts stay null and count as empty. Names that begin with the prefix are reserved. An empty
    table gives no rows; texts of any length are read whole.

    Lines of fewer than ``line_words`` words (LINE_WORDS where it isn't given) always stay, so that short lines which many
    clean documents share are left alone; with 1 every repeated line goes. Words are compared by digests of 64 bits.
    """
    line_words = LINE_WORDS if line_words is None else line_words
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "line-dedup")
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST).bitwiseOR(text_hash.bitwiseAND(LAST - 1)))
    slim = docs.select(rank.alias("rank"), text_hash.alias("hash"), "text")
    units = lambda hot: slim.mapInArrow(_digests(hot, line_words), "digest long, rank long, hash long")
    none = np.zeros(0, dtype=np.int64)
    firsts = units(none).groupBy("digest").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("*").alias("n"))
    firsts = scratch.save(firsts.where("first < last").select("digest", "first", "n"), "firsts")
    _release(spark)
    limit = max(LEAST_HOT, (firsts.agg(F.sum("n")).first()[0] or 0) // HOT)
    hot = firsts.where(F.col("n") > limit).select("digest", "first").toArrow().sort_by("digest")  # HOT rows at most
    hot_digests, hot_firsts = (hot.column(k).to_numpy() for k in (0, 1))
    again = units(hot_digests).join(firsts.where(F.col("n") <= limit).select("digest", "first"), "digest").where("first < rank")
    again = again.groupBy("rank", "hash").agg(F.collect_set("digest").alias("again"))
    again = scratch.save(again.select(F.col("rank").alias(prefix + "rank"), F.col("hash").alias(prefix + "hash"), F.col("again").alias(prefix + "again")), "again", codec="none")
    _release(spark)
    keyed = docs.withColumn(prefix + "key", rank).withColumn(prefix + "text", text_hash)
    joined = keyed.join(again, (F.col(prefix + "key") == F.col(prefix + "rank")) & (F.col(prefix + "text") == F.col(prefix + "hash")), "left")
    joined = joined.select(*docs.columns, prefix + "key", prefix + "again")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField(f.name, T.StringType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    schema = T.StructType([*fields, T.StructField(prefix + "words", T.LongType()), T.StructField(prefix + "removed_words", T.LongType()), T.StructField(prefix + "spans", span)])
    at, n_own, arrow_span = docs.columns.index("text"), len(docs.columns), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, words, gone, spans = [], [], [], []
            lists = batch.column(n_own + 1)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for text, own_rank, a, b in zip(batch.column(at).to_pylist(), batch.column(n_own).to_pylist(), offsets[:-1], offsets[1:]):
                own = Units(text or "", line_words)
                known = own.digests[np.isin(own.digests, hot_digests)] if len(hot_digests) else none
                known = known[hot_firsts[np.searchsorted(hot_digests, known)] < own_rank] if len(known) else none
                flags = own.repeated(np.concatenate([values[a:b], known]))
                n = int(flags.sum())
                new, removed = own.without(flags) if n else (text, [])
                texts.append(new)
                words.append(own.n_words)
                gone.append(n)
                spans.append([{"start": c, "end": d} for c, d in removed])
            columns = list(batch.columns[:n_own])
            columns[at] = pa.array(texts, type=pa.string())
            more = [pa.array(words, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(spans, type=arrow_span)]
            yield pa.RecordBatch.from_arrays([*columns, *more], names=schema.names)

    return joined.mapInArrow(run, schema)
