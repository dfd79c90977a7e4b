"""Quality rules with host-level verdicts (operator 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, limit_batches
from .words import windows, word_hashes

SYMBOLS, BLANKS, WINDOW = "#*$%&|<>", " \t\n\r\x0b\x0c", 5
#: A document fails with fewer words, or with more than this percentage of its words in repeated windows.
MIN_WORDS, MAX_REPEAT = 10, 20
#: A host goes when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: Bounds of the prior's weight in documents.
PRIOR = (1.0, 1000.0)

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_features(text: str) -> tuple[int, int, int, int, int]:
    words = word_hashes(text.encode())[0]
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    seen = windows(words, WINDOW)
    repeated = 0
    if len(seen) > 1:
        order = np.sort(seen)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            again, covered = np.isin(seen, twice), np.zeros(len(words), dtype=bool)
            for k in range(WINDOW):
                covered[k : k + len(again)] |= again
            repeated = int(covered.sum())
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


def with_features(docs: DataFrame, text: str = "text", prefix: str = "_rule_") -> DataFrame:
    """All rows and columns of ``docs``, and the five counts of each text under ``prefix``."""
    schema = T.StructType([*docs.schema.fields, *(T.StructField(prefix + n, T.LongType()) for n in FEATURES)])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_features(x or "") for x in batch.column(at).to_pylist()]
            more = [pa.array([f[k] for f in found], type=pa.int64()) for k in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=schema.names)

    return docs.mapInArrow(run, schema)


def failed(prefix: str = "_rule_"):
    return (F.col(prefix + "n_words") < MIN_WORDS) | (100 * F.col(prefix + "n_repeat_words") > MAX_REPEAT * F.col(prefix + "n_words"))


def host_verdicts(rows: DataFrame) -> DataFrame:
    """``rows(host, failed)`` to one row for each host: n_docs, n_failed, rate (shrunk), host_ok.

    The beta prior has the overall failure rate as its mean and the spread of the hosts' raw rates as its variance
    (moments); its weight lies within PRIOR. The null host is a host like any other.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    raw = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg((F.sum("n_failed") / F.sum("n_docs")).alias("mean"), F.round(F.var_pop(raw), 12).alias("spread"))
    weight = F.when(F.col("spread") > 0, F.least(F.lit(PRIOR[1]), F.greatest(F.lit(PRIOR[0]), F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1))).otherwise(F.lit(PRIOR[1]))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    # The prior is one row.
    return hosts.crossJoin(F.broadcast(prior.withColumn("weight", weight))).select("host", "n_docs", "n_failed", shrunk.alias("rate"), (shrunk <= MAX_HOST_RATE).alias("host_ok"))


#: Failing hosts that are sent to all tasks at most; more are joined by a shuffle.
SENT_HOSTS = 100_000


def _with_verdicts(rows: DataFrame, host: str, hosts: DataFrame) -> DataFrame:
    """``rows`` with ``_rule_failed`` and the host's verdict applied as ``_rule_kept``. Only hosts that fail are looked up."""
    bad = hosts.where("not host_ok").select(F.col("host").alias("_rule_host"), F.lit(True).alias("_rule_host_bad"))
    bad = F.broadcast(bad) if bad.limit(SENT_HOSTS + 1).count() <= SENT_HOSTS else bad
    joined = rows.withColumn("_rule_failed", failed()).join(bad, rows[host].eqNullSafe(bad["_rule_host"]), "left")
    return joined.withColumn("_rule_kept", ~F.col("_rule_failed") & F.col("_rule_host_bad").isNull()).drop("_rule_host", "_rule_host_bad")


def judge_counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, the ``_rule_*`` counts, ``_rule_failed`` and ``_rule_kept`` of every row, without the texts.

    The texts are read once: their counts are written and the verdicts joined to them. Otherwise as ``judge``.
    """
    limit_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality-rules")
    slim = with_features(docs.select("doc_id", F.col(host).alias("host"), "text")).drop("text")
    slim = scratch.save(slim, "counts")
    hosts = scratch.save(host_verdicts(slim.select("host", failed().alias("failed"))), "hosts")
    return _with_verdicts(slim, "host", hosts)


def judge(docs: DataFrame, host: str = "source") -> DataFrame:
    """All rows and columns of ``docs`` with ``_rule_*`` counts, ``_rule_failed`` and ``_rule_kept``.

    Null and empty texts have no words and fail. Every row is judged, repeated or not. Columns of the input keep
    their names and values; names that begin with ``_rule_`` are reserved. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    scratch = Scratch(spark, "quality-rules")
    first = with_features(docs.select("text", F.col(host).alias("host"))).select("host", failed().alias("failed"))
    hosts = scratch.save(host_verdicts(first), "hosts")
    return _with_verdicts(with_features(docs), host, hosts)


def apply_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The kept rows of ``docs``, with the same columns."""
    return judge(docs, host).where("_rule_kept").select(*docs.columns)
