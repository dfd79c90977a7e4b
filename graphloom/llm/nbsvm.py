"""Quality classifier: naive Bayes scaled n-gram indicators with a linear hinge-loss model (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, limit_batches
from .words import mixed

#: Labelled rows that the model is fitted on at most, those with the smallest hash of their doc_id; and the bytes of
#: their features at most, which end the sample earlier where texts are very long.
SAMPLE, SAMPLE_BYTES = 10_000, 256 << 20
#: Bytes of an n-gram, and places that n-grams are hashed to.
GRAM, BUCKETS_LOG2 = 5, 18
THRESHOLD = 0.3
#: The fit ends when no coordinate's projected gradient differs by more than this over a round, or after so many rounds.
TOLERANCE, ROUNDS = 0.1, 100


class Grams:
    """Distinct n-grams of the bytes of a whole text, hashed to 2^18 places."""

    def __init__(self):
        self.last = np.zeros(1 << BUCKETS_LOG2, dtype=np.int32)

    def of(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), dtype=np.uint8).astype(np.uint64)
        n = len(raw) - GRAM + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int32)
        code = raw[:n].copy()
        for k in range(1, GRAM):
            code |= raw[k : k + n] << np.uint64(8 * k)
        code = (mixed(code) >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int32)
        place = np.arange(n, dtype=np.int32)
        self.last[code] = place  # the last place of each code stays
        return code[self.last[code] == place]


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    size = 1 << BUCKETS_LOG2
    counts = [np.full(size, smooth), np.full(size, smooth)]
    for codes, label in zip(rows, labels):
        counts[label][codes] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, c: float = 1.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model by dual coordinate descent over unit-length rows.

    Both classes carry the same total cost. The last coordinate, always 1, is the bias. The fit ends when the largest and
    the smallest projected gradient of a round are ``tolerance`` apart at most.
    """
    rng, n = np.random.default_rng(seed), len(rows)
    weight, bias, alpha = np.zeros(1 << BUCKETS_LOG2), 0.0, np.zeros(n)
    share = np.array([n / (2 * max(1, (labels == k).sum())) for k in (0, 1)])
    values = []
    for codes in rows:
        x = ratio[codes]
        values.append(x / (np.linalg.norm(x) or 1.0))
    for _ in range(rounds):
        low, high = 0.0, 0.0
        for i in rng.permutation(n):
            y, codes, x = 2 * labels[i] - 1, rows[i], values[i]
            slack = y * (weight[codes] @ x + bias) - 1
            moves = min(slack, 0.0) if alpha[i] <= 0 else max(slack, 0.0) if alpha[i] >= c * share[labels[i]] else slack
            low, high = min(low, moves), max(high, moves)
            new = min(max(alpha[i] - slack / (2.0 if len(codes) else 1.0), 0.0), c * share[labels[i]])
            if step := (new - alpha[i]) * y:
                weight[codes] += step * x
                bias += step
            alpha[i] = new
        if high - low <= tolerance:
            break
    return weight, bias


def margins(rows: list[np.ndarray], ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    out = np.full(len(rows), bias)
    for k, codes in enumerate(rows):
        x = ratio[codes]
        out[k] += weight[codes] @ x / (np.linalg.norm(x) or 1.0)
    return out


def sigmoid_fit(margin: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that turn margins into probabilities, by Newton steps on the smoothed targets."""
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()]) + [1e-3 * a, 0]
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(a), float(b)


class Model:
    """Product of ratio and weight for each bucket, and what makes a score of a margin."""

    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, offset: float):
        self.ratio, self.weight, self.bias, self.slope, self.offset = ratio, weight, bias, slope, offset

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray) -> Model:
        """Fit on all rows; the sigmoid is fitted on margins of two models that have not seen the row."""
        size = 1 << BUCKETS_LOG2
        if len(set(labels.tolist())) < 2:  # nothing to tell apart: the share of label 1
            share = (labels.sum() + 1) / (len(labels) + 2)
            return cls(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log(share / (1 - share))))
        half, margin = np.arange(len(rows)) % 2, np.zeros(len(rows))
        for k in (0, 1):
            own = [r for r, h in zip(rows, half) if h != k]
            if len(set(labels[half != k].tolist())) == 2:
                ratio = log_count_ratio(own, labels[half != k])
                margin[half == k] = margins([r for r, h in zip(rows, half) if h == k], ratio, *dual_descent(own, labels[half != k], ratio))
        ratio = log_count_ratio(rows, labels)
        weight, bias = dual_descent(rows, labels, ratio)
        return cls(ratio, weight, bias, *sigmoid_fit(margin, labels))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = margins(rows, self.ratio, self.weight, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on at most ``sample`` documents that have a label and are not held out.

    Rows of ``labels(doc_id, quality)`` with nulls or labels other than 0 and 1 are left out; a document with
    several labels has the more frequent one, 1 at equal numbers; of several texts of one doc_id the one with the smallest
    hash counts. Documents are taken in the order of a hash of their doc_id, as long as their features take
    ``sample_bytes`` at most. Without labels every score is 0.5.
    """
    limit_batches(docs.sparkSession)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null and quality in (0, 1)").where(~held_out())
    voted = usable.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    chosen = voted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    schema = pa.schema([("label", pa.int32()), ("doc_id", pa.int64()), ("codes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            codes = [grams.of(x or "").tobytes() for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(codes, type=pa.binary())], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # At most ``sample`` rows of two numbers are broadcast.
    chosen = Scratch(docs.sparkSession, "quality-sample").save(chosen, "chosen")
    one = slim.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))
    found = Scratch(docs.sparkSession, "quality-sample").save(one.select("label", "doc_id", "text").mapInArrow(run, "label int, doc_id long, codes binary"), "features")
    order = F.xxhash64("doc_id")
    sizes = found.select(order.alias("order"), "doc_id", F.octet_length("codes").alias("size")).toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    fits = int((np.cumsum(sizes.column("size").to_numpy().astype(np.int64)) <= sample_bytes).sum())
    if fits < len(sizes):
        last = sizes.column("order")[max(fits, 1) - 1].as_py()
        found = found.where(order <= last)
    found = found.toArrow().sort_by("doc_id")
    rows = [np.frombuffer(x, dtype=np.int32) for x in found.column("codes").to_pylist()]
    return Model.fit(rows, np.array(found.column("label").to_pylist(), dtype=np.int64))


def score_quality(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null texts count as empty, empty ones get the bias's score.

    Repeated rows get a row each; a null doc_id is not held out; other columns are left out.
    """
    spark = docs.sparkSession
    limit_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # two vectors of 2^18 numbers
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            score = sent.value.scores([grams.of(x or "") for x in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return slim.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
