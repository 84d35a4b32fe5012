"""Quality classifier: hashed word n-gram logistic regression trained by FTRL-proximal (operator 3).

Features are hashed into 2^18 places: words, word pairs, and runs of one to three word
*shapes* (case pattern, digits, the punctuation itself, "same word as before"). Each
counts as its share of the text's tokens, so a score is one sparse dot product over the
whole text.

Training: the labelled rows that are not held out, at most ``max_train`` of them
(documented bound, chosen by hash of doc_id), dealt by hash to ``shards`` FTRL learners
that run side by side; their weights are averaged (shards x 2^18 x 4 bytes reach the
driver, whatever the input). Scoring reads every whole text once, with the weights
broadcast (1 MB).

Defined results: a null or empty text has no features, its score is that of the bias.
Rows without doc_id are scored and not held out. Repeated labels of a document: their mean, label 1
from one half on; null labels don't count. Without any usable label every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm import bytekit as bk
from cohortlab.llm.common import text_or_empty

BITS = 18
_N = 1 << BITS
_BIAS = _N  # one more weight

_CLASSES = np.where(bk.ALNUM, 1, 2).astype(np.uint8)
_CLASSES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_UPPER = np.zeros(256, np.int64)
_UPPER[0x41:0x5B] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[0x30:0x3A] = 1
_PER_TOKEN = 6


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _place(x: np.ndarray) -> np.ndarray:
    return (bk.mix(x) & np.uint64(_N - 1)).astype(np.int32)


def _features(texts):
    """Blocks of rows: ``(lo, hi, places, first)``; ``places`` has _PER_TOKEN columns, a row for each token."""
    data, offsets = bk.string_bytes(texts)
    for lo, hi in bk.blocks(offsets):
        part, offs = data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        starts, ends, first = bk.find_words(part, offs, _CLASSES)
        h = bk.hash_spans(part, starts, ends)
        count = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[part])))[np.stack((starts, ends))], axis=0)[0]
        upper, digits, size = count(_UPPER), count(_DIGIT), ends - starts
        word = _CLASSES[part[starts]] == 1
        shape = np.where(digits * 2 > size, 5, np.where(upper == 0, 1, np.where(upper == 1, 2, np.where(upper * 2 >= size, 3, 4)))).astype(np.uint64)
        shape = np.where(word, shape, h | np.uint64(8))
        begins = np.zeros(h.size, np.int64)  # tokens before this one in its row
        begins[:] = np.arange(h.size) - np.repeat(first[:-1], np.diff(first))
        back = lambda x, k: np.where(begins >= k, np.concatenate((np.zeros(min(k, x.size), np.uint64), x[:-k]))[:x.size], np.uint64(0))
        again = (word & ((h == back(h, 1)) | (h == back(h, 2)))).astype(np.uint64)
        p1, p2, c = back(shape, 1), back(shape, 2), [np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64) | 1) for k in range(1, 8)]
        places = np.stack([_place(h + c[0]), _place(h * c[1] + back(h, 1)), _place(shape * c[2] + c[3]),
                           _place(shape * c[3] + p1 * c[4] + c[5]), _place(shape * c[5] + p1 * c[6] + p2 * c[1] + c[2]),
                           _place(again + c[6])], axis=1)
        yield lo, hi, places, first


def _examples(batches):
    """Sparse rows of the training sample."""
    for b in batches:
        places_of, values_of = [], []
        for _, _, places, first in _features(b.column("text")):
            for x, y in zip(first[:-1], first[1:]):
                at, n = np.unique(places[x:y], return_counts=True)
                places_of.append(at.astype(np.int32)), values_of.append((n / max(1, y - x)).astype(np.float32))
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("turn"), b.column("doc_id"), b.column("y"),
                                          pa.array(places_of, pa.list_(pa.int32())), pa.array(values_of, pa.list_(pa.float32()))],
                                         ["shard", "turn", "doc_id", "y", "at", "x"])


class Ftrl:
    """FTRL-proximal for logistic loss: per-coordinate rates, L1 and L2."""

    def __init__(self, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(_N + 1), np.zeros(_N + 1)

    def weights(self, at):
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0,
                        (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at, x, y):
        at, x = np.append(at, _BIAS), np.append(x.astype(float), 1.0)
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def _learner(epochs, settings):
    def trained(batches):
        held, shard = [], None

        def done():
            model = Ftrl(**settings)
            for _ in range(epochs):
                for at, x, y in held:
                    model.learn(at, x, y)
            w = model.weights(np.arange(_N + 1)).astype(np.float32)
            return pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([len(held)], pa.int64())], ["w", "n"])

        for b in batches:
            for s, at, x, y in zip(b.column("shard").to_pylist(), b.column("at"), b.column("x"), b.column("y").to_pylist()):
                if s != shard and held:
                    yield done()
                    held = []
                shard = s
                held.append((at.values.to_numpy(), x.values.to_numpy(), y))
        if held:
            yield done()

    return trained


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, shards: int = 6, epochs: int = 4,
          alpha: float = 2.0, beta: float = 0.1, l1: float = 0.02, l2: float = 0.05) -> np.ndarray:
    """Weights (2^18 and the bias) learnt from at most ``max_train`` labelled rows that are not held out."""
    usable = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("y")))
    sample = (usable.withColumn("turn", F.xxhash64("doc_id", F.lit("turn"))).orderBy("turn", "doc_id").limit(max_train))
    # at most max_train rows of three numbers: half a megabyte
    rows = (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
            .withColumn("shard", F.pmod(F.xxhash64("turn"), F.lit(shards)).cast("int")))
    seen = rows.select("shard", "turn", F.col("doc_id").cast("long").alias("doc_id"), "y", "text").mapInArrow(bk.tidy(_examples), "shard int, turn long, doc_id long, y double, at array<int>, x array<float>")
    learnt = (seen.repartition(shards, "shard").sortWithinPartitions("shard", "turn", "doc_id")
              .mapInArrow(bk.tidy(_learner(epochs, dict(alpha=alpha, beta=beta, l1=l1, l2=l2))), "w binary, n long"))
    found = learnt.collect()  # one row for each shard
    if not found:
        return np.zeros(_N + 1, np.float32)
    share = np.array([r.n for r in found], float)
    return np.average([np.frombuffer(r.w, np.float32) for r in found], axis=0, weights=share).astype(np.float32)


def scored(rows: DataFrame, weights: np.ndarray) -> DataFrame:
    """``rows`` (any columns, one of them ``text``) with ``score`` added."""
    held = rows.sparkSession.sparkContext.broadcast(weights)
    fields = [f for f in rows.schema.fields if f.name != "text"]

    def run(batches):
        w = held.value
        for b in batches:
            score = np.zeros(len(b))
            for lo, hi, places, first in _features(b.column("text")):
                total = np.concatenate(([0.0], np.cumsum(w[places].sum(axis=1, dtype=np.float64))))
                n = np.maximum(1, np.diff(first))
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(w[_BIAS] + (total[first[1:]] - total[first[:-1]]) / n, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in fields] + [pa.array(score)], [f.name for f in fields] + ["score"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["score double"])
    return rows.mapInArrow(bk.tidy(run), schema)


def report(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return scored(rows, train(docs, labels, **params)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """``docs`` without the rows that the classifier rejects (score below 0.5)."""
    weights = train(docs, labels, **params)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_or_empty().alias("text"))
    return scored(rows, weights).where("score >= 0.5").select("row.*")


