"""Text quality by logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

A text's features are its words and word pairs, and the same of the words' shapes: capitals only,
symbols, digits, no letter, the same as the word before, the start of a word triple that the text
has already. All are hashed into one table of weights, each with its share of the text as value. A
score is a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import forget, lean, need, written

U = np.uint64
BITS = 18
#: Bounds of the labelled rows that are learned from, those of the smallest key hashes, and of their features in all. All texts are scored whole.
ROWS, FEATURES = 8000, 8_000_000
#: FTRL-proximal step, smoothing, L1 and L2; passes over the rows; weight of a share.
ALPHA, BETA, L1, L2, PASSES, SCALE = 0.3, 1.0, 0.02, 0.1, 4, 8.0

_CLASS = np.zeros((4, 256), dtype=np.int64)
_CLASS[0, 0x41:0x5B] = 1  # capitals
_CLASS[1, 0x61:0x7B] = _CLASS[1, 0x80:] = 1  # other letters
_CLASS[2, 0x30:0x3A] = 1  # digits
_CLASS[3] = 1 - _CLASS[:3].sum(axis=0)  # the rest


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of a chunk, row by row with one block of four for each word, and the rows' first words."""
    start, stop, first = hashing.places(data, offsets)
    word = hashing.hashes(data, start, stop)
    if not len(word):
        return np.zeros((0, 4), dtype=np.int64), first
    total = np.zeros((4, len(data) + 1), dtype=np.int64)
    for c in range(4):
        np.cumsum(_CLASS[c][data], out=total[c, 1:])
    capital, letter, digit, other = total[:, stop + 1] - total[:, start]
    row = np.searchsorted(first, np.arange(len(word)), side="right")
    same = np.zeros(len(word), dtype=bool)
    same[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    triple = np.zeros(len(word), dtype=np.uint64)
    if len(word) > 2:
        triple[:-2] = hashing.mix(word[:-2] * hashing.STEP[0] + word[1:-1] * hashing.STEP[1] + word[2:] * hashing.STEP[2])
    again = np.zeros(len(word), dtype=bool)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a > 3:
            own = triple[a : b - 2]
            order = np.argsort(own, kind="stable")
            again[a + order[1:]] = own[order[1:]] == own[order[:-1]]
    shape = ((capital > 1) & (letter == 0)) * 1 + (digit > 0) * 2 + np.minimum(other, 3) * 4 + (capital + letter + digit == 0) * 16 + same * 32 + again * 64
    shape = hashing.mix(shape.astype(np.uint64) + U(1 << 40))

    def pairs(x: np.ndarray) -> np.ndarray:
        before = np.concatenate((x[:1], x[:-1]))
        before[first[:-1][first[:-1] < len(x)]] = U(7)
        return hashing.mix(before * hashing.STEP[3] + x * hashing.STEP[4])

    found = np.stack((word, pairs(word), shape, pairs(shape)), axis=1)
    return (found >> U(64 - BITS)).astype(np.int64), first


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row; a row without words has the bias alone."""
        found, first = features(data, offsets)
        total = np.concatenate(([0.0], np.cumsum(self.weights[found].sum(axis=1))))
        n = np.diff(first)
        z = self.bias + SCALE * (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """FTRL-proximal over rows of (distinct buckets, shares, label), in the order given."""
    size = (1 << BITS) + 1
    z, n, w = np.zeros(size), np.zeros(size), np.zeros(size)
    for _ in range(PASSES):
        for index, share, label in rows:
            at, x = np.append(index, size - 1), np.append(share * SCALE, 1.0)
            own = z[at]
            w = np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model(w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = ROWS, most: int = FEATURES) -> Model:
    """A model from the labelled rows (0 or 1; others are left out), rows of them at most, with most features at most.

    Features are made on the executors, from whole texts; the driver gets the bounded rows' sparse vectors
    and runs the updates in the order of the key's hash, so the model doesn't depend on partitions. A
    key with several labels has the least, and one with several rows the row of the least vector; null keys and labels
    are left out, other columns are dropped. Without labelled rows, as with an empty table, every score is 0.5.
    """
    need(docs, key, text)
    need(labels, key, label)
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    chosen = chosen.groupBy("key").agg(F.min("label").alias("label")).withColumn("order", F.xxhash64("key")).orderBy("order", "key").limit(rows)
    held = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("order", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in hashing.chunks(batch.column(2)):
                found, first = features(data, offsets)
                out = [np.unique(found[i:j], return_counts=True) for i, j in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([x.astype(np.int32).tobytes() for x, _ in out], pa.binary()), pa.array([(c / max(1, c.sum() / 4)).astype(np.float32).tobytes() for _, c in out], pa.binary())],
                    names=["order", "label", "index", "share"],
                )

    made = held.mapInArrow(lean(run), "order long, label int, index binary, share binary")
    table = written(made.groupBy("order", "label").agg(F.min(F.struct("index", "share")).alias("x")).select("order", "label", "x.*"))
    sizes = table.select("order", F.octet_length("index") / 4).orderBy("order").collect()
    kept = int(np.searchsorted(np.cumsum([n for _, n in sizes]), most, side="right"))
    got = table.where(F.col("order") <= sizes[kept - 1][0]).collect() if kept else []
    got.sort(key=lambda r: (r["order"], r["label"], bytes(r["index"])))
    forget(table)
    return fit([(np.frombuffer(r["index"], dtype=np.int32).astype(np.int64), np.frombuffer(r["share"], dtype=np.float32).astype(float), r["label"]) for r in got])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score for each row; null texts count as empty, repeated rows repeat, an empty table gives none, other columns are dropped.

    A very long text is one task's work and needs some 200 bytes of memory for each of its words.
    """
    need(docs, key, text)
    src = docs.select(key, text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in hashing.chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(shared.value.score(data, offsets))], names=[key, "score"])

    return src.mapInArrow(lean(run), f"`{key}` {src.schema[key].dataType.simpleString()}, score double")


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text, modulo folds; a null key's is that of the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds
