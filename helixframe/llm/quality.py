"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Words are runs of letters and digits or runs of other signs, as they are written; words, pairs of
neighbours and, as a feature of its own, that a word follows itself are hashed into ``2 ** bits`` weights. A document's features are their counts over
the square root of their number, its score the logistic function of their dot product with the
weights. Follow-the-regularised-leader sees the training rows one by one, in the order of a hash of
their ids, ``epochs`` times; its per-coordinate state gives each weight in closed form.

Labels come from a bounded sample (``max_rows`` rows, the smallest by hash, of texts of at most
``max_bytes``), featurised on the executors; the weights are a broadcast of ``4 * 2 ** bits``
bytes. Neither grows with the data. Labels, ``lang``, ``source`` and ``doc_id`` are never inputs.

Defined results: a null text counts as empty and has the score of the bias alone; a null ``doc_id``
is not held out; labels of null value are not learned from; without labels every score is 0.5 and
is predicted 1; equal texts have equal scores; very long texts are scored whole; a
repeated ``doc_id`` is scored row by row, and learned from with the smallest of its labels; an empty table
gives an empty result; columns other than ``doc_id`` and ``text`` are ignored, and passed through by ``keep_good``.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm._shared import doc_texts

WORDS = re.compile(rb"[0-9A-Za-z_\x80-\xff]+|[^0-9A-Za-z_\x80-\xff\s]+")
BITS = 18
#: Stands for any word that follows itself.
TWICE = np.uint32(0x7F4A7C15)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Weight indices of the whole text's words and word pairs, repeats included."""
    words = [crc32(w) for w in WORDS.findall(text.encode("utf-8", "surrogatepass"))]
    one = np.array(words, np.uint32)
    two = (one[:-1] * np.uint32(2654435761) ^ one[1:]) * np.uint32(2246822519)
    twice = np.full(int((one[:-1] == one[1:]).sum()), TWICE)
    return np.concatenate([one * np.uint32(3266489917), two, twice]) >> np.uint32(32 - bits)


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, text: str) -> float:
        idx = features(text, self.bits)
        total = self.bias + (float(self.weights[idx].sum()) / len(idx) ** 0.5 if len(idx) else 0.0)
        return 1.0 / (1.0 + float(np.exp(-np.clip(total, -30, 30))))


class FTRL:
    """Follow-the-regularised-leader for logistic loss; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, idx: np.ndarray | slice) -> np.ndarray:
        z = self.z[idx]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[idx])) / self.alpha + self.l2))

    def learn(self, idx: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(idx)
        gradient = (1.0 / (1.0 + np.exp(-np.clip(w @ values, -30, 30))) - label) * values
        squared = self.n[idx] + gradient * gradient
        self.z[idx] += gradient - (np.sqrt(squared) - np.sqrt(self.n[idx])) / self.alpha * w
        self.n[idx] = squared


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 3) -> Model:
    """``rows``: distinct indices, how often each occurs, label."""
    learner = FTRL(1 << bits)
    for _ in range(epochs):
        for idx, counts, label in rows:
            idx = np.append(idx, 1 << bits).astype(np.int64)
            learner.learn(idx, np.append(counts / max(1.0, counts.sum()) ** 0.5, 1.0), label)
    w = learner.weights(slice(None))
    return Model(w[:-1].astype(np.float32), float(w[-1]), bits)


def in_fold(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether ``crc32(doc_id as text) mod folds`` is ``fold``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, max_rows: int, max_bytes: int, per_class: bool = False) -> DataFrame:
    """``doc_id, text, label, place`` of at most ``max_rows`` labelled rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label is not null and doc_id is not null")
    known = known.filter(~in_fold(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("place", F.xxhash64("doc_id"))
    if per_class:
        some = known.filter("label = 1").orderBy("place").limit(max_rows // 2).unionByName(known.filter("label = 0").orderBy("place").limit(max_rows // 2))
    else:
        some = known.orderBy("place").limit(max_rows)
    return doc_texts(docs).join(F.broadcast(some), "doc_id").filter(F.octet_length("text") <= max_bytes)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, fold: int = 1, max_rows: int = 6000, max_bytes: int = 20_000, bits: int = BITS, epochs: int = 3) -> Model:
    """Train on a bounded sample of labelled rows.

    One task learns from all their features; the driver gets the model alone.
    """

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [np.unique(features(t, bits), return_counts=True) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([i.astype("<u4").tobytes() for i, _ in made], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in made], pa.binary())], names=["place", "label", "idx", "counts"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for b in batches for x in zip(*[b.column(k).to_pylist() for k in (0, 2, 3, 1)], strict=True))
        rows = [(np.frombuffer(i, "<u4"), np.frombuffer(c, "<u4").astype(float), y) for _, i, c, y in found]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(rows, bits, epochs))], pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, label, folds, fold, max_rows, max_bytes).select("place", "text", "label")
    made = sample.mapInArrow(featurise, "place long, label int, idx binary, counts binary").repartition(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(made.model) if made else train([], bits, epochs)


def scores(docs: DataFrame, model: Model, folds: int = 3, fold: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.score(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.float64()), pa.array([int(s >= 0.5) for s in found], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    texts = doc_texts(docs)
    return texts.select("doc_id", in_fold(F.col("doc_id"), folds, fold).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [shared.value.score(t or "") >= 0.5 for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield b.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
