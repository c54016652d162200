"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Feature extraction and scoring are Arrow stages over every whole text; the model is
fitted on a bounded sample of labelled rows (at most `sample_rows` documents of together
at most `sample_bytes` of text, none above a sixteenth of that), in an order that depends on ids only. L1 leaves few non-zero weights, which are what is broadcast
(at most 2**bits of them).

Defined results: null or empty text scores by the bias alone; without a labelled row, or
with labels of one class, nothing tells documents apart: every score is PRIOR and none is rejected; repeated labels of a document
count as toxic if any is; rows that repeat an id are each learnt from; null labels are not used; null ids are scored and never
learnt from; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import text_of, written

BITS = 20
SAMPLE_ROWS = 16_384
#: Text of the sample: about three bytes of features each in the task that fits.
SAMPLE_BYTES = 128 << 20
#: Largest share of it that one document may take; a larger document is not sampled.
ROW_SHARE = 1 / 16
THRESHOLD = 0.3
#: The score where there is no evidence; below the threshold.
PRIOR = 0.05
_PAIR = np.uint64(0x9DDFEA08EB382D69)
_KINDS = [np.uint64(x) for x in (0x1F123BB5, 0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)]


def slice_features(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document of the slice, feature) for words, adjacent pairs, and pairs that skip one or two words."""
    h, _, _, at = K.words(data, offsets, lower=True)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows, cols = [doc], [K.mix(h ^ _KINDS[0])]
    for gap in (1, 2, 3):
        if len(h) > gap:
            same = doc[gap:] == doc[:-gap]
            rows.append(doc[gap:][same])
            cols.append(K.mix(h[:-gap][same] * _PAIR + h[gap:][same] * _KINDS[gap]))
    return np.concatenate(rows), (np.concatenate(cols) >> np.uint64(64 - bits)).astype(np.int64)


def distinct_features(row: np.ndarray, col: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of each document once, in order of document; with the offsets."""
    keys = np.unique((row << bits) | col)
    return (keys & ((1 << bits) - 1)).astype(np.int32), np.searchsorted(keys, np.arange(n + 1) << bits)


class Ftrl:
    """Per-coordinate FTRL-proximal with L1 and L2 (McMahan et al., 2013)."""

    def __init__(self, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: float) -> None:
        """One step on a row whose features at `at` are 1."""
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def labelled_sample(documents: DataFrame, labels: DataFrame, sample_rows: int, sample_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled documents outside the held-out quarter, in order of a hash of the id, as far as both bounds go.

    One that is too large is passed over; what is read is at most one such size short of `sample_bytes`.
    """
    usable = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    chosen = (
        usable.groupBy("doc_id").agg(F.max("toxic").alias("_label")).withColumn("_order", F.xxhash64(F.col("doc_id").cast("string")))
        .orderBy("_order", "doc_id").limit(sample_rows).select(F.col("doc_id").alias("_lid"), "_label", "_order")
    )
    rows = documents.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    size = F.sum(F.octet_length("_text")).alias("_size")
    sizes = rows.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).groupBy("_lid", "_label", "_order").agg(size)  # at most sample_rows rows
    so_far = F.sum("_size").over(Window.orderBy("_order", "_lid"))
    fits = sizes.filter(F.col("_size") <= int(sample_bytes * ROW_SHARE))
    fitting = written(fits.withColumn("_so_far", so_far).filter(F.col("_so_far") <= sample_bytes).select("_lid", "_label", "_order"), "sample")
    return rows.join(F.broadcast(fitting), F.col("_id") == F.col("_lid")).select("_order", "_id", F.col("_label").cast("int").alias("_label"), "_text")


def fit(documents: DataFrame, labels: DataFrame, *, bits: int = BITS, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES, epochs: int = 5, l1_per_row: float = 1 / 600, l1_most: float = 16.0) -> tuple[np.ndarray, np.ndarray]:
    """(features, weights) that are not zero; the bias is feature 2**bits."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, data, offsets in K.text_slices(b.column("_text")):
                at, cut = distinct_features(*slice_features(data, offsets, bits), last - first, bits)
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(b.column(i).slice(first, last - first) for i in range(3)), lists], names=["o", "id", "y", "f"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            flat, cut = b.column("f").values.to_numpy(), b.column("f").offsets.to_numpy()
            for i, (o, key, y) in enumerate(zip(b.column("o").to_pylist(), b.column("id").to_pylist(), b.column("y").to_pylist(), strict=True)):
                at = flat[cut[i] : cut[i + 1]].copy()
                rows.append((o, key, len(at), zlib.crc32(at), y, at))
        if len({r[4] for r in rows}) < 2:
            yield pa.RecordBatch.from_arrays([pa.array([1 << bits], pa.int64()), pa.array([math.log(PRIOR / (1 - PRIOR))])], names=["feature", "weight"])
            return
        rows.sort(key=lambda r: r[:4])  # whatever order they came in
        model = Ftrl((1 << bits) + 1, l1=min(max(len(rows) * l1_per_row, 1.0), l1_most))
        rng = np.random.default_rng(7)
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                *_, y, at = rows[i]
                model.learn(np.append(at, 1 << bits), float(y))
        w = model.weights(slice(None))
        at = np.nonzero(w)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["feature", "weight"])
        del rows, model, w
        K.give_back()

    sample = labelled_sample(documents, labels, sample_rows, sample_bytes)
    features = sample.mapInArrow(extract, "o long, id long, y int, f array<int>")
    got = features.repartition(1).mapInArrow(train, "feature long, weight double").toArrow()
    at, w = got.column("feature").to_numpy(), got.column("weight").to_numpy()
    order = np.argsort(at)
    return at[order], w[order]


def _scorer(model: tuple[np.ndarray, np.ndarray], bits: int):
    """A function from a text column to scores; the weights are few, features present count once."""
    at, w = model[0].astype(np.int64), model[1]

    def run(column: pa.Array) -> np.ndarray:
        weights = np.zeros((1 << bits) + 1)
        weights[at] = w
        known = weights[:-1] != 0
        parts = [np.empty(0)]
        for first, last, data, offsets in K.text_slices(column):
            row, col = slice_features(data, offsets, bits)
            hit = known[col]
            keys = np.unique((row[hit] << bits) | col[hit])
            total = np.bincount(keys >> bits, weights[keys & ((1 << bits) - 1)], last - first) + weights[-1]
            parts.append(1 / (1 + np.exp(-np.clip(total, -35, 35))))
        return np.concatenate(parts)

    return run


def score(documents: DataFrame, model: tuple[np.ndarray, np.ndarray], *, bits: int = BITS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of every row."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value, bits)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(scorer(b.column("_text")))], names=["_id", "score"])

    rows = documents.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.mapInArrow(run, f"_id {dict(rows.dtypes)['_id']}, score double").select(
        F.col("_id").alias(id_col), held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_clean(documents: DataFrame, labels: DataFrame, *, bits: int = BITS, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score is below the threshold, with their columns."""
    sent = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, bits=bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(sent.value, bits)
        for b in batches:
            yield b.filter(pa.array(scorer(b.column(text_col)) < threshold))

    return documents.mapInArrow(run, documents.schema)
