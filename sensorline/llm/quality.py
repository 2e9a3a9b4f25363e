"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are runs of letters and digits (case kept) and runs of other signs, over whole texts. Their 1- and 2-grams are
hashed into 2**BITS weights; a text is the vector of log counts scaled to length 1, and its score a sparse dot product.
The model is fitted on a bounded sample of labelled rows (SAMPLE, a parameter), one text for each of their ids; every
document is scored. Features of the sample are staged in a fixed order, which every epoch follows, so the driver holds
them only as far as HELD_BYTES and otherwise reads them again row by row: the model is the same either way.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered, hash_sample, staged

BITS = 18
SAMPLE = 6_000
#: Bytes of features that the driver keeps between epochs.
HELD_BYTES = 128 << 20
EPOCHS = 10
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.02, 0.1
TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
MEMO = 400_000


class _Hashes(dict):
    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return h


_HASHES = _Hashes()


def features(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Weight numbers, ascending, and values of a whole text; null and empty texts have none."""
    tokens = TOKEN.findall(text) if text else []
    if not tokens:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    one = np.array(list(map(_HASHES.__getitem__, tokens)), np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] + np.uint64(1)
    mixed = np.concatenate([one, two]) * np.uint64(0xD6E8FEB86659FD93)
    at, n = np.unique((mixed >> np.uint64(64 - bits)).astype(np.int32), return_counts=True)
    value = np.log1p(n).astype(np.float32)
    return at, value / np.sqrt(value @ value)


class Model:
    """Weights of the hashed n-grams and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        at, value = features(text, len(self.weights).bit_length() - 1)
        return float(1 / (1 + np.exp(-(self.bias + float(self.weights[at] @ value)))))


Row = tuple[np.ndarray, np.ndarray, int]


def train(rows: Callable[[], Iterable[Row]], n_rows: int, n_good: int, bits: int = BITS, epochs: int = EPOCHS) -> Model:
    """Follow the regularised leader: each weight follows from its sums of gradients (z) and of their squares (n).

    rows gives (weight numbers, values, label) in the same order for every epoch.
    """
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    weight = [n_rows / (2 * max(1, k)) for k in (n_rows - n_good, n_good)]  # both labels count alike

    def weights(at) -> np.ndarray:
        own = z[at]
        free = np.abs(own) > L1
        return np.where(free, -(own - np.sign(own) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs if n_rows else 0):
        for at, value, label in rows():
            at, value = np.append(at, 1 << bits), np.append(value, 1.0)
            w = weights(at)
            gradient = weight[label] * (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - label) * value
            grown = n[at] + gradient**2
            z[at] += gradient - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    final = weights(np.arange((1 << bits) + 1))
    return Model(final[:-1].astype(np.float32), float(final[-1]))


def in_training(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = BITS) -> Model:
    """Fit on at most so many labelled documents outside the held-out fold (crc32 of the id as text, modulo 5, is 0).

    The sample is drawn by a hash of doc_id. Labels other than 0 and 1 and ids with both take no part, and of several texts
    under one id the smallest is taken; without labels every score is 0.5. Only texts of sampled ids leave the JVM.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").where(in_training("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other"))
    known = staged(hash_sample(known.where("label = other").select("doc_id", "label"), ["doc_id"], sample), "labels")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py(), bits) for t in batch.column("text")]
            at, value = (pa.array([x[i].astype(k).tobytes() for x in found], pa.binary()) for i, k in ((0, "<i4"), (1, "<f4")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), at, value], names=["doc_id", "label", "at", "value"])

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # at most sample rows
    made = texts.mapInArrow(extract, "doc_id bigint, label int, at binary, value binary")
    made = staged(made, "features")
    size = F.sum(F.octet_length("at") + F.octet_length("value"))
    n_rows, n_good, size = made.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0)), F.coalesce(size, F.lit(0))).first()
    ordered = made.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").select("at", "value", "label")

    def stream() -> Iterator[Row]:
        for at, value, label in ordered.toLocalIterator():
            yield np.frombuffer(at, "<i4"), np.frombuffer(value, "<f4"), label

    held = list(stream()) if size <= HELD_BYTES else None
    return train(stream if held is None else lambda: held, n_rows, n_good, bits)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out and score of every row. A null doc_id is in neither fold: its held_out is null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS weights: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(got, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", (~in_training("doc_id")).alias("held_out"), "score")


def keep_good(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """Documents that score at least so much, with all their columns. Decisions are made row by row, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filtered(docs, lambda texts: [shared.value.score(t) >= least for t in texts])
