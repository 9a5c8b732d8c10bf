"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the buckets of its words, word pairs and pairs with one word between them; a feature is present
or not, however often it occurs. Every coordinate has a learning rate of its own, and the L1 term keeps the weight of
uninformative ones at exactly zero, so the model that scoring needs is a short list of weights. Texts become features
on the executors; the fit runs over a sample of at most ``MOST_ROWS`` labelled documents. Scoring reads every text as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tagloom.llm.store import batches_of, held_out, slices, values

MOST_ROWS = 8192
BUCKET_BITS = 20
MOST_WORDS = 60_000
NEXT, SKIPPED, SPREAD = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


class WordHashes(dict):
    """Hash of each word, remembered while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = code = xxhash.xxh64_intdigest(word)
        return code


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Buckets of all n-grams of a text in order, repeats included."""
    words = re.findall(r"\w+", (text or "").lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    grams = np.concatenate([h, h[:-1] * NEXT + h[1:], h[:-2] * SKIPPED + h[2:]])
    grams = (grams ^ (grams >> np.uint64(31))) * SPREAD
    return (grams >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """The bias, and the buckets with a weight: at most 2**BUCKET_BITS of them."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << BUCKET_BITS, np.float32)
        dense[self.buckets] = self.weights
        return dense


def ftrl(
    rows: list[tuple[int, np.ndarray]], alpha: float = 1.0, beta: float = 1.0, l1: float = 15.0, l2: float = 0.1, epochs: int = 6, balance: float = 0.5
) -> Model:
    """Fit (label, distinct buckets) rows in a fixed shuffled order; the bias has no L1 term. No rows: all scores 0.5.

    A row of the rarer class counts as many times as the classes' ratio to the power ``balance`` says.
    """
    ones = sum(label for label, _ in rows)
    ratio = (max(len(rows) - ones, 1) / max(ones, 1)) ** balance
    counts = (max(1.0, 1.0 / ratio), max(1.0, ratio))
    z, n = np.zeros(1 << BUCKET_BITS), np.zeros(1 << BUCKET_BITS)
    bias_z = bias_n = bias = 0.0
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            label, at = rows[k]
            zs, ns = z[at], n[at]
            rate = (beta + np.sqrt(ns)) / alpha + l2
            w = np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / rate)
            g = counts[label] * (1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label)
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / alpha * w
            n[at] = ns + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * bias
            bias_n += g * g
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)
    kept = np.flatnonzero(w).astype(np.int32)
    return Model(float(bias), kept, w[kept])


def score(texts: Iterator[str | None], table: np.ndarray, bias: float, hashes: WordHashes) -> list[float]:
    """Probability of the label 1 for each text."""
    out = []
    for text in texts:
        at = features(text, hashes)
        w = table[at]
        at = np.unique(at[w != 0])
        out.append(1.0 / (1.0 + float(np.exp(-np.clip(table[at].sum(dtype=np.float64) + bias, -35, 35)))))
    return out


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS) -> Model:
    """Fit on labelled documents that are not held out (crc32 of the key mod 5 is not 0).

    The sample is those ``most_rows`` labelled keys that hash lowest. A key labelled both ways counts as 1, a key with several texts
    as the least of them; rows without a key or a label are left out.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where("key is not null and label is not null")
    known = known.where(~held_out(F.col("key"), 5, 0)).groupBy("key").agg(F.max("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("key"), "key").limit(most_rows)
    texts = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    texts = texts.groupBy("key").agg(F.min("label").alias("label"), F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches_of(batches):
            for part in slices(batch, 2):
                rows = pa.array([np.unique(features(t, hashes)) for t in values(part.column(2))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.int32()), rows], ["key", "label", "at"])

    kind = texts.schema["key"].dataType.simpleString()
    rows = texts.mapInArrow(run, f"key {kind}, label int, at array<int>").toArrow()
    order = np.argsort(rows["key"].to_numpy(), kind="stable")
    return ftrl([(int(rows["label"][int(i)].as_py()), rows["at"][int(i)].values.to_numpy()) for i in order])


def scored(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with ``score``, the probability that the text is toxic; nothing but the text enters it.

    A null or empty text gets the score of the bias alone. Every row gives a row; an empty table an empty one. A column
    named ``score`` is replaced.
    """
    weights = documents.sparkSession.sparkContext.broadcast((model.bias, model.buckets, model.weights))
    rows = documents.drop("score")
    if text not in rows.columns:
        raise ValueError(f"no column {text}")
    place = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, buckets, kept = weights.value
        table, hashes = Model(bias, buckets, kept).table(), WordHashes()
        for batch in batches_of(batches):
            for part in slices(batch, place):
                scores = pa.array(score(values(part.column(place)), table, bias, hashes), pa.float64())
                yield pa.RecordBatch.from_arrays([*part.columns, scores], [*part.schema.names, "score"])

    schema = StructType([*rows.schema.fields, StructField("score", DoubleType())])
    return rows.mapInArrow(run, schema)
