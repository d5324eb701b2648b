"""Operator 5: toxicity by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A text is the set of its words, adjacent word pairs and pairs with one word between, each hashed
to one of 2**BITS coordinates. FTRL-proximal keeps a learning rate for each coordinate and sets
weights to exactly zero under L1, so the model that is broadcast for scoring is bounded by 2**BITS
float32 values (1 MB) whatever the corpus.

The model is fitted on at most `sample` labelled rows (default SAMPLE), those with the smallest
hash of doc_id, and at most BYTES of their features, on the driver, which gets their feature
numbers only; scoring covers all rows.
A null or empty text scores as the bias alone. Rows with a null doc_id are never training rows.
A document labelled more than once counts as toxic if any label says so; without usable labels
every score is PRIOR. Equal texts get equal scores. Very long texts are scored whole, in one
pass; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, map_batches, map_whole, materialize, release

BITS = 18
#: Labelled rows, and bytes of their features (four for each), that come to the driver at most.
SAMPLE, BYTES = 8000, 128_000_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 4.0, 1.0, 8.0, 0.0
#: The value of a present pair (a present word has 1), and how often a toxic row is repeated.
PAIR, WEIGHT = 0.1, 4
THRESHOLD = 0.7
PRIOR = 0.02
_WORD = re.compile(r"\w+")


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[word] = zlib.crc32(word.encode())
        return value


_hashes = _Hashes()


def features(text: str | None) -> np.ndarray:
    """The distinct coordinates of a text, ascending."""
    words = _WORD.findall((text or "").lower())
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    near = h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77) + np.uint64(1)
    skip = h[:-2] * np.uint64(0xC2B2AE3D) + h[2:] * np.uint64(0x27D4EB2F) + np.uint64(2)
    pairs = np.concatenate([near, skip])
    at = (np.concatenate([h, pairs]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - BITS)).astype(np.int64)
    at[len(h) :] += 1 << BITS - 1  # words in the lower half, pairs in the upper
    return np.unique(at)


def value(at: np.ndarray) -> np.ndarray:
    """1 for a word and for the bias, PAIR for a pair."""
    return np.where((at >= 1 << BITS - 1) & (at < 1 << BITS), PAIR, 1.0)


class Ftrl:
    """FTRL-proximal logistic regression over present features; the last coordinate is the bias."""

    def __init__(self, size: int = (1 << BITS) + 1):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(z.shape, L1)
        if isinstance(at, slice):
            l1[-1] = 0
        else:
            l1[at == len(self.z) - 1] = 0
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: float) -> None:
        w, x = self.weights(at), value(at)
        g = (1 / (1 + np.exp(-np.clip((w * x).sum(), -35, 35))) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - step * w
        self.n[at] += g * g


def fit(rows: list[tuple[np.ndarray, int]]) -> np.ndarray | None:
    """Dense float32 weights, bias last; None without both labels. `rows` are in a fixed order."""
    if len({y for _, y in rows}) < 2:
        return None
    rows = [r for r in rows for _ in range(WEIGHT if r[1] else 1)]
    model, bias = Ftrl(), np.array([1 << BITS])
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[k]
            model.learn(np.concatenate([x, bias]), y)
    return (model.weights() * value(np.arange((1 << BITS) + 1))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = BYTES) -> np.ndarray | None:
    """Fit on at most `sample` labelled rows whose crc32(doc_id as text) mod 3 is not 1, and `most` bytes of features.

    Of rows that repeat a doc_id the first text counts. Rows are taken in the order of a hash of
    doc_id until one of the bounds is met; with texts of the usual length that is the first.
    """
    usable = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 != 1")
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def run(keys, texts, toxic):
        return [keys, [features(x).astype(np.uint32).tobytes() for x in texts], toxic]

    found = materialize(map_batches(texts.select("doc_id", "text", "toxic"), "doc_id long, at binary, toxic int", run), "features")
    sizes = found.select("doc_id", F.octet_length("at").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fits = int(np.searchsorted(np.cumsum([r.n for r in sizes]), most, "right")) if sizes else 0
    got = found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fits).collect() if fits < len(sizes) else found.collect()
    release(found)
    got.sort(key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id))
    return fit([(np.frombuffer(r.at, np.uint32).astype(np.int64), int(r.toxic)) for r in got])


def probability(text: str | None, w: np.ndarray | None) -> float:
    if w is None:
        return PRIOR
    return float(1 / (1 + np.exp(-np.clip(w[features(text)].sum(dtype=np.float64) + w[-1], -35, 35))))


def score(docs: DataFrame, weights: np.ndarray | None, key: str = "doc_id") -> DataFrame:
    """Rows of (key, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(keys, texts):
        return [keys, [probability(x, shared.value) for x in texts]]

    return map_batches(docs.select(key, "text"), f"`{key}` {docs.schema[key].dataType.simpleString()}, score double", run)


def accepted(docs: DataFrame, weights: np.ndarray | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    at = docs.columns.index("text")

    def run(batch):
        return batch.filter(pa.array([probability(x, shared.value) < threshold for x in batch.column(at).to_pylist()], pa.bool_()))

    return map_whole(docs, run)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    weights = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, weights).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
