"""Quality classifier: averaged hashed word and character n-gram vectors, softmax, SGD in numpy.

A text's features are its words and the character n-grams (NGRAMS code points) of its words, the
white space on either side of a word counting as one mark; all are hashed into BUCKETS vectors.
Each pair of neighbouring words adds one more feature, which says whether they are the same word
(buckets 0 and 1): no vector of a word or n-gram can say that of words not met in training. The
text's vector is the mean; a linear layer and softmax give the label's probability. Training is
one document at a time with a falling rate. Since mean and layer are linear, scoring needs one
number for each bucket: the layer applied to the bucket's vector.

Scale: training takes at most TRAIN_ROWS labelled rows (those of smallest hash) and of these at
most so many that their sparse features stay below TRAIN_FEATURES: documented bounds, so six bytes
for each of TRAIN_FEATURES come to the driver at most. Scoring maps each text once, whole, with a
table of BUCKETS floats; nothing shuffles.

Defined results: a null or empty text has no features and gets the label's share among the
training rows' odds (the layer's bias); labels that are null or of unknown documents are not
used, and a label's rows that repeat count once; with no training rows or one label only, all
scores are that label's share (0.5 without any); repeated rows get equal scores; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan
from .common import discard, written

BUCKETS = 1 << 16
NGRAMS = (3, 4)
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.5
TRAIN_ROWS = 3000
TRAIN_FEATURES = 10_000_000
SLICE_BYTES = 1 << 21


def _hashed(texts: list[str | None], repeats: bool = True) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of texts: (first, end, [(bucket of each feature, bounds of the texts)]), a pair for each sort of feature."""
    for a, b in bytescan.batches([(t or "").encode() for t in texts], SLICE_BYTES):
        own = [t or "" for t in texts[a:b]]
        data = np.frombuffer(("\n" + "\n".join(own) + "\n").encode("utf-32-le"), np.uint32)
        before = np.concatenate(([0], np.cumsum([len(t) + 1 for t in own])))  # places of the line feeds between texts
        space = (data == 32) | (data - 9 < 5)
        chars = np.where(space, 32, data).astype(np.uint64)
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = change[0::2], change[1::2]
        words = bytescan.span_hashes(bytescan.prefix_sums(chars), starts, ends)
        first = np.searchsorted(starts, before)
        again = np.zeros(len(words), np.int64)
        again[1:] = words[1:] == words[:-1]
        again[first[:-1][first[:-1] < len(words)]] = 0
        parts = [((words >> np.uint64(48)).astype(np.int64).clip(2), first)] + [(again, first)] * repeats
        spaces = np.concatenate(([0], np.cumsum(space)))
        for n in NGRAMS:
            size = max(0, len(chars) - n + 1)
            # none of the inner characters is white space, nor all of them with the last one
            at = np.flatnonzero((spaces[n - 1 : n - 1 + size] == spaces[1 : 1 + size]) & (spaces[n : n + size] - spaces[:size] < n))
            gram = np.full(len(at), n, np.uint64)
            for k in range(n):
                gram = gram * np.uint64(bytescan.BASE) + chars[at + k]
            parts.append(((bytescan.mixed(gram) >> np.uint64(48)).astype(np.int64).clip(2), np.searchsorted(at, before)))
        yield a, b, parts


def counts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: buckets, and their shares of all its features."""
    out = []
    for a, b, parts in _hashed(texts):
        for k in range(b - a):
            own = np.concatenate([f[at[k] : at[k + 1]] for f, at in parts])
            bucket, times = np.unique(own, return_counts=True)
            out.append((bucket.astype(np.uint16), (times / max(1, len(own))).astype(np.float32)))
    return out


@dataclass
class Model:
    """The odds that each bucket adds, and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, parts in _hashed(texts):
            total, number = np.zeros(b - a), np.zeros(b - a)
            for bucket, at in parts:
                upto = np.concatenate(([0.0], np.cumsum(self.weights[bucket], dtype=np.float64)))[at]
                total += upto[1:] - upto[:-1]
                number += at[1:] - at[:-1]
            out[a:b] = total / np.maximum(number, 1)
        return 1.0 / (1.0 + np.exp(-np.clip(out + self.bias, -50, 50)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[int], seed: int = 7) -> Model:
    """Fit vectors and layer by stochastic gradient descent, one document at a time."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), {0.0: -50.0, 1.0: 50.0}.get(share, 0.0))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / DIMENSIONS, 1.0 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = rng.uniform(-0.5, 0.5, (DIMENSIONS, 2)).astype(np.float32), np.log([1 - share, share])
    steps = EPOCHS * len(y)
    for n, k in enumerate(np.concatenate([rng.permutation(len(y)) for _ in range(EPOCHS)])):
        bucket, times = rows[k]
        rate = RATE * (1 - n / steps)
        hidden = times @ vectors[bucket]
        odds = hidden @ layer + bias
        p = np.exp(odds - odds.max())
        p /= p.sum()
        p[y[k]] -= 1.0
        back = layer @ p
        layer -= (rate * np.outer(hidden, p)).astype(np.float32)
        bias -= 0.02 * rate * p
        # the mean's gradient is spread over its features; scaling it up by their number's root keeps steps alive
        vectors[bucket] -= (rate * len(bucket) ** 0.5 * times)[:, None] * back[None].astype(np.float32)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = TRAIN_ROWS, most_features: int = TRAIN_FEATURES) -> Model:
    """Train on labelled rows of smallest hash, as many as both bounds allow; ``labels`` says which rows may be learnt from."""
    chosen = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("of"), "of").limit(most_rows)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), F.col("key") == F.col("of"))

    def sparse(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = counts(batch.column("text").to_pylist())
            arrays = [pa.array([len(b) for b, _ in found], pa.int64()), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([t.tobytes() for _, t in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("y"), batch.column("text_hash"), *arrays], ["h", "y", "text_hash", "n", "b", "t"])

    rows = rows.select(F.xxhash64("of").alias("h"), F.col("y").cast("int").alias("y"), F.xxhash64("text").alias("text_hash"), "text")
    found = written(rows.mapInArrow(bytescan.tidy(sparse), "h bigint, y int, text_hash bigint, n bigint, b binary, t binary"), "train-features")
    once = F.row_number().over(Window.partitionBy("h").orderBy("text_hash"))
    upto = F.sum("n").over(Window.orderBy("h"))  # over TRAIN_ROWS small rows
    taken = found.select("h", "text_hash", "n").withColumn("nth", once).where("nth = 1").withColumn("upto", upto).where(F.col("upto") <= most_features)
    got = found.join(F.broadcast(taken.select("h", "text_hash")), ["h", "text_hash"]).dropDuplicates(["h"]).select("h", "y", "b", "t").collect()
    discard(found)
    got.sort(key=lambda r: r["h"])
    return train([(np.frombuffer(r["b"], np.uint16), np.frombuffer(r["t"], np.float32)) for r in got], [r["y"] for r in got])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key and score, the probability of label 1."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for a, b, texts in bytescan.slices(batch.column("text"), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(a, b - a), pa.array(model.scores(texts), pa.float64())], ["key", "score"])

    return rows.mapInArrow(bytescan.tidy(run), f"key {kind}, score double")
