"""Supervised subword embeddings for document quality.

A document is the average of learned vectors of its hashed features: byte
3-grams and 5-grams, words, and neighbouring words. A softmax layer on the
average gives the class. Embeddings and layer are fitted by stochastic gradient
descent in numpy on a bounded sample of labelled rows; the average being linear,
scoring needs one folded number per hash bucket, so whole texts of any length
are scored in blocks.

A pair of neighbouring words is hashed by the difference of its word hashes, so
that all immediate repetitions share one bucket.

NULL and empty texts have no feature and get the score of the intercept. Rows
without a label (or a NULL one) are not used for fitting; with labels of one
class only, or none, every score is that class's share (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from millrace.llm.common import fresh, utf8

BITS = 18
BUCKETS = 1 << BITS
DIM = 8
EPOCHS = 3
RATE = 0.4

#: Labelled rows used for fitting: at most so many of each class, in the order
#: of a hash of their id, and only while their texts sum up to FIT_BYTES.
FIT_ROWS = 3_000
FIT_BYTES = 48 << 20

#: Documents with at least this score are kept.
KEEP = 0.7

#: Bytes of text turned into features at once.
BLOCK = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = h ^ np.uint32((kind * 0x9E3779B1) & 0xFFFFFFFF)
    h = h * np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BITS)


def features(data: np.ndarray) -> np.ndarray:
    """Feature buckets of one text given as bytes."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint32)
    b = data.astype(np.uint32)
    found = []
    if n >= 3:
        three = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        found.append(_bucket(three, 1))
        if n >= 5:
            five = three[:-2] * np.uint32(0x01000193) ^ (b[3:-1] | (b[4:] << np.uint32(8))) * np.uint32(0x9E3779B1)
            found.append(_bucket(five, 2))
    space = _SPACES[data]
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    if len(starts):
        length = np.diff(np.concatenate([starts, [n]]))
        place = np.arange(n, dtype=np.uint32)
        place[starts[0]:] -= np.repeat(starts.astype(np.uint32), length)
        term = (b + np.uint32(1)) * (place * np.uint32(0x9E3779B1) + np.uint32(0x7F4A7C15))
        term ^= term >> np.uint32(13)
        term *= np.uint32(0xC2B2AE35)
        term[space] = 0
        word = np.add.reduceat(term, starts).astype(np.uint32)
        found.append(_bucket(word, 3))
        if len(word) > 1:
            found.append(_bucket(word[1:] - word[:-1], 4))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def blocks(text: bytes) -> Iterator[np.ndarray]:
    """Feature buckets of a text, block by block, cut at white space where there is one."""
    data = np.frombuffer(text, np.uint8)
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        if end < len(data):
            spaces = np.flatnonzero(_SPACES[data[end - 4096 : end]])
            end = end - 4096 + int(spaces[-1]) + 1 if len(spaces) else end
        yield features(data[at:end])
        at = end


@dataclass
class Model:
    """One number per bucket: difference of the class scores; and the intercept."""

    weights: np.ndarray
    intercept: float

    def logit(self, text: bytes) -> float:
        total, count = 0.0, 0
        for found in blocks(text):
            total += float(self.weights[found].sum(dtype=np.float64))
            count += len(found)
        return self.intercept + (total / count if count else 0.0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        logits = np.array([self.logit(t) for t in texts], np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(logits, -500, 500)))


def fit(texts: list[bytes], labels: np.ndarray, share: float, seed: int = 7) -> Model:
    """Gradient descent over the sample; ``share`` is class 1's among all labelled rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer = np.zeros((2, DIM), np.float32)
    bias = np.zeros(2, np.float32)
    docs = []
    for text in texts:
        found = np.concatenate([*blocks(text), np.zeros(0, np.uint32)])
        at, times = np.unique(found, return_counts=True)
        docs.append((at, (times / max(1, len(found))).astype(np.float32)))
    classes = np.bincount(labels, minlength=2)
    if classes.min() == 0:
        share = 0.5 if not len(labels) else float(labels[0])
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    weight = len(labels) / (2.0 * classes)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            rate = RATE * (1 - done / steps)
            done += 1
            at, share_of = docs[i]
            x = share_of @ vectors[at]
            z = layer @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1.0
            p *= rate * weight[labels[i]]
            back = p @ layer
            layer -= np.outer(p, x)
            bias -= p
            # As usual for averaged features, every feature takes the whole step.
            vectors[at] -= np.minimum(share_of[:, None] * len(at), 4.0) * back[None, :]
    folded = vectors @ (layer[1] - layer[0])
    # The sample is weighted to equal classes; the intercept brings the real shares back.
    prior = float(np.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    return Model(folded.astype(np.float32), float(bias[1] - bias[0]) + prior)


def _fit_batches(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, ranks = [], [], []
        for batch in batches:
            texts += utf8(batch.column("text"))
            labels += batch.column("label").to_pylist()
            ranks += batch.column("rank").to_pylist()
        order = sorted(range(len(texts)), key=lambda i: (ranks[i], labels[i], texts[i]))
        model = fit([texts[i] for i in order], np.array([labels[i] for i in order], np.int64), share)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept])],
            ["weights", "intercept"],
        )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Model from the labelled rows for which ``usable`` (over the id column) holds.

    The sample is chosen on ids and labels alone and then meets the documents by
    a broadcast of at most 2 * ``FIT_ROWS`` rows; it is fitted in one task.
    """
    known = (
        labels.where(usable & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    )
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.5
    order = F.md5(F.col("id").cast("string"))
    picked = [
        known.where(F.col("label") == value).withColumn("rank", order).orderBy("rank").limit(FIT_ROWS)
        for value in (0, 1)
    ]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(sample, "id")
    so_far = W.orderBy("rank", "label").rowsBetween(W.unboundedPreceding, 0)
    # At most 2 * FIT_ROWS rows by now; repeated ids can add to them, the bytes cannot.
    bounded = (
        texts.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(so_far))
        .where(F.col("bytes") <= FIT_BYTES)
        .coalesce(1)
    )
    rows = bounded.select("text", "label", "rank").mapInArrow(
        _fit_batches(share), "weights binary, intercept double"
    ).collect()
    if not rows:
        return fit([], np.zeros(0, np.int64), share)
    return Model(np.frombuffer(rows[0]["weights"], np.float32), rows[0]["intercept"])


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; other columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores([(t or "").encode("utf-8", "surrogatepass") for t in texts]))

    made = fresh("score")
    out = docs.withColumn(made, scored(F.col(text_col).cast("string")))
    return out.drop(score_col).withColumnRenamed(made, score_col) if score_col in docs.columns else out.withColumnRenamed(
        made, score_col
    )


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; a NULL id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)
