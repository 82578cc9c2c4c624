"""Quality scores: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its distinct hashed words, word pairs, word shapes and shape pairs (a shape
maps letters, digits and marks to classes and shortens runs), binary and scaled to unit length.
Training takes a bounded sample of labelled rows (`MAX_TRAIN`, a documented parameter; picked by a
hash of the id). The sample is dealt to `SHARDS` groups; each runs FTRL-proximal over its rows,
and their weights are averaged after every epoch. Scoring is one sparse dot product per text.

Null or empty text has no features and scores by the bias alone. Rows without a label (null) don't
train; with no labelled rows, or an empty table, every score is 0.5. Repeated rows train as
often as they occur and score alike. A document with two labels trains with both.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.functions.lineage import cut
from rankloom.llm.common import CACHE_WORDS, WordHashes, field, hashed_share, map_texts, mixed, word_hashes

BITS = 18
MAX_TRAIN = 12_000
SHARDS, EPOCHS = 4, 4
ALPHA, BETA, L1, L2 = 5.0, 1.0, 1e-4, 1e-4

_SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else 0xC3 if c >= 0x80 else c for c in range(256))


_RUN = re.compile(rb"(.)\1{2,}", re.S)


def shape(word: bytes) -> bytes:
    """Classes of the characters, each run of a class once or, if longer, twice."""
    return _RUN.sub(rb"\1\1", word.translate(_SHAPE))


class Shapes(dict):
    """Hashes of words' shapes, remembered up to a number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(shape(word), 1)
        return value


def features(text: bytes, words: WordHashes, shapes: Shapes) -> np.ndarray:
    """Sorted distinct feature numbers of a text, whole."""
    found = text.split()
    if not found:
        return np.empty(0, np.int64)
    w, s = word_hashes(found, words), np.fromiter(map(shapes.__getitem__, found), np.uint64, len(found))
    m = np.uint64(0x9E3779B97F4A7C15)
    i = np.sort((mixed(np.concatenate((w, s, w[:-1] * m + w[1:], s[:-1] * m + s[1:]))) >> np.uint64(64 - BITS)).astype(np.int32))
    return i[np.concatenate(([True], i[1:] != i[:-1]))].astype(np.int64)


def featured(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    words, shapes = WordHashes(), Shapes()

    def work(texts):
        return [pa.array([features(t, words, shapes).astype(np.int32) for t in texts], pa.list_(pa.int32()))]

    return map_texts(df, keep, text, [field("_x", "ints")], work)


class Leader:
    """FTRL-proximal with a rate for each coordinate; the last coordinate is the bias, which isn't regularised."""

    def __init__(self, start: np.ndarray, alpha: float = ALPHA, l1: float = L1):
        self.alpha, self.l1 = alpha, l1
        self.n = np.zeros(len(start))
        self.z = -start * (BETA / alpha + L2) - np.sign(start) * l1

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((BETA + np.sqrt(self.n[i])) / self.alpha + L2))

    def learn(self, i: np.ndarray, y: float, x: np.ndarray | None = None) -> None:
        w, x = self.weights(i), value(i) if x is None else x
        g = (sigmoid(float(w @ x)) - y) * x
        root = np.sqrt(self.n[i] + g * g)
        self.z[i] += g - (root - np.sqrt(self.n[i])) / self.alpha * w
        self.n[i] += g * g


def value(i: np.ndarray) -> np.ndarray:
    """Feature values of a row whose last coordinate is the bias."""
    x = np.full(len(i), 1.0 / np.sqrt(max(1, len(i) - 1)))
    x[-1] = 1.0
    return x


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def epoch(start: np.ndarray):
    """One pass of a shard from the weights `start`; returns one row."""

    def run(frame):
        leader, bias = Leader(start.astype(np.float64)), len(start) - 1
        for y, x in frame.sort_values(["_turn", "_y"])[["_y", "_x"]].itertuples(index=False):
            leader.learn(np.append(x, bias).astype(np.int64), float(y))
        return pd.DataFrame({"w": [leader.weights(np.arange(bias + 1)).astype("<f4").tobytes()], "seen": [len(frame)]})

    return run


def trained(sample: DataFrame) -> np.ndarray:
    """Weights and bias from the bounded sample (_id, _y, _x)."""
    size = 1 << BITS
    weights = np.zeros(size + 1)
    # Each shard is at most its part of the bounded sample; it is dealt out once, for all epochs.
    dealt = cut(sample.select(F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(SHARDS)).alias("_shard"), F.xxhash64("_id", F.lit(2)).alias("_turn"), "_y", "_x").repartition("_shard"))
    for _ in range(EPOCHS):
        shards = dealt.groupBy("_shard").applyInPandas(epoch(weights.astype(np.float32)), "w binary, seen long").collect()  # SHARDS rows of one weight vector each
        if not shards:
            return weights
        weights = sum(np.frombuffer(r["w"], "<f4").astype(np.float64) * r["seen"] for r in shards) / sum(r["seen"] for r in shards)
    return weights


def sampled(df: DataFrame, labels: DataFrame, use: Column, *, doc_id: str, text: str, label: str, most: int) -> DataFrame:
    """(_id, _y, _text) of about `most` labelled rows at the most for which `use` (an expression over `_id`) holds, picked by a 64-bit hash of the id."""
    y = labels.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{label}`").cast("int").alias("_y")).where("_y IS NOT NULL").where(use)
    # The bound holds before the texts are read, so that no more than the sample is joined.
    y = y.where(hashed_share(F.col("_id"), most, y.count()))
    return df.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text")).join(y, "_id")


def fit(df: DataFrame, labels: DataFrame, use: Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MAX_TRAIN) -> np.ndarray:
    """Train on the documents that have a label and for which `use` (an expression over `_id`) holds."""
    joined = sampled(df, labels, use, doc_id=doc_id, text=text, label=label, most=most)
    return trained(featured(joined, ["_id", "_y"], "_text"))


def scores(df: DataFrame, weights: np.ndarray, *, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` and `_score`, 0 to 1."""
    w = weights.astype(np.float32)
    words, shapes = WordHashes(), Shapes()

    def work(texts):
        out = []
        for t in texts:
            i = features(t, words, shapes)
            dot = float(w[i].sum(dtype=np.float64)) / np.sqrt(max(1, len(i)))
            out.append(sigmoid(dot + float(w[-1])))
        return [pa.array(out, pa.float64())]

    return map_texts(df, keep, text, [field("_score", "double")], work)
