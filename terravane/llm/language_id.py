"""Operator 1: language identification.

Sparse multinomial logistic regression on TF-IDF weights of hashed character 1- to 3-grams, trained with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), then temperature calibration on
rows that training has not seen. Training takes a bounded sample (`per_language` rows of each language);
prediction reads every whole text.

A null text, or one without a letter, gives `und` with score 0. Ties go to the language that sorts first.
With no usable training rows every text gives `und`. Repeated rows give equal rows; other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts
from .sampling import balanced

BITS = 15
UNDETERMINED = "und"


@functools.cache
def _letters() -> np.ndarray:
    """Code point -> itself if a letter of the basic plane, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(65536)], np.uint32)


def grams(text: bytes | None) -> np.ndarray | None:
    """Buckets of the character 1- to 3-grams of a whole text, in lower case, other than letters as spaces; None without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    c = _letters()[np.minimum(c, 65535)] if c.max() < 65536 else np.where(c < 65536, _letters()[np.minimum(c, 65535)], np.fromiter((x if chr(x).isalpha() else 32 for x in c.tolist()), np.uint32, len(c)))
    if not (c != 32).any():
        return None
    c = np.concatenate([[32], c, [32]]).astype(np.uint32)
    one = c * np.uint32(2654435761) + np.uint32(0x85EBCA6B)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(668265263) + c[2:] * np.uint32(374761393)
    return np.concatenate([one[1:-1], two, three]) >> np.uint32(32 - BITS)


def counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(g, minlength=1 << BITS)
    at = np.flatnonzero(n)
    return at, n[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        v = np.log1p(n) * self.idf[at]
        return v / max(np.sqrt(v @ v), 1e-12)

    def logits(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.vector(at, n) @ self.weights[at] + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        g = grams(text)
        if g is None or not self.languages:
            return UNDETERMINED, 0.0
        z = self.logits(*counted(g)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def train(rows: list[tuple[str, int, np.ndarray, np.ndarray]], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 3) -> Model:
    """rows: (language, order, buckets, counts). Every fifth row by order is kept for the calibration."""
    rows = sorted(rows, key=lambda r: r[1])
    names = sorted({r[0] for r in rows})
    size, k = 1 << BITS, len(names)
    df = np.zeros(size)
    for r in rows:
        df[r[2]] += 1
    if not rows:
        return Model([], np.ones(size, np.float32), np.zeros((size, 0), np.float32), np.zeros(0, np.float32))
    model = Model(names, np.log((1 + len(rows)) / (1 + df)).astype(np.float32) + np.float32(1), np.zeros((size, k), np.float32), np.zeros(k, np.float32))
    fit = [r for i, r in enumerate(rows) if i % 5 or len(rows) < 10]
    rest = [r for i, r in enumerate(rows) if not i % 5] if len(rows) >= 10 else rows
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at):
        return np.where(np.abs(z[at]) <= l1, 0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    vectors = [(np.append(r[2], size), np.append(model.vector(r[2], r[3]), 1.0), names.index(r[0])) for r in fit]
    for _ in range(epochs):
        for at, x, y in vectors:
            w = weights(at)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha * w
            n[at] += g * g
    w = weights(np.arange(size + 1)).astype(np.float32)
    model.weights, model.bias = w[:-1], w[-1]
    scores = np.array([model.logits(r[2], r[3]) for r in rest]).reshape(-1, k)
    truth = np.array([names.index(r[0]) for r in rest], int)
    if k > 1:
        def loss(t):
            s = scores / t
            s = s - s.max(1, keepdims=True)
            return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]))

        model.temperature = float(min(np.geomspace(0.05, 5, 80), key=loss))
    return model


def fit(documents: DataFrame, per_language: int = 600) -> Model:
    """documents: doc_id, text, lang, of which only rows with a text and a lang count."""
    sample = balanced(documents.where("lang is not null and text is not null"), "lang", "doc_id", per_language)

    def features(batches):
        for batch, found in texts(batches):
            lang, order = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [(a, b, *(x.astype(np.int32).tobytes() for x in counted(g))) for a, b, t in zip(lang, order, found) if (g := grams(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "o", "at", "n"])

    rows = sample.select("text", "lang", F.xxhash64(F.col("doc_id"), F.lit("order")).alias("o")).mapInArrow(features, "lang string, o long, at binary, n binary").collect()
    return train([(r[0], r[1], np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.int32)) for r in rows])


def identify(documents: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, lang_pred and score for every row."""
    schema = documents.select(*keys).schema.add("lang_pred", "string").add("score", "double")

    def predict(batches):
        for batch, found in texts(batches):
            out = [model.predict(t) for t in found]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=[*keys, "lang_pred", "score"])

    return documents.select(*keys, "text").mapInArrow(predict, schema)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = fit(docs.where(~held))
    return identify(docs.withColumn("held_out", held), model, ("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")
