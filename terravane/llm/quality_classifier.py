"""Operator 5: document quality by nearest-neighbour voting in a latent-semantic space.

TF-IDF weights of hashed byte 1- to 3-grams and of shape terms (word repetition, symbols, capitals, pipes, line
and word lengths) are projected on the leading singular vectors of a bounded labelled sample. The labelled
vectors (at most about 2 x `per_class` x `dims` floats) are sent to all tasks; each document's exact cosine products
with all of them are computed in blocks, and its nearest neighbours' labels are averaged by similarity.

Vectors are rounded to multiples of 1 / STEPS, so that products and their sums have no rounding at all: a score depends on the text alone and
not on the rows beside it, and equal texts get equal scores. Ties among neighbours go to the earlier one in the sample's hash order. Texts
without a word get the sample's share of label 1 as their score, and accepted() drops them, as there is nothing to accept; without labelled
rows every score is 0.5. Several labels of a document count as their largest. A null doc_id has no label and is scored as any
other; rows that share a doc_id are scored each by its text. Other columns are ignored.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, table, texts
from .sampling import balanced

BITS = 13
SHAPES = 1 << 8
SIZE = (1 << BITS) + SHAPES
SHAPE_WEIGHT = 0.5
#: Of the contract.
ACCEPT = 0.3
#: Sums of products of rounded unit vectors stay below 2^53, so they are exact in any order.
STEPS = 1 << 20
#: Rows of the sample that are dense at a time.
ROWS = 256


def _shape(text: bytes, c: np.ndarray) -> list[int]:
    """Shape terms: each measure's step, as an index below SHAPES."""
    n = len(c)
    words = text.split()
    w = max(1, len(words))
    kinds = np.bincount(c, minlength=256)
    letters = max(1, int(kinds[65:91].sum() + kinds[97:123].sum()))
    symbols = int(sum(kinds[ord(x)] for x in "#*$%&|<>!^~=_{}[]\\@"))
    measures = (
        len(set(words)) / w,
        min(1.0, symbols / w),
        int(kinds[65:91].sum()) / letters,
        min(1.0, n / w / 16),
        min(1.0, int(kinds[10]) * 8 / w),
        int(kinds[48:58].sum()) / n,
        min(1.0, int(kinds[46] + kinds[44]) * 4 / w),
        min(1.0, int(np.log2(w + 1)) / 16),
    )
    return [16 * i + min(15, int(m * 16)) for i, m in enumerate(measures)]


def features(text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets and weights, before the inverse document frequency, of a whole text; None if it is empty."""
    if not text or not text.split():
        return None
    c = np.frombuffer(text, np.uint8).astype(np.uint32)
    one = c * np.uint32(2654435761)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * np.uint32(2246822519) + c[1:] * np.uint32(3266489917)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(668265263) + c[2:] * np.uint32(374761393)
    n = np.bincount(np.concatenate([one, two, three]) >> np.uint32(32 - BITS), minlength=1 << BITS)
    at = np.flatnonzero(n)
    v = np.log1p(n[at])
    v /= np.sqrt(v @ v)
    shape = _shape(text, c.astype(np.uint8))
    return np.append(at, np.array(shape) + (1 << BITS)).astype(np.int32), np.append(v, np.full(len(shape), SHAPE_WEIGHT)).astype(np.float32)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int
    prior: float

    def scores(self, found: list[tuple | None], block: int = 256) -> np.ndarray:
        out = np.full(len(found), self.prior)
        rows = [i for i, x in enumerate(found) if x is not None] if len(self.labels) else []
        for start in range(0, len(rows), block):
            some = rows[start : start + block]
            out[some] = self.vote(rounded(np.array([projected(*found[i], self.idf, self.axes) for i in some])))
        return out

    def vote(self, q: np.ndarray) -> np.ndarray:
        n = len(self.labels)
        s = q @ self.vectors.T  # whole numbers
        rank = s.astype(np.int64) * n - np.arange(n)  # no two are equal
        k = min(self.neighbours, n)
        near = np.argpartition(-rank, k - 1, axis=1)[:, :k]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(rank, near, 1), axis=1), 1)
        w = np.maximum(np.take_along_axis(s, near, 1) / STEPS**2, 1e-6) ** 4
        return np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0, 1)


def projected(at: np.ndarray, v: np.ndarray, idf: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (v * idf[at]) @ axes[at]


def rounded(x: np.ndarray) -> np.ndarray:
    """Unit vectors in whole multiples of 1 / STEPS."""
    x = x.astype(float)
    return np.rint(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12) * STEPS)


def singular(blocks: list, n: int, dims: int, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues and vectors of the products of all rows, by subspace iteration from a fixed start.

    blocks: functions that give ROWS dense rows each. Beside the n x n products no more than two of them are held.
    """
    g = np.empty((n, n), np.float32)
    for i, left in enumerate(blocks):
        x = left()
        for j in range(i + 1):
            y = x if i == j else blocks[j]()
            g[ROWS * i : ROWS * i + len(x), ROWS * j : ROWS * j + len(y)] = x @ y.T
            g[ROWS * j : ROWS * j + len(y), ROWS * i : ROWS * i + len(x)] = g[ROWS * i : ROWS * i + len(x), ROWS * j : ROWS * j + len(y)].T
    q = np.random.default_rng(0).normal(size=(n, min(n, dims + 16))).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(g @ q)
    values, v = np.linalg.eigh((q.T @ (g @ q)).astype(float))
    top = np.argsort(-values, kind="stable")[:dims]
    top = top[values[top] > 1e-6 * values.max()]
    return values[top], q @ v[:, top].astype(np.float32)


def train(rows: list[tuple[int, int, np.ndarray, np.ndarray]], dims: int = 48, neighbours: int = 9) -> Model:
    """rows: (order, label, buckets, weights)."""
    rows = sorted(rows, key=lambda r: r[0])
    labels = np.array([r[1] for r in rows], float)
    df = np.zeros(SIZE)
    for r in rows:
        df[r[2]] += 1
    idf = (np.log((1 + len(rows)) / (1 + df)) + 1).astype(np.float32)
    if not rows:
        return Model(idf, np.zeros((SIZE, 1), np.float32), np.zeros((0, 1)), labels, neighbours, 0.5)

    def dense(some):
        x = np.zeros((len(some), SIZE), np.float32)
        for i, r in enumerate(some):
            x[i, r[2]] = r[3] * idf[r[2]]
        return x

    blocks = [functools.partial(dense, rows[i : i + ROWS]) for i in range(0, len(rows), ROWS)]
    values, u = singular(blocks, len(rows), dims)
    axes = np.zeros((SIZE, len(values)), np.float32)
    for i, block in enumerate(blocks):
        axes += block().T @ (u[ROWS * i : ROWS * (i + 1)] / np.sqrt(values)).astype(np.float32)
    return Model(idf, axes, rounded(np.array([projected(r[2], r[3], idf, axes) for r in rows])), labels, neighbours, float(labels.mean()))


def fit(documents: DataFrame, labels: DataFrame, per_class: int = 1000) -> Model:
    """documents: doc_id, text; labels: doc_id, quality, of which about per_class rows of each class are used."""
    sample = balanced(labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")), "quality", "doc_id", per_class)

    def read(batches):
        for batch, found in texts(batches):
            q, order = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = [(b, a, x[0].tobytes(), x[1].tobytes()) for a, b, t in zip(q, order, found) if (x := features(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["o", "q", "at", "v"])

    # the sample's size is bounded by per_class, so it may be sent to all tasks and to the driver
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", F.col("quality").cast("int").alias("q"), F.xxhash64(F.col("doc_id"), F.lit("order")).alias("o")).mapInArrow(read, "o long, q int, at binary, v binary").toArrow()
    model = train([(o.as_py(), q.as_py(), np.frombuffer(at.as_buffer(), np.int32), np.frombuffer(v.as_buffer(), np.float32)) for o, q, at, v in zip(*rows.columns)])
    release()
    return model


def classify(documents: DataFrame, model: Model, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, score and predicted for every row."""
    schema = documents.select(*keys).schema.add("score", "double").add("predicted", "integer")

    def predict(batches):
        for batch, found in texts(batches):
            s = model.scores([features(t) for t in found])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keys))), pa.array(s, pa.float64()), pa.array((s >= ACCEPT).astype(np.int32), pa.int32())], names=[*keys, "score", "predicted"])

    return documents.select(*keys, "text").mapInArrow(predict, schema)


def accepted(documents: DataFrame, model: Model, least: float = ACCEPT) -> DataFrame:
    """The documents, with all their columns, that have a word and a score of at least `least`."""

    def keep(batches):
        for batch, found in texts(batches):
            own = [features(t) for t in found]
            yield batch.filter(pa.array((model.scores(own) >= least) & np.array([x is not None for x in own], bool)))

    return documents.mapInArrow(keep, documents.schema)


def held_out() -> "F.Column":
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op5_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return classify(docs.withColumn("held_out", held_out()), model, ("doc_id", "held_out"))
