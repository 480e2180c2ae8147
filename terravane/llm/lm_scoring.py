"""Operator 8: cross-entropy difference of matched target and background bigram models.

Both models share one vocabulary (every word of every document), one order and one smoothing (linear interpolation of bigram, unigram
and uniform shares), so that their losses differ by corpus only. The background is every whole document; the target is those labelled
quality 1 and not toxic. A document's score is the mean over its words of target loss minus background loss, in nats: lower is closer
to the target. Its end counts as a follower of its last word, but isn't scored.

Vocabulary and bigrams grow with the corpus and are nowhere gathered. Documents are dealt into blocks of about BLOCK bytes. A block
asks for the totals of its distinct words and bigrams, in SHARDS slices by range of a 64-bit hash; a shard sums what all blocks sent
and answers each one; a block with its answers scores its documents. What a block asks is summed in it, so that a frequent word is one row of it.
Words and bigrams are told apart by 63-bit hashes.

Null and empty texts have n_tokens 0 and null losses. Several labels of a document count as target if any does. Documents with a null
doc_id are in the background only. Other columns are ignored.

fit and score are the same with a vocabulary of bounded size, which the query doesn't use: the `size` most frequent words (ties go to the
word that sorts first), and classes by length and final punctuation for others, with two matrices of (size + classes + 1) squared floats.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, SECOND, Scratch, hashes, table, texts

LENGTHS = 12
CLASSES = 2 * LENGTHS
#: Distinct words that a task sums before it passes their counts on.
HELD = 400_000
#: Bytes of text in a block, and slices of the hash range.
BLOCK, SHARDS = 4 << 20, 2048
U = np.uint64
START = U(0x5BD1E995A7C3B9E2)


class Ids(dict):
    """Word -> id: the vocabulary's, else its class; remembers other words up to a bound."""

    def __init__(self, words: list[bytes], most: int = 300_000):
        super().__init__((w, i) for i, w in enumerate(words))
        self.n, self.most = len(words), len(words) + most

    def __missing__(self, w: bytes) -> int:
        i = self.n + 2 * (min(len(w), LENGTHS) - 1) + (w[-1:] in b".,;:!?")
        if len(self) < self.most:
            self[w] = i
        return i

    @property
    def start(self) -> int:
        return self.n + CLASSES

    def cells(self, words: list[bytes]) -> np.ndarray:
        """Cells (before, word) of the words, flattened; the first follows the start sign."""
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.r_[self.start, ids[:-1]] * (self.start + 1) + ids if len(ids) else ids


@dataclass
class Models:
    words: list[bytes]
    target: np.ndarray
    background: np.ndarray


def smoothed(cells: np.ndarray, k: int, bigram: float = 0.7, unigram: float = 0.29) -> np.ndarray:
    """Losses -log p(word | before) of a k by k matrix of counts, flattened."""
    c = cells.reshape(k, k).astype(float)
    rows, cols = c.sum(1, keepdims=True), c.sum(0)
    base = unigram * cols / max(1.0, cols.sum()) + (1 - bigram - unigram) / k
    base = np.maximum(base, 1e-12)
    share = np.divide(c, rows, out=np.zeros_like(c), where=rows > 0)
    p = np.where(rows > 0, bigram * share + base, base / (1 - bigram))
    return (-np.log(p)).astype(np.float32).ravel()


def _word_counts(batches):
    held: Counter = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
        held.clear()
        return batch

    for _, found in texts(batches):
        for t in found:
            if t:
                held.update(t.split())
        if len(held) > HELD:
            yield out()
    yield out()


def fit(documents: DataFrame, labels: DataFrame, size: int = 1000) -> Models:
    wanted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct().withColumn("target", F.lit(True))
    counts = documents.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = [bytes(r[0]) for r in counts.orderBy(F.desc("n"), "word").limit(size).collect()]
    k = len(words) + CLASSES + 1

    def bigrams(batches):
        ids, sums = Ids(words), [np.zeros(k * k, np.int64), np.zeros(k * k, np.int64)]
        for batch, found in texts(batches):
            target = batch.column(batch.schema.get_field_index("target")).to_pylist()
            for kind in (False, True):
                own = [ids.cells(t.split()) for t, x in zip(found, target) if t and x is kind]
                if own:
                    sums[kind] += np.bincount(np.concatenate(own), minlength=k * k)
        at = np.flatnonzero(sums[0] + sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array((sums[0] + sums[1])[at], pa.int64()), pa.array(sums[1][at], pa.int64())], names=["cell", "n", "target"])

    # labels grow with the corpus, so they are joined by a shuffle at any size
    marked = documents.select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left").select("text", F.coalesce("target", F.lit(False)).alias("target"))
    # at most k * k rows
    got = marked.mapInArrow(bigrams, "cell long, n long, target long").groupBy("cell").agg(F.sum("n").alias("n"), F.sum("target").alias("target")).toArrow()
    sums = np.zeros((2, k * k))
    for i, name in enumerate(("target", "n")):
        sums[i, got["cell"].to_numpy()] = got[name].to_numpy()
    return Models(words, smoothed(sums[0], k), smoothed(sums[1], k))


def score(documents: DataFrame, models: Models) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row."""

    def run(batches):
        ids = Ids(models.words)
        for batch, found in texts(batches):
            out = []
            for t in found:
                c = ids.cells(t.split()) if t else ()
                out.append((len(c), float(models.target[c].mean(dtype=float)), float(models.background[c].mean(dtype=float))) if len(c) else (0, None, None))
            n, a, b = (list(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def _packed(a: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, which are mostly zeros and compress well."""
    return a.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(parts: list[bytes], kind) -> list[np.ndarray]:
    return [np.ascontiguousarray(np.frombuffer(p, np.uint8).reshape(8, -1).T).view(kind).ravel() for p in parts]


def _groups(batches):
    """Runs of rows that agree in the first column."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield held[0][0], held
                held = []
            held.append(row)
    if held:
        yield held[0][0], held


def _tokens(found: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, and for each word its own key, that of the word before and that of the bigram; words are even, bigrams odd."""
    split = [t.split() if t else [] for t in found]
    size = np.array([len(w) for w in split], np.int64)
    word = hashes([w for ws in split for w in ws]) & ~U(1)
    before = np.r_[START, word[:-1]] if len(word) else word
    before[(np.cumsum(size) - size)[size > 0]] = START
    pair = before * MULTIPLIER + word
    pair = (pair ^ (pair >> U(32))) * SECOND
    return size, word, before, (pair ^ (pair >> U(29))) | U(1)


def _distinct(size: np.ndarray, word: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys that a block asks for; of each word, bigram and text with words its place among them."""
    return np.unique(np.concatenate([word, pair, np.full((size > 0).sum(), START)]), return_inverse=True)


def _asked(batches):
    """Rows by block, ids of the target before texts -> slices of (key, count, count in the target)."""
    for block, rows in _groups(batches):
        wanted = {r[2] for r in rows if not r[1]}
        docs = [r for r in rows if r[1]]
        size, word, _, pair = _tokens([r[3] for r in docs])
        keys, at = _distinct(size, word, pair)
        own = np.array([r[2] in wanted for r in docs], bool)
        of_word = np.repeat(own, size)
        n, t = np.bincount(at), np.bincount(at, np.concatenate([of_word, of_word, own[size > 0]])).astype(np.int64)
        if not len(keys):
            continue
        cuts = np.r_[np.searchsorted(keys // U((1 << 64) // SHARDS), np.arange(SHARDS, dtype=U)), len(keys)]
        shards = np.flatnonzero(cuts[1:] > cuts[:-1])
        steps = np.diff(keys, prepend=U(0))
        steps[cuts[shards]] = keys[cuts[shards]]
        cols = [pa.array([_packed(x[cuts[s] : cuts[s + 1]]) for s in shards], pa.binary()) for x in (steps, n, t)]
        yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array([block] * len(shards), pa.int64()), *cols], names=["shard", "block", "keys", "n", "target"])


def _answered(batches):
    """The asked slices with the totals of their keys; block -1 has the number of distinct words and of all words."""
    for shard, rows in _groups(batches):
        keys, at = np.unique(np.concatenate([np.cumsum(x, dtype=U) for x in _unpacked([r[2] for r in rows], U)]), return_inverse=True)
        totals = [np.bincount(at, np.concatenate(_unpacked([r[i] for r in rows], np.int64))).astype(np.int64) for i in (3, 4)]
        word = (keys & U(1) == 0) & (keys != START)
        cuts = np.cumsum([0, *(len(r[2]) // 8 for r in rows)])
        cols = [pa.array([_packed(x[at[lo:hi]]) for lo, hi in zip(cuts, cuts[1:])] + [_packed(np.array([word.sum(), x[word].sum()]))], pa.binary()) for x in totals]
        yield pa.RecordBatch.from_arrays([pa.array([*(r[1] for r in rows), -1], pa.int64()), pa.array([shard] * (len(rows) + 1), pa.int32()), *cols], names=["block", "shard", "n", "target"])


def losses(pair: np.ndarray, before: np.ndarray, word: np.ndarray, all_words: int, k: int, bigram: float = 0.7, unigram: float = 0.29) -> np.ndarray:
    """-log p(word | before) of words by the counts of their bigram, of the word before and of the word; smoothed as in smoothed()."""
    base = unigram * word / max(1, all_words) + (1 - bigram - unigram) / k
    return -np.log(np.where(before > 0, bigram * pair / np.maximum(before, 1) + base, base / (1 - bigram)))


def score_all(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score of every row, by models with every word and bigram."""
    scratch = Scratch(documents.sparkSession, "scores")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    blocks = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK
    docs = docs.withColumn("block", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(blocks)))
    wanted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    wanted = wanted.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), F.lit(0).alias("kind"), "doc_id", F.lit(None).cast("binary").alias("text"))
    marked = wanted.union(docs.select("block", F.lit(1), "doc_id", "text")).repartition("block").sortWithinPartitions("block", "kind")
    asked = marked.mapInArrow(_asked, "shard int, block long, keys binary, n binary, target binary")
    answers = scratch.keep(asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(_answered, "block long, shard int, n binary, target binary"))
    sums = [tuple(_unpacked([bytes(r.n), bytes(r.target)], np.int64)) for r in answers.where("block < 0").collect()]  # at most SHARDS rows
    k, n_all, n_target = max(1, sum(int(n[0]) for n, _ in sums)), sum(int(n[1]) for n, _ in sums), sum(int(t[1]) for _, t in sums)

    def run(batches):
        for _, rows in _groups(batches):
            told, docs = [r for r in rows if r[1] < SHARDS], [r for r in rows if r[1] == SHARDS]
            size, word, before, pair = _tokens([r[5] for r in docs])
            keys, at = _distinct(size, word, pair)
            m, of = len(word), np.repeat(np.arange(len(docs)), size)
            at_before = np.searchsorted(keys, before)
            means = []
            for column, total in ((3, n_target), (2, n_all)):
                counts = np.concatenate([*_unpacked([r[column] for r in told], np.int64), np.empty(0, np.int64)])
                if len(counts) != len(keys):
                    raise RuntimeError(f"{len(counts)} answers to {len(keys)} keys")
                loss = losses(counts[at[m : 2 * m]], counts[at_before], counts[at[:m]], total, k)
                means.append(np.bincount(of, loss, len(docs)) / np.maximum(size, 1))
            yield pa.RecordBatch.from_arrays([pa.array([r[4] for r in docs], pa.int64()), pa.array(size), *(pa.array(x, pa.float64(), mask=size == 0) for x in means)], names=["doc_id", "n_tokens", "target_loss", "background_loss"])

    none = lambda kind: F.lit(None).cast(kind)
    told = answers.where("block >= 0").select("block", "shard", "n", "target", none("long").alias("doc_id"), none("binary").alias("text"))
    both = told.union(docs.select("block", F.lit(SHARDS), none("binary"), none("binary"), "doc_id", "text")).repartition("block").sortWithinPartitions("block", "shard")
    out = both.mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def op8_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
