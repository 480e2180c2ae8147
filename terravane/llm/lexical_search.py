"""Operator 12: ranked lexical search by MaxScore in every shard of an inverted index.

1. index(): each task cuts its documents into shards of about SHARD_BYTES of text and writes one row for a shard: its documents
   with their lengths, its terms, and for each term its postings (place of the document, occurrences). Texts aren't shuffled; they are read once. A file
   holds one shard, as Parquet's writer and reader would hold up to a hundred such rows at once.
2. Totals over all shards: documents, terms, and the documents of each term that is asked for, summed in Spark.
3. Items are asked in blocks of a bounded number of bytes, each block against every shard. In a shard a term's upper bound is its weight times its highest
   impact. An item's terms are split by these bounds: those of lowest bound whose sum can't reach the score of the TOP-th best document so far are
   non-essential. Essential lists are added up whole, one after another; non-essential postings are probed only for
   documents that can still qualify.
4. The best of each shard are ranked for each item; a shard gives TOP rows at most, so that a ranking is exact and small.

All scores are 64-bit integers, so results don't depend on shards, order or partitions.

Null and empty texts and those without a term aren't documents of the collection. Rows with equal doc_ids are documents of their own; a null doc_id is ranked behind
others of equal score. Rows of one item_id make one item with the terms of all; null item_ids are an item as well; items without
a term, or without a hit, give no rows. Other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, numbers, release, table, texts

TOP = 10
#: Bytes of text of a shard, and bytes of the items of a block.
SHARD_BYTES, BLOCK_BYTES = 8 << 20, 4 << 20
#: The weights' unit, the saturation of repeated terms, and the share of the length in it.
UNIT, SCALE, FLAT, SLOPE = 1000, 1_000_000_000, 10, 90
SATURATION = 8
#: Bytes that end a term become spaces, A-Z become a-z; other bytes, those of all other characters included, stay.
FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SHARD = "doc_ids array<bigint>, lengths array<int>, terms array<binary>, starts array<int>, docs array<int>, tfs array<int>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class _Builder:
    """Gathers the postings of one shard."""

    def __init__(self):
        self.bytes, self.ids, self.doc_ids, self.lengths, self.parts = 0, {}, [], [], []

    def add(self, doc_id, text: bytes) -> None:
        counts = Counter(terms_of(text))
        if not counts:
            return
        known = self.ids
        t = np.fromiter((known.setdefault(w, len(known)) for w in counts), np.int32, len(counts))
        tf = np.fromiter(counts.values(), np.int32, len(counts))
        self.parts.append((t, np.full(len(t), len(self.doc_ids), np.int32), tf))
        self.doc_ids.append(doc_id)
        self.lengths.append(int(tf.sum()))
        self.bytes += len(text)

    def row(self) -> pa.RecordBatch:
        t, d, tf = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(t, kind="stable")  # documents of a term stay in order
        starts = np.r_[0, np.cumsum(np.bincount(t, minlength=len(self.ids)))].astype(np.int32)
        columns = [(self.doc_ids, pa.int64()), (self.lengths, pa.int32()), (list(self.ids), pa.binary()), (starts, pa.int32()), (d[order], pa.int32()), (tf[order], pa.int32())]
        arrays = [pa.array(v, k) for v, k in columns]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays], names=[c.split()[0] for c in SHARD.split(", ")])


def index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard; a shard is closed by the document that brings it to shard_bytes, and a partition's last one at its end."""

    def build(batches):
        shard = _Builder()
        for batch, found in texts(batches):
            for doc, text in zip(batch.column(0).to_pylist(), found):
                if text:
                    shard.add(doc, text)
                    if shard.bytes >= shard_bytes:
                        yield shard.row()
                        shard = _Builder()
        if shard.parts:
            yield shard.row()
        release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, SHARD)


def _items(rows: DataFrame) -> DataFrame:
    """item_id and its distinct terms."""

    def split(batches):
        for batch, found in texts(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(set(terms_of(t))) for t in found], pa.list_(pa.binary()))], names=["item_id", "terms"])

    cut = rows.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(split, "item_id long, terms array<binary>")
    return cut.groupBy("item_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")).where(F.size("terms") > 0)


def blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The items in lists of (item_id, terms) of about block_bytes each, which the driver holds one at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append((row.item_id, [bytes(t) for t in row.terms]))
        size += 40 + sum(len(t) + 40 for t in held[-1][1])
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _list(batch: pa.RecordBatch, name: str, row: int):
    return batch.column(batch.schema.get_field_index(name)).slice(row, 1).flatten()


def frequencies(shards: DataFrame, wanted: list[bytes]) -> dict[bytes, int]:
    """Documents of the whole collection that hold each of the wanted terms."""
    asked = sorted(wanted)

    def count(batches):
        here = pa.array(asked, pa.binary())
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                starts = _list(batch, "starts", i).to_numpy()
                at = pc.index_in(_list(batch, "terms", i), value_set=here)
                found = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                np.add.at(total, at.take(pa.array(found)).to_numpy(), np.diff(starts)[found])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["t", "n"])

    rows = shards.select("terms", "starts").mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()
    return {asked[r.t]: r.n for r in rows}


def weight(n_docs: int, df: int) -> int:
    return math.floor(UNIT * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best_of_shard(lists: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, n_docs: int, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the documents that may be among the top of the collection, from an item's lists (places, contributions to the score).

    ids are the documents' ids, by which equal scores are ordered. Of equal scores at the end all are kept until that order decides.
    """
    lists = sorted((x for x in lists if len(x[0])), key=lambda x: -int(x[1].max()))
    bounds = [int(x[1].max()) for x in lists]
    rest = [sum(bounds[i:]) for i in range(len(lists) + 1)]  # what the lists from i on can add at most
    score, limit, i = np.zeros(n_docs, np.int64), 0, 0

    def reached(some: np.ndarray) -> int:
        return int(np.partition(some, len(some) - top)[len(some) - top]) if len(some) >= top else 0

    # essential lists: a document in none of them can reach less than the limit
    while i < len(lists) and (rest[i] >= limit or not limit):
        score[lists[i][0]] += lists[i][1]
        i += 1
        limit = max(limit, reached(score))
    left = np.flatnonzero((score > 0) & (score + rest[i] >= limit))
    # non-essential lists are probed for the documents that can still qualify
    for j in range(i, len(lists)):
        places, add = lists[j]
        at = np.minimum(np.searchsorted(places, left), len(places) - 1)
        hit = places[at] == left
        score[left[hit]] += add[at[hit]]
        now = score[left]
        limit = max(limit, reached(now))
        left = left[now + rest[j + 1] >= limit]
    order = np.lexsort((ids[left], -score[left]))[:top]
    return left[order], score[left[order]]


#: Stands for a null doc_id among ids, which it follows.
NO_ID = np.iinfo(np.int64).max


def _search(shards: DataFrame, items: list[tuple], weights: dict[bytes, int], n_docs: int, n_terms: int, top: int) -> DataFrame:
    asked = sorted(weights)
    number = {t: i for i, t in enumerate(asked)}
    wanted = [(item, [number[t] for t in terms if t in number]) for item, terms in items]
    w = np.array([weights[t] for t in asked], np.int64)

    def search(batches):
        here = pa.array(asked, pa.binary())
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, lengths, starts, docs, tfs = (_list(batch, c, i) for c in ("doc_ids", "lengths", "starts", "docs", "tfs"))
                ids = doc_ids.fill_null(NO_ID).to_numpy()
                m = UNIT // 10 - SLOPE + (SLOPE * lengths.to_numpy().astype(np.int64) * n_docs) // n_terms
                starts, docs, tfs = starts.to_numpy(), docs.to_numpy(), tfs.to_numpy()
                known = pc.index_in(here, value_set=_list(batch, "terms", i)).fill_null(-1).to_numpy()
                lists: list = [(docs[:0], docs[:0])] * len(asked)
                for t in np.flatnonzero(known >= 0).tolist():
                    a, b = starts[known[t]], starts[known[t] + 1]
                    tf = tfs[a:b].astype(np.int64)
                    lists[t] = docs[a:b], w[t] * ((SCALE * tf) // (UNIT * tf + SATURATION * m[docs[a:b]]))
                out = []
                for item, terms in wanted:
                    at, score = best_of_shard([lists[t] for t in terms], ids, len(ids), top)
                    if len(at):
                        out.append((item, at, score))
                if out:
                    at = np.concatenate([x[1] for x in out])
                    items_ = pa.array([x[0] for x in out for _ in x[1]], pa.int64())
                    yield pa.RecordBatch.from_arrays([items_, doc_ids.take(pa.array(at)), pa.array(np.concatenate([x[2] for x in out]))], names=["item_id", "doc_id", "score"])
        release()

    return shards.mapInArrow(search, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the top documents of each item with a score above 0."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    shards = scratch.keep(index(docs, shard_bytes), per_file=1)
    held = shards.agg(F.sum(F.size("doc_ids")), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x))).first()
    hits = None
    for block in blocks(_items(items), block_bytes) if held[0] else ():
        found = frequencies(shards, sorted({t for _, terms in block for t in terms}))
        weights = {t: x for t, df in found.items() if (x := weight(held[0], df)) > 0}
        part = _search(shards, block, weights, held[0], held[1], top)
        hits = part if hits is None else hits.union(part)
    if hits is None:
        hits = spark.createDataFrame([], "item_id long, doc_id long, score long")
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def op12_lexical_search(spark, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple], items: list[tuple], top: int = TOP) -> list[tuple]:
    """(item_id, rank, doc_id, score) from every document's score for every item; for tests."""
    counted = [(doc, Counter(terms_of(text.encode()))) for doc, text in docs if text]
    counted = [(doc, c) for doc, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    asked: dict = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of((text or "").encode()))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, c in counted:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(weight(n, df[t]) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc, s))
        out += [(item, k, doc, s) for k, (_, _, doc, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top], 1)]
    return out


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
d AS (SELECT rid, doc_id, ws, CAST(len(ws) AS BIGINT) AS n FROM t WHERE len(ws) > 0),
z AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
m AS (SELECT rid, doc_id, 100 - 90 + (90 * n * nn) // ll AS m FROM d, z),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), z),
s AS (SELECT item_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score, any_value(doc_id) AS doc_id FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (rid) GROUP BY item_id, rid),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
