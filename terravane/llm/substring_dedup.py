"""Operator 2: removal of repeated word passages, found by difference-cover anchors.

A word goes if a window of WINDOW consecutive words that covers it also starts earlier (in a document of
smaller doc_id, or earlier in the same one). Two equal windows at places i and j share, for some k < PERIOD,
the places i + k and j + k that both lie in the cover modulo PERIOD, so hashes of ANCHOR words at cover places
find every match: only windows around an anchor that occurs twice are hashed whole (96 bits) and compared.

1. Documents whose text is an exact copy of one with a smaller id lose all they can lose; they take no further part.
2. Each document gives its distinct anchors; those in two documents go back to their documents. Repeats inside a
   document need no shuffle.
3. Each document extends its repeated anchors to whole windows and gives the distinct ones with their first place.
4. A window is earlier in the smallest document that has it; the places in other documents go back to them.

The shuffles carry hashes and places; one shuffle of texts by document is used three times. No group is
gathered: groups are counted with sorted windows that spill. A document's own lists are as long as its text.

Null and empty texts have no words. doc_id should be unique and not null; rows with a null doc_id are
returned and lose only what they repeat themselves, and rows that share a doc_id count as one document of each text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SECOND, hashes, numbers, signed, table, texts, windows

WINDOW = 20
#: A perfect difference cover: each difference modulo 13 occurs.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1


def _anchor_places(n: int) -> np.ndarray:
    """Cover places at which an anchor of a text of n words can start."""
    at = np.arange(max(0, n - ANCHOR + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _distinct_anchors(batches):
    for batch, found in texts(batches):
        docs, out = numbers(batch, "doc_id"), []
        for doc, t in zip(docs, found):
            w = t.split() if t else []
            if len(w) >= WINDOW:
                out.append((doc, np.unique(windows(hashes(w), ANCHOR)[_anchor_places(len(w))])))
        yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([a for _, a in out])) if out else [], pa.int64()), pa.array(np.repeat([d for d, _ in out], [len(a) for _, a in out]) if out else [], pa.int64())], names=["h", "doc_id"])


def candidate_windows(h: np.ndarray, elsewhere: np.ndarray) -> np.ndarray:
    """Starts of the windows around an anchor that occurs in another document or twice in this one."""
    n = len(h)
    at = _anchor_places(n)
    a = windows(h, ANCHOR)[at]
    _, back, count = np.unique(a, return_inverse=True, return_counts=True)
    hit = at[(count[back] > 1) | np.isin(a, elsewhere)]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, np.maximum(hit - (WINDOW - ANCHOR), 0), 1)
    np.add.at(mark, np.minimum(hit + 1, n), -1)
    return np.flatnonzero(np.cumsum(mark)[: max(0, n - WINDOW + 1)])


def _distinct_windows(batches):
    """(h, c, doc_id, place): the first place of each distinct candidate window of a document."""
    for batch, found in texts(batches):
        docs, known, out = numbers(batch, "doc_id"), batch.column(batch.schema.get_field_index("hs")).to_pylist(), []
        for doc, t, hs in zip(docs, found, known):
            w = t.split() if t else []
            if len(w) < WINDOW:
                continue
            h = hashes(w)
            at = candidate_windows(h, np.array(hs or [], np.int64).view(np.uint64))
            if not len(at):
                continue
            key = windows(h, WINDOW)[at]
            key, first = np.unique(key, return_index=True)
            place = at[first]
            check = (windows(h, WINDOW, SECOND)[place] >> np.uint64(32)).astype(np.uint32).view(np.int32)
            out.append((np.full(len(place), doc), signed(key), check, place.astype(np.int32)))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[3], pa.int32())], names=["h", "c", "doc_id", "place"])


def removed_words(words: list[bytes], elsewhere: np.ndarray) -> np.ndarray:
    """Which words of a document go, given the first places of its windows that a smaller document has."""
    n = len(words)
    if n < WINDOW:
        return np.zeros(n, bool)
    key = windows(hashes(words), WINDOW)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    late = first[back] != np.arange(len(key))  # starts earlier in this document
    gone = np.zeros(len(first), bool)
    gone[back[elsewhere]] = True
    late |= gone[back]
    mark = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(late)
    mark[at] += 1
    np.add.at(mark, at + WINDOW, -1)
    return np.cumsum(mark)[:n] > 0


def _verdicts(batches):
    """The words of every document, kept or not; with_text: the kept words themselves."""
    for batch, found in texts(batches):
        places, copies = batch.column(batch.schema.get_field_index("places")).to_pylist(), batch.column(batch.schema.get_field_index("copy")).to_pylist()
        n_words, n_removed, kept_text = [], [], []
        for t, at, copy in zip(found, places, copies):
            w = t.split() if t else []
            gone = np.ones(len(w), bool) if copy and len(w) >= WINDOW else removed_words(w, np.array(sorted(at or []), int))
            n_words.append(len(w))
            n_removed.append(int(gone.sum()))
            kept_text.append(b" ".join(w if not gone.any() else [x for x, g in zip(w, gone) if not g]))
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_text, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])


def _by_document(replies: DataFrame) -> DataFrame:
    """Sends replies to their documents as plain rows, sorted first, as neighbours with the same doc_id compress."""
    return replies.sortWithinPartitions("doc_id").repartition("doc_id")


def substring_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) of every document."""
    every = documents.select("doc_id", "text")  # an alias here would give the shuffle of texts two forms
    if dict(every.dtypes)["doc_id"] != "bigint":
        every = every.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.where("doc_id is not null")  # stated once, so that all three uses share one shuffle of the texts
    same = Window.partitionBy("a", "b")
    copies = (
        docs.select("doc_id", F.xxhash64("text").alias("a"), F.xxhash64(F.lit("second"), F.col("text"), F.char_length("text")).alias("b"))
        .select("doc_id", F.min("doc_id").over(same).alias("owner"))
        .where("owner < doc_id")
        .select("doc_id", F.lit(True).alias("copy"))
        .distinct()
    )
    base = docs.join(copies, "doc_id", "left")
    own = base.where("copy is null").select("doc_id", "text")
    anchors = own.mapInArrow(_distinct_anchors, "h long, doc_id long")
    repeated = anchors.select("h", "doc_id", F.count("*").over(Window.partitionBy("h")).alias("n")).where("n > 1").select("doc_id", "h")
    repeated = _by_document(repeated).groupBy("doc_id").agg(F.collect_list("h").alias("hs"))
    found = own.join(repeated, "doc_id", "left").select("doc_id", "text", "hs").mapInArrow(_distinct_windows, "h long, c int, doc_id long, place int")
    late = found.select("doc_id", "place", F.min("doc_id").over(Window.partitionBy("h", "c")).alias("owner")).where("owner < doc_id").select("doc_id", "place")
    late = _by_document(late).groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    judged = base.join(late, "doc_id", "left").select("doc_id", "text", "copy", "places")
    without_id = every.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("boolean").alias("copy"), F.lit(None).cast("array<int>").alias("places"))
    return judged.union(without_id).mapInArrow(_verdicts, "doc_id long, n_words long, n_removed long, kept_text string")


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    """What the contract says, window by window; for tests."""
    seen: set[tuple] = set()
    out = {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - WINDOW + 1):
            key = tuple(w[i : i + WINDOW])
            if key in seen:
                gone[i : i + WINDOW] = [True] * WINDOW
            seen.add(key)
        out[doc] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS i, unnest(list_transform(range(1, len(ws) - 18), lambda i: md5(array_to_string(ws[i:i + 19], ' ')))) AS h FROM d WHERE len(ws) >= 20),
l AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS rn FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM l WHERE rn > 1),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
r AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
t AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.p) AS kept FROM w LEFT JOIN g ON g.doc_id = w.doc_id AND g.p = w.p WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t.kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)
"""
