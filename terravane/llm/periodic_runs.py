"""Operator 13: periodic runs of words, found by probing harmonic grids.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), as long as it gets, of at least
LEAST words and REPEATS periods. A run of period p holds a grid point jp of its first period, and from there on all words equal those p
further, for one more period at least. So for each p the words at jp and (j + 1)p are compared, for all p that is a harmonic sum
of n log n probes, made in blocks of bounded size; what passes a few more probes is extended both ways in chunks. Grid points within a run
that has been found are skipped for its period's multiples, whose stretch is the same run.

Words are numbered within their text, so equality is exact. Null, empty and short texts have no runs and keep their words. Each row is a text of
its own: null and repeated doc_ids and repeated rows don't matter, and other columns are ignored. Rows stay where they are (no shuffle), and a
task holds one text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, texts, words_of

#: Words and periods of a run at least.
LEAST, REPEATS = 24, 3
#: Grid points that are probed at once, and words of the first and the longest chunk of an extension.
PROBES, CHUNK, LONGEST_CHUNK = 1 << 16, 64, 1 << 16
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Numbers that are equal where words are."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def _first_difference(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays of one length."""
    done, chunk = 0, CHUNK
    while done < len(a):
        differ = np.flatnonzero(a[done : done + chunk] != b[done : done + chunk])
        if len(differ):
            return done + int(differ[0])
        done, chunk = done + chunk, min(2 * chunk, LONGEST_CHUNK)
    return len(a)


def _stretch(ids: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """First word, and the one after the last, of the stretch of period p around the words at and at + p."""
    right = at + _first_difference(ids[at : len(ids) - p], ids[at + p :])
    left = at - _first_difference(ids[:at][::-1], ids[p : at + p][::-1])
    return left, right + p


def _blocks(n: int, most: int):
    """Ranges of periods whose grids have about PROBES points together, or one period."""
    low = 1
    while low <= most:
        high = low + 1
        points = n // low
        while high <= most and points + n // high <= PROBES:
            points += n // high
            high += 1
        yield low, high
        low = high


def find_runs(ids: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start and period; repeats is 3 or more."""
    n, found = len(ids), []
    for low, high in _blocks(n, n // repeats if n >= least else 0):
        p = np.arange(low, high)
        counts = (n - 1) // p
        per = np.repeat(p, counts)
        at = (np.arange(len(per)) - np.repeat(np.cumsum(counts) - counts, counts)) * per
        reach = np.maximum(least - 2 * per, per)  # so many words from the first grid point of a run on equal those a period further
        go = at + reach + per < n
        go[go] = ids[at[go]] == ids[at[go] + per[go]]
        per, at, reach = per[go], at[go], reach[go]
        for t in range(1, 17):
            if not len(per):
                break
            place = at + np.minimum(t if t % 2 else reach - t // 2, reach)
            go = ids[place] == ids[place + per]
            per, at, reach = per[go], at[go], reach[go]
        for start, length, q in found:
            if not len(per):
                break
            go = (per % q != 0) | (at < start) | (at + per >= start + length)
            per, at = per[go], at[go]
        while len(per):
            q = int(per[0])
            start, end = _stretch(ids, int(at[0]), q)
            go = (per != q) | (at + q >= end)
            if end - start >= max(least, repeats * q):
                found.append((start, end - start, q))
                go &= (per % q != 0) | (at < start) | (at + per >= end)
            go[0] = False
            per, at = per[go], at[go]
    return sorted((s, k, q) for s, k, q in found)


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Places of the words that no run holds after its first period."""
    mark = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        mark[start + period] += 1
        mark[start + length] -= 1
    return np.flatnonzero(np.cumsum(mark)[:n] == 0)


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, exactly; of those that tie the first, then that of the smallest period."""
    best = None
    for run in sorted(runs, key=lambda r: (r[0], r[2])):
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, n_words, runs by start and period, best (the strongest run or null) and collapsed (kept words joined by one space) of every row."""

    def search(batches):
        for batch, found in texts(batches, text="_text"):
            n_words, runs, best, kept = [], [], [], []
            for t in found:
                words = t.split() if t else []
                got = find_runs(numbered(words))
                n_words.append(len(words))
                runs.append([{"start": s, "length": k, "period": q} for s, k, q in got])
                top = strongest(got)
                best.append(top and dict(zip(("start", "length", "period"), top)))
                kept.append(b" ".join([words[i] for i in kept_words(len(words), got)] if got else words))
            one = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(one)), pa.array(best, one), pa.array(kept, pa.binary()).cast(pa.string())], names=["key", "n_words", "runs", "best", "collapsed"]
            )

    kind = dict(docs.dtypes)[key]
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("_text")).mapInArrow(search, f"key {kind}, n_words long, runs {RUNS}, best {RUNS[6:-1]}, collapsed string")
    return out.withColumnRenamed("key", key)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which a tenth of the documents, told by the crc32 of their ids, repeat a stretch of words from some place on to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, w = F.floor(h / 10), words_of(F.col("text"))
    n = F.size("_w")
    a = F.expr("_g % size(_w)")
    p = 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8))
    repeated = F.array_join(F.transform("_w", lambda x, i: F.when(i < F.col("_a"), x).otherwise(F.get("_w", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")))), " ")
    chosen = docs.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, w).otherwise(F.array().cast("array<string>")).alias("_w"))
    placed = chosen.withColumn("_a", F.when(n > 0, a)).withColumn("_p", p)
    return placed.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def brute_force(ids: list, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """Every run by its definition: the maximal stretches of each period, without those that have a smaller period; for tests."""
    n, found = len(ids), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


#: Pairs of equal words give, for each distance, islands of consecutive places: the maximal stretches of that period.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT rid, doc_id, ws, len(ws) AS n, CASE WHEN doc_id IS NOT NULL AND len(ws) > 0 THEN xor(4294967295, list_reduce(
        list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
        lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))) END AS h FROM d),
g AS (SELECT *, (h // 10) % n AS a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) AS q FROM h),
w AS (SELECT rid, doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(0, n), lambda i: ws[CAST(1 + CASE WHEN i < a THEN i ELSE a + (i - a) % q END AS BIGINT)]) ELSE ws END AS ws FROM g),
k AS (SELECT rid, n, unnest(range(0, n)) AS i, unnest(ws) AS word FROM w),
e AS (SELECT x.rid, x.i, y.i - x.i AS p FROM k x JOIN k y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
l AS (SELECT rid, p, min(i) AS s, max(i) + 1 + p AS t FROM (SELECT rid, p, i, i - row_number() OVER (PARTITION BY rid, p ORDER BY i) AS grp FROM e) GROUP BY rid, p, grp HAVING max(i) + 1 + p - min(i) >= greatest(24, 3 * p)),
r AS (SELECT rid, s AS start, t - s AS length, min(p) AS period FROM l GROUP BY rid, s, t),
b AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM r),
m AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
c AS (SELECT k.rid, string_agg(word, ' ' ORDER BY k.i) AS kept FROM k LEFT JOIN x ON x.rid = k.rid AND x.i = k.i WHERE x.i IS NULL GROUP BY k.rid)
SELECT w.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period, CAST(1000 * length // period AS BIGINT) AS exponent_milli,
       sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM w LEFT JOIN m USING (rid) LEFT JOIN c USING (rid) LEFT JOIN b ON b.rid = w.rid AND b.place = 1
"""
