"""Operator 4: benchmark decontamination by template canonicalisation.

Words lose outer punctuation and case; numbers, names (words that start with a capital) and units become typed placeholders, so that
a question whose numbers, names or units were changed has the same template. Windows of `window` template words of every
document are joined by hash with the windows of the benchmark. Hits are compared word by word, put together by item and
shift, and their slots are checked: within a shift, an item's slot value must always stand for the same value in the document and two
different ones for different ones; words of slots that break this don't count. A pair is a leak if the words so covered are
at least `share` of the item's words or a run of at least `run` words.

Every item with a word can match. Its windows are:
* templates of `window` words (of the whole item, if it is shorter) with at least `literal` words that aren't placeholders;
* where a window has fewer, the same words verbatim (but for case and outer punctuation), and the template of a longer window around them
  with `literal` such words, or of the whole item if that has at least 2 of them and `least` words, so that a changed item is found too.
Items of fewer than `least` words may be common phrases; they are reported wherever they stand verbatim, as all leaks with the number of documents that
hold the item, so that the caller can choose. A share of all documents may be given (`usual`) beyond which such items don't count; by default none is.

Documents give only windows whose hash is in a bitmap of the benchmark's, which has a fixed size; these are joined with the
benchmark's windows, which Spark sends to all tasks if their measured size allows and shuffles otherwise, and judged by document and item. Nothing of either
table is gathered but the lengths of windows.

Null and empty texts match nothing, as do empty tables and items without an id. Repeated rows of either table change nothing; rows that share an id
but not the text count each, and give a pair of the ids once. A null doc_id makes pairs with a null doc_id. Other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import defaultdict
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULTIPLIER, SECOND, Scratch, fresh, signed, table, texts

U = np.uint64
#: Words for units.
UNITS = frozenset(
    b"mm cm m km in ft yd mi mg g kg t lb lbs oz ml l gal s sec min h hr hrs ms hz khz mhz w kw kwh j kj cal kcal v a k c f pa bar "
    b"percent % meter meters metre metres kilometer kilometers gram grams kilogram kilograms liter liters litre litres second seconds "
    b"minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros mile miles foot feet inch inches".split()
)
EDGE = b".,;:!?\"'()[]{}<>*#$&|"
DIGITS = frozenset(b"%c" % c for c in b"+-$0123456789")
NUMBER = re.compile(rb"[+-]?[$]?\d[\d.,/:]*%?")
PLACEHOLDERS = {"number": 0x1111111111111111, "name": 0x2222222222222222, "unit": 0x3333333333333333}
SLOTS = frozenset(PLACEHOLDERS.values())
#: Lengths of longer windows, as multiples of 4 that grow by about a third.
STEPS = (12, 16, 20, 28, 36, 48, 64, 84, 112, 148)
BITS = 24
_BACK = U(pow(int(MULTIPLIER), -1, 1 << 64))


def template(bare: bytes) -> int:
    """The hash of a word without outer punctuation, or of its placeholder."""
    head, low = bare[:1], bare.lower()
    if head in DIGITS and NUMBER.fullmatch(bare):
        return PLACEHOLDERS["number"]
    if low in UNITS:
        return PLACEHOLDERS["unit"]
    if low[:1] != head or (head == b"\xc3" and b"\x80" <= bare[1:2] <= b"\x9e"):
        return PLACEHOLDERS["name"]
    return _hashed(low)


def _hashed(word: bytes) -> int:
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little")


class Vocabulary(dict):
    """Word -> place in the lists of template and verbatim hashes; kept for later texts, and emptied when it has grown to `most` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most, self.hashes = most, (array("Q"), array("Q"))

    def __missing__(self, word: bytes) -> int:
        bare = word.strip(EDGE)
        self.hashes[0].append(template(bare))
        self.hashes[1].append(_hashed(bare.lower()))
        self[word] = out = len(self)
        return out

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Template and verbatim hashes of the words."""
        if len(self) >= self.most:
            self.clear()
            self.hashes = (array("Q"), array("Q"))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return tuple(np.array(np.frombuffer(h, U)[at]) if len(words) else np.empty(0, U) for h in self.hashes)


@functools.lru_cache(4)
def _powers(log: int) -> tuple[np.ndarray, np.ndarray]:
    out = [np.full(1 << log, x) for x in (MULTIPLIER, _BACK)]
    for x in out:
        x[0] = 1
        np.cumprod(x, out=x)
    return tuple(out)


class Runs:
    """Hashes of all runs of any length of a sequence of word hashes, by sums of their products with falling powers."""

    def __init__(self, h: np.ndarray):
        self.power, back = _powers(len(h).bit_length())
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(h * back[: len(h)], dtype=U)])

    def of(self, k: int, exact: bool) -> np.ndarray:
        n = len(self.sums) - k
        if n <= 0 or k < 1:
            return np.empty(0, U)
        out = (self.sums[k:] - self.sums[:n]) * self.power[k - 1 : n + k - 1] + U((2 * k + exact) * int(SECOND) % (1 << 64))
        out ^= out >> U(29)
        return out * MULTIPLIER


def item_windows(literals: np.ndarray, window: int, literal: int, least: int) -> set[tuple[bool, int, int]]:
    """(exact, place, length) of the windows of an item; literals: which of its words aren't placeholders."""
    n, out = len(literals), set()
    before = np.concatenate([[0], np.cumsum(literals)])
    count = lambda p, k: int(before[p + k] - before[p])
    k = min(window, n)
    for p in range(n - k + 1):
        if count(p, k) >= min(literal, k):
            out.add((False, p, k))
            continue
        out.add((True, p, k))
        for longer in [x for x in STEPS if k < x < n] + [n]:
            at = max(0, min(p, n - longer))
            if count(at, longer) >= (literal if longer < n or n >= literal and before[n] >= literal else 2) and longer >= least:
                out.add((False, at, longer))
                break
    return out


def _benchmark(batches, window: int, literal: int, least: int):
    """(item_id, ih, text) -> (h, exact, k, item_id, ih, q, size, own): the windows of each item with their words."""
    known = Vocabulary()
    names = ["h", "exact", "k", "item_id", "ih", "q", "size", "own"]
    kinds = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    for batch, found in texts(batches):
        out = []
        for item, ih, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found):
            words = t.split()
            hashes = known.of(words)
            runs = [Runs(h) for h in hashes]
            bare = [w.strip(EDGE) for w in words]
            for exact, q, k in sorted(item_windows(np.array([int(h) not in SLOTS for h in hashes[0]], bool), window, literal, least)) if words else ():
                h = runs[exact].of(k, exact)[q]
                out.append((int(h.view(np.int64)), exact, k, item, ih, q, len(words), b" ".join(bare[q : q + k])))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=names)


def _looked_up(batches, lengths: list[tuple[bool, int]], bits: np.ndarray, least: int):
    """Documents -> (h, doc_id, th, place, met): their windows whose hash may be in the benchmark; of short ones the first of each hash."""
    known = Vocabulary()
    for batch, found in texts(batches):
        docs, marks = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("th")).to_pylist()
        out = []
        for doc, th, t in zip(docs, marks, found):
            words = t.split() if t else []
            if not words:
                continue
            runs = [Runs(h) for h in known.of(words)]
            for exact, k in lengths:
                h = runs[exact].of(k, exact)
                slot = (h >> U(64 - BITS)).astype(np.int64)
                at = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(U)) & U(1))
                if k < least and len(at):
                    at = at[np.sort(np.unique(h[at], return_index=True)[1])]
                out += [(x, doc, th, p, b" ".join(w.strip(EDGE) for w in words[p : p + k])) for x, p in zip(signed(h[at]).tolist(), at.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["h", "doc_id", "th", "place", "met"])


def leak(hits: list[tuple[int, int, bytes, bytes]], size: int, share: float, run: int) -> tuple[int, bool] | None:
    """(words covered, whether all slots are as in the item) if the hits (shift, place in the item, item's words, document's words) are a leak."""
    by_shift: dict[int, dict[int, tuple[bytes, bytes]]] = defaultdict(dict)
    for shift, q, own, met in hits:
        by_shift[shift].update((q + i, pair) for i, pair in enumerate(zip(own.split(b" "), met.split(b" "))))
    covered, longest, same = set(), 0, True
    for _, at in sorted(by_shift.items()):
        good, to, back = [], {}, {}
        for q, (a, b) in sorted(at.items()):
            kind, of_b, a, b = template(a), template(b), a.lower(), b.lower()
            if a != b and (kind not in SLOTS or of_b != kind):
                continue
            if kind in SLOTS:
                if to.setdefault(a, b) != b or back.setdefault(b, a) != a:
                    continue
                same &= a == b
            good.append(q)
        covered.update(good)
        if good:
            ends = np.flatnonzero(np.diff(good, append=size + 9) > 1)
            longest = max(longest, int(np.diff(ends, prepend=-1).max()))
    return (len(covered), same) if covered and (len(covered) >= share * size or longest >= run) else None


def _judged(batches, share: float, run: int):
    """Hits sorted by document and item -> the leaks."""
    held, at = [], None

    def found():
        got = leak([h[5:9] for h in held], held[0][4], share, run) if held else None
        return [(at[0], at[2], got[0], held[0][4], got[1])] if got else []

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))], names=["doc_id", "item_id", "n_covered", "n_item_words", "verbatim"])

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:4] != at:
                out += found()
                held, at = [], row[:4]
            held.append(row)
        yield packed(out)
    yield packed(found())


PAIRS = "doc_id long, item_id long, n_covered long, n_item_words long, verbatim boolean"
#: Words of an item from which on its leaks cost a document its place; shorter phrases are in too many clean texts.
SHORTEST = 3


def contaminated_pairs(documents: DataFrame, benchmark: DataFrame, window: int = 8, literal: int = 5, least: int = 5, share: float = 0.5, run: int = 13, usual: float | None = None) -> DataFrame:
    """doc_id, item_id, n_covered, n_item_words, verbatim (no slot was changed, but for case) of each leak, and n_documents that hold the item."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "leaks")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    items = items.select("item_id", F.xxhash64("text").alias("ih"), "text")
    items = scratch.keep(items.mapInArrow(lambda batches: _benchmark(batches, window, literal, least), "h long, exact boolean, k int, item_id long, ih long, q int, size int, own binary"))
    lengths = sorted((r[0], r[1]) for r in items.select("exact", "k").distinct().collect())  # of windows: two dozen at most, and those of items below the longest of STEPS
    if not lengths:
        return spark.createDataFrame([], PAIRS + ", n_documents long")
    slot = F.shiftrightunsigned("h", 64 - BITS)
    words = items.select(F.shiftright(slot, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITS}) & 63 as int))").alias("bit"))
    bits = np.zeros(1 << (BITS - 6), U)
    for word, bit in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).collect():  # as many longs as the bitmap has, whatever the benchmark
        bits[word] = bit & 0xFFFFFFFFFFFFFFFF

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").where("text is not null")
    met = docs.mapInArrow(lambda batches: _looked_up(batches, lengths, bits, least), "h long, doc_id long, th long, place int, met binary")
    hits = met.join(items, "h").select("doc_id", "th", "item_id", "ih", "size", (F.col("place") - F.col("q")).alias("shift"), "q", "own", "met")
    group = ["doc_id", "th", "item_id", "ih"]
    pairs = hits.repartition(*group).sortWithinPartitions(*group).mapInArrow(lambda batches: _judged(batches, share, run), PAIRS).distinct()
    pairs = scratch.keep(pairs)
    held = pairs.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("n_documents"))
    counted = pairs.join(held, F.col("item_id") == F.col("_item")).drop("_item")
    if usual is None:
        return counted
    return counted.where((F.col("n_item_words") >= least) | (F.col("n_documents") <= max(1, int(usual * documents.count()))))


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 8, literal: int = 5, least: int = 5, share: float = 0.5, run: int = 13, usual: float | None = None, shortest: int = SHORTEST) -> DataFrame:
    """The documents, with all their columns, whose doc_id has no leak of an item of `shortest` words or more (a null doc_id stands for all documents without one)."""
    leaked = fresh(documents, "leaked")
    found = contaminated_pairs(documents, benchmark, window, literal, least, share, run, usual).where(F.col("n_item_words") >= shortest)
    # written first, so that Spark knows its size and needn't shuffle the documents if it is small
    found = Scratch(documents.sparkSession, "leaked").keep(found.select(F.col("doc_id").alias(leaked)).distinct())
    return documents.join(found, F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
