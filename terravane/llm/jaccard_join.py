"""Operator 9: Jaccard self-join of shingle sets and its components, by a size-aware light/heavy scheme.

Two sets of sizes a <= b link when 100 * |A and B| >= percent * |A or B|; then 100a >= percent * b, they share at least
ceil(percent(a + b) / (100 + percent)) shingles and differ in at most floor((100 - percent)(a + b) / (100 + percent)). The query takes
shingles of SHINGLE words and PERCENT; the pipeline has its own.

Light sets (size up to a boundary): a set lists all its subsets of the size that a link with each possible partner size
needs. Two sets that list one subset are linked. Heavy sets: shingles have one order for the whole corpus, common ones last and else by
hash. Linked sets share a shingle among the first size - ceil(percent * size / 100) + 1 of either, so each set is put with its place
into the inverted lists of these shingles, and the lists are scanned. The boundary is the one that makes the fewest rows, by the numbers
of sets of each small size in the corpus, where a row of a list counts as LIST_WEIGHT of a subset, as it proves nothing.

1. A list of up to SMALL rows gives the pairs whose sizes and places allow a link; a longer one those of its leader alone. Pairs whose
   sketches (parities of shingle counts by hash, a lower bound on the difference) rule a link out go. Of the others one for each set
   is verified, then those whose sets aren't in one component by then.
2. Long lists whose sets are in several components yet are scanned for more: sets of different components whose sizes, places and
   sketches allow a link. They are cut into blocks of about LIST_BLOCK sets of a size class, a pair of blocks is one unit of work,
   and only sketches are sent. First a few drawn partners for each set are verified, in turns, then all that are in several components yet.
3. Pairs are verified exactly with the shingles of the whole texts; a set that is compared with many is dealt out with BLOCK of them at a time.

So no pairs within a long list are put out but those that can't be told apart by size, place, component and sketch, and every link between
different sets is found. Equal sets take part once. Which shingles count as common changes the cost only: counts by BUCKETS hash ranges,
put out by each task for ranges well above its mean. Sets are told apart by 64-bit hashes of shingles and of whole sets;
n different sets have a chance of n * n / 2^65 that two are taken for equal.

Null texts and texts without words have the empty set: n_shingles 0, component_id = doc_id. With fewer words than a shingle the whole
sequence is the one shingle. Rows that share a doc_id keep sets of their own and get the components of these. A null doc_id takes no part and gets the
component of an equal set, or null. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MULTIPLIER, SECOND, Scratch, components, hashes, likely, signed, table, texts, windows

SHINGLE, PERCENT = 4, 85
BLOCK = 256
SMALL = 64
#: Sets of a long list that are compared in one unit of work; a unit holds two times as many sketches at most.
LIST_BLOCK = 2048
#: A set is tried with so many others of a list in a turn, and turns end when they join nothing or after so many; then all that are apart yet are compared.
FEW, TURNS = 2, 2
BUCKETS_LOG = 20
LIST_WEIGHT = 4
#: Sizes among which the boundary is looked for.
MOST_LIGHT = 24
U = np.uint64
SETS = "doc_id long, n long, fp long, sketch binary, bucket int, often long"


def mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> U(30))) * U(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> U(27))) * U(0x94D049BB133111EB)
    return a ^ (a >> U(31))


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct word shingles, A-Z in lower case."""
    w = text.lower().split() if text else []
    return np.unique(windows(hashes(w), min(shingle, len(w)))) if w else np.empty(0, U)


def overlap(a, b, percent: int = PERCENT):
    return -(-percent * (a + b) // (100 + percent))


def apart(a, b, percent: int = PERCENT):
    return (100 - percent) * (a + b) // (100 + percent)


def partners(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def listed(n: int, percent: int = PERCENT) -> int:
    """Number of shingles of a heavy set whose lists it is put into."""
    return n - -(-percent * n // 100) + 1


def boundary(sizes: dict[int, int], percent: int = PERCENT) -> int:
    """The largest light size at the least cost; sizes: the number of sets of each size up to MOST_LIGHT * 100 / percent."""

    def cost(b: int) -> int:
        total = 0
        for n, sets in sizes.items():
            subsets = sum(math.comb(n, n - overlap(n, m, percent)) for m in partners(n, percent) if min(n, m) <= b)
            total += sets * (subsets + (LIST_WEIGHT * listed(n, percent) if n > b else 0))
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def light_keys(s: np.ndarray, light: int, percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """(least size of the two, hashes of the subsets) for each partner size at which a link is found by subsets."""
    n, out = len(s), []
    mixed = mix(s)
    total = mixed.sum(dtype=U)
    for m in partners(n, percent) if n * percent <= 100 * light else ():
        if min(n, m) <= light:
            tag = mix(np.array([(min(n, m) << 32) + max(n, m)], U))[0]
            left_out = n - overlap(n, m, percent)
            sums = np.array([sum(c) & 0xFFFFFFFFFFFFFFFF for c in itertools.combinations(mixed.tolist(), left_out)], U) if left_out else np.zeros(1, U)
            out.append((min(n, m), mix((total - sums) ^ tag)))
    return out


def heavy_keys(s: np.ndarray, light: int, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The set's first shingles in the corpus's order; common: which hash ranges come last."""
    if len(s) <= light:
        return s[:0]
    late = common[(s >> U(64 - BUCKETS_LOG)).astype(np.int64)]
    return np.concatenate([s[~late], s[late]])[: listed(len(s), percent)]


def fingerprint(s: np.ndarray) -> np.uint64:
    return mix(np.array([mix(s * MULTIPLIER + SECOND).sum(dtype=U) + U(len(s))], U))[0]


def sketch(s: np.ndarray) -> bytes:
    """Parities of the number of shingles in each of one to two times as many hash buckets; half as many are the exclusive or of both halves."""
    words = 1 << max(0, (len(s) - 1).bit_length() - 6)
    odd = np.bincount((mix(s) & U(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(batches, shingle: int):
    """(doc_id, n, fp, sketch) of every document, fp and sketch null for the empty set; then (bucket, often) of hash ranges with many shingles here."""
    counts = np.zeros(1 << BUCKETS_LOG, np.int64)
    for batch, found in texts(batches):
        s = [shingles(t, shingle) for t in found]
        if any(map(len, s)):
            np.add.at(counts, (np.concatenate(s) >> U(64 - BUCKETS_LOG)).astype(np.int64), 1)
        fp = [int(fingerprint(x).view(np.int64)) if len(x) else None for x in s]
        none = [None] * len(s)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array([len(x) for x in s], pa.int64()), pa.array(fp, pa.int64()), pa.array([sketch(x) if len(x) else None for x in s], pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.int64())], names=["doc_id", "n", "fp", "sketch", "bucket", "often"])
    many = np.flatnonzero(counts > 2 * (counts.mean() + np.sqrt(counts.mean()) + 1))
    none = pa.nulls(len(many), pa.int64())
    yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(many), pa.binary()), pa.array(many, pa.int32()), pa.array(counts[many])], names=["doc_id", "n", "fp", "sketch", "bucket", "often"])


def _lists(batches, shingle: int, percent: int, light: int, common: np.ndarray, most: int = 1_000_000):
    """(key, fp, info) of every set, those that are equal after all once in a task; info packs size, place, and of a subset's sizes the smaller (0 for the list of a shingle)."""
    seen: set[int] = set()
    for _, found in texts(batches):
        rows = []
        for t in found:
            s = shingles(t, shingle)
            if not len(s) or (fp := fingerprint(s)) in seen:
                continue
            seen.add(fp)
            of = [(keys, np.full(len(keys), least)) for least, keys in light_keys(s, light, percent)]
            keys = heavy_keys(s, light, common, percent)
            of.append((keys, np.arange(len(keys)) << 5))
            rows += [(keys, np.full(len(keys), fp, U), info + (len(s) << 32)) for keys, info in of if len(keys)]
        if len(seen) > most:
            seen.clear()
        cols = [np.concatenate(x) for x in zip(*rows)] if rows else [np.empty(0, U), np.empty(0, U), np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(signed(cols[0])), pa.array(signed(cols[1])), pa.array(cols[2])], names=["key", "fp", "info"])


def parts(info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size, place and least of a packed info."""
    return info >> 32, (info >> 5) & ((1 << 27) - 1), info & 31


#: What _scan puts out: a pair that may link, a row of a long list, a link.
PAIR, LONG, LINK = 0, 1, 2


def _scan(batches, percent: int, small: int):
    """Rows by key, with the leader (a, ainfo) and the length c of their list -> (kind, a, b, info, key)."""
    left = None
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if left is not None:
            cols = [np.concatenate(x) for x in zip(left, cols)]
        key, fp, info, a, ainfo, c = cols
        last = (key == key[-1]) & (c <= small) if len(key) else np.zeros(0, bool)
        left = [x[last] for x in cols]
        yield _scanned(*(x[~last] for x in cols), percent, small)
    if left is not None:
        yield _scanned(*left, percent, small)


def _scanned(key, fp, info, a, ainfo, c, percent, most):
    (n, place, least), (an, ap, _) = parts(info), parts(ainfo)
    out = []

    def put(kind, x, y, what=None, of=None):
        zeros = np.zeros(len(x), np.int64)
        out.append((np.full(len(x), kind, np.int32), x, y, zeros if what is None else what, zeros if of is None else of))

    at = np.flatnonzero((least > 0) & (an == least) & (a != fp))
    put(LINK, a[at], fp[at])
    at = np.flatnonzero((least == 0) & (c > most))
    put(LONG, fp[at], fp[at], info[at], key[at])
    at = at[(a[at] != fp[at]) & (np.minimum(n[at] - place[at], an[at] - ap[at]) >= overlap(n[at], an[at], percent))]
    pairs = [(np.minimum(a[at], fp[at]), np.maximum(a[at], fp[at]))]
    small = np.flatnonzero((least == 0) & (c <= most))
    i = np.arange(len(small))
    for d in range(1, len(small)):
        i = i[: np.searchsorted(i, len(small) - d)]
        i = i[key[small[i]] == key[small[i + d]]]
        if not len(i):
            break
        x, y = small[i], small[i + d]
        ok = (fp[x] != fp[y]) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= overlap(n[x], n[y], percent))
        pairs.append((np.minimum(fp[x], fp[y])[ok], np.maximum(fp[x], fp[y])[ok]))
    first, second = (np.concatenate(x) for x in zip(*pairs))
    if len(first):
        once = ~pd.MultiIndex.from_arrays([first, second]).duplicated()
        put(PAIR, first[once], second[once])
    cols = [np.concatenate(x) for x in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["kind", "a", "b", "info", "key"])


def _linked(batches, shingle: int, percent: int):
    """Rows sorted by (a, chunk, member), the set a first -> the links (a, fp) of a with members."""
    at, first = None, None
    for batch, found in texts(batches):
        a_, chunk, member, fp_ = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "chunk", "member", "fp"))
        out = []
        for a, c, is_member, fp, t in zip(a_, chunk, member, fp_, found):
            if (a, c) != at:
                at, first = (a, c), None
            s = shingles(t, shingle)
            if not len(s) or int(fingerprint(s).view(np.int64)) != fp:
                continue  # another text of the same doc_id
            if not is_member:
                first = s
            elif first is not None and len(np.intersect1d(first, s, assume_unique=True)) >= overlap(len(first), len(s), percent):
                out.append((a, fp))
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that link; members: fp and a doc_id of each."""
    counts = pairs.groupBy("a").agg(F.count("*").alias("c"))
    of = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / BLOCK)).cast("int").alias("chunk"), F.col("b").alias("fp"))
    needs = of.withColumn("member", F.lit(True)).union(of.select("a", "chunk", F.col("a").alias("fp")).distinct().withColumn("member", F.lit(False)))
    needs = scratch.keep(needs.join(members.select("fp", "doc_id"), "fp"))
    held = likely(docs, needs, "doc_id").join(needs, "doc_id").select("a", "chunk", "member", "fp", "text")
    return held.repartition("a", "chunk").sortWithinPartitions("a", "chunk", "member").mapInArrow(lambda batches: _linked(batches, shingle, percent), "a long, b long")


def fold(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches with `words` words or more, as if made with that many."""
    return np.array([np.bitwise_xor.reduce(np.frombuffer(x, np.uint64).reshape(-1, words), axis=0) for x in sketches])


def _close(batches, percent: int):
    """(a, b, n, m, s, t) of pairs with sizes and sketches -> those whose sketches allow a link."""
    for batch in batches:
        a, b, n, m, s, t = (c.to_pylist() for c in batch.columns)
        keep = []
        for i in range(len(a)):
            x, y = (s[i], t[i]) if len(s[i]) <= len(t[i]) else (t[i], s[i])
            both = fold([x, y], len(x) // 8)
            keep.append(int(np.bitwise_count(both[0] ^ both[1]).sum()) <= apart(n[i], m[i], percent))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def possible(n: np.ndarray, place: np.ndarray, label: np.ndarray, sketches: list[bytes], side: np.ndarray | None, every: bool, percent: int = PERCENT, turn: int = 0) -> list[tuple[int, int]]:
    """Of sets of one list, pairs that may link, of different labels and, if given, sides; without every, up to FEW for each set as the larger and as the
    smaller one, drawn by `turn` among all that may, so that a set that links with few doesn't take the others' only try."""
    order = np.argsort(n, kind="stable")
    n, place, label, raw = n[order], place[order], label[order], [sketches[i] for i in order]
    side = None if side is None else side[order]
    tries, folded, out, drawn = np.zeros(len(n), np.int64), {}, [], np.random.default_rng(turn)
    for i in range(len(n) - 1):
        j = np.arange(i + 1, np.searchsorted(n, 100 * n[i] // percent, "right"))
        j = j[(label[j] != label[i]) & (every | (tries[j] < FEW)) & (np.minimum(n[i] - place[i], n[j] - place[j]) >= overlap(n[i], n[j], percent))]
        if side is not None:
            j = j[side[j] != side[i]]
        if not len(j):
            continue
        w = len(raw[i]) // 8
        if w not in folded:  # sets from here on have as many words at least
            folded = {w: (i, fold(raw[i:], w))}
        start, bits = folded[w]
        j = j[np.bitwise_count(bits[j - start] ^ bits[i - start]).sum(1) <= apart(n[i], n[j], percent)]
        if not every:
            j = drawn.permutation(j)[:FEW]
            tries[j] += 1
        out += [(int(order[i]), int(order[x])) for x in j]
    return out


def _survivors(batches, every: bool, percent: int, turn: int = 0):
    """Rows sorted by unit -> (a, b) of the pairs of a unit that may link."""
    held, unit = [], None

    def pairs():
        if len(held) < 2:
            return []
        side, info, fp, label, bits = zip(*held)
        n, place, _ = parts(np.array(info))
        two = unit[1:3] != unit[3:5]
        return [tuple(sorted((fp[i], fp[j]))) for i, j in possible(n, place, np.array(label), bits, np.array(side) if two else None, every, percent, turn)]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:5] != unit:
                out += pairs()
                held, unit = [], row[:5]
            held.append(row[5:])
        yield packed(out)
    yield packed(pairs())


def _open(long: DataFrame, labels: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """The rows (key, fp, info) of lists with several labels, with their label and the length c of their list.

    Of a list's first and last label (one is that of its largest family as a rule) a row stays only if by sizes and places it may link with a
    row of another label: a link's larger set has no more than 100 / percent of the shingles that either has from the shared one on.
    """
    by_key = Window.partitionBy("key")
    rows = long.select("key", "fp", "info").join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    rows = rows.withColumns({"c": F.count("*").over(by_key), "lo": F.min("label").over(by_key), "hi": F.max("label").over(by_key)}).where("lo < hi")
    rows = rows.withColumns({"n": F.expr("info >> 32"), "left": F.expr(f"(info >> 32) - (info >> 5 & {(1 << 27) - 1})")})
    other = {}
    for x, of in (("lo", F.when(F.col("label") != F.col("lo"), True)), ("hi", F.when(F.col("label") != F.col("hi"), True)), ("any", F.lit(True))):
        other |= {f"n_{x}": F.min(F.when(of, F.col("n"))).over(by_key), f"left_{x}": F.max(F.when(of, F.col("left"))).over(by_key)}
    pick = lambda c: F.when(F.col("label") == F.col("lo"), F.col(f"{c}_lo")).when(F.col("label") == F.col("hi"), F.col(f"{c}_hi")).otherwise(F.col(f"{c}_any"))
    may = (100 * pick("left") >= percent * F.col("n")) & (100 * F.col("left") >= percent * pick("n"))
    return scratch.keep(rows.withColumns(other).where(may).select("key", "fp", "info", "label", "c"))


def _rest(rows: DataFrame, sets: DataFrame, every: bool, percent: int, turn: int = 0) -> DataFrame:
    """Pairs (a, b) of sets that share an open list, have different labels and may link."""
    one = rows.where(F.col("c") <= LIST_BLOCK).selectExpr("key", "0 as lc", "0 as bi", "0 as hc", "0 as bj", "0 as side", "info", "fp", "label")
    # a link's sizes are less than one class apart
    width = math.log(100 / percent) * 1.01
    of = rows.where(F.col("c") > LIST_BLOCK).withColumn("class", F.floor(F.log(F.shiftright("info", 32)) / width).cast("int"))
    blocks = of.groupBy("key", "class").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"))
    blocks = blocks.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("class", "blocks"))).alias("blocks"))  # an entry for each class, so a few dozen
    of = of.join(blocks, "key").withColumn("block", F.expr("cast(pmod(xxhash64(fp), blocks[class]) as int)"))
    units = F.expr(
        """concat(
          transform(sequence(0, blocks[class] - 1), j -> struct(class as lc, least(block, j) as bi, class as hc, greatest(block, j) as bj, if(block <= j, 0, 1) as side)),
          if(try_element_at(blocks, class + 1) is null, array(), transform(sequence(0, try_element_at(blocks, class + 1) - 1), j -> struct(class as lc, block as bi, class + 1 as hc, j as bj, 0 as side))),
          if(try_element_at(blocks, class - 1) is null, array(), transform(sequence(0, try_element_at(blocks, class - 1) - 1), j -> struct(class - 1 as lc, j as bi, class as hc, block as bj, 1 as side))))"""
    )
    many = of.select("key", F.explode(units).alias("u"), "info", "fp", "label").select("key", "u.lc", "u.bi", "u.hc", "u.bj", "u.side", "info", "fp", "label")
    work = one.union(many).join(_sketches(sets, rows.select("fp")), "fp").select("key", "lc", "bi", "hc", "bj", "side", "info", "fp", "label", "sketch")
    unit = ["key", "lc", "bi", "hc", "bj"]
    return work.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(lambda batches: _survivors(batches, every, percent, turn), "a long, b long").distinct()


def _sketches(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """fp, n and sketch of the wanted sets."""
    return likely(sets.select("fp", "n", "sketch"), wanted, "fp").groupBy("fp").agg(F.first("n").alias("m"), F.first("sketch").alias("sketch")).join(wanted.distinct(), "fp").select("fp", "m", "sketch")


def jaccard_components(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    scratch = Scratch(documents.sparkSession, "jaccard")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = scratch.keep(docs.mapInArrow(lambda batches: _sets(batches, shingle), SETS))
    sets = every.where("n is not null").select("doc_id", "n", "fp", "sketch")
    shares = every.agg(F.sum("n")).first()[0] or 0
    often = every.where("bucket is not null").groupBy("bucket").agg(F.sum("often").alias("often")).where(F.col("often") > 4 * shares / (1 << BUCKETS_LOG) + 16)
    common = np.zeros(1 << BUCKETS_LOG, bool)
    common[[r[0] for r in often.select("bucket").collect()]] = True  # at most a quarter of the ranges
    owners = scratch.keep(sets.where("doc_id is not null and fp is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.count("*").alias("c")))
    light = boundary(dict(owners.where(F.col("n") <= 100 * MOST_LIGHT // percent).groupBy("n").count().collect()), percent)

    # equal sets give lists once; a doc_id that has another set too stays, as it owns that one
    copies = sets.join(owners.where("c > 1").select("fp", F.col("doc_id").alias("own")), "fp").where("doc_id <> own").select("doc_id").distinct()
    copies = scratch.keep(copies.join(owners.select("doc_id"), "doc_id", "left_anti"))
    unsure = likely(docs, copies, "doc_id").join(copies.withColumn("copy", F.lit(True)), "doc_id", "left").where("copy is null")
    once = likely(docs, copies, "doc_id", False).where("doc_id is not null").select("text").union(unsure.select("text"))
    lists = once.mapInArrow(lambda batches: _lists(batches, shingle, percent, light, common), "key long, fp long, info long")
    by_key, small = Window.partitionBy("key"), SMALL
    lead = F.min(F.struct(F.expr("if(info & 31 > 0, info, 0)"), "fp", "info")).over(by_key)
    met = lists.select("*", lead.alias("lead"), F.max("fp").over(by_key).alias("x"), F.min("fp").over(by_key).alias("m"), F.count("*").over(by_key).alias("c")).where("m < x")
    met = scratch.keep(met.select("key", "fp", "info", "lead.fp", "lead.info", "c").toDF("key", "fp", "info", "a", "ainfo", "c").mapInArrow(lambda batches: _scan(batches, percent, small), "kind int, a long, b long, info long, key long"))

    def verified(pairs):
        return scratch.keep(_verified(pairs, owners, docs, scratch, shingle, percent))

    def joined(labels, links):
        return scratch.keep(components(labels.toDF("a", "b").union(links), scratch).toDF("fp", "label"))

    pairs = met.where(F.col("kind") == PAIR).select("a", "b").distinct()
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    sketches = scratch.keep(_sketches(sets, ends))
    close = pairs.join(sketches.toDF("a", "n", "s"), "a").join(sketches.toDF("b", "m", "t"), "b").select("a", "b", "n", "m", "s", "t")
    close = scratch.keep(close.mapInArrow(lambda batches: _close(batches, percent), "a long, b long"))
    first = close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = met.where(F.col("kind") == LINK).select("a", "b").distinct().union(verified(first))
    labels = joined(links.limit(0), links)

    def apart_yet(pairs):
        of = lambda c: labels.toDF(c, f"{c}_label")
        return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where("coalesce(a_label, a) <> coalesce(b_label, b)").select("a", "b")

    tested, more = first, scratch.keep(apart_yet(close).join(first, ["a", "b"], "left_anti"))
    long = met.where(F.col("kind") == LONG).select("key", F.col("a").alias("fp"), "info").distinct()
    turn, last = 0, False
    while True:
        if not more.isEmpty():
            tested, found = tested.union(more), verified(more)
            last = last or found.isEmpty()
            labels = joined(labels, found)
        elif turn:
            last = True
        if turn > TURNS:
            break
        turn = TURNS + 1 if last else turn + 1
        long = _open(long, labels, scratch, percent)
        more = scratch.keep(_rest(long, sets, turn > TURNS, percent, turn).join(tested, ["a", "b"], "left_anti"))

    # only sets with copies or links can have a component other than their doc_id
    linked = labels.union(labels.select("label", "label")).distinct()
    least = linked.join(owners, "fp").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    copied = owners.where("c > 1").select("fp", F.col("doc_id").alias("own"))
    copied = copied.union(sets.where("doc_id is null").select("fp").distinct().join(owners, "fp").select("fp", "doc_id")).distinct()
    of_set = scratch.keep(linked.join(least, "label").select("fp", "component_id").join(copied, "fp", "full").select("fp", F.coalesce("component_id", "own").alias("component_id")))
    return sets.join(of_set, "fp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]], shingle: int = SHINGLE, percent: int = PERCENT) -> dict[int, tuple[int, int]]:
    """All pairs, by what the contract says; for tests."""
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * min(len(sets[a]), len(sets[b])) >= percent * max(len(sets[a]), len(sets[b])):
            i = len(sets[a] & sets[b])
            if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.i >= 85 * (x.n + y.n - p.i)),
u(a, b) AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
