"""Operator 3: sampled SentencePiece segmentations and lossless decoding.

The pieces of a public model (never trained here) span a lattice over each text. A piece weighs
(rank + 2) ** -alpha by its place among the model's merges; the forward pass sums the weights of all ways to each
place, the backward pass draws one way from the end. No piece crosses from text into a space or over a line end, so the
lattice falls into parts (leading spaces and what follows them) that are drawn independently. Forward sums are
computed once for each distinct part of a chunk of rows, draws once for each occurrence, all in arrays.

A draw's random numbers are a hash of seed, row key, the part's place in the row and the step: a row's pieces depend on
its key and text alone. Characters without a piece become byte pieces. A space is put before each text, and taken off by decoding, so
decode(encode(t)) = t for every text, with any white space or the model's own space sign in it.

A null text gives null ids and decodes to null; an empty text gives no ids. Repeated rows (same key and text)
give equal ids. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MULTIPLIER, SECOND, table, texts
from .jaccard_join import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
PART = re.compile(rb" *[^ \n]+| *\n| +")
U = np.uint64
TABLE_BITS = 20


class Pieces:
    """The model's pieces as arrays: their bytes, weights, and a table from hashes of their characters."""

    def __init__(self, pieces: list[tuple[str, float, int]], alpha: float):
        """pieces: (text, score, kind), kind 0 a piece, 1 a byte, 2 a sign that stands for no text."""
        raw = [bytes([int(p[3:5], 16)]) if kind == 1 else b"" if kind == 2 else p.replace("▁", " ").encode() for p, _, kind in pieces]
        self.raw = b"".join(raw)
        self.size = np.array([len(r) for r in raw])
        self.at = np.r_[0, np.cumsum(self.size)[:-1]]
        self.byte = np.zeros(256, np.int64)
        for i, (p, _, kind) in enumerate(pieces):
            if kind == 1:
                self.byte[int(p[3:5], 16)] = i
        plain = [i for i, p in enumerate(pieces) if p[2] == 0]
        order = sorted(plain, key=lambda i: -pieces[i][1])
        self.weight = np.zeros(len(pieces))
        self.weight[order] = -alpha * np.log(np.arange(len(order)) + 2.0)
        self.byte_weight = -alpha * np.log(len(order) + 2.0)
        self.longest = max(len(pieces[i][0]) for i in plain)
        self.table = np.full(1 << TABLE_BITS, -1, np.int32)
        self.hash = np.zeros(len(pieces), U)
        rest: dict[int, int] = {}
        for i in plain:
            h = 0
            for c in pieces[i][0].replace("▁", " "):
                h = (h * int(MULTIPLIER) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            self.hash[i] = h
            slot = int(self._slot(np.array([h], U))[0])
            if self.table[slot] < 0:
                self.table[slot] = i
            else:
                rest[h] = i
        self.rest_hash = np.array(sorted(rest), U)
        self.rest_id = np.array([rest[int(h)] for h in self.rest_hash], np.int32)

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h * SECOND) >> U(64 - TABLE_BITS)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece of each hash, or -1."""
        got = self.table[self._slot(h)]
        m = np.flatnonzero((got >= 0) & (self.hash[got] != h))  # another piece has the slot
        if len(m) and len(self.rest_hash):
            k = np.minimum(np.searchsorted(self.rest_hash, h[m]), len(self.rest_hash) - 1)
            got[m] = np.where(self.rest_hash[k] == h[m], self.rest_id[k], -1)
        else:
            got[m] = -1
        return got

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, without the space that was put before them."""
        size = self.size[ids]
        ends = np.cumsum(size)
        place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(self.at[ids], size)
        return np.frombuffer(self.raw, np.uint8)[place].tobytes()[1:]


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(m.id_to_piece(i), m.get_score(i), 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0) for i in range(m.get_piece_size())]


@functools.lru_cache(2)
def _loaded(pieces: tuple, alpha: float) -> Pieces:
    return Pieces(list(pieces), alpha)


class Lattice:
    """Forward sums over the lattices of distinct parts: for each place, its incoming pieces and their chances."""

    def __init__(self, parts: list[bytes], p: Pieces):
        chars = [x.decode("utf-8", "replace") for x in parts]
        size = np.array([len(c) for c in chars])
        c = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
        n = len(c)
        # a node before each character and one after the last of each part
        part_of = np.repeat(np.arange(len(parts)), size)
        node = np.arange(n) + part_of
        place = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(size, size) - place
        self.first = np.cumsum(size + 1) - (size + 1)
        self.last = self.first + size
        starts, lengths, ids = [], [], []
        h, live = np.zeros(n, U), np.arange(n)
        single = np.full(n, -1)
        for length in range(1, p.longest + 1):
            live = live[left[live] >= length]
            if not len(live):
                break
            h[live] = h[live] * MULTIPLIER + c[live + (length - 1)] + U(1)
            got = p.find(h[live])
            if length == 1:
                single = got
            hit = got >= 0
            starts.append(live[hit])
            lengths.append(np.full(int(hit.sum()), length))
            ids.append(got[hit])
        none = np.flatnonzero(single < 0)
        starts.append(none)
        lengths.append(np.ones(len(none), int))
        ids.append(-1 - c[none].astype(np.int64))  # a character that is spelt in bytes
        start, length, piece = (np.concatenate(x) for x in (starts, lengths, ids))
        spelt = piece < 0
        weight = np.where(spelt, 0, p.weight[np.where(spelt, 0, piece)])
        code = -1 - piece[spelt]
        weight[spelt] = p.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        end = node[start] + length
        step = place[start] + length
        order = np.lexsort((piece, end, step))
        self.start, self.piece, end, step, weight = node[start][order], piece[order], end[order], step[order], weight[order]
        total = n + len(parts)
        forward = np.zeros(total)
        self.edge = np.zeros(total + 1, np.int64)
        self.chance = np.zeros(len(end))
        bounds = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else np.empty(0, int)
        for lo, hi in zip(bounds, np.r_[bounds[1:], len(step)]):
            v = forward[self.start[lo:hi]] + weight[lo:hi]
            e = end[lo:hi]
            cut = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
            many = np.diff(np.r_[cut, hi - lo])
            top = np.maximum.reduceat(v, cut)
            w = np.exp(v - np.repeat(top, many))
            s = np.add.reduceat(w, cut)
            forward[e[cut]] = top + np.log(s)
            self.edge[e[cut]] = lo + cut
            up = np.cumsum(w)
            base = np.r_[0, up[cut[1:] - 1]]
            chance = (up - np.repeat(base, many)) / np.repeat(s, many)
            chance[cut + many - 1] = 2.0  # the last takes what is left
            self.chance[lo:hi] = chance


def _draw(key: np.ndarray, step: int) -> np.ndarray:
    return (mix(key + U((step + 1) * int(SECOND) & 0xFFFFFFFFFFFFFFFF)) >> U(11)).astype(np.float64) * 2.0**-53


def encode(found: list[bytes | None], keys: np.ndarray, p: Pieces, seed: int) -> list[np.ndarray | None]:
    """Sampled piece ids of each text."""
    parts, counts = [], []
    for t in found:
        own = PART.findall(b" " + t) if t else []
        parts += own
        counts.append(len(own))
    counts = np.array(counts, int)
    if not parts:
        return [None if t is None else np.empty(0, np.int64) for t in found]
    a = np.empty(len(parts), object)
    a[:] = parts
    of, distinct = pd.factorize(a)
    lattice = Lattice(list(distinct), p)
    place = np.arange(len(parts)) - np.repeat(np.cumsum(counts) - counts, counts)
    row = mix(keys.astype(np.int64).view(U) * MULTIPLIER + U(seed))
    key = mix(np.repeat(row, counts) + place.astype(U) * MULTIPLIER)
    state, stop = lattice.last[of], lattice.first[of]
    live, steps, used = np.arange(len(parts)), np.zeros(len(parts), np.int64), []
    k = 0
    while len(live):
        u = _draw(key[live], k)
        e = lattice.edge[state]
        more = np.flatnonzero(u >= lattice.chance[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= lattice.chance[e[more]]]
        used.append((live, lattice.piece[e]))
        steps[live] += 1
        state = lattice.start[e]
        on = state != stop[live]
        live, state, k = live[on], state[on], k + 1
    ends = np.cumsum(steps)
    ids = np.empty(ends[-1], np.int64)
    for k, (live, piece) in enumerate(used):
        ids[ends[live] - 1 - k] = piece
    sizes = np.add.reduceat(np.r_[steps, 0], np.minimum(np.cumsum(counts) - counts, len(steps))) * (counts > 0)
    out, at = [], 0
    for t, n in zip(found, sizes):
        own = ids[at : at + n]
        at += n
        if t is not None and (own < 0).any():
            own = np.concatenate([own[i : i + 1] if own[i] >= 0 else p.byte[list(chr(-1 - own[i]).encode("utf-8", "surrogatepass"))] for i in range(n)]) if (own < 0).sum() * 4 > n else _spelt(own, p)
        out.append(None if t is None else own)
    return out


def _spelt(own: np.ndarray, p: Pieces) -> np.ndarray:
    """Puts byte pieces in the place of characters without a piece."""
    at = np.flatnonzero(own < 0)
    new = [p.byte[list(chr(-1 - int(own[i])).encode("utf-8", "surrogatepass"))] for i in at]
    size = np.ones(len(own), int)
    size[at] = [len(x) for x in new]
    out = np.repeat(own, size)
    out[np.repeat(own < 0, size)] = np.concatenate(new)
    return out


def sample_pieces(documents: DataFrame, key: str = "doc_id", alpha: float = 1.0, seed: int = 1, model: str = MODEL) -> DataFrame:
    """key, text, ids array<int> of every row."""
    pieces = tuple(read_pieces(model))

    def run(batches):
        p = _loaded(pieces, alpha)
        for batch, found in texts(batches, 1 << 18):
            keys = batch.column(batch.schema.get_field_index("k")).to_numpy(zero_copy_only=False)
            ids = encode(found, keys, p, seed)
            at = np.cumsum([0, *(0 if x is None else len(x) for x in ids)]).astype(np.int32)
            flat = np.concatenate([x for x in ids if x is not None] or [np.empty(0)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), pa.array(flat, pa.int32()), mask=pa.array([x is None for x in ids]))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in (key, "text")] + [lists], names=[key, "text", "ids"])

    schema = f"{documents.select(F.col(key)).schema[0].simpleString().replace(':', ' ')}, text string, ids array<int>"
    return documents.select(F.col(key), "text", F.xxhash64(F.col(key)).alias("k")).mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, key: str = "doc_id", model: str = MODEL) -> DataFrame:
    """key and text, as the ids say."""
    pieces = tuple(read_pieces(model))

    def run(batches):
        p = _loaded(pieces, 1.0)
        for batch in batches:
            out = [None if x is None else p.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{encoded.select(key).schema[0].simpleString().replace(':', ' ')}, text string")


def piece_digests(documents: DataFrame, alpha: float = 1.0, seed: int = 1, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_sha256 (of the ids as little-endian 32-bit numbers) and whether decoding gives the text back."""
    pieces = tuple(read_pieces(model))

    def run(batches):
        p = _loaded(pieces, alpha)
        for batch, found in texts(batches, 1 << 18):
            ids = encode(found, batch.column(batch.schema.get_field_index("k")).to_numpy(zero_copy_only=False), p, seed)
            n = [0 if x is None else len(x) for x in ids]
            digest = [None if x is None else hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids]
            back = [x is None or p.decode(x) == t for x, t in zip(ids, found)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.bool_())], names=["doc_id", "n_pieces", "ids_sha256", "lossless"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.col("doc_id")).alias("k")).mapInArrow(run, "doc_id long, n_pieces long, ids_sha256 string, lossless boolean")


def op3_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"))
