"""Periodic runs against their definition, and on hard cases."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.llm import periodic_runs as P


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=150), st.integers(0, 149), st.integers(1, 30), st.sampled_from([40, 1 << 16]))
def test_runs_are_those_of_the_definition(ids, a, p, probes):
    ids = [ids[i if i < a else a + (i - a) % p] if (i < a or a + (i - a) % p < len(ids)) else ids[i] for i in range(len(ids))]
    was, P.PROBES = P.PROBES, probes
    try:
        assert P.find_runs(np.array(ids, np.int32)) == P.brute_force(ids)
    finally:
        P.PROBES = was


def test_long_texts():
    assert P.find_runs(np.zeros(300_000, np.int32)) == [(0, 300_000, 1)]
    ids = np.arange(100_000) % 30_000
    assert P.find_runs(ids) == [(0, 100_000, 30_000)]
    assert P.find_runs(ids[:89_999]) == []


def test_ties_go_to_the_first_run():
    assert P.strongest([(100, 24, 6), (0, 24, 6), (0, 28, 7), (50, 23, 6)]) == (0, 24, 6)
    assert P.strongest([]) is None


def expected(rows):
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        n = len(words)
        h = zlib.crc32(str(doc).encode()) if doc is not None else 1
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = P.brute_force(words)
        top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
        gone = {i for s, k, q in runs for i in range(s + q, s + k)}
        listed = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(runs), *top, top[0] is not None and 1000 * top[1] // top[2] or None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 200))) for _ in range(150)]
    texts += [None, "", " \n\t", "x", "x " * 23, "x " * 24, "x\x0bx\x1cx x " * 30, "a b c\n" * 8, "é ü " * 40, "p q " * 20 + "r s t u v " + "w " * 30 + "p q " * 15, "same " * 5000, " ".join(f"w{i % 400}" for i in range(3000))]
    rows = [(3 * i - 20, t) for i, t in enumerate(texts)]
    return rows + [(None, "y " * 50), (None, None), (4, texts[3]), (4, texts[3]), (4, "z " * 30)]


def test_query_on_hard_cases(spark, hard, tmp_path):
    docs = spark.createDataFrame(hard, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("runs", "key", "_text", "_w", "_a", "_p", "start", "best")})
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = P.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want = expected(hard)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sum(w[1] for w in want) > 10 and max(w[1] for w in want) > 1


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert P.periodic_runs(P.with_planted_runs(none)).count() == 0
