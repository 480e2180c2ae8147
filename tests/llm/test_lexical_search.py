"""Ranked search against every document's score, and on hard cases."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.llm import lexical_search as L

LISTS = st.lists(st.dictionaries(st.integers(0, 29), st.integers(1, 40), max_size=30), max_size=6)


@settings(max_examples=200, deadline=None)
@given(LISTS, st.integers(1, 12), st.randoms())
def test_best_of_a_shard(found, top, rng):
    ids = np.array(rng.sample(range(100), 30))
    total = np.zeros(30, np.int64)
    for one in found:
        for k, v in one.items():
            total[k] += v
    lists = [(np.array(sorted(x), np.int32), np.array([x[k] for k in sorted(x)], np.int64)) for x in found]
    at, score = L.best_of_shard(lists, ids, 30, top)
    some = np.flatnonzero(total)
    want = some[np.lexsort((ids[some], -total[some]))][:top]
    assert at.tolist() == want.tolist() and score.tolist() == total[want].tolist()


def test_few_postings_are_probed():
    """A list of low bound isn't added up for documents that can't qualify."""
    many = np.arange(10_000, dtype=np.int32)
    touched = []

    class Watched(np.ndarray):
        def __getitem__(self, k):
            touched.append(np.size(k))
            return np.asarray(self)[k]

    at, _ = L.best_of_shard([(many[:50], np.full(50, 1000)), (many, np.ones(10_000, np.int64).view(Watched))], many, 10_000, 10)
    assert at.tolist() == list(range(10)) and sum(touched) <= 50


def test_terms():
    text = "Ab-c_9\x00É\x1c¼ ß.İ\U0001f600Z\x7fk"
    assert L.terms_of(text.encode()) == [w.encode() for w in ("ab", "c", "9", "É", "¼", "ß", "İ\U0001f600z", "k")]
    assert L.terms_of(None) == L.terms_of(b"") == L.terms_of(b" .\x00\x7f") == []


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß9", "x"]
    texts = [" ".join(vocabulary[min(int(rng.expovariate(0.12)), 62)] for _ in range(rng.randint(1, 60))) for _ in range(300)]
    texts += [texts[0]] * 30 + [None, "", " .,\x00", "w1", "W1", "w1 " * 4000, " ".join(f"r{i}" for i in range(9000))]
    docs = [(i * 2, t) for i, t in enumerate(texts)] + [(4, "w3 w3"), (4, "w3 w3"), (None, "w3 w4"), (None, "r1 r2")]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12)))) for i in range(40)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "R1 r1 r8"), (None, "w3 w4"), (3, "x É"), (3, "x É"), (54, texts[0])]
    return docs, items


@pytest.mark.parametrize("shard, block", [(L.SHARD_BYTES, L.BLOCK_BYTES), (400, 600), (1, 1 << 20)])
def test_rankings(spark, corpus, shard, block):
    docs, items = corpus
    clashing = {c: F.lit("z") for c in ("rank", "score", "terms", "docs", "starts", "n", "t")}
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns(clashing).repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string").withColumns(clashing)
    got = sorted(map(tuple, L.ranked_search(d, i, shard_bytes=shard, block_bytes=block).collect()), key=str)
    assert got == sorted(L.brute_force(docs, items), key=str)


def test_empty_tables(spark, corpus):
    d = spark.createDataFrame(corpus[0], "doc_id long, text string")
    i = spark.createDataFrame(corpus[1], "item_id long, text string")
    for docs, items in ((d.limit(0), i), (d, i.limit(0)), (d.where("text is null"), i)):
        assert L.ranked_search(docs, items).count() == 0
