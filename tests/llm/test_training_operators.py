"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and on hard cases: nulls in any column,
empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names.
"""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.llm import (
    common, decontamination, jaccard_join, language_id, line_dedup, lm_scoring, piece_sampling, quality_classifier, quality_rules, registry, substring_dedup, token_counts,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Clashes with names that the operators use for themselves.
CLASHING = ["h", "key", "fp", "label", "pos", "id", "gone", "score", "owner", "copy", "hs", "k", "block", "place", "target", "held_out", "_doc", "_t"]


def invented(rng, n, words=400):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6))) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) for _ in range(n)) for _ in range(1)][0]


@pytest.fixture(scope="module")
def corpus():
    """Small documents with exact copies, near copies, repeated passages and lines, and hard cases."""
    rng = random.Random(5)
    base = [invented(rng, rng.randint(3, 120)) for _ in range(40)]
    passage = invented(rng, 45)
    out = list(base)
    for t in base[:12]:
        w = t.split()
        for _ in range(2):
            v = list(w)
            if len(v) > 6:
                v[rng.randrange(len(v))] = "edited"
            out.append(" ".join(v))
    out += base[:6] + [base[20] + "\n" + passage, passage + "\t" + base[21], passage + " " + passage]
    out += [None, "", "   \n\t ", "x", "x", "one two three", "one two three", "é ñ ▁ 🤦🏼", "a\x0bb\x0cc d", "same " * 3000, " ".join(f"w{i}" for i in range(4000))]
    return [(3 * i + 1, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", None) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    df = spark.createDataFrame(corpus, SCHEMA)
    return df.withColumns({c: F.lit(None).cast("string") for c in CLASHING}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_words_agree():
    t = " a\x0bb\x0cc\td\re\nf\x1cg\x85h i  "
    assert t.encode().split() == [w.encode() for w in "a b c d e f\x1cg\x85h i".replace(" ", "|").split("|")]


def test_substring_dedup(docs, none, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.substring_dedup(docs).collect()}
    want = substring_dedup.brute_force([(r[0], r[1]) for r in corpus])
    assert got == want and sum(v[1] for v in want.values()) > 100
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "a " * 30), (1, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()) == [(0, 0), (30, 29)]


def test_cover_meets_every_difference():
    cover = set(substring_dedup.COVER)
    for i, j in itertools.product(range(substring_dedup.PERIOD), repeat=2):
        assert any((i + k) % substring_dedup.PERIOD in cover and (j + k) % substring_dedup.PERIOD in cover for k in range(substring_dedup.PERIOD))


def test_jaccard_components(docs, none, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    want = jaccard_join.brute_force([(r[0], r[1]) for r in corpus])
    assert got == want and sum(k != c for k, (_, c) in want.items()) > 10
    assert jaccard_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
@settings(max_examples=150, deadline=None)
@given(st.integers(1, 90), st.integers(0, 12), st.integers(0, 12), st.integers(0, 10**6), st.sampled_from([0, 5, 13, 24]))
def test_linked_sets_share_a_list(percent, n, a_only, b_only, seed, light):
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 2**64, n + a_only + b_only, dtype=np.uint64)
    common = rng.random(1 << jaccard_join.BUCKETS_LOG) < 0.2
    a, b = np.unique(pool[: n + a_only]), np.unique(np.concatenate([pool[:n], pool[n + a_only :]]))
    inter = len(np.intersect1d(a, b))
    linked = 100 * inter >= percent * (len(a) + len(b) - inter)
    least = min(len(a), len(b))  # a subset proves a link if one of the sets has the smaller of its sizes
    of_a, of_b = ({k for m, keys in jaccard_join.light_keys(s, light, percent) if m == least for k in keys.tolist()} for s in (a, b))
    x, y = (jaccard_join.heavy_keys(s, light, common, percent).tolist() for s in (a, b))
    if least <= light:
        assert bool(of_a & of_b) == linked
    elif linked:
        first = next(k for k in x if k in set(y))  # the places of the first shared shingle allow the link
        assert min(len(a) - x.index(first), len(b) - y.index(first)) >= jaccard_join.overlap(len(a), len(b), percent)
    if linked:
        for i, j in ((0, 1), (1, 0)):
            both = (a, b)[i], (a, b)[j]
            assert jaccard_join.possible(np.array([len(s) for s in both]), np.zeros(2, int), np.array([1, 2]), [jaccard_join.sketch(s) for s in both], None, True, percent)


def test_boundary_is_the_cheapest():
    costs = lambda sizes: jaccard_join.boundary(sizes)
    assert costs({}) == 0 and costs({1: 100}) >= 1 and costs({1000: 5}) == 0
    assert 5 <= costs({n: 10 for n in range(1, 29)}) < jaccard_join.MOST_LIGHT


@pytest.mark.parametrize("small", [3, 64])
def test_large_families_in_blocks(spark, monkeypatch, small):
    """Near copies of one text, and texts with a long shared passage that aren't linked; leaders alone can't find all links."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(30):
        w = list(base)
        for k in rng.sample(range(60), rng.randint(0, 2)):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    for i in range(40):
        own = [f"o{i // 2}_{j}" for j in range(24)]
        rows.append((100 + i, " ".join(base[:50] + own + ["x"] * (i % 2))))
    chain = [f"c{i}" for i in range(200)]
    rows += [(200 + i, " ".join(chain[3 * i : 3 * i + 90])) for i in range(30)]
    for shingle, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), shingle, percent).collect()}
        assert got == jaccard_join.brute_force(rows, shingle, percent)


def test_jaccard_repeated_and_null_ids(spark):
    """A doc_id with two texts keeps two sets; a null doc_id gets the component of an equal set, or null."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(7, one), (7, two), (9, two + " tail"), (3, one + " tail"), (None, one), (None, three), (None, None), (5, "")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(7, 37, 3), (7, 37, 7), (9, 38, 7), (3, 38, 3), (None, 37, 3), (None, 37, None), (None, 0, None), (5, 0, 5)], key=str)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("most", [1, 2, 3])
def test_banded_automaton(spark, most):
    rng = random.Random(most)
    rows = [("", ""), ("a", ""), ("", "ab"), ("abc", "abc"), ("é🤦ñ", "éñ"), ("aaaa", "aaaaaa")]
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        b = list(a)
        for _ in range(rng.randint(0, most + 1)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice([[], ["a"], ["x"]])
        rows.append((a, "".join(b)))
    got = {tuple(r) for r in line_dedup.within_edits(spark.createDataFrame(rows, "a string, b string"), "a", "b", most).collect()}
    assert got == {(a, b) for a, b in rows if edits(a, b) <= most}


def lines_brute(rows):
    first, gone = {}, collections.defaultdict(set)
    lines = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if x.encode().split()]
    for d, i, x in sorted(lines):
        first.setdefault(x, (d, i))
    near = {x for x in first for y in first if min(len(x), len(y)) >= line_dedup.LEAST and first[y] < first[x] and abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2}
    for d, i, x in lines:
        if x in near or first[x] != (d, i):
            gone[d].add(i)
    return {d: sorted(g) for d, g in gone.items()}


def test_line_dedup(spark, none):
    rng = random.Random(9)
    rows = []
    for d in range(30):
        lines = []
        for _ in range(4):
            x = f"{rng.choice('abc') * rng.randint(18, 22)} common line {rng.choice('xyz')}"
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(x))
                x = rng.choice([x[:k] + "#" + x[k:], x[:k] + x[k + 1 :], x[:k] + "é" + x[k + 1 :]])
            lines.append(x)
        rows.append((d, "\n".join([*lines, "short", "  ", lines[0]])))
    rows += [(100, None), (101, ""), (102, "z" * 5000), (103, "z" * 5001)]
    base = "a line that many near copies of it follow, each with other letters"
    for d in range(110, 150):  # a chain: each is near the one before it, few are near the first
        k = rng.randrange(len(base))
        base = base[:k] + rng.choice("xyzw") + base[k + 1 :]
        rows.append((d, base))
    rows += [(d, base[:10] + c + base[11:]) for d, c in enumerate("0123456789", 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in CLASHING})
    got = {r.doc_id: r.gone for r in line_dedup.removed_lines(df).collect()}
    assert got == lines_brute(rows) and len(got) > 20
    kept = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    for d, t in rows:
        left = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in got.get(d, ()))
        if d in got and not left.split():
            assert d not in kept
        else:
            assert kept[d] == left
    assert line_dedup.line_dedup(none).count() == 0 and line_dedup.removed_lines(none).count() == 0


def test_quality_rules(docs, none, corpus):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for d, t, *_ in corpus:
        w = (t or "").encode().split()
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        assert (got[d].n_words, got[d].n_repeat_words, got[d].n_dup_lines) == (len(w), len(covered), len(lines) - len(set(lines)))
        assert got[d].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (got[d].kept and got[d].base_failed)
    assert quality_rules.quality_rules(none).count() == 0


def test_language_identification(spark, docs, none):
    rng = random.Random(1)
    words = {"aa": ["alpha", "arra", "abba", "atta"], "bb": ["bobo", "brubu", "blob", "bubb"], "cc": ["cíc", "cecé", "ccic", "ciel"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(12)), k) for i in range(150) for k in [sorted(words)[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 5 <> 0"), 40)
    got = language_id.identify(df.where("doc_id % 5 = 0").select("doc_id", "text", "lang"), model, ("doc_id", "lang")).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    assert (model.weights == 0).mean() > 0.9
    hard = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "x" * 100_000), (5, "𐐀")], "doc_id long, text string"), model).collect()}
    assert [hard[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and hard[4].lang_pred != "und" and hard[5].lang_pred != "und"
    assert language_id.identify(docs, language_id.fit(none)).where("lang_pred <> 'und'").count() == 0
    assert language_id.identify(none, model).count() == 0


def test_quality_classifier(spark, docs, none):
    rng = random.Random(4)
    good = [" ".join(rng.choice(["the", "of", "house", "river", "stone"]) for _ in range(60)) for _ in range(60)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "***", "NOW!!"]) for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(df, labels, 25)
    got = {r.doc_id: r for r in quality_classifier.classify(df, model).collect()}
    assert all(got[i].predicted == int(i < 60) for i in range(1, 120, 2))
    out = quality_classifier.classify(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.accepted(df, model).count() == 60 and quality_classifier.accepted(none, model).count() == 0
    untrained = quality_classifier.fit(none, labels.limit(0))
    assert {r.score for r in quality_classifier.classify(df, untrained).collect()} == {0.5}


def test_votes_are_exact_products():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=(50, 6))
    v = quality_classifier.rounded(np.concatenate([raw, raw[:20], raw[:20]]))  # ties
    labels = (rng.random(90) < 0.5).astype(float)
    m = quality_classifier.Model(None, None, v, labels, 7, 0.5)
    q = quality_classifier.rounded(np.concatenate([rng.normal(size=(20, 6)), raw[:10]]))
    together = m.vote(q)
    for x, s in zip(q, together):
        products = [int(x.astype(int) @ v[i].astype(int)) for i in range(90)]
        near = sorted(range(90), key=lambda i: (-products[i], i))[:7]
        w = [max(products[i] / quality_classifier.STEPS**2, 1e-6) ** 4 for i in near]
        assert abs(s - sum(a * labels[i] for a, i in zip(w, near)) / sum(w)) < 1e-12
        assert m.vote(x[None])[0] == s


def test_leading_vectors_are_those_of_the_whole_matrix(monkeypatch):
    monkeypatch.setattr(quality_classifier, "ROWS", 16)
    rng = np.random.default_rng(1)
    x = (rng.normal(size=(60, 8)) * 3.0 ** -np.arange(8) @ rng.normal(size=(8, 300))).astype(np.float32)
    values, u = quality_classifier.singular([lambda i=i: x[i : i + 16] for i in range(0, 60, 16)], 60, 5)
    full = np.linalg.svd(x.astype(float))
    assert np.allclose(np.sqrt(values), full.S[:5], rtol=1e-3)
    assert np.allclose(np.abs(np.sum(u * full.U[:, :5], 0)), 1, atol=1e-3)


def test_scores_depend_on_the_text_alone(spark):
    rng = random.Random(6)
    kinds = [["the", "of", "house", "river"], ["BUY!!", "$$$", "river", "***"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(rng.randint(2, 30)))) for i in range(120)]
    rows += [(200 + i, t) for i, t in rows[:40]] + [(1, rows[2][1]), (None, rows[3][1]), (500, None), (501, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    model = quality_classifier.fit(df.where("doc_id < 120"), labels, 20)
    by_text = collections.defaultdict(set)
    for n in (1, 7):
        for (_, t), r in zip(sorted(rows, key=str), sorted(quality_classifier.classify(df.repartition(n), model, ("doc_id", "text")).collect(), key=lambda r: str((r.doc_id, r.text)))):
            assert t == r.text
            by_text[t].add(r.score)
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[None] == by_text[" \n"] == {model.prior}
    assert not {500, 501} & {r.doc_id for r in quality_classifier.accepted(df, model).collect()}


def test_pieces_round_trip_and_repeat(docs, none, corpus):
    first = piece_sampling.sample_pieces(docs)
    a, b = ({r.doc_id: r.ids for r in df.collect()} for df in (first, piece_sampling.sample_pieces(docs.repartition(1))))
    assert a == b
    back = {r.doc_id: r.text for r in piece_sampling.decode_pieces(first).collect()}
    assert back == {r[0]: r[1] for r in corpus}
    assert piece_sampling.piece_digests(docs).where("not lossless").count() == 0
    assert piece_sampling.sample_pieces(none).count() == 0


def test_piece_chances():
    raw = piece_sampling.read_pieces(piece_sampling.MODEL)
    p = piece_sampling.Pieces(raw, 1.0)
    known = {t: i for i, (t, _, kind) in enumerate(raw) if kind == 0}

    def ways(s):
        if not s:
            yield ()
        for n in range(1, len(s) + 1):
            if s[:n] in known:
                yield from ((known[s[:n]], *rest) for rest in ways(s[n:]))

    weight = {w: math.exp(p.weight[list(w)].sum()) for w in ways("▁stone")}
    n = 20_000
    seen = collections.Counter(tuple(x.tolist()) for x in piece_sampling.encode([b"stone"] * n, np.arange(n), p, 7))
    assert set(seen) <= set(weight)
    for w, v in weight.items():
        share = v / sum(weight.values())
        assert abs(seen[w] / n - share) < 5 * math.sqrt(share / n) + 1e-3


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), min_size=1, max_size=5))
def test_any_text_round_trips(found):
    p = piece_sampling._loaded(tuple(piece_sampling.read_pieces(piece_sampling.MODEL)), 1.0)
    raw = [None if t is None else t.encode("utf-8", "ignore") for t in found]
    for t, ids in zip(raw, piece_sampling.encode(raw, np.arange(len(raw)), p, 1)):
        assert (ids is None) == (t is None) and (t is None or p.decode(ids) == t)


QUESTION = "A train leaves the old station at 9 and travels 240 km toward the far coast while Anna counts 17 red boats near the quiet harbour"


def placeholder(word):
    """What a word becomes in a template, from the rules as stated."""
    bare = word.strip(".,;:!?\"'()[]{}<>*#$&|")
    if re.fullmatch(r"[+-]?[$]?[0-9][0-9.,/:]*%?", bare):
        return "<number>"
    if bare.lower().encode() in decontamination.UNITS:
        return "<unit>"
    return "<name>" if bare[:1].lower() != bare[:1] else bare.lower()


def windows_of_item(words, window=8, literal=5, least=5):
    """(exact, place, length), from the rules as stated."""
    plain = [not placeholder(w).startswith("<") for w in words]
    k, out = min(window, len(words)), set()
    for p in range(len(words) - k + 1):
        if sum(plain[p : p + k]) >= min(literal, k):
            out.add((False, p, k))
            continue
        out.add((True, p, k))
        for size in [x for x in decontamination.STEPS if k < x < len(words)] + [len(words)]:
            at = max(0, min(p, len(words) - size))
            enough = 2 if size == len(words) and sum(plain) < literal else literal
            if size >= least and sum(plain[at : at + size]) >= enough:
                out.add((False, at, size))
                break
    return out


def leaks_brute(docs, items, share=0.5, run=13, least=5, usual=0.001):
    out = {}
    for (d, text), (item, asked) in itertools.product(docs, items):
        if d is None or item is None or not (text or "").split() or not (asked or "").split():
            continue
        words, own = text.split(), asked.split()
        bare, mine = ([w.strip(".,;:!?\"'()[]{}<>*#$&|") for w in x] for x in (words, own))
        found = collections.defaultdict(set)
        for exact, q, k in windows_of_item(own):
            form = (lambda w: w.strip(".,;:!?\"'()[]{}<>*#$&|").lower()) if exact else placeholder
            want = [form(w) for w in own[q : q + k]]
            starts = [p for p in range(len(words) - k + 1) if [form(w) for w in words[p : p + k]] == want]
            for p in starts[:1] if k < least else starts:
                found[p - q].update(range(q, q + k))
        covered, longest, same = set(), 0, True
        for shift, places in found.items():
            to, back, good = {}, {}, []
            for q in sorted(places):
                a, b = mine[q].lower(), bare[q + shift].lower()
                if placeholder(mine[q]).startswith("<"):
                    if to.setdefault(a, b) != b or back.setdefault(b, a) != a:
                        continue
                    same &= a == b
                good.append(q)
            covered.update(good)
            longest = max([longest, *(1 + max(j for j in range(len(own)) if all(q + i in good for i in range(j + 1))) for q in good)])
        if covered and (len(covered) >= share * len(own) or longest >= run):
            out[d, item] = (len(covered), len(own), same)
    often = collections.Counter(i for (_, i), x in out.items() if x[1] < least)
    return {k: v for k, v in out.items() if v[1] >= least or often[k[1]] <= max(1, int(usual * len(docs)))}


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, QUESTION), (2, None), (3, "too short"), (1, QUESTION), (None, "null id has no row at all in the result set")], "item_id long, text string")
    filler = "grey clouds were moving slowly over the wide valley and nobody said a word "
    changed = QUESTION.replace("9", "11").replace("240", "310").replace("Anna", "Boris").replace("17", "5")
    rows = [(1, filler + QUESTION + " " + filler), (2, filler + changed), (3, filler * 5), (4, None), (5, ""), (6, filler + " ".join(QUESTION.split()[:7])), (7, (filler * 300) + changed), (1, filler), (2, filler + changed)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(None).cast("string") for c in ("h", "th", "item_id", "leaked", "q")})
    got = sorted((r.doc_id, r.item_id, r.verbatim) for r in decontamination.contaminated_pairs(df, bench).collect())
    assert got == [(1, 1, True), (2, 1, False), (7, 1, False)]
    out = decontamination.decontaminate(df, bench)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [3, 4, 5, 6]
    assert decontamination.contaminated_pairs(docs, bench.limit(0)).count() == 0 and decontamination.contaminated_pairs(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench).count() == docs.count()
    assert decontamination.decontaminate(spark.createDataFrame([(None, "a b c"), (1, QUESTION)], "doc_id long, text string"), bench).count() == 1


def test_every_item_can_match(spark):
    """Short items, items of many slots and long ones, verbatim or with other slots, against all windows of all pairs."""
    rng = random.Random(12)
    words = ["river", "stone", "count", "the", "of", "boats", "red", "leave", "near", "far"]
    word = lambda slots: rng.choice([str(rng.randint(2, 40)), rng.choice(["Anna", "Boris", "Clara"]), "km", "kg"]) if rng.random() < slots else rng.choice(words)
    items = [(0, "What is 7 times 8 ?"), (1, "capital of red stones"), (2, "1 2 3 4 5 6 7 8 9 10 11 12"), (3, "WHAT IS THE RIVER OF STONE NEAR BOATS"), (4, "boats"), (5, "?"), (6, "the")]
    items += [(10 + i, " ".join(word(rng.choice([0.1, 0.5, 0.8])) for _ in range(rng.choice([3, 5, 7, 9, 14, 30, 60])))) for i in range(25)]
    other = lambda t: " ".join(str(int(w) + 50) if w.isdigit() else w for w in t.split())
    docs = []
    for i, (_, t) in enumerate(items):
        pad = " ".join(word(0.1) for _ in range(12))
        docs += [(10 * i, f"{pad} {t}, {pad}"), (10 * i + 1, f"{pad} {other(t)} {pad}"), (10 * i + 2, " ".join(t.split()[: len(t.split()) // 2])), (10 * i + 3, pad + " " + t.lower())]
    docs += [(9000, None), (9001, ""), (9002, "What is 7 times 8 ?")]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for usual in (0.05, 0.001):
        got = {(r.doc_id, r.item_id): (r.n_covered, r.n_item_words, r.verbatim) for r in decontamination.contaminated_pairs(*tables, usual=usual).collect()}
        assert got == leaks_brute(docs, items, usual=usual)
        assert ((10, 1) in got) == (usual == 0.05)  # a phrase of four words that two documents hold
    assert all((10 * i, item) in got for i, (item, t) in enumerate(items) if len(t.split()) >= 5) and (1, 0) in got and (9002, 0) in got


@pytest.mark.parametrize("holders", [3, 300])
def test_short_items_are_reported_at_any_frequency(spark, holders):
    docs = [(i, f"so {'what is Blue ?' if i < holders else 'why not red'} they said {i}") for i in range(holders + 200)]
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, "What is blue ?"), (8, "said")], "item_id long, text string")
    got = decontamination.contaminated_pairs(*tables).where("item_id = 7").collect()
    assert sorted(r.doc_id for r in got) == list(range(holders)) and {r.n_documents for r in got} == {holders}
    assert decontamination.decontaminate(*tables).count() == 200  # the one-word item is reported only


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        get = staticmethod(lambda key, default: default)

    class Spark:
        conf, sparkContext = Conf, type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        common.shared_dir(Spark)


def test_slots_must_be_consistent():
    item = "move 5 crates then add 7 crates then take 5 crates and leave 7 crates for later use today".encode()
    covered = lambda text: decontamination.leak([(0, 0, item, text)], len(item.split()), 0.0, 99)[0]
    assert covered(item.replace(b"5", b"50").replace(b"7", b"70")) == len(item.split())
    assert covered(item.replace(b"take 5", b"take 9")) == len(item.split()) - 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 9))
def test_runs_are_told_apart_by_their_words(h, k):
    a = np.array(h + h[3:], np.uint64)
    got = decontamination.Runs(a).of(k, False)
    by = collections.defaultdict(set)
    for p, x in enumerate(got.tolist()):
        by[tuple(a[p : p + k].tolist())].add(x)
    assert len(got) == max(0, len(a) - k + 1) and all(len(v) == 1 for v in by.values()) and len({min(v) for v in by.values()}) == len(by)


def test_token_rollups(spark, docs, none, tmp_path):
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    row = "op string, source string, lang string, tokenizer string, n_tokens long, old_n_tokens long"
    put = lambda *rows: spark.createDataFrame(list(rows), row)
    first = put(("insert", "a", "en", "v1", 10, None), ("insert", "a", "en", "v1", 5, None), ("insert", None, None, "v1", None, None))
    assert ledger.commit("1", first) and not ledger.commit("1", first)
    assert ledger.commit("2", put(("delete", "a", "en", "v1", 5, None), ("revise", "a", "en", "v1", 12, 10), ("insert", "a", "en", "v2", 9, None)))
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == sorted([("a", "en", "v1", 1, 12), ("a", "en", "v2", 1, 9), (None, None, "v1", 1, 0)], key=str)
    with pytest.raises(Exception, match="unknown op"):
        ledger.commit("3", put(("upsert", "a", "en", "v1", 1, None)))
    assert ledger.batches() == ["1", "2"]
    assert ledger.commit("4", put(("delete", "a", "en", "v2", 9, None))) and ledger.totals().where("tokenizer = 'v2'").count() == 0
    with pytest.raises(ValueError):
        ledger.commit("base-1", first)
    before = sorted(map(tuple, ledger.totals().collect()), key=str)
    assert ledger.compact() and not ledger.compact() and ledger._folders() == ["base-000000000000"]
    assert ledger.batches() == ["1", "2", "4"] and not ledger.commit("2", first)
    assert sorted(map(tuple, ledger.totals().collect()), key=str) == before
    assert ledger.commit("5", put(("insert", "a", "en", "v1", 1, None))) and ledger.compact() and ledger.batches() == ["1", "2", "4", "5"]
    assert ("a", "en", "v1", 2, 13) in {tuple(r) for r in ledger.totals().collect()}


def test_two_writers_of_one_batch(spark, tmp_path, monkeypatch):
    """A second writer that has seen no batch when it began is refused when it publishes."""
    at = f"file://{tmp_path}/ledger"
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 3)], "op string, source string, lang string, tokenizer string, n_tokens long")
    late = token_counts.Ledger(spark, at)
    monkeypatch.setattr(late, "batches", lambda: [])
    assert token_counts.Ledger(spark, at).commit("1", rows) and not late.commit("1", rows)
    assert [tuple(r) for r in token_counts.Ledger(spark, at).totals().collect()] == [("a", "en", "v1", 1, 3)]


def test_left_over_batches_of_a_compaction(spark, tmp_path, monkeypatch):
    """A failure after the base is published and before its batches are removed."""
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = spark.createDataFrame([("insert", "a", "en", "v1", 3)], "op string, source string, lang string, tokenizer string, n_tokens long")
    ledger.commit("1", rows)
    monkeypatch.setattr(token_counts, "remove", lambda *a: None)
    assert ledger.compact() and ledger._folders() == ["1", "base-000000000000"]
    assert [r.n_tokens for r in ledger.totals().collect()] == [3] and not ledger.commit("1", rows) and ledger.batches() == ["1"]


def test_token_count_query(spark, docs, none, corpus, tmp_path):
    """The query's batches against a sum over the documents that are left."""
    enc = token_counts._encoding(open(token_counts.RANKS, "rb").read())
    size = lambda t: len(enc.encode_ordinary(t)) if t else 0
    got = {r.doc_id: (r.n_tokens, r.n_clean) for r in token_counts.counted(docs).collect()}
    assert got == {d: (size(t), size(re.sub(r"\s+", " ", t or ""))) for d, t, *_ in corpus} and any(a != b for a, b in got.values())
    marks = [(corpus[0][0], 0, 1), (corpus[1][0], 1, 1), (corpus[2][0], 1, 0), (corpus[3][0], None, 1), (corpus[3][0], 0, 1), (None, 1, 1), (99999, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    total = collections.defaultdict(lambda: [0, 0])
    for i, (d, t, lang, source, _) in enumerate(corpus):
        if i not in (0, 3):
            total[source, lang, "byte_bpe_50k"][0] += 1
            total[source, lang, "byte_bpe_50k"][1] += got[d][1]
    ledger = token_counts.Ledger(spark, f"file://{tmp_path}/ledger")
    rows = token_counts.apply_batches(ledger, docs, labels).collect()
    assert {tuple(r)[:3]: list(r)[3:] for r in rows} == total and ledger.batches() == ["appeal", "clean", "load", "toxic"]
    assert token_counts.apply_batches(token_counts.Ledger(spark, f"file://{tmp_path}/none"), none, labels.limit(0)).count() == 0


def test_lm_scores(spark, docs, none, corpus):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (7, 1, 1), (10, 0, 0), (None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    size = 30
    models = lm_scoring.fit(docs, labels, size)
    words = collections.Counter(w for r in corpus if r[1] for w in r[1].encode().split())
    assert models.words == [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:size]]
    k = size + lm_scoring.CLASSES + 1
    ids = lm_scoring.Ids(models.words)
    sums = np.zeros((2, k, k))
    for d, t, *_ in corpus:
        before = ids.start
        for w in (t or "").encode().split():
            sums[:, before, ids[w]] += [d in (1, 4), 1]
            before = ids[w]
    assert np.allclose(models.target, lm_scoring.smoothed(sums[0].ravel(), k)) and np.allclose(models.background, lm_scoring.smoothed(sums[1].ravel(), k))
    assert np.allclose(np.exp(-models.background.reshape(k, k).astype(float)).sum(1), 1, atol=1e-3)
    got = {r.doc_id: r for r in lm_scoring.score(docs, models).collect()}
    for d, t, *_ in corpus:
        c = ids.cells(t.encode().split()) if t else []
        assert got[d].n_tokens == len(c)
        assert got[d].score is None if not len(c) else abs(got[d].score - (models.target[c] - models.background[c]).mean()) < 1e-5
    assert lm_scoring.score(none, models).count() == 0 and lm_scoring.score(docs, lm_scoring.fit(none, labels.limit(0))).count() == docs.count()


def test_lm_scores_of_every_word(spark, docs, none, corpus, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK", 20_000)
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, None), (7, 1, 1), (10, 0, 0), (None, 1, 0), (1, 1, 0), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    pairs, words = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    split = lambda t: [None, *(t or "").encode().split()]
    for d, t, *_ in corpus:
        w = split(t)
        for kind in range(2 if d in (1, 4) else 1):
            pairs[kind].update(zip(w, w[1:]))
            words[kind].update(w if len(w) > 1 else [])
    k = len(words[0]) - 1
    assert k > 4000

    def loss(kind, v, w):
        base = 0.29 * words[kind][w] / (sum(words[kind].values()) - words[kind][None]) + 0.01 / k
        return -np.log(0.7 * pairs[kind][v, w] / words[kind][v] + base if words[kind][v] else base / 0.3)

    got = {r.doc_id: r for r in lm_scoring.score_all(docs, labels).collect()}
    for d, t, *_ in corpus:
        w = split(t)
        assert got[d].n_tokens == len(w) - 1
        if len(w) > 1:
            b, a = (np.mean([loss(kind, *x) for x in zip(w, w[1:])]) for kind in (0, 1))
            assert abs(got[d].target_loss - a) < 1e-9 and abs(got[d].background_loss - b) < 1e-9 and abs(got[d].score - (a - b)) < 1e-9
        else:
            assert got[d].score is None and got[d].target_loss is None
    assert lm_scoring.score_all(none, labels).count() == 0 and lm_scoring.score_all(docs, labels.limit(0)).count() == docs.count()


def test_held_out_folds(spark):
    rows = [(i,) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", quality_classifier.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_component_loop(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(5, 5)], "a long, b long")
    got = common.components(e, common.Scratch(spark, "test"))
    assert {r.node for r in got.collect()} == set(range(1, 41)) and {r.label for r in got.collect()} == {0}


def test_registry_is_whole():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)
