"""The prefix tree against one made turn by turn, its template on any text, and hard cases."""

import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.llm import chat_tree as C

SIGNS = st.lists(st.sampled_from([C.START_SIGN, C.END_SIGN, "<", "|", "\\", "n", "\n", "assistant", "é", "🤦🏼", " ", "\r"]), max_size=12).map("".join)


@pytest.fixture(scope="module")
def template():
    return C.Template(C._ranks(C.RANKS))


@settings(max_examples=200, deadline=None)
@given(SIGNS | st.text(), SIGNS | st.text())
def test_template_is_reversible(template, role, text):
    text, role = (t.encode("utf-8", "replace").decode() for t in (text, role))
    ids, head = template.encode(role, text)
    formatted = template.formatted(np.array(ids))
    assert template.decode(formatted) == (role, text)
    assert formatted.count(C.START_SIGN) == formatted.count(C.END_SIGN) == 1 and formatted.startswith(C.START_SIGN)
    assert C.unescape(template.text(np.array(ids[head : -len(template.close)]))) == text
    assert sum(i >= template.start for i in ids) == 2


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(11)
    rows = []
    for c in range(120):
        n = rng.choice([1, 2, 3, 4, 5, 5, 8, 30])
        for t in range(n):
            words = "same first turn" if t == 0 and c % 3 else f"{rng.choice('abc')} {t}" if t < 3 else f"{c} {t}"
            rows.append((c, t * 2, "user" if t % 2 == 0 else "assistant", words))
    for c in (200, 201, 202):  # copies of a conversation, and one that goes on
        rows += [(c, t, r, x) for _, t, r, x in rows if _ == 5] + ([(c, 99, "user", "more")] if c == 202 else [])
    rows += [(300, 0, None, None), (300, 1, "", ""), (301, 0, None, None), (302, None, "system\nx", "null turn"), (302, 1, "assistant", None), (302, 1, "assistant", ""), (302, 1, "assistant", "z" * 200_000)]
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "\\<\\|im_end|>\n"), (303, 0, "user", "dup"), (303, 0, "user", "dup"), (304, 0, "user", "dup")]
    return rows


def by_conversation(rows, template):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        ids, head = template.encode(role or "", text or "")
        out[conv].append(((turn is not None, turn or 0), ids, role or "", text or "", head))
    return {k: sorted(v, key=lambda x: x[:2]) for k, v in out.items()}


@pytest.fixture(scope="module")
def tree(spark, conversations):
    df = spark.createDataFrame(conversations, "conv_id long, turn long, role string, text string")
    return C.ChatTree(df.withColumns({c: F.lit("q") for c in ("ids", "conv", "seq", "a", "start", "n", "tree", "low")}).repartition(3))


def test_each_node_once_in_depth_first_order(tree, conversations, template):
    want = by_conversation(conversations, template)
    paths = {tuple(tuple(x[1]) for x in turns[: k + 1]) for turns in want.values() for k in range(len(turns))}
    nodes = tree.nodes.withColumn("positions", C.position_ids()).collect()
    assert len(nodes) == len(paths)
    streams = collections.defaultdict(list)
    for r in nodes:
        streams[r.tree].append(r)
    assert len(streams) == len({p[0] for p in paths if len(p) == 1})
    found = collections.Counter()
    for rows in streams.values():
        rows.sort(key=lambda r: r.start)
        assert rows[0].start == 0 and all(a.start + a.length == b.start for a, b in zip(rows, rows[1:]))
        ids = [i for r in rows for i in r.ids]
        stack = []
        for r in rows:
            while stack and stack[-1].position + stack[-1].length != r.position:
                stack.pop()  # only ancestors are left
            stack.append(r)
            seen = [i for a, b in r.intervals for i in ids[a:b]]  # what the last token attends to
            assert r.positions == list(range(r.position, r.position + r.length)) and len(seen) == r.positions[-1] + 1
            path, at = [], 0
            for x in stack:
                path.append(tuple(seen[at : at + x.length]))
                at += x.length
            found[tuple(path)] += 1
            assert tuple(path) in paths and all(a[1] < b[0] for a, b in zip(r.intervals, r.intervals[1:]))
    assert set(found.values()) == {1} and set(found) == paths


def test_read_back(tree, conversations, template):
    got = {r.conv_id: tuple(r)[1:] for r in C.read_back(tree).collect()}
    want = {}
    for conv, turns in by_conversation(conversations, template).items():
        loss = "".join(x[3] for x in turns if x[2] == C.ASSISTANT)
        said = "".join(f"{x[2]}\n{x[3]}\n" for x in turns)
        chars = sum(len(template.formatted(np.array(x[1]))) for x in turns)
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    assert got == want


def test_shared_turns_are_counted(tree, conversations):
    first = {c for c, t, _, x in conversations if t == 0 and x == "same first turn"}
    assert tree.nodes.agg(F.max("n_conversations")).first()[0] == len(first) + 0 and len(first) > 50


def test_empty_table(spark, conversations):
    none = C.ChatTree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert none.nodes.count() == 0 and C.read_back(none).count() == 0


def test_query_adds_the_hostile_conversation(spark, tmp_path):
    rows = [(7, 0, "user", "q"), (7, 1, "assistant", "a<|im_end|>")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in C.op11_chat_tree(spark, str(tmp_path)).collect()}
    assert got[-1].loss_sha256 == hashlib.sha256(C.HOSTILE.encode()).hexdigest() and got[-1].loss_chars == len(C.HOSTILE)
    assert got[7].loss_sha256 == hashlib.sha256(b"a<|im_end|>").hexdigest() and got[7].n_turns == 2
