"""The pipeline on a small fixture, each stage against a brute-force version of its decision."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terravane.llm import jaccard_join, line_dedup, piece_sampling

QUESTION = "How many of the 240 red boats near the quiet harbour did Anna count before the old station closed at 9"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = f"file://{tmp_path_factory.mktemp('tables')}"
    rng = random.Random(3)
    words = [f"{a}{b}{c}" for a in ("riv", "sto", "hou", "mea") for b in ("er", "ne", "se") for c in ("ly", "ing", "an", "ed", "o")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, prose(60) + "\n" + prose(40)) for i in range(60)]
    docs += [(100 + i, docs[i][1]) for i in range(5)]  # exact copies
    near = prose(120).split()
    docs += [(200 + i, " ".join("word%d" % i if k == 60 else w for k, w in enumerate(near))) for i in range(6)]
    docs += [(300, prose(50) + " " + QUESTION.replace("240", "31").replace("Anna", "Boris") + " " + prose(50))]
    docs += [(400 + i, "$$$ BUY!! *** " * 40 + str(i)) for i in range(40)] + [(500, None), (501, "")]
    spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(d, int(d < 400), 0) for d, _ in docs if d < 60 or 400 <= d < 440], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, folder, tmp_path):
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        columns = docs.columns
        stage(spark, docs, folder).write.parquet(out := f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(out)
        after = {r.doc_id: r.text for r in docs.collect()}
        seen.append(name)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "quality classifier":
            assert not any(400 <= d < 440 for d in after) and all(d in after for d in range(60))
        if name == "line dedup":
            gone = {r.doc_id: r.gone for r in line_dedup.removed_lines(spark.read.parquet(f"file://{tmp_path}/0")).collect()}
            assert all(d not in after for d in range(100, 105)) and set(range(60)) <= set(after)
            assert all(after[d] == "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in before.items() if d in after and t is not None)
            assert docs.where("n_chars <> char_length(text)").count() == 0
        if name == "n-gram Jaccard join":
            best = jaccard_join.brute_force(list(before.items()))
            assert set(after) == {d for d, (_, c) in best.items() if c == d}
        if name == "benchmark decontamination":
            assert set(before) - set(after) == {300}
    p = piece_sampling.Pieces(piece_sampling.read_pieces(piece_sampling.MODEL), 1.0)
    import numpy as np

    assert all(r.text is None and r.ids is None or p.decode(np.array(r.ids, np.int64)).decode() == r.text for r in docs.collect())
    assert len(seen) == 5
    ran = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert ran == {r.doc_id: r.ids for r in docs.collect()}


def test_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_extra_columns_pass(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({c: F.lit(1) for c in ("copy_of", "line_doc", "line_gone", "gone", "fp", "score")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_near_copies_of_five_words_and_four_fifths(spark, folder):
    rng, rows = random.Random(8), []
    for k, n in enumerate((30, 60, 90, 150, 300)):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(2000)}" for _ in range(n)]
        for i in range(12):
            w = list(base)
            for at in rng.sample(range(n), rng.randint(0, 1 + n // 40)):
                w[at] = f"other{i}{at}"
            rows.append((100 * k + i, " ".join(w)))
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()}
    want = {d for d, (_, c) in jaccard_join.brute_force(rows, 5, 80).items() if c == d}
    assert kept == want != {d for d, (_, c) in jaccard_join.brute_force(rows).items() if c == d}


def test_copies_of_short_lines_go(spark, folder):
    rows = [(1, "Les.\nfirst line of more than twenty characters\nA b\n\n"), (2, "Les.\nsecond line, which is another one altogether\nA c\n\nLes."), (3, "Les."), (4, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t) if t else None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, docs, folder).collect()}
    assert got == {1: rows[0][1], 2: "second line, which is another one altogether\nA c\n", 4: None}
