"""A corpus pipeline of the training-data operators.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import decontamination, jaccard_join, line_dedup, piece_sampling, quality_classifier
from terravane.llm.common import Scratch, fresh, table

#: Near copies: words of a shingle, and the least Jaccard similarity in percent.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go, and those without a word; it learns from the labels outside the held-out fold."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~quality_classifier.held_out()))
    return quality_classifier.accepted(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines equal or nearly equal to an earlier one go, and documents that lose all their words."""
    return line_dedup.line_dedup(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest doc_id stays; rows that share a doc_id stay or go together."""
    found = jaccard_join.jaccard_components(docs, NEAR_SHINGLE, NEAR_PERCENT)
    copy = fresh(docs, "copy_of")
    # written first, so that Spark knows its size and needn't shuffle the documents if it is small
    copies = Scratch(spark, "copies").keep(found.where("component_id <> doc_id").select(F.col("doc_id").alias(copy)).distinct())
    return docs.join(copies, F.col("doc_id") == F.col(copy), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, its slots changed or not, go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, text and sampled piece ids, from which the text can be decoded."""
    return piece_sampling.sample_pieces(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode_pieces),
]
#: The stages learn, hash and sample: SQL can't express them. Tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
