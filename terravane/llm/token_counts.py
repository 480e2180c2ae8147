"""Operator 6: token counts as additive rollups kept up to date by signed batches.

A batch holds changes: inserts, deletes and revisions of documents' token counts. It is summed to one signed row for each
(source, lang, tokenizer) and committed under its batch_id by one rename in the shared folder, whose file system must rename folders
atomically; committing an id again changes nothing, so a job may be repeated after any failure, and of two writers of one id
one is refused. Totals are sums over the committed batches. compact() folds these into one base, published by a rename as well, which
names the batches it holds; they stay committed, and what is left of them after a failure isn't counted twice.

Nulls in source, lang or tokenizer make groups of their own. Null and empty texts have no tokens but count as documents; a null count
counts as 0. Repeated rows of a batch all count. Groups whose documents and tokens have both come to 0 are left out. No batches give no rows.
"""

from __future__ import annotations

import base64
import functools
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, remove, shared_dir, table, texts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
KEYS = ["source", "lang", "tokenizer"]
BASE = "base-"
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Fixed value: the pattern by which this family of vocabularies cuts texts.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

WHITE = re.compile(r"\s+")


class Ledger:
    """Committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *names)))

    def _folders(self) -> list[str]:
        if not self._fs.exists(self._at("batches")):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at("batches")))

    def _state(self) -> tuple[str | None, set[str], list[str]]:
        """The last base, the batches it holds, and the batches beside it."""
        found = self._folders()
        base = max((f for f in found if f.startswith(BASE)), default=None)
        folded = {r[0] for r in self.spark.read.parquet(f"{self.path}/batches/{base}/folded").collect()} if base else set()
        return base, folded, [f for f in found if not f.startswith(BASE) and f not in folded]

    def batches(self) -> list[str]:
        """Ids of the committed batches, those folded into a base included."""
        _, folded, beside = self._state()
        return sorted(folded | set(beside))

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """changes: op (insert, delete or revise), source, lang, tokenizer, n_tokens, and old_n_tokens for revisions.

        False if the batch was there already; an unknown op fails the batch.
        """
        if batch_id.startswith(BASE):
            raise ValueError(f"{BASE} starts the names of bases")
        if batch_id in self.batches():
            return False
        n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_n_tokens", F.lit(0)) if "old_n_tokens" in changes.columns else F.lit(0)
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
        signed = changes.select(*KEYS, sign.cast("long").alias("n_docs"), F.when(F.col("op") == "revise", n - old).otherwise(sign * n).cast("long").alias("n_tokens"))
        staged = f"staging-{uuid.uuid4().hex}"
        signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.parquet(f"{self.path}/{staged}")
        return self._publish(staged, batch_id)

    def _publish(self, staged: str, batch_id: str) -> bool:
        self._fs.mkdirs(self._at("batches"))
        done = not self._fs.exists(self._at("batches", batch_id)) and self._fs.rename(self._at(staged), self._at("batches", batch_id))
        if not done:
            remove(self.spark, f"{self.path}/{staged}")
        elif self._fs.exists(self._at("batches", batch_id, staged)):  # a writer of the same batch was first, and the rename put this one inside
            remove(self.spark, f"{self.path}/batches/{batch_id}/{staged}")
            return False
        return bool(done)

    def _summed(self, base: str | None, beside: list[str]) -> DataFrame:
        paths = [f"{self.path}/batches/{b}" for b in beside] + [f"{self.path}/batches/{base}/rows"] * (base is not None)
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        base, _, beside = self._state()
        return self._summed(base, beside)

    def compact(self) -> bool:
        """Folds all committed batches into a new base; False if there is nothing to fold or another writer was first."""
        base, folded, beside = self._state()
        if not beside:
            return False
        staged, after = f"staging-{uuid.uuid4().hex}", f"{BASE}{int(base.removeprefix(BASE)) + 1 if base else 0:012d}"
        self._summed(base, beside).write.parquet(f"{self.path}/{staged}/rows")
        self.spark.createDataFrame([(b,) for b in sorted(folded | set(beside))], "batch_id string").write.parquet(f"{self.path}/{staged}/folded")
        if not self._publish(staged, after):
            return False
        for old in [*beside, *([base] if base else [])]:
            remove(self.spark, f"{self.path}/batches/{old}")
        return True


@functools.lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def counted(documents: DataFrame, tokenizer: str = "byte_bpe_50k", ranks_path: str = RANKS) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens of every whole text and n_clean of the text with each run of white space as one space.

    The driver reads the ranks and sends them to the tasks.
    """
    with open(ranks_path, "rb") as f:
        ranks = f.read()

    def run(batches):
        enc = _encoding(ranks)
        size = lambda t: len(enc.encode_ordinary(t)) if t else 0
        for batch, found in texts(batches):
            whole = [t.decode("utf-8", "replace") if t else "" for t in found]
            clean = [cleaned(t) for t in whole]
            n = [size(t) for t in whole]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array([k if c == t else size(c) for k, t, c in zip(n, whole, clean)], pa.int64())], names=["doc_id", "source", "lang", "n_tokens", "n_clean"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, lang string, n_tokens long, n_clean long").withColumn("tokenizer", F.lit(tokenizer))


def cleaned(text: str) -> str:
    return WHITE.sub(" ", text)


def apply_batches(ledger: Ledger, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The totals after four batches, each committed twice as after a failure, with a compaction between them.

    All documents are inserted; those whose count changes when their white space is cleaned are revised; those labelled toxic are
    deleted with their revised counts; and the deleted ones of quality 1 come back as late inserts.
    """
    scratch = Scratch(documents.sparkSession, "token-counts")
    counts = scratch.keep(counted(documents))  # each text is encoded once
    marks = labels.where("doc_id is not null and toxic = 1").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce("quality", F.lit(0))).alias("quality"))
    toxic = scratch.keep(counts.join(marks, "doc_id").select(*KEYS, F.col("n_clean").alias("n_tokens"), "quality"))
    revised = counts.where("n_clean <> n_tokens").select(*KEYS, F.col("n_clean").alias("n_tokens"), F.col("n_tokens").alias("old_n_tokens"))
    for batch_id, op, rows in (("load", "insert", counts), ("clean", "revise", revised), ("toxic", "delete", toxic), ("appeal", "insert", toxic.where("quality = 1"))):
        for _ in range(2):
            ledger.commit(batch_id, rows.withColumn("op", F.lit(op)))
        if batch_id == "clean":
            ledger.compact()
    return ledger.totals()


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """source, lang, tokenizer, n_docs and n_tokens, kept up to date by batches over all documents."""
    ledger = Ledger(spark, f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}")
    return apply_batches(ledger, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
