"""What the training-data operators share: word rules, hashing, shared folders, components."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than the six ASCII white-space ones; bytes.split() follows the same rule.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Odd multiplier of the window hashes.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A name that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text) -> "F.Column":
    """The words of a text column as an array; null gives no words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; one of our own only if that is unset in local mode, as executors elsewhere
    wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        import tempfile

        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/terravane-shared"
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a file system that Spark can reach."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Written tables in the shared folder that cut lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, per_file: int = 0) -> DataFrame:
        """per_file bounds the rows of a file: large rows are held by writer and reader a file at a time, whatever their bytes come to."""
        self.n += 1
        df.write.option("maxRecordsPerFile", per_file).parquet(path := f"{self.at}/{self.n}")
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        remove(self.spark, df._scratch_path)


#: Longs of the bitmap of likely().
WORDS = 1 << 18


def likely(rows: DataFrame, wanted: DataFrame, key: str, may: bool = True) -> DataFrame:
    """The rows whose key may be in wanted, told by a bitmap of fixed size: all that are, and few others while wanted has fewer keys than bits.
    Without `may` the other rows.

    It keeps most other rows out of the shuffle of a join, which is exact whatever the bitmap lets through.
    """
    h = F.xxhash64(F.col(key), F.lit("likely"))
    word, bit = h.bitwiseAND(F.lit(WORDS - 1)), F.shiftrightunsigned(h, 58).cast("int")
    at, bits = fresh(rows, "word"), fresh(rows, "bits")
    bitmap = wanted.where(F.col(key).isNotNull()).select(word.alias(at), F.shiftleft(F.lit(1).cast("long"), 0).alias(bits), bit.alias("bit"))
    bitmap = bitmap.groupBy(at).agg(F.bit_or(F.expr(f"shiftleft({bits}, bit)")).alias(bits))
    marked = rows.withColumn(at, word).join(F.broadcast(bitmap), at, "inner" if may else "left")
    hit = F.expr(f"shiftright({bits}, cast(shiftrightunsigned(xxhash64({key}, 'likely'), 58) as int)) & 1")
    return marked.where(F.coalesce(hit, F.lit(0)) == int(may)).select(*rows.columns)


def texts(batches: Iterator[pa.RecordBatch], most: int = 4 << 20, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of Arrow batches with their whole texts as UTF-8 bytes (None for null), of about `most` bytes each."""
    for batch in batches:
        at = batch.schema.get_field_index(text)
        start, found, held = 0, [], 0
        for low in range(0, batch.num_rows, 64):
            some = batch.column(at).slice(low, 64).cast(pa.binary()).to_pylist()
            found += some
            held += sum(len(t) for t in some if t is not None)
            if held >= most:
                yield batch.slice(start, len(found)), found
                start, found, held = start + len(found), [], 0
        if found:
            yield batch.slice(start), found
    release()


def release() -> None:
    """Gives freed memory back to the system, as idle Python workers stay beside the next stage's executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others need none
    if trim is not None:
        trim(0)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not words:
        return np.empty(0, np.uint64)
    a = np.empty(len(words), object)
    a[:] = words
    return pd.util.hash_array(a, categorize=False)


def windows(h: np.ndarray, k: int, by: np.uint64 = MULTIPLIER) -> np.ndarray:
    """The hash of each run of k consecutive word hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= by
        out += h[j : n + j]
    out ^= out >> np.uint64(29)
    return out


def signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node reachable.

    Alternates large-star and small-star steps until nothing changes; each step is two shuffles of the
    edges, written to the shared folder. Nothing is gathered on the driver but a count and a checksum.
    Nulls are ignored; no edges give no rows.
    """
    now = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small_min = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_min, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = scratch.keep(small)
        mark = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        scratch.drop(now)
        now = after
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
