"""Structured Streaming extension: windowed counts over the events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources.world import World


def counts(stream: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts by window and type; rows later than `late` are left out of a running stream, as their state is gone."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp("window.start").alias("start"), "event_type", "n")


def hourly_counts(w: World) -> DataFrame:
    """All files that are there now, read as a stream; the result is what the last batch wrote."""
    spark, at = w.spark, f"{shared_folder(w.spark)}/stream-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{w.folder}/events.parquet")
    reader = spark.readStream.schema(w.table("events").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        stream = reader.parquet(f"{w.folder}/events.parquet")
    else:
        stream = reader.option("pathGlobFilter", "events.parquet").parquet(w.folder)

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out")

    counts(stream).writeStream.outputMode("complete").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{at}/out")
