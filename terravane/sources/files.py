"""Sources and sinks: JSON, GeoJSON, globs with provenance, rasters, quantised columns, memoised stages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import unique


def read_json(spark: SparkSession, path: str, schema: str, lines: bool = True) -> DataFrame:
    """JSON files, one row for each line or one for each file, with a stated schema."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Compact JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


FEATURES = "type string, name string, features array<struct<type:string,properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of GeoJSON files: properties, geometry type, coordinates as JSON text."""
    return spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties", F.col("f.geometry.type").alias("geometry"), F.col("f.geometry.coordinates").alias("coordinates"))


POINT, LINE, POLYGON, MULTI = (f"{'array<' * n}double{'>' * n}" for n in (1, 2, 3, 4))


def polygons(geometry: str = "geometry", coordinates: str = "coordinates") -> Column:
    """Polygons and multipolygons alike as a list of polygons."""
    return F.when(F.col(geometry) == "Polygon", F.array(F.from_json(coordinates, POLYGON))).when(F.col(geometry) == "MultiPolygon", F.from_json(coordinates, MULTI))


def feature(geometry: str, coordinates: Column, properties: Column) -> Column:
    """GeoJSON text of a feature."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), F.struct(F.lit(geometry).alias("type"), coordinates.alias("coordinates")).alias("geometry")))


def collection(features: DataFrame, text: str, name: str) -> DataFrame:
    """One FeatureCollection text, for a catalogue of a few features; others are written as lines (write_collection)."""
    body = F.array_join(F.array_sort(F.collect_list(text)), ",")
    return features.agg(F.concat(F.lit('{"type":"FeatureCollection","name":"' + name + '","features":['), body, F.lit("]}")).alias("json"))


def collection_lines(features: DataFrame, text: str, key: str, name: str) -> DataFrame:
    """part, place, line: the lines of a FeatureCollection, its head (part 0), a feature each in order of the key, its end."""
    first = features.agg(F.min(key).alias("_first"))
    comma = F.when(F.col(key) == F.col("_first"), "").otherwise(",")
    body = features.crossJoin(F.broadcast(first)).select(F.lit(1).alias("part"), F.col(key).cast("long").alias("place"), F.concat(comma, F.col(text)).alias("line"))  # one row
    ends = features.sparkSession.createDataFrame([(0, 0, '{"type":"FeatureCollection","name":"' + name + '","features":['), (2, 0, "]}")], "part int, place long, line string")
    return body.union(ends)


def write_collection(features: DataFrame, text: str, key: str, name: str, path: str) -> None:
    """Writes a FeatureCollection as text files that are one JSON text when put together in order of their names; keys are unique."""
    collection_lines(features, text, key, name).repartitionByRange("part", "place").sortWithinPartitions("part", "place").select("line").write.mode("overwrite").text(path)


def read_many(spark: SparkSession, glob: str, schema: str, key: str) -> DataFrame:
    """Files of a glob with the file's name as _file; a key that occurs twice fails the query."""
    return unique(spark.read.schema(schema).json(glob).withColumn("_file", F.col("_metadata.file_name")), key)


def flatten_points(points: Column, stride: int = 2) -> Column:
    """[x, y, ...] of a list of points."""
    return F.flatten(F.transform(points, lambda p: F.array(*[p[n] for n in ("x", "y", "z")[:stride]])))


def unflatten_points(flat: Column, stride: int = 2) -> Column:
    return F.transform(F.sequence(F.lit(0), (F.size(flat) / stride).cast("int") - 1), lambda i: F.struct(*[F.get(flat, i * stride + k).alias(n) for k, n in enumerate(("x", "y", "z")[:stride])]))


def write_raster(cells: DataFrame, value: str, path: str) -> None:
    """Rows of a raster as float32 bytes: a table of (iy, data)."""
    rows = cells.groupBy("iy").agg(F.transform(F.array_sort(F.collect_list(F.struct("ix", value))), lambda s: s[value].cast("float")).alias("a"))

    def pack(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(a, "<f4").tobytes() for a in b.column(1).to_pylist()], pa.binary())], names=["iy", "data"])

    rows.select("iy", "a").mapInArrow(pack, "iy long, data binary").write.mode("overwrite").parquet(path)


def read_raster(spark: SparkSession, path: str) -> DataFrame:
    """Cells (ix, iy, v) of a raster that write_raster wrote."""
    return _unpacked(spark.read.parquet(path).select("iy", "data"))


def read_raw_raster(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Cells (ix, iy, v) of raw little-endian float32 files, row by row, any number of bands one below the other."""
    whole = spark.read.format("binaryFile").load(path).select("content")
    row = 4 * width
    rows = whole.select(F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("content") / row).cast("int") - 1), lambda i: F.expr("content").substr(i * row + 1, F.lit(row)))).alias("iy", "data"))
    return _unpacked(rows.select(F.col("iy").cast("long").alias("iy"), "data"))


def _unpacked(rows: DataFrame) -> DataFrame:
    def unpack(batches):
        for b in batches:
            a = [np.frombuffer(d, "<f4") for d in b.column(1).to_pylist()]
            n = [len(x) for x in a]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.arange(k) for k in n]) if n else [], pa.int64()), pa.array(np.repeat(b.column(0).to_numpy(zero_copy_only=False), n), pa.int64()), pa.array(np.concatenate(a).astype(float) if a else [], pa.float64())], names=["ix", "iy", "v"])

    return rows.mapInArrow(unpack, "ix long, iy long, v double")


def snap(x: Column, step: float) -> Column:
    """Rounds to multiples of a step."""
    return F.round(x / step) * step


def sqrt_levels(d: Column, most: float, levels: int = 255) -> Column:
    """Square-root scale of small whole numbers."""
    return F.round(F.sqrt(F.greatest(F.lit(0.0), F.least(d, F.lit(most))) / most) * levels).cast("long")


def dead_zone_levels(d: Column, levels: int = 32, zone: float = 0.03) -> Column:
    return F.when(d < zone, 0).otherwise(F.floor(d * levels)).cast("long")


def content_key(*columns: str) -> Column:
    """A hash of a row's definition, by which unchanged rows are known."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def changed(now: DataFrame, known: DataFrame, key: str = "hash") -> DataFrame:
    """The rows whose content isn't in the table of earlier results: only they are computed again."""
    return now.join(known.select(key).distinct(), key, "left_anti")


def memo(df: DataFrame, path: str) -> DataFrame:
    """A stage's result from its folder, written there first if it isn't yet."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def manifest(**tables: DataFrame) -> DataFrame:
    """name, rows, columns and the extent of the first column of each table."""
    parts = []
    for name, df in tables.items():
        key = F.col(df.columns[0])
        parts.append(df.agg(F.count("*").alias("n"), F.min(key).cast("double").alias("lo"), F.max(key).cast("double").alias("hi")).select(F.lit(name).alias("name"), "n", F.lit(len(df.columns)).cast("long").alias("columns"), "lo", "hi"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
