"""Queries of sources and sinks (S), and of the streaming extension (X)."""

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.graph import shared_folder
from ..sources import files as I
from .registry import query

R = F.round


def _at(w, name):
    return f"{shared_folder(w.spark)}/{name}-{uuid.uuid4().hex}"


@query("s01_json_scan", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation")
def _(w):
    path = _at(w, "json")
    I.write_json(w.table("nation").selectExpr("cast(n_nationkey as bigint) as k", "n_name as name"), path)
    return I.read_json(w.spark, path, "k long, name string")


@query("s03_geojson_scan", "SELECT CAST(zid AS VARCHAR) AS id, x0 * 1.0 AS x, y0 * 1.0 AS y FROM zone")
def _(w):
    """Zones written as features, read again: properties and the first corner."""
    ring = F.array(*[F.array(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    f = w.zone.select(I.feature("Polygon", F.array(ring), F.struct(F.col("zid").cast("string").alias("id"))).alias("f"))
    path = _at(w, "geojson")
    I.collection(f, "f", "zones").write.text(path)
    got = I.read_features(w.spark, path)
    return got.select(F.col("properties")["id"].alias("id"), I.polygons()[0][0][0][0].alias("x"), I.polygons()[0][0][0][1].alias("y"))


@query("s04_feature_build", """SELECT zid, '{"type":"Feature","properties":{"id":' || CAST(zid AS VARCHAR) || '},"geometry":{"type":"Point","coordinates":[' || CAST(CAST(x0 AS DOUBLE) AS VARCHAR) || ',' || CAST(CAST(y0 AS DOUBLE) AS VARCHAR) || ']}}' AS f FROM zone""")
def _(w):
    return w.zone.select("zid", I.feature("Point", F.array(R(F.col("x0").cast("double"), 2), R(F.col("y0").cast("double"), 2)), F.struct(F.col("zid").alias("id"))).alias("f"))


@query("s05_feature_collection", """SELECT 0 AS part, '{"type":"FeatureCollection","name":"points","features":[' AS line, 0 AS place UNION ALL SELECT 2, ']}', 0
UNION ALL SELECT 1, CASE WHEN id = (SELECT min(id) FROM pts) THEN '' ELSE ',' END || '{"type":"Feature","properties":{"id":' || id || ',"kind":"' || event_type || '"},"geometry":{"type":"Point","coordinates":[' || CAST(x AS DOUBLE) || ',' || CAST(y AS DOUBLE) || ']}}', id FROM pts""")
def _(w):
    """All points as the lines of one collection; the sink's files are these lines in order."""
    f = w.pts.select("id", I.feature("Point", F.array(F.col("x").cast("double"), F.col("y").cast("double")), F.struct("id", F.col("event_type").alias("kind"))).alias("f"))
    return I.collection_lines(f, "f", "id", "points")


@query("s06_glob_scan", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region")
def _(w):
    path = _at(w, "glob")
    rows = w.table("region").selectExpr("cast(r_regionkey as bigint) as k", "r_name as name")
    I.write_json(rows.where("k < 2"), f"{path}/a")
    I.write_json(rows.where("k >= 2"), f"{path}/b")
    return I.read_many(w.spark, f"{path}/*", "k long, name string", "k").drop("_file")


@query("s07_raster_round_trip", "SELECT ix, iy, CAST(v AS DOUBLE) AS v FROM ras")
def _(w):
    """Also s08: rows of the raster as packed bytes."""
    path = _at(w, "raster")
    I.write_raster(w.ras, "v", path)
    return I.read_raster(w.spark, path)


@query("s02_json_sink", "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name, CAST(NULL AS DOUBLE) AS note FROM region")
def _(w):
    """Nulls are written as such, so every row keeps its columns."""
    path = _at(w, "sink")
    I.write_json(w.table("region").selectExpr("cast(r_regionkey as bigint) as k", "r_name as name", "cast(null as double) as note"), path)
    lines = w.spark.read.text(path)
    return lines.select(F.from_json("value", "k long, name string, note double").alias("r")).where(F.col("value").contains('"note":null')).select("r.*")


@query("s08_raster_sink", "SELECT iy, count(*) * 4 AS bytes FROM ras GROUP BY iy")
def _(w):
    path = _at(w, "tiles")
    I.write_raster(w.ras, "v", path)
    return w.spark.read.parquet(path).select("iy", F.length("data").cast("long").alias("bytes"))


#: Tables by name, with their keys.
_TABLES = dict(t.split(":") for t in "region:r_regionkey nation:n_nationkey customer:c_custkey supplier:s_suppkey part:p_partkey orders:o_orderkey lineitem:l_orderkey events:event_id documents:doc_id embeddings:vec_id pages:page_id benchmark:item_id labels:doc_id conversations:conv_id".split())


@query("s17_manifest", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, (SELECT count(*) FROM (SELECT unnest(x) FROM (SELECT json_keys(to_json(q)) AS x FROM (SELECT * FROM {t} LIMIT 1) q))) AS columns, CAST(min({k}) AS DOUBLE) AS lo, CAST(max({k}) AS DOUBLE) AS hi FROM {t}" for t, k in _TABLES.items()))
def _(w):
    """All tables with their rows, columns and the extent of their keys."""
    return I.manifest(**{t: w.table(t) for t in _TABLES})


@query("v07_tile_table", "SELECT ix // 25 AS tx, iy // 25 AS ty, CAST(sum(v) AS BIGINT) AS s FROM ras GROUP BY 1, 2")
def _(w):
    """Tiles computed once, written by tile, and read back; the second read computes nothing."""
    tiles = w.ras.groupBy(F.expr("ix div 25").alias("tx"), F.expr("iy div 25").alias("ty")).agg(F.sum("v").alias("s"))
    path = _at(w, "tile-table")
    I.memo(tiles, path)
    return I.memo(tiles, path)


@query("s09_quantise", ", q AS (SELECT min(v) AS lo, max(v) AS hi FROM ras), e AS (SELECT ix, iy, lo, hi, CAST(greatest(0, least(65535, round((v - lo) * 1.0 / (hi - lo) * 65535))) AS BIGINT) AS q FROM ras, q) SELECT ix, iy, q, round(lo + q / 65535.0 * (hi - lo), 3) AS back FROM e")
def _(w):
    e = w.ras.crossJoin(F.broadcast(w.ras.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))).withColumn("q", S.quantise("v", "lo", "hi"))
    return e.select("ix", "iy", "q", R(S.dequantise("q", "lo", "hi"), 3).alias("back"))


@query("s10_small_levels", "SELECT id, CAST(round(255 * sqrt(least(y, 500) / 500.0)) AS BIGINT) AS s, CASE WHEN y / 667.0 < 0.03 THEN 0 ELSE CAST(floor(y / 667.0 * 32) AS BIGINT) END AS d FROM pts")
def _(w):
    return w.pts.select("id", I.sqrt_levels(F.col("y").cast("double"), 500.0).alias("s"), I.dead_zone_levels(F.col("y") / 667.0).alias("d"))


@query("s11_grid_snap", "SELECT id, round(x / 7.0) * 7.0 AS sx FROM pts")
def _(w):
    return w.pts.select("id", I.snap(F.col("x"), 7.0).alias("sx"))


@query("s14_catalogue", "SELECT 'pts' AS name, count(*) AS n FROM pts UNION ALL SELECT 'zone', count(*) FROM zone UNION ALL SELECT 'ras', count(*) FROM ras UNION ALL SELECT 'gedge', count(*) FROM gedge")
def _(w):
    return I.manifest(pts=w.pts, zone=w.zone, ras=w.ras, gedge=w.gedge).select("name", "n")


@query("s15_flatten_points", "SELECT user_id, string_agg(CAST(x AS VARCHAR) || ',' || CAST(y AS VARCHAR), ',' ORDER BY seq) AS flat, count(*) AS n FROM track GROUP BY user_id")
def _(w):
    a = w.track.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("a")).withColumn("f", I.flatten_points(F.col("a")))
    return a.select("user_id", F.array_join(F.col("f").cast("array<string>"), ",").alias("flat"), F.size(I.unflatten_points(F.col("f"))).cast("long").alias("n"))


@query("s16_polygon_normalisation", "SELECT zid, CASE WHEN zid % 2 = 0 THEN 1 ELSE 2 END AS n FROM zone")
def _(w):
    one = "[[[0,0],[1,0],[1,1],[0,0]]]"
    z = w.zone.select("zid", F.when(F.col("zid") % 2 == 0, "Polygon").otherwise("MultiPolygon").alias("geometry"), F.when(F.col("zid") % 2 == 0, one).otherwise(f"[{one},{one}]").alias("coordinates"))
    return z.select("zid", F.size(I.polygons()).cast("long").alias("n"))


@query("s18_memoised_stage", "SELECT event_type, count(*) AS n FROM pts GROUP BY 1")
def _(w):
    path = _at(w, "memo")
    stage = w.pts.groupBy("event_type").agg(F.count("*").alias("n"))
    I.memo(stage, path)
    return I.memo(stage, path)


@query("s19_incremental", "SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3")
def _(w):
    """Of the customers only those whose definition has changed are left to do."""
    now = w.table("customer").select("c_custkey", "c_name", "c_nationkey")
    was = now.where("c_custkey % 10 <> 3").withColumn("hash", I.content_key("c_custkey", "c_name", "c_nationkey"))
    return I.changed(now.withColumn("hash", I.content_key("c_custkey", "c_name", "c_nationkey")), was).select("c_custkey")


@query("s20_optional_input", "SELECT id, CAST(NULL AS BIGINT) AS override FROM pts")
def _(w):
    return w.pts.join(w.optional("road_overrides", "id long, override long"), "id", "left").select("id", "override")


@query("s22_chunk_export", ", b AS (SELECT x // 100 AS cx, y // 100 AS cy, event_type AS g, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY 1, 2, 3) SELECT p.id, CASE WHEN x1 > x0 THEN CAST(round((x - x0) * 65535.0 / (x1 - x0)) AS BIGINT) ELSE 0 END AS qx, CASE WHEN y1 > y0 THEN CAST(round((y - y0) * 65535.0 / (y1 - y0)) AS BIGINT) ELSE 0 END AS qy FROM pts p JOIN b ON cx = x // 100 AND cy = y // 100 AND g = event_type")
def _(w):
    """Positions as whole numbers within the box of their chunk and group; the boxes are windows, so the points are shuffled once."""
    from pyspark.sql import Window

    by = Window.partitionBy("cx", "cy", "event_type")
    p = w.pts.withColumns({"cx": F.expr("x div 100"), "cy": F.expr("y div 100")})
    q = lambda v: F.when(F.max(v).over(by) > F.min(v).over(by), F.round((F.col(v) - F.min(v).over(by)) * 65535.0 / F.nullif(F.max(v).over(by) - F.min(v).over(by), F.lit(0)))).otherwise(0).cast("long")
    return p.select("id", q("x").alias("qx"), q("y").alias("qy"))


@query("x01_stream_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(w):
    """An extension: hourly counts of the events as a stream that ends."""
    from ..streaming.windows import hourly_counts

    return hourly_counts(w)
