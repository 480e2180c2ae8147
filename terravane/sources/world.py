"""The relations that queries read: the star tables, and points, tracks, zones, a graph and a raster derived from them by integer arithmetic.

SQL holds the same derivations for an SQL engine, so both sides see equal values.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed

#: Cells of the derived raster.
NX, NY = 100, 50


class World:
    """Lazy tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def optional(self, name: str, schema: str) -> DataFrame:
        """The table, or an empty one of the schema if the folder doesn't have it."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
        if at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            return self.table(name)
        return self.spark.createDataFrame([], schema)

    @functools.cached_property
    def pts(self) -> DataFrame:
        return self.table("events").selectExpr("event_id as id", "(event_id * 7919 + user_id * 104729) % 2000 as x", "(event_id * 6101 + user_id * 15485863) % 667 as y", "user_id", "ts", "event_type", "value")

    @functools.cached_property
    def track(self) -> DataFrame:
        """Points of a user in order of time, numbered from 1."""
        return self.pts.withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id")).cast("long"))

    @functools.cached_property
    def zone(self) -> DataFrame:
        """Overlapping rectangles; zid is the priority, lowest first."""
        return self.table("nation").selectExpr("cast(n_nationkey as bigint) as zid", "n_name as zname", "cast((n_nationkey % 5) * 400 - 40 as bigint) as x0", "cast((n_nationkey % 5) * 400 + 380 as bigint) as x1", "cast((n_nationkey div 5) * 133 - 20 as bigint) as y0", "cast((n_nationkey div 5) * 133 + 120 as bigint) as y1")

    @functools.cached_property
    def gedge(self) -> DataFrame:
        """Edges between even nodes (orders) and odd ones (eight for each seven orders), from every line of every order."""
        e = self.table("lineitem").selectExpr("l_orderkey * 2 as src", "((l_orderkey div 7) * 8 + l_partkey % 8) * 2 + 1 as dst").distinct()
        return e.selectExpr("src * 10000000 + dst as eid", "src", "dst", "(src * 7 + dst * 13) % 97 + 1 as len", "(src + dst * 3) % 6 as kind")

    @functools.cached_property
    def gnode(self) -> DataFrame:
        n = self.gedge.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        return n.selectExpr("node", "(node * 37) % 2000 as x", "(node * 91) % 667 as y")

    @functools.cached_property
    def snode(self) -> DataFrame:
        """Corners of streets, one for each order, on a shaken grid as wide as high."""
        o = self.table("orders")
        wide = o.agg(F.floor(F.sqrt(F.max("o_orderkey") + 1)).alias("wide"))
        o = o.crossJoin(F.broadcast(wide))  # one row
        return o.selectExpr("o_orderkey as node", "(o_orderkey % wide) * 100 + (o_custkey * 37) % 60 as x", "(o_orderkey div wide) * 100 + (o_custkey * 53 + o_orderkey * 29) % 60 as y", "o_orderkey % wide < wide - 1 and (o_custkey + o_orderkey) % 5 <> 0 as right", "(o_custkey * 3 + o_orderkey) % 4 <> 0 as up", "wide", "o_custkey % 6 as kind")

    @functools.cached_property
    def street(self) -> DataFrame:
        """Streets between neighbouring corners, which cross nowhere else; most of them are connected."""
        n = self.snode
        e = n.where("right").selectExpr("node * 2 as eid", "node as src", "node + 1 as dst", "kind").union(n.where("up").selectExpr("node * 2 + 1", "node", "node + wide", "(kind + 1) % 6"))
        ends = [n.selectExpr(f"node as {k}", f"x as x{i}", f"y as y{i}") for i, k in enumerate(("src", "dst"))]
        return e.join(ends[0], "src").join(ends[1], "dst").select("eid", "src", "dst", "kind", "x0", "y0", "x1", "y1")

    @functools.cached_property
    def ras(self) -> DataFrame:
        """A dense raster of NX by NY cells: value v, class cls."""
        grid = self.spark.range(NX * NY).selectExpr(f"id % {NX} as ix", f"id div {NX} as iy")
        v = self.table("lineitem").groupBy((F.col("l_partkey") % NX).alias("ix"), (F.col("l_suppkey") % NY).alias("iy")).agg(F.expr("sum(cast(l_quantity as bigint)) as v"), F.expr("cast(max(l_linenumber) % 5 as bigint) as cls"))
        return grid.join(v, ["ix", "iy"], "left").selectExpr("ix", "iy", "coalesce(v, 0) as v", "coalesce(cls, 0) as cls")

    @functools.cached_property
    def spans(self) -> DataFrame:
        """Ten intervals of seq for each user; some touch or overlap, some are near."""
        return self.pts.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("k")).selectExpr("user_id", "k", "10 * k as s0", "10 * k + (k * 7 + user_id) % 14 as s1")

    @functools.cached_property
    def dim(self) -> DataFrame:
        """The catalogue of road types, as a small table."""
        return self.spark.createDataFrame(fixed.ROAD_TYPES, "kind long, type string, rank double, width double, lanes long, max_grade double, min_radius double")


_DIM = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS {'BIGINT' if isinstance(v, int) else 'DOUBLE'})" for v in row) + ")" for row in fixed.ROAD_TYPES)
SQL = f"""
pts AS (SELECT event_id AS id, (event_id * 7919 + user_id * 104729) % 2000 AS x, (event_id * 6101 + user_id * 15485863) % 667 AS y, user_id, ts, event_type, value FROM events),
track AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS seq FROM pts),
zone AS (SELECT CAST(n_nationkey AS BIGINT) AS zid, n_name AS zname, CAST((n_nationkey % 5) * 400 - 40 AS BIGINT) AS x0, CAST((n_nationkey % 5) * 400 + 380 AS BIGINT) AS x1, CAST((n_nationkey // 5) * 133 - 20 AS BIGINT) AS y0, CAST((n_nationkey // 5) * 133 + 120 AS BIGINT) AS y1 FROM nation),
gedge AS (SELECT src * 10000000 + dst AS eid, src, dst, (src * 7 + dst * 13) % 97 + 1 AS len, (src + dst * 3) % 6 AS kind FROM (SELECT DISTINCT l_orderkey * 2 AS src, ((l_orderkey // 7) * 8 + l_partkey % 8) * 2 + 1 AS dst FROM lineitem)),
gnode AS (SELECT node, (node * 37) % 2000 AS x, (node * 91) % 667 AS y FROM (SELECT src AS node FROM gedge UNION SELECT dst FROM gedge)),
snode AS (SELECT o_orderkey AS node, (o_orderkey % wide) * 100 + (o_custkey * 37) % 60 AS x, (o_orderkey // wide) * 100 + (o_custkey * 53 + o_orderkey * 29) % 60 AS y, o_orderkey % wide < wide - 1 AND (o_custkey + o_orderkey) % 5 <> 0 AS to_right, (o_custkey * 3 + o_orderkey) % 4 <> 0 AS to_up, wide, o_custkey % 6 AS kind
  FROM orders, (SELECT CAST(floor(sqrt(max(o_orderkey) + 1)) AS BIGINT) AS wide FROM orders)),
street AS (SELECT e.*, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM (SELECT node * 2 AS eid, node AS src, node + 1 AS dst, kind FROM snode WHERE to_right UNION ALL SELECT node * 2 + 1, node, node + wide, (kind + 1) % 6 FROM snode WHERE to_up) e JOIN snode a ON a.node = src JOIN snode b ON b.node = dst),
ras AS (SELECT g.ix, g.iy, CAST(coalesce(v, 0) AS BIGINT) AS v, CAST(coalesce(cls, 0) AS BIGINT) AS cls FROM (SELECT i % {NX} AS ix, i // {NX} AS iy FROM range({NX * NY}) t(i)) g
  LEFT JOIN (SELECT l_partkey % {NX} AS ix, l_suppkey % {NY} AS iy, sum(CAST(l_quantity AS BIGINT)) AS v, max(l_linenumber) % 5 AS cls FROM lineitem GROUP BY 1, 2) q ON q.ix = g.ix AND q.iy = g.iy),
spans AS (SELECT user_id, k, 10 * k AS s0, 10 * k + (k * 7 + user_id) % 14 AS s1 FROM (SELECT DISTINCT user_id FROM pts), range(10) r(k)),
dim AS (SELECT * FROM (VALUES {_DIM}) d(kind, type, rank, width, lanes, max_grade, min_radius))
"""
