"""Queries of the spatial join, geometry and viewer families (J, K, V)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import sequence as Q
from ..operators import spatial as P
from ..operators.graph import cut
from .registry import query

R = F.round
_IN = "p.x >= z.x0 AND p.x < z.x1 AND p.y >= z.y0 AND p.y < z.y1"


def _zoned(w):
    return P.first_zone(w.pts, w.zone.withColumn("ring", P.rectangle_ring("x0", "y0", "x1", "y1")))


def _grid_nodes(w):
    return w.gnode.select("node", "x", "y")


def _nodes(w, name="node", x="bx", y="by"):
    return w.gnode.select(F.col("node").alias(name), F.col("x").alias(x), F.col("y").alias(y))


_SEG = "seg AS (SELECT id AS sid, x AS x0, y AS y0, x + id % 37 - 18 AS x1, y + (id * 7) % 41 - 20 AS y1 FROM pts)"


def _segments(w):
    return w.pts.selectExpr("id as sid", "x as x0", "y as y0", "x + id % 37 - 18 as x1", "y + (id * 7) % 41 - 20 as y1")


@query("j03_zone_event_counts", f""", m AS (SELECT p.id, min(z.zid) AS zid FROM pts p JOIN zone z ON {_IN} GROUP BY p.id) SELECT zname, event_type, count(*) AS n, round(sum(value), 2) AS total FROM pts JOIN m USING (id) JOIN zone USING (zid) GROUP BY 1, 2""")
def _(w):
    return _zoned(w).join(F.broadcast(w.zone.select("zid", "zname")), "zid").groupBy("zname", "event_type").agg(F.count("*").alias("n"), R(F.sum("value"), 2).alias("total"))


@query("j03_first_zone", f"SELECT p.id, min(z.zid) AS zid FROM pts p LEFT JOIN zone z ON {_IN} GROUP BY p.id")
def _(w):
    return _zoned(w).select("id", "zid")


@query("j03_diamond_zones", """, d AS (SELECT zid, (x0 + x1) / 2.0 AS mx, (y0 + y1) / 2.0 AS my, (x1 - x0) / 2.0 AS hw, (y1 - y0) / 2.0 AS hh FROM zone)
SELECT p.id, min(d.zid) AS zid FROM pts p LEFT JOIN d ON abs(p.x + 0.3 - mx) / hw + abs(p.y + 0.2 - my) / hh < 1 GROUP BY p.id""")
def _(w):
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    mx, my = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    z = w.zone.withColumn("ring", F.array(point(mx, F.col("y0")), point(F.col("x1"), my), point(mx, F.col("y1")), point(F.col("x0"), my)))
    p = w.pts.select("id", (F.col("x") + 0.3).alias("x"), (F.col("y") + 0.2).alias("y"))
    return P.first_zone(p, z).select("id", "zid")


@query("j04_nearest_neighbour", "SELECT id, arg_min(node, d * 1e7 + node) AS node, round(sqrt(min(d)), 4) AS dist FROM (SELECT p.id, g.node, (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y) AS d FROM pts p, gnode g) GROUP BY id")
def _(w):
    return P.nearest(w.pts, _grid_nodes(w), "id", "node", 4.0).select("id", "node", R("dist", 4).alias("dist"))


@query("j05_k_nearest", ", n AS (SELECT id, arg_min({'n': node, 'd': d}, (d, node), 6) AS l FROM (SELECT p.id, g.node, (p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y) AS d FROM pts p JOIN gnode g ON g.x BETWEEN p.x - 200 AND p.x + 200) GROUP BY id) SELECT id, round(list_min(list_transform(l, lambda e: sqrt(e.d) + e.n % 10)), 4) AS best, len(l) AS k FROM n")
def _(w):
    near = P.nearest(w.pts, _grid_nodes(w), "id", "node", 8.0, k=6)
    return near.groupBy("id").agg(R(F.min(F.col("dist") + F.col("node") % 10), 4).alias("best"), F.max("rank").alias("k"))


@query("j06_nearest_within_bound", "SELECT p.id, arg_min(g.node, (power(p.x - g.x, 2) + power(p.y - g.y, 2)) * 1e7 + g.node) AS node FROM pts p LEFT JOIN gnode g ON power(p.x - g.x, 2) + power(p.y - g.y, 2) <= 625 GROUP BY p.id")
def _(w):
    near = P.nearest(w.pts, _grid_nodes(w), "id", "node", 25.0, most=25.0).select("id", "node")
    return w.pts.select("id").join(near, "id", "left")


@query("j07_nearest_of_few", "SELECT p.id, arg_min(z.zid, abs(2 * p.x - z.x0 - z.x1) * 1000 + abs(2 * p.y - z.y0 - z.y1) * 1000 + z.zid) AS zid FROM pts p, zone z GROUP BY p.id")
def _(w):
    """All zones against each point: their number is that of nations."""
    z = F.broadcast(w.zone.agg(F.collect_list(F.struct("zid", "x0", "x1", "y0", "y1")).alias("zones")))  # one row
    d = lambda e: F.abs(2 * F.col("x") - e["x0"] - e["x1"]) + F.abs(2 * F.col("y") - e["y0"] - e["y1"])
    return w.pts.crossJoin(z).select("id", F.array_min(F.transform("zones", lambda e: F.struct(d(e).alias("d"), e["zid"].alias("zid"))))["zid"].alias("zid"))


@query("j08_distance_within", "SELECT p.id, g.node FROM pts p JOIN gnode g ON power(p.x - g.x, 2) + power(p.y - g.y, 2) <= 36")
def _(w):
    return P.all_within(w.pts, w.gnode.select("node", "x", "y"), 6.0, other="node")


@query("j09_radius_self_join", "SELECT a.id AS a, b.id AS b FROM pts a JOIN pts b ON b.id > a.id + 5 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 36")
def _(w):
    a, b = w.pts.select(F.col("id").alias("a"), "x", "y"), w.pts.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return P.within(a, b, 6.0, bx="bx", by="by").where("b > a + 5").select("a", "b")


_X = """q AS (SELECT a.sid AS a, b.sid AS b, a.x0 AS ax0, a.y0 AS ay0, a.x1 AS ax1, a.y1 AS ay1, (a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0) AS d1, (a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0) AS d2,
 (b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0) AS d3, (b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0) AS d4 FROM seg a JOIN seg b ON a.sid < b.sid AND abs(a.x0 - b.x0) <= 40 AND abs(a.y0 - b.y0) <= 44)"""


@query("j10_line_crossings", f", {_SEG}, {_X} SELECT a, b, round(ax0 + d3 / CAST(d3 - d4 AS DOUBLE) * (ax1 - ax0), 3) AS px, round(ay0 + d3 / CAST(d3 - d4 AS DOUBLE) * (ay1 - ay0), 3) AS py FROM q WHERE sign(d1) * sign(d2) < 0 AND sign(d3) * sign(d4) < 0")
def _(w):
    x = P.crossings(_segments(w), _segments(w), 40.0).where("a_sid < b_sid")
    return x.select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"), R("px", 3).alias("px"), R("py", 3).alias("py"))


_CLIP = """CASE WHEN x1 = x0 AND (x0 < bx0 OR x0 > bx1) OR y1 = y0 AND (y0 < by0 OR y0 > by1) THEN 0.0 ELSE greatest(0.0, least(1.0, CASE WHEN x1 <> x0 THEN greatest((bx0 - x0) / CAST(x1 - x0 AS DOUBLE), (bx1 - x0) / CAST(x1 - x0 AS DOUBLE)) ELSE 1.0 END, CASE WHEN y1 <> y0 THEN greatest((by0 - y0) / CAST(y1 - y0 AS DOUBLE), (by1 - y0) / CAST(y1 - y0 AS DOUBLE)) ELSE 1.0 END)
 - greatest(0.0, CASE WHEN x1 <> x0 THEN least((bx0 - x0) / CAST(x1 - x0 AS DOUBLE), (bx1 - x0) / CAST(x1 - x0 AS DOUBLE)) ELSE 0.0 END, CASE WHEN y1 <> y0 THEN least((by0 - y0) / CAST(y1 - y0 AS DOUBLE), (by1 - y0) / CAST(y1 - y0 AS DOUBLE)) ELSE 0.0 END)) END"""


@query("j11_line_polygon_overlay", f", {_SEG}, c AS (SELECT sid, zid, {_CLIP} AS share, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS len FROM seg, (SELECT zid, x0 AS bx0, x1 AS bx1, y0 AS by0, y1 AS by1 FROM zone)) SELECT zid, count(*) AS n, round(sum(share * len), 2) AS length FROM c WHERE share > 0 GROUP BY zid")
def _(w):
    """Length of segments inside each box; the boxes, as many as nations, are sent to all tasks."""
    z = F.broadcast(w.zone.selectExpr("zid", "x0 as bx0", "x1 as bx1", "y0 as by0", "y1 as by1"))
    meets = "least(x0, x1) <= bx1 and greatest(x0, x1) >= bx0 and least(y0, y1) <= by1 and greatest(y0, y1) >= by0"
    c = _segments(w).crossJoin(z).where(meets).withColumn("share", P.box_share("x0", "y0", "x1", "y1", "bx0", "by0", "bx1", "by1")).where("share > 0")
    return c.groupBy("zid").agg(F.count("*").alias("n"), R(F.sum(F.col("share") * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 2).alias("length"))


@query("j12_keep_out", "SELECT id FROM pts p WHERE NOT EXISTS (SELECT 1 FROM gnode g WHERE power(p.x - g.x, 2) + power(p.y - g.y, 2) <= 9)")
def _(w):
    return P.keep_out(w.pts, w.gnode, 3.0).select("id")


@query("j13_keep_out_by_field", "SELECT id FROM pts p JOIN ras r ON r.ix = p.x // 20 AND r.iy = p.y // 14 WHERE r.v >= 280 + (p.user_id % 3) * 20")
def _(w):
    p = w.pts.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")})
    return p.join(w.ras, ["ix", "iy"]).where("v >= 280 + (user_id % 3) * 20").select("id")


@query("j15_raster_sample", """, b AS (SELECT id, x / 20.0 - 0.5 AS fx, y / 14.0 - 0.5 AS fy FROM pts), c AS (SELECT id, CAST(floor(fx) AS BIGINT) AS gx, CAST(floor(fy) AS BIGINT) AS gy, fx - floor(fx) AS u, fy - floor(fy) AS v FROM b)
SELECT c.id, p4.v AS near, round((1 - u) * (1 - c.v) * q.v + u * (1 - c.v) * r.v + (1 - u) * c.v * s.v + u * c.v * t.v, 4) AS bil FROM c JOIN pts p USING (id) JOIN ras p4 ON p4.ix = p.x // 20 AND p4.iy = p.y // 14
LEFT JOIN ras q ON q.ix = gx AND q.iy = gy LEFT JOIN ras r ON r.ix = gx + 1 AND r.iy = gy LEFT JOIN ras s ON s.ix = gx AND s.iy = gy + 1 LEFT JOIN ras t ON t.ix = gx + 1 AND t.iy = gy + 1""")
def _(w):
    near = P.sample_nearest(w.pts.select("id", "x", F.col("y")).withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).drop("x", "y").withColumnsRenamed({"ix": "x", "iy": "y"}), w.ras, 1.0, "v").select("id", F.col("v").alias("near")).where("near is not null")
    scaled = w.pts.select("id", F.col("x").cast("double").alias("x"), (F.col("y") * (20.0 / 14.0)).alias("y"))
    return near.join(P.sample_bilinear(scaled, w.ras, 20.0, "v", "bil"), "id").select("id", "near", R("bil", 4).alias("bil"))


@query("j16_duplicate_parallels", f""", {_SEG}, s AS (SELECT sid, k, x0 + (x1 - x0) * k / 4.0 AS px, y0 + (y1 - y0) * k / 4.0 AS py FROM seg, range(5) r(k)),
m AS (SELECT s.sid AS a, b.sid AS b, count(*) AS n FROM s JOIN seg b ON s.sid < b.sid AND abs(s.px - b.x0) <= 30 AND abs(s.py - b.y0) <= 30 AND power(s.px - (b.x0 + least(1.0, greatest(0.0, ((s.px - b.x0) * (b.x1 - b.x0) + (s.py - b.y0) * (b.y1 - b.y0)) / greatest(1e-9, power(b.x1 - b.x0, 2) + power(b.y1 - b.y0, 2)))) * (b.x1 - b.x0)), 2)
 + power(s.py - (b.y0 + least(1.0, greatest(0.0, ((s.px - b.x0) * (b.x1 - b.x0) + (s.py - b.y0) * (b.y1 - b.y0)) / greatest(1e-9, power(b.x1 - b.x0, 2) + power(b.y1 - b.y0, 2)))) * (b.y1 - b.y0)), 2) <= 12.25 GROUP BY 1, 2) SELECT a, b, n FROM m WHERE n > 3""")
def _(w):
    """Of five samples of a segment more than 60 % lie within 3.5 of another."""
    s = _segments(w)
    return P.running_on(s, s, 3.5, 5, 40.0, 3, F.col("a_sid") < F.col("b_sid")).select(F.col("a_sid").alias("a"), F.col("b_sid").alias("b"), F.col("near").alias("n"))


@query("j19_hierarchy", ", h AS (SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(n_nationkey AS BIGINT) AS root, 0 AS depth FROM nation WHERE n_nationkey < 2 UNION ALL SELECT n.n_nationkey, h.root, h.depth + 1 FROM h JOIN nation n ON n.n_nationkey >= 2 AND n.n_nationkey // 2 = h.id) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM h")
def _(w):
    """Children take the root of their parent, level by level, in a recursive query."""
    w.table("nation").selectExpr("cast(n_nationkey as bigint) as id", "cast(n_nationkey div 2 as bigint) as parent").createOrReplaceTempView("terravane_tree")
    return w.spark.sql("WITH RECURSIVE h AS (SELECT id, id AS root, 0L AS depth FROM terravane_tree WHERE id < 2 UNION ALL SELECT t.id, h.root, h.depth + 1 FROM h JOIN terravane_tree t ON t.parent = h.id WHERE t.id >= 2) SELECT * FROM h")


_PROJ = "least(1.0, greatest(0.0, ((g.x - s.x0) * (s.x1 - s.x0) + (g.y - s.y0) * (s.y1 - s.y0)) / greatest(1e-9, power(s.x1 - s.x0, 2) + power(s.y1 - s.y0, 2))))"


@query("j20_endpoint_on_line", f", {_SEG}, q AS (SELECT g.node, s.sid, {_PROJ} AS t, sqrt(power(g.x - (s.x0 + {_PROJ} * (s.x1 - s.x0)), 2) + power(g.y - (s.y0 + {_PROJ} * (s.y1 - s.y0)), 2)) AS d FROM gnode g JOIN seg s ON abs(g.x - s.x0) <= 30 AND abs(g.y - s.y0) <= 32) SELECT node, sid, round(t, 4) AS t FROM q WHERE d <= 4 AND t > 0.05 AND t < 0.95")
def _(w):
    inner = (F.col("t") > 0.05) & (F.col("t") < 0.95)
    return P.all_near_segments(w.gnode.select(F.col("node").alias("id"), "x", "y"), _segments(w), 4.0, 40.0, inner, t=R("t", 4)).withColumnRenamed("id", "node")


@query("j21_cone_join", """, c AS (SELECT p.id, g.node, sqrt(power(g.x - p.x, 2) + power(g.y - p.y, 2)) AS d, (g.x - p.x) * cos(radians(p.id % 360)) + (g.y - p.y) * sin(radians(p.id % 360)) AS dot FROM pts p JOIN gnode g ON power(p.x - g.x, 2) + power(p.y - g.y, 2) <= 2500)
SELECT id, arg_min(node, (round(d - 4 * dot / d, 6), node)) AS node FROM c WHERE d > 0 AND dot / d >= cos(radians(50)) GROUP BY id""")
def _(w):
    """The best node ahead within 50, by distance less four times the cosine. A node beyond r scores above r - 4, so what scores less is found for good."""
    places = cut(_nodes(w).groupBy("bx", "by").agg(F.min("node").alias("node")))  # nodes of a place have one score
    a = F.radians((F.col("id") % 360).cast("double"))
    cos = ((F.col("bx") - F.col("ax")) * F.cos(a) + (F.col("by") - F.col("ay")) * F.sin(a)) / F.col("dist")

    def search(rest, r, last):
        c = P.within(rest, places, r, bx="bx", by="by").where("dist > 0")
        ahead = c.withColumn("c", cos).where(F.col("c") >= F.cos(F.radians(F.lit(50.0))))
        best = ahead.groupBy("id").agg(F.min(F.struct(R(F.col("dist") - F.col("c") * 4, 6).alias("score"), "node")).alias("m"))
        return best if last else best.where(F.col("m.score") < r - 4 - 1e-5)

    start = 4.0 + P.start_radius(places, 8.0, "bx", "by")
    return P.by_rounds(w.pts.select("id", "x", "y"), "id", search, start, 50.0).select("id", "m.node")


@query("j22_registry_matching")
def _(w):
    c = w.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 7919 % 2000).alias("x"), (F.col("c_custkey") * 6101 % 667).alias("y"), (F.col("c_custkey") % 50 + 5).alias("len"))
    new = c.where("id % 10 <> 3").select((F.col("id") + 1_000_000).alias("id"), (F.col("x") + F.col("id") % 2).alias("x"), "y", "len")
    return P.match_registry(c, new, 2.0)


@query("j23_box_entry", "SELECT id, round(greatest(CASE WHEN id % 7 = 3 THEN -1e9 ELSE least((0 - x) / (id % 7 - 3.0), (2000 - x) / (id % 7 - 3.0)) END, least((0 - y) / 2.0, (667 - y) / 2.0)), 4) AS enter FROM pts")
def _(w):
    dx = F.col("id") % 7 - 3.0
    slab = F.when(dx == 0, F.lit(-1e9)).otherwise(F.least((F.lit(0) - F.col("x")) / F.when(dx != 0, dx), (F.lit(2000) - F.col("x")) / F.when(dx != 0, dx)))
    return w.pts.select("id", R(F.greatest(slab, F.least((F.lit(0) - F.col("y")) / 2.0, (F.lit(667) - F.col("y")) / 2.0)), 4).alias("enter"))


@query("j25_hausdorff", ", d AS (SELECT a.user_id, a.id, min(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS d FROM pts a JOIN pts b ON b.user_id = a.user_id + 1 GROUP BY 1, 2) SELECT user_id, round(sqrt(max(d)), 4) AS h FROM d GROUP BY user_id")
def _(w):
    """Directed distance from each line to the next one, as a stated set of pairs of lines."""
    b = w.pts.select((F.col("user_id") - 1).alias("user_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    d = w.pts.join(b, "user_id").groupBy("user_id", "id").agg(F.min(F.hypot(F.col("x") - F.col("bx"), F.col("y") - F.col("by"))).alias("d"))
    return d.groupBy("user_id").agg(R(F.max("d"), 4).alias("h"))


@query("j26_nearest_attribute", ", w AS (SELECT * FROM ras WHERE v > 340) SELECT r.ix, r.iy, arg_min(w.v, (power(r.ix - w.ix, 2) + power(r.iy - w.iy, 2)) * 1e7 + w.iy * 100 + w.ix) AS level FROM ras r, w GROUP BY 1, 2")
def _(w):
    src = w.ras.where("v > 340").select((F.col("iy") * 100 + F.col("ix")).alias("cell"), F.col("ix").alias("x"), F.col("iy").alias("y"))
    all_cells = w.ras.select((F.col("iy") * 100 + F.col("ix")).alias("id"), F.col("ix").alias("x"), F.col("iy").alias("y"))
    near = P.nearest(all_cells, src, "id", "cell", 4.0)
    v = w.ras.select((F.col("iy") * 100 + F.col("ix")).alias("cell"), F.col("v").alias("level"))
    return near.join(v, "cell").selectExpr("id % 100 as ix", "id div 100 as iy", "level")


_S = "st AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY seq) AS s FROM (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0.0) AS d FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)))"


@query("k01_line_length", f", {_S} SELECT user_id, round(max(s), 3) AS len, round(max(s) / 2, 3) AS mid FROM st GROUP BY user_id")
def _(w):
    a = w.track.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("a"))
    steps = F.zip_with(F.slice("a", 1, F.size("a") - 1), F.slice("a", 2, F.size("a") - 1), lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))
    total = F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)
    return a.select("user_id", R(total, 3).alias("len"), R(total / 2, 3).alias("mid"))


@query("k02_point_to_line", f", {_SEG}, q AS (SELECT g.node, s.sid, {_PROJ} AS t, sqrt(power(g.x - (s.x0 + {_PROJ} * (s.x1 - s.x0)), 2) + power(g.y - (s.y0 + {_PROJ} * (s.y1 - s.y0)), 2)) AS d FROM gnode g JOIN seg s ON g.x BETWEEN least(s.x0, s.x1) - 12 AND greatest(s.x0, s.x1) + 12 AND g.y BETWEEN least(s.y0, s.y1) - 12 AND greatest(s.y0, s.y1) + 12) SELECT node, sid, round(t, 5) AS t, round(d, 4) AS dist FROM q WHERE d <= 12")
def _(w):
    """Distance and place along the segment, for each node and segment within 12."""
    near = P.all_near_segments(w.gnode.select(F.col("node").alias("id"), "x", "y"), _segments(w), 12.0, 40.0, t=R("t", 5), dist=R("dist", 4))
    return near.withColumnRenamed("id", "node")


@query("k03_polygon_measures", ", q AS (SELECT user_id, seq, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT user_id, abs(CAST(sum(x * ny - nx * y) AS BIGINT)) / 2.0 AS area, round(avg(x), 4) AS cx, round(avg(y), 4) AS cy, min(x) AS x0, max(y) AS y1 FROM q GROUP BY user_id")
def _(w):
    by = Q.along()
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    q = w.track.withColumns({"nx": F.coalesce(F.lead("x").over(by), F.first("x").over(whole)), "ny": F.coalesce(F.lead("y").over(by), F.first("y").over(whole))})
    return q.groupBy("user_id").agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2.0).alias("area"), R(F.avg("x"), 4).alias("cx"), R(F.avg("y"), 4).alias("cy"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query("k05_oriented_rectangle", "SELECT id, k, round(x + (CASE WHEN k IN (0, 3) THEN -6 ELSE 6 END) * cos(radians(id % 180)) - (CASE WHEN k < 2 THEN -4 ELSE 4 END) * sin(radians(id % 180)), 4) AS px, round(y + (CASE WHEN k IN (0, 3) THEN -6 ELSE 6 END) * sin(radians(id % 180)) + (CASE WHEN k < 2 THEN -4 ELSE 4 END) * cos(radians(id % 180)), 4) AS py FROM pts, range(4) r(k)")
def _(w):
    p = w.pts.select("id", "x", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    u, v, a = F.when(F.col("k").isin(0, 3), -6.0).otherwise(6.0), F.when(F.col("k") < 2, -4.0).otherwise(4.0), F.radians((F.col("id") % 180).cast("double"))
    return p.select("id", "k", R(F.col("x") + u * F.cos(a) - v * F.sin(a), 4).alias("px"), R(F.col("y") + u * F.sin(a) + v * F.cos(a), 4).alias("py"))


@query("k06_line_substring", f", {_S} SELECT user_id, seq, x, y FROM st WHERE s BETWEEN 1000 AND 9000")
def _(w):
    return Q.arclength(w.track).where("s between 1000 and 9000").select("user_id", "seq", "x", "y")


@query("k07_offset_line", ", t AS (SELECT user_id, seq, x, y, CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2.0 END AS tx, CASE WHEN lag(y) OVER w IS NULL THEN lead(y) OVER w - y WHEN lead(y) OVER w IS NULL THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2.0 END AS ty FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)) SELECT user_id, seq, round(x - ty / sqrt(tx * tx + ty * ty) * 5, 4) AS x, round(y + tx / sqrt(tx * tx + ty * ty) * 5, 4) AS y FROM t WHERE tx <> 0 OR ty <> 0")
def _(w):
    t = Q.tangent(w.track).where("tx <> 0 or ty <> 0")
    n = F.hypot("tx", "ty")
    return t.select("user_id", "seq", R(F.col("x") - F.col("ty") / n * 5, 4).alias("x"), R(F.col("y") + F.col("tx") / n * 5, 4).alias("y"))


@query("k12_catch_point", ", c AS (SELECT p.id, k, r.v - (200 + 10 * k) AS gap FROM pts p, range(20) t(k) JOIN ras r ON r.ix = (p.x // 20 + k) % 100 AND r.iy = p.y // 14) SELECT id, min(k) AS k FROM c WHERE gap <= 0 GROUP BY id")
def _(w):
    """The first offset at which a rising slope line meets the terrain."""
    k = w.ras.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long")))).where("v - (200 + 10 * k) <= 0")
    first = k.groupBy(((F.col("ix") + 100 - F.col("k")) % 100).alias("ix"), "iy").agg(F.min("k").alias("k"))  # of each cell, so that points meet one row
    return w.pts.selectExpr("id", "x div 20 as ix", "y div 14 as iy").join(F.broadcast(first), ["ix", "iy"]).select("id", "k")


@query("k13_frustum_test", "SELECT cx, cy FROM (SELECT DISTINCT x // 100 AS cx, y // 100 AS cy FROM pts) WHERE (cx * 100 + 50) * 0.6 + (cy * 100 + 50) * 0.8 - 400 > -70.72 AND (cx * 100 + 50) * -0.6 + (cy * 100 + 50) * 0.8 + 500 > -70.72 AND 1400 - (cx * 100 + 50) > -70.72")
def _(w):
    cells = w.pts.selectExpr("x div 100 as cx", "y div 100 as cy").distinct()
    x, y = F.col("cx") * 100 + 50, F.col("cy") * 100 + 50
    return cells.where((x * 0.6 + y * 0.8 - 400 > -70.72) & (x * -0.6 + y * 0.8 + 500 > -70.72) & (F.lit(1400) - x > -70.72))


@query("v01_clustered_order", "SELECT event_type, (x // 20) * 1000 + y // 20 AS cell, count(*) AS n, min(id) AS first FROM pts GROUP BY 1, 2")
def _(w):
    """Rows are laid out by (type, cell), so that a cell's rows are neighbours in the files."""
    laid = w.pts.withColumn("cell", F.expr("(x div 20) * 1000 + y div 20")).repartitionByRange("event_type", "cell").sortWithinPartitions("event_type", "cell", "id")
    return laid.groupBy("event_type", "cell").agg(F.count("*").alias("n"), F.min("id").alias("first"))


_CELL = "c AS (SELECT x // 20 AS cx, y // 20 AS cy, count(*) AS n FROM pts GROUP BY 1, 2), b AS (SELECT *, sqrt(power(greatest(0, greatest(cx * 20 - 900, 900 - cx * 20 - 20)), 2) + power(greatest(0, greatest(cy * 20 - 300, 300 - cy * 20 - 20)), 2)) AS dmin, sqrt(power(greatest(abs(cx * 20 - 900), abs(cx * 20 + 20 - 900)), 2) + power(greatest(abs(cy * 20 - 300), abs(cy * 20 + 20 - 300)), 2)) AS dmax FROM c)"


def _cell_band(w):
    c = w.pts.groupBy(F.expr("x div 20").alias("cx"), F.expr("y div 20").alias("cy")).agg(F.count("*").alias("n"))
    near = lambda v, e: F.greatest(F.lit(0), F.greatest(F.col(v) * 20 - e, F.lit(e - 20) - F.col(v) * 20))
    far = lambda v, e: F.greatest(F.abs(F.col(v) * 20 - e), F.abs(F.col(v) * 20 + 20 - e))
    return c.withColumns({"dmin": F.hypot(near("cx", 900), near("cy", 300)), "dmax": F.hypot(far("cx", 900), far("cy", 300))})


@query("v02_cell_level_mask", f", {_CELL} SELECT cx, cy, CAST((dmin < 150)::INT + 2 * (dmin < 400 AND dmax >= 150)::INT + 4 * (dmax >= 400)::INT AS BIGINT) AS mask FROM b")
def _(w):
    bit = lambda c, v: F.when(c, v).otherwise(0)
    m = bit(F.col("dmin") < 150, 1) + bit((F.col("dmin") < 400) & (F.col("dmax") >= 150), 2) + bit(F.col("dmax") >= 400, 4)
    return _cell_band(w).select("cx", "cy", m.cast("long").alias("mask"))


@query("v03_filter_then_refine", "SELECT id FROM pts WHERE power(x - 900, 2) + power(y - 300, 2) < 22500")
def _(w):
    """Cells all inside are taken whole; only points of cells on the border are tested."""
    cells = _cell_band(w).where("dmin < 150").select("cx", "cy", (F.col("dmax") < 150).alias("inside"))
    p = w.pts.withColumns({"cx": F.expr("x div 20"), "cy": F.expr("y div 20")}).join(cells, ["cx", "cy"])
    return p.where(F.col("inside") | (F.hypot(F.col("x") - 900, F.col("y") - 300) < 150)).select("id")


@query("v05_cull_with_cap", "SELECT id FROM (SELECT id, power(x - 900, 2) + power(y - 300, 2) AS d FROM pts) WHERE d <= 90000 ORDER BY d, id LIMIT 200")
def _(w):
    d = F.pow(F.col("x") - 900, 2) + F.pow(F.col("y") - 300, 2)
    return w.pts.where("x between 600 and 1200 and y between 0 and 600").withColumn("d", d).where("d <= 90000").orderBy("d", "id").limit(200).select("id")


@query("v06_chunk_families", "SELECT x // 100 AS cx, y // 100 AS cy, event_type, CASE WHEN power(x - 900, 2) + power(y - 300, 2) < 40000 THEN 'hi' ELSE 'lo' END AS level, count(*) AS n FROM pts GROUP BY 1, 2, 3, 4")
def _(w):
    level = F.when(F.pow(F.col("x") - 900, 2) + F.pow(F.col("y") - 300, 2) < 40000, "hi").otherwise("lo")
    return w.pts.groupBy(F.expr("x div 100").alias("cx"), F.expr("y div 100").alias("cy"), "event_type", level.alias("level")).agg(F.count("*").alias("n"))


@query("v08_prop_keep_out", "SELECT id FROM pts p JOIN ras r ON r.ix = p.x // 20 AND r.iy = p.y // 14 WHERE r.cls <> 3 AND r.v < 330")
def _(w):
    return w.pts.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras.where("cls <> 3 and v < 330"), ["ix", "iy"]).select("id")


@query("v09_level_pyramid", "SELECT s, ix // s AS bx, iy // s AS by, min(v) AS lo, max(v) AS hi FROM ras, (VALUES (1), (2), (4), (8)) l(s) GROUP BY 1, 2, 3")
def _(w):
    levels = w.ras.withColumn("s", F.explode(F.array(*[F.lit(s).cast("long") for s in (1, 2, 4, 8)])))
    return levels.groupBy("s", F.expr("ix div s").alias("bx"), F.expr("iy div s").alias("by")).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("v11_pick", f"SELECT p.id, r.cls, r.v, min(z.zid) AS zid FROM pts p JOIN ras r ON r.ix = p.x // 20 AND r.iy = p.y // 14 LEFT JOIN zone z ON {_IN} GROUP BY 1, 2, 3")
def _(w):
    return _zoned(w).withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras, ["ix", "iy"]).select("id", "cls", "v", "zid")


@query("v14_focus_box", f", m AS (SELECT p.id, p.x, p.y, min(z.zid) AS zid FROM pts p JOIN zone z ON {_IN} GROUP BY 1, 2, 3) SELECT zid, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, round(avg(x), 3) AS cx FROM m GROUP BY zid")
def _(w):
    return _zoned(w).where("zid is not null").groupBy("zid").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), R(F.avg("x"), 3).alias("cx"))
