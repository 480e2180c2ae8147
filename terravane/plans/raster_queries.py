"""Queries of the raster (R) family and of drainage."""

from pyspark.sql import functions as F

from ..operators import raster as A
from ..operators import spatial as P
from ..operators import terrain as T
from ..sources.world import NX, NY
from .registry import query

R = F.round
_BOX = "b AS (SELECT a.ix, a.iy, {} FROM ras a JOIN ras c ON abs(c.ix - a.ix) <= {} AND abs(c.iy - a.iy) <= {} GROUP BY 1, 2)"


@query("r01_box_blur", ", " + _BOX.format("round(avg(c.v), 4) AS v", 2, 2) + " SELECT ix, iy, v FROM b")
def _(w):
    return A.blur(w.ras, "v", "m", 2).select("ix", "iy", R("m", 4).alias("v"))


@query("r01_gaussian_blur", ", g AS (SELECT a.ix, a.iy, sum(c.v * exp(-0.5 * (power(c.ix - a.ix, 2) + power(c.iy - a.iy, 2)))) / sum(exp(-0.5 * (power(c.ix - a.ix, 2) + power(c.iy - a.iy, 2)))) AS v FROM ras a JOIN ras c ON abs(c.ix - a.ix) <= 2 AND abs(c.iy - a.iy) <= 2 GROUP BY 1, 2) SELECT ix, iy, round(v, 4) AS v FROM g")
def _(w):
    from ..operators.sequence import gaussian_weights

    return A.gaussian(w.ras, "v", "m", gaussian_weights(2, 1.0)).select("ix", "iy", R("m", 4).alias("v"))


_GRAD = "g AS (SELECT ix, iy, v, CASE WHEN lag(v) OVER r IS NULL THEN (lead(v) OVER r - v) / 2.5 WHEN lead(v) OVER r IS NULL THEN (v - lag(v) OVER r) / 2.5 ELSE (lead(v) OVER r - lag(v) OVER r) / 5.0 END AS gx, CASE WHEN lag(v) OVER c IS NULL THEN (lead(v) OVER c - v) / 2.5 WHEN lead(v) OVER c IS NULL THEN (v - lag(v) OVER c) / 2.5 ELSE (lead(v) OVER c - lag(v) OVER c) / 5.0 END AS gy FROM ras WINDOW r AS (PARTITION BY iy ORDER BY ix), c AS (PARTITION BY ix ORDER BY iy))"


@query("r02_slope_aspect_hillshade", f", {_GRAD} SELECT ix, iy, round(sqrt(gx * gx + gy * gy), 4) AS slope, round((sin(radians(45)) - gx * cos(radians(45)) * sin(radians(315)) - gy * cos(radians(45)) * cos(radians(315))) / sqrt(gx * gx + gy * gy + 1), 4) AS shade FROM g")
def _(w):
    g = A.gradient(w.ras, "v", 2.5)
    return g.select("ix", "iy", R(F.hypot("gx", "gy"), 4).alias("slope"), R(A.hillshade(F.col("gx"), F.col("gy")), 4).alias("shade"))


@query("r03_morphology", ", " + _BOX.format("max(c.v) AS hi, min(c.v) AS lo", 1, 1) + " SELECT ix, iy, hi, lo FROM b")
def _(w):
    return A.erode(A.dilate(w.ras, "v", "hi", 1), "v", "lo", 1).select("ix", "iy", "hi", "lo")


@query("r03_open_close", ", e AS (SELECT a.ix, a.iy, min(c.v) AS lo, max(c.v) AS hi FROM ras a JOIN ras c ON abs(c.ix - a.ix) <= 1 AND abs(c.iy - a.iy) <= 1 GROUP BY 1, 2) SELECT a.ix, a.iy, max(c.lo) AS opened, min(c.hi) AS closed FROM e a JOIN e c ON abs(c.ix - a.ix) <= 1 AND abs(c.iy - a.iy) <= 1 GROUP BY 1, 2")
def _(w):
    return A.closed(A.opened(w.ras, "v", "opened", 1), "v", "closed", 1).select("ix", "iy", "opened", "closed")


@query("r04_spikes", ", " + _BOX.format("median(c.v) AS m", 1, 1) + " SELECT ix, iy, m FROM b JOIN ras USING (ix, iy) WHERE abs(v - m) > 60")
def _(w):
    return A.spikes(w.ras, "v", 60.0).select("ix", "iy", F.col("median").alias("m"))


_LAB = "m AS MATERIALIZED (SELECT CAST(iy * 100 + ix AS BIGINT) AS n, CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy FROM ras WHERE {}), e AS MATERIALIZED (SELECT p.n AS a, c.n AS b FROM m p JOIN m c ON c.n = p.n + 1 WHERE p.ix < 99 UNION ALL SELECT c.n, p.n FROM m p JOIN m c ON c.n = p.n + 1 WHERE p.ix < 99 UNION ALL SELECT p.n, c.n FROM m p JOIN m c ON c.n = p.n + 100 UNION ALL SELECT c.n, p.n FROM m p JOIN m c ON c.n = p.n + 100), r(a, b) AS (SELECT n, n FROM m UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), l AS MATERIALIZED (SELECT a, min(b) AS label FROM r GROUP BY a), lab AS (SELECT m.ix, m.iy, l.label FROM m JOIN l ON l.a = m.n)"


@query("r05_label_regions", ", " + _LAB.format("v > 320") + " SELECT ix, iy, label FROM lab")
def _(w):
    return A.label(w.ras.where("v > 320"), 100)


@query("r06_small_holes", ", " + _LAB.format("v <= 290") + " SELECT label, count(*) AS n FROM lab GROUP BY label HAVING count(*) < 25 AND min(ix) > 0 AND max(ix) < 99 AND min(iy) > 0 AND max(iy) < 49")
def _(w):
    return A.fill_holes(w.ras.withColumn("m", F.col("v") > 290), "m", NX, NY, 25).select("label", "n").distinct()


@query("r07_distance_transform", ", w AS (SELECT ix, iy FROM ras WHERE v > 340), d AS (SELECT r.ix, r.iy, min((r.ix - w.ix) * (r.ix - w.ix) + (r.iy - w.iy) * (r.iy - w.iy)) AS d2 FROM ras r, w GROUP BY 1, 2) SELECT ix, iy, CASE WHEN d2 <= 36 THEN d2 END AS d2 FROM d")
def _(w):
    return A.distance_transform(w.ras.withColumn("m", F.col("v") > 340), "m", 6).select("ix", "iy", "d2")


@query("r08_rasterise_lines", """, s AS (SELECT id, x / 20.0 AS x0, y / 14.0 AS y0, (x + id % 37 - 18) / 20.0 AS x1, (y + (id * 7) % 41 - 20) / 14.0 AS y1 FROM pts), m AS (SELECT r.ix, r.iy, s.*, least(1.0, greatest(0.0, ((r.ix + 0.5 - x0) * (x1 - x0) + (r.iy + 0.5 - y0) * (y1 - y0)) / greatest(1e-12, power(x1 - x0, 2) + power(y1 - y0, 2)))) AS t FROM s JOIN ras r ON r.ix BETWEEN x0 - 4 AND x0 + 4 AND r.iy BETWEEN y0 - 4 AND y0 + 4)
SELECT ix, iy, count(*) AS n FROM m WHERE sqrt(power(ix + 0.5 - (x0 + t * (x1 - x0)), 2) + power(iy + 0.5 - (y0 + t * (y1 - y0)), 2)) <= 0.6 GROUP BY 1, 2""")
def _(w):
    """Cells whose centre is within 0.6 of a line."""
    s = w.pts.selectExpr("id as sid", "x / 20.0D as x0", "y / 14.0D as y0", "(x + id % 37 - 18) / 20.0D as x1", "(y + (id * 7) % 41 - 20) / 14.0D as y1")
    cells = w.ras.select(F.struct("ix", "iy").alias("id"), (F.col("ix") + 0.5).alias("x"), (F.col("iy") + 0.5).alias("y"))
    return P.points_near_segments(cells, s, 0.6, 4.0).groupBy("a_id").agg(F.count("*").alias("n")).select("a_id.ix", "a_id.iy", "n")


@query("r10_hysteresis", ", r(ix, iy) AS (SELECT ix, iy FROM ras WHERE v > 345 UNION SELECT c.ix, c.iy FROM r JOIN ras c ON abs(c.ix - r.ix) + abs(c.iy - r.iy) = 1 AND c.v > 310) SELECT ix, iy FROM r")
def _(w):
    return A.hysteresis(w.ras, "v", 310, 345, 100)


@query("r13_resample", "SELECT ix // 2 AS bx, iy // 2 AS by, round(avg(v), 4) AS mean, arg_min(v, iy * 100 + ix) AS first FROM ras GROUP BY 1, 2")
def _(w):
    from ..operators.aggregate import block_reduce

    return block_reduce(w.ras, 2, R(F.avg("v"), 4).alias("mean"), F.min_by("v", F.struct("iy", "ix")).alias("first"))


@query("r14_lattice_noise")
def _(w):
    """Value noise: hashed lattice points, blended smoothly, over three octaves."""
    total = F.lit(0.0)
    for octave, cell in enumerate((16, 8, 4)):
        gx, gy = F.floor(F.col("ix") / cell), F.floor(F.col("iy") / cell)
        u, v = F.col("ix") / cell - gx, F.col("iy") / cell - gy
        u, v = u * u * (F.lit(3) - u * 2), v * v * (F.lit(3) - v * 2)
        h = lambda i, j: F.pmod(F.xxhash64(gx + i, gy + j, F.lit(octave)), F.lit(1 << 20)) / float(1 << 20)  # noqa: B023, E731
        total = total + ((h(0, 0) * (1 - u) + h(1, 0) * u) * (1 - v) + (h(0, 1) * (1 - u) + h(1, 1) * u) * v) * 0.5**octave
    return w.ras.select("ix", "iy", total.alias("n"))


@query("r18_lit_height", "SELECT a.ix, a.iy, round(max(c.v - 3.0 * (a.ix - c.ix)), 3) AS lit FROM ras a JOIN ras c ON c.iy = a.iy AND c.ix <= a.ix AND c.ix > a.ix - 16 GROUP BY 1, 2")
def _(w):
    return A.lit_height(w.ras, "v", "lit", 3.0, 4).select("ix", "iy", R("lit", 3).alias("lit"))


@query("r19_position_index", ", " + _BOX.format("avg(c.v) AS m", 3, 3) + " SELECT ix, iy, round(v - m, 4) AS tpi, round(1 / (1 + exp((v - m) / 40.0)), 4) AS wet FROM b JOIN ras USING (ix, iy)")
def _(w):
    d = F.col("v") - F.col("m")
    return A.blur(w.ras, "v", "m", 3).select("ix", "iy", R(d, 4).alias("tpi"), R(F.lit(1.0) / (F.exp(d / 40.0) + 1), 4).alias("wet"))


@query("r20_voronoi_fields", ", s AS (SELECT iy * 100 + ix AS seed, ix + (ix * 7 + iy * 3) % 5 - 2 AS sx, iy + (ix * 5 + iy) % 5 - 2 AS sy FROM ras WHERE ix % 10 = 5 AND iy % 10 = 5) SELECT r.ix, r.iy, arg_min(seed, ((r.ix - sx) * (r.ix - sx) + (r.iy - sy) * (r.iy - sy)) * 100000 + seed) AS seed FROM ras r, s GROUP BY 1, 2")
def _(w):
    s = w.ras.where("ix % 10 = 5 and iy % 10 = 5").selectExpr("iy * 100 + ix as seed", "ix + (ix * 7 + iy * 3) % 5 - 2 as x", "iy + (ix * 5 + iy) % 5 - 2 as y")
    cells = w.ras.selectExpr("iy * 100 + ix as id", "ix as x", "iy as y")
    return P.nearest(cells, s, "id", "seed", 8.0).selectExpr("id % 100 as ix", "id div 100 as iy", "seed")


@query("r21_feathered_blend", ", z AS (SELECT ix, iy, zid, greatest(0.0, 1 - greatest(abs(ix * 20 + 10 - (x0 + x1) / 2.0) / 260.0, abs(iy * 13 + 6 - (y0 + y1) / 2.0) / 120.0)) AS w FROM ras, zone) SELECT ix, iy, round(sum(w * zid) / sum(w), 4) AS blend FROM z WHERE w > 0 GROUP BY 1, 2")
def _(w):
    far = F.greatest(F.abs(F.col("ix") * 20 + 10 - (F.col("x0") + F.col("x1")) / 2) / 260.0, F.abs(F.col("iy") * 13 + 6 - (F.col("y0") + F.col("y1")) / 2) / 120.0)
    z = w.ras.crossJoin(F.broadcast(w.zone)).withColumn("w", F.greatest(F.lit(0.0), F.lit(1.0) - far)).where("w > 0")
    return z.groupBy("ix", "iy").agg(R(F.sum(F.col("w") * F.col("zid")) / F.sum("w"), 4).alias("blend"))


_D2 = "d AS (SELECT ix, iy, abs(v - 2 * lag(v) OVER r + lag(v, 2) OVER r) AS d2 FROM ras WINDOW r AS (PARTITION BY iy ORDER BY ix))"


@query("r22_seams", f", {_D2} SELECT ix, iy, d2 FROM d WHERE ix % 10 = 0 AND d2 > (SELECT greatest(1.2 * quantile_cont(d2, 0.95), 3) FROM d)")
def _(w):
    d = w.ras.select("ix", "iy", F.abs(F.col("v") - 2 * F.lag("v").over(A.rows()) + F.lag("v", 2).over(A.rows())).alias("d2"))
    limit = d.agg(F.greatest(F.percentile("d2", 0.95) * 1.2, F.lit(3.0)).alias("lim"))
    return d.where("ix % 10 = 0").crossJoin(F.broadcast(limit)).where("d2 > lim").select("ix", "iy", "d2")


@query("r23_ring_comparison", ", b AS (SELECT ix // 2 AS bx, iy // 2 AS by_, avg(v) AS m FROM ras GROUP BY 1, 2) SELECT round(max(abs(v - m)), 4) AS top, round(quantile_cont(abs(v - m), 0.95), 4) AS p95 FROM ras JOIN b ON bx = ix // 2 AND by_ = iy // 2 WHERE ix IN (0, 99) OR iy IN (0, 49)")
def _(w):
    from ..operators.aggregate import block_reduce

    b = block_reduce(w.ras, 2, F.avg("v").alias("m"))
    ring = w.ras.where("ix in (0, 99) or iy in (0, 49)").withColumns({"bx": F.expr("ix div 2"), "by": F.expr("iy div 2")}).join(b, ["bx", "by"])
    d = F.abs(F.col("v") - F.col("m"))
    return ring.agg(R(F.max(d), 4).alias("top"), R(F.percentile(d, 0.95), 4).alias("p95"))


@query("r24_layer_weights", ", " + _BOX.format("avg(CASE WHEN c.cls = 1 THEN 1.0 ELSE 0 END) AS g, avg(CASE WHEN c.cls = 2 THEN 1.0 ELSE 0 END) AS f", 1, 1) + " SELECT ix, iy, round(g, 4) AS grass, round(greatest(f, 1 - g - f), 4) AS other FROM b")
def _(w):
    hot = w.ras.withColumns({"h1": F.when(F.col("cls") == 1, 1.0).otherwise(0.0), "h2": F.when(F.col("cls") == 2, 1.0).otherwise(0.0)})
    m = A.blur(A.blur(hot, "h1", "g", 1), "h2", "f", 1)
    return m.select("ix", "iy", R("g", 4).alias("grass"), R(F.greatest(F.col("f"), F.lit(1.0) - F.col("g") - F.col("f")), 4).alias("other"))


@query("r25_land_use", f", {_GRAD} SELECT ix, iy, CASE WHEN sqrt(gx * gx + gy * gy) > 30 THEN 'rock' WHEN cls = 3 THEN 'urban' WHEN r.v < 280 THEN 'water' WHEN cls = 1 AND sqrt(gx * gx + gy * gy) < 12 THEN 'field' ELSE 'forest' END AS cover FROM g JOIN ras r USING (ix, iy)")
def _(w):
    s = F.hypot("gx", "gy")
    masks = [("forest", F.lit(True)), ("field", (F.col("cls") == 1) & (s < 12)), ("water", F.col("v") < 280), ("urban", F.col("cls") == 3), ("rock", s > 30)]
    return A.gradient(w.ras, "v", 2.5).select("ix", "iy", A.cascade(masks).alias("cover"))


_NEAR = "n AS (SELECT r.ix, r.iy, r.v, arg_min(g.node, (power(r.ix * 20 + 10 - g.x, 2) + power(r.iy * 13 + 6 - g.y, 2), g.node)) AS node, sqrt(min(power(r.ix * 20 + 10 - g.x, 2) + power(r.iy * 13 + 6 - g.y, 2))) AS d FROM ras r, gnode g GROUP BY 1, 2, 3)"


def _near_node(w):
    cells = w.ras.select((F.col("iy") * 100 + F.col("ix")).alias("id"), (F.col("ix") * 20 + 10).alias("x"), (F.col("iy") * 13 + 6).alias("y"))
    return P.nearest(cells, w.gnode, "id", "node", 8.0).withColumns({"ix": F.col("id") % 100, "iy": F.expr("id div 100")})


@query("r26_grade_to_road", f", {_NEAR} SELECT ix, iy, round(CASE WHEN d < 60 THEN least(greatest(v, 250 + node % 50 - d * 0.5), 250 + node % 50 + d * 0.5) ELSE v END, 4) AS z FROM n")
def _(w):
    j = _near_node(w).join(w.ras, ["ix", "iy"])
    road = F.col("node") % 50 + 250
    z = F.when(F.col("dist") < 60, F.least(F.greatest(F.col("v"), road - F.col("dist") * 0.5), road + F.col("dist") * 0.5)).otherwise(F.col("v"))
    return j.select("ix", "iy", R(z.cast("double"), 4).alias("z"))


@query("r27_corridor_distance", f", {_NEAR} SELECT ix, iy, node, round(greatest(d - 5, 0), 4) AS edge FROM n")
def _(w):
    return _near_node(w).select("ix", "iy", "node", R(F.greatest(F.col("dist") - 5, F.lit(0.0)), 4).alias("edge"))


_D8 = "nb AS (SELECT a.ix, a.iy, c.ix AS rx, c.iy AS ry, (a.v - c.v) / sqrt((c.ix - a.ix) * (c.ix - a.ix) + (c.iy - a.iy) * (c.iy - a.iy)) AS fall FROM ras a JOIN ras c ON abs(c.ix - a.ix) <= 1 AND abs(c.iy - a.iy) <= 1 AND (a.ix, a.iy) <> (c.ix, c.iy)), d8 AS (SELECT ix, iy, arg_max(rx, (fall, -(ry - iy), -(rx - ix))) AS rx, arg_max(ry, (fall, -(ry - iy), -(rx - ix))) AS ry, max(fall) AS fall FROM nb GROUP BY 1, 2)"


@query("g25_receivers", f", {_D8} SELECT ix, iy, CASE WHEN fall > 0 THEN rx END AS rx, CASE WHEN fall > 0 THEN ry END AS ry, CASE WHEN fall > 0 THEN round(fall, 4) END AS fall FROM d8")
def _(w):
    return A.receivers(w.ras, "v").select("ix", "iy", "rx", "ry", R("drop", 4).alias("fall"))


@query("g26_flow_accumulation", f", {_D8}, f AS (SELECT ix, iy, rx, ry FROM d8 WHERE fall > 0), p AS (SELECT ix, iy, ix AS x, iy AS y FROM ras UNION ALL SELECT p.ix, p.iy, f.rx, f.ry FROM p JOIN f ON f.ix = p.x AND f.iy = p.y) SELECT x AS ix, y AS iy, count(*) AS area FROM p GROUP BY 1, 2")
def _(w):
    return A.accumulate(A.receivers(w.ras, "v"))


@query("g27_pit_filling", """, q AS (SELECT ix, iy, v // 40 AS z FROM ras), l AS (SELECT DISTINCT z AS lev FROM q), o(lev, ix, iy) AS (SELECT lev, ix, iy FROM q, l WHERE z <= lev AND (ix IN (0, 99) OR iy IN (0, 49)) UNION SELECT o.lev, c.ix, c.iy FROM o JOIN q c ON abs(c.ix - o.ix) <= 1 AND abs(c.iy - o.iy) <= 1 AND c.z <= o.lev)
SELECT ix, iy, min(lev) AS filled FROM o GROUP BY 1, 2""")
def _(w):
    return T.flooded(w.ras.selectExpr("ix", "iy", "v div 40 as z"), "z").select("ix", "iy", F.col("filled").cast("long").alias("filled"))
