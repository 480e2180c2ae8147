"""Queries of routes (W31), least-cost ways (G18) and conditioned terrain (G28): structures that cross the whole graph or raster."""

from pyspark.sql import functions as F

from ..operators import contours, fill, heights, overlay, paths, raster, rivers, terrain
from ..operators.repair import Repair
from .registry import query

R = F.round

#: Ends of edges paired at each node; half-edges that follow one another; walks from loose ends, then from the closed trails' smallest halves.
_TRAILS = """ends AS (SELECT src AS node, eid, 0 AS k FROM street UNION ALL SELECT dst, eid, 1 FROM street),
pairs AS (SELECT eid, k, CASE WHEN row_number() OVER w % 2 = 1 THEN lead(2 * eid + k) OVER w ELSE lag(2 * eid + k) OVER w END AS nxt FROM ends WINDOW w AS (PARTITION BY node ORDER BY eid, k)),
nx AS (SELECT 2 * eid + 1 - k AS h, nxt FROM pairs),
op(s, h, place) AS (SELECT xor(h, 1), xor(h, 1), 0 FROM nx WHERE nxt IS NULL UNION ALL SELECT s, nxt, place + 1 FROM op JOIN nx USING (h) WHERE nxt IS NOT NULL),
od AS (SELECT s, min(h // 2) AS trail, xor(arg_max(h, place), 1) AS other FROM op GROUP BY s),
rw(s, cur) AS (SELECT h, nxt FROM nx WHERE h NOT IN (SELECT h FROM op) UNION ALL SELECT s, nxt FROM rw JOIN nx ON nx.h = cur WHERE cur > s),
rg(s, h, place) AS (SELECT s, s, 0 FROM rw WHERE cur = s UNION ALL SELECT s, nxt, place + 1 FROM rg JOIN nx USING (h) WHERE nxt <> s),
rl AS (SELECT s, min(h // 2) AS trail FROM rg GROUP BY s)"""


@query("w31_chain_order", f", {_TRAILS} SELECT trail, CAST(place AS BIGINT) AS place, h // 2 AS eid, h % 2 = 1 AS turned FROM op JOIN od USING (s) WHERE s < other UNION ALL SELECT trail, CAST(place AS BIGINT), h // 2, h % 2 = 1 FROM rg JOIN rl USING (s) WHERE s % 2 = 0 AND s = 2 * trail")
def _(w):
    """Streets in the order of trails; nearly all are in one component."""
    return paths.routes(w.street.select("eid", "src", "dst"))


@query("g18_least_cost_path")
def _(w):
    """The way from one corner of the raster to the other."""
    cells = w.ras.select("ix", "iy", (1 / F.pow(0.03 + F.col("v") / 900, 1.6)).alias("cost"))
    ends = cells.agg(F.max("ix").alias("ix"), F.max("iy").alias("iy"))
    return paths.Ways(cells, w.spark.createDataFrame([(0, 0)], "ix long, iy long"), ends, 32).path().withColumn("d", R("d", 6))


@query("g28_breached_terrain")
def _(w):
    """Every cell drains to the rim or to water (class 4), whose cells stay as they are."""
    return terrain.breached(w.ras.select("ix", "iy", "v", (F.col("cls") == 4).alias("wet")), "v", 3.0, 2e-3, F.col("wet"))


#: Means by blocks of 2, 4 ... 128 cells, each of the means of its parts.
_BLOCKS = ", ".join(["k0 AS (SELECT ix, iy, CASE WHEN v < 320 THEN CAST(v AS DOUBLE) END AS v FROM ras)"] + [f"k{i} AS (SELECT ix // 2 AS ix, iy // 2 AS iy, avg(v) AS v FROM k{i - 1} GROUP BY 1, 2)" for i in range(1, 8)])


@query("r16_pull_push", f", {_BLOCKS} SELECT k0.ix, k0.iy, round(coalesce({', '.join(f'k{i}.v' for i in range(8))}), 6) AS z FROM k0 {' '.join(f'JOIN k{i} ON k{i}.ix = k0.ix // {1 << i} AND k{i}.iy = k0.iy // {1 << i}' for i in range(1, 8))}")
def _(w):
    """Cells from 320 on are unknown and take the means of ever larger blocks."""
    known = w.ras.select("ix", "iy", "v", (F.col("v") < 320).alias("known"))
    return raster.pull_push(known, "v", "known", "z").select("ix", "iy", R("z", 6).alias("z"))


def _street_graph(w) -> Repair:
    """Streets ranked 1 to 3 by their kind; kind 0 is closed to repairs."""
    return Repair(w.snode, w.street.select("eid", "src", "dst", (F.col("kind") % 3 + 1).alias("rank"), F.col("kind").cast("string").alias("kind")))


def _repaired(g: Repair):
    """The edges of the last version, with the version that made them (null for those of the first)."""
    return g.edges.select("eid", "src", "dst", "rank", (F.col("eid") < 0).alias("new"))


@query("g08_near_miss_repair")
def _(w):
    """Streets with dead ends linked to what lies ahead, within 60, 50 or 40 by rank."""
    g = _street_graph(w)
    g.connect_near_misses({3: 60.0, 2: 50.0, 1: 40.0}, closed=("0",), box=(50.0, 50.0, 1e9, 1e9))
    return _repaired(g)


@query("g09_contract_short_edges")
def _(w):
    """Streets with those shorter than 50 between junctions contracted."""
    g = _street_graph(w)
    g.contract_short(50.0, closed=("0",))
    return _repaired(g)


@query("g10_sharp_angle_repair")
def _(w):
    """Streets with legs that enclose less than 50 degrees parted where they are 30 apart."""
    g = _street_graph(w)
    g.part_sharp_legs(50.0, 30.0, 60.0, 90.0, closed=("0",))
    return _repaired(g)


@query("g08_edit_log")
def _(w):
    """What all three repairs do to the streets, one after the other."""
    g = _street_graph(w)
    g.connect_near_misses({3: 60.0, 2: 50.0, 1: 40.0}, closed=("0",), box=(50.0, 50.0, 1e9, 1e9))
    g.contract_short(50.0, closed=("0",))
    g.part_sharp_legs(50.0, 30.0, 60.0, 90.0, closed=("0",))
    return g.log


@query("g20_height_relaxation")
def _(w):
    """Corners near heights that vary a lot, at most 12 in 100 along streets; every 17th is pinned to a plain that falls by 4 in 100."""
    plain, pinned = F.col("x") * 0.02 + F.col("y") * 0.02, F.col("node") % 17 == 0
    nodes = w.snode.select("node", F.when(pinned, plain).otherwise(plain + F.col("node") * 7919 % 41 - 20).alias("z"), pinned.alias("pinned"))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return heights.relaxed(nodes, w.street.select("src", "dst", (length * 0.12).alias("limit"))).withColumn("z", R("z", 6))


#: Sides of set cells without a set cell across; each goes on with its own cell's next side, or the only one that starts where it ends.
_OUTLINE = """c AS (SELECT ix, iy, iy * 100 + ix AS n FROM ras WHERE v > 320), u(a, b) AS (SELECT p.n, q.n FROM c p JOIN c q ON abs(p.ix - q.ix) + abs(p.iy - q.iy) = 1), r(a, b) AS (SELECT n, n FROM c UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b), lab AS (SELECT a AS n, min(b) AS region FROM r GROUP BY a),
s AS (SELECT n, ix, iy, side, nx, ny, x, y, tx, ty FROM c, LATERAL (VALUES (0, ix, iy - 1, ix, iy, ix + 1, iy), (1, ix + 1, iy, ix + 1, iy, ix + 1, iy + 1), (2, ix, iy + 1, ix + 1, iy + 1, ix, iy + 1), (3, ix - 1, iy, ix, iy + 1, ix, iy)) t(side, nx, ny, x, y, tx, ty)),
e AS (SELECT ((iy::BIGINT << 31) | ix) * 4 + side AS h, n, side, x, y, tx, ty FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.ix = nx AND c.iy = ny)),
turn AS (SELECT a.h, arg_min(b.h, (CASE WHEN b.n = a.n THEN 0 ELSE 1 END, b.h)) AS nxt FROM e a JOIN e b ON b.x = a.tx AND b.y = a.ty GROUP BY a.h),
walk(ring, cur) AS (SELECT h, nxt FROM turn UNION ALL SELECT ring, nxt FROM walk JOIN turn ON turn.h = cur WHERE cur > ring),
k(ring, place, h) AS (SELECT ring, 0, ring FROM walk WHERE cur = ring UNION ALL SELECT ring, place + 1, nxt FROM k JOIN turn USING (h) WHERE nxt <> ring),
o AS (SELECT ring, place, region, x, y, side, h % 4 <> (SELECT t.h % 4 FROM turn t WHERE t.nxt = k.h) AS corner FROM k JOIN e USING (h) JOIN lab USING (n)),
ar AS (SELECT ring, min(region) AS region, sum(x * (CASE side WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END) - y * (CASE side WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END)) / 2 AS area FROM o GROUP BY ring)"""


@query("r09_vectorise", f", {_OUTLINE}, big AS (SELECT * FROM ar WHERE abs(area) >= 2) SELECT region, ring, area < 0 AS hole, CAST(place AS BIGINT) AS place, x, y FROM o JOIN (SELECT ring, area FROM big WHERE region IN (SELECT region FROM big WHERE area > 0)) b USING (ring) WHERE corner")
def _(w):
    """Shells and holes of the regions above 320, from two cells on, as corners in order."""
    return contours.polygons(w.ras.where("v > 320").select("ix", "iy"), 100, 2.0)


@query("r09_simplified_polygons")
def _(w):
    """Regions above the mean, simplified to two cells."""
    mean = w.ras.agg(F.avg("v").alias("mean"))  # one row
    return contours.polygons(w.ras.crossJoin(F.broadcast(mean)).where("v > mean").select("ix", "iy"), 100, 2.0, 2.0)


@query("r11_skeleton")
def _(w):
    return contours.skeleton(w.ras.where("v > 300"), 32, 8)


@query("g19_skeleton_graph")
def _(w):
    """The edges of the skeleton's graph."""
    return contours.skeleton_graph(contours.skeleton(w.ras.where("v > 300"), 32, 8))[1].withColumn("length", R("length", 4))


def _blur_sql(name: str, source: str, sigma: float) -> str:
    """The weighted means of contours.blurred as two relations."""
    out, weights = [], contours.gaussian_weights(sigma)
    for k, (a, b) in enumerate((("iy", "ix"), ("ix", "iy"))):
        at = [(weights[abs(i)], f"lag(v, {-i}) OVER w" if i < 0 else f"lead(v, {i}) OVER w".replace("lead(v, 0) OVER w", "v")) for i in range(1 - len(weights), len(weights))]
        total = " + ".join(f"coalesce({v} * CAST({x!r} AS DOUBLE), 0)" for x, v in at)
        share = " + ".join(f"CASE WHEN {v} IS NULL THEN 0 ELSE CAST({x!r} AS DOUBLE) END" for x, v in at)
        out.append(f"{name}{k} AS (SELECT ix, iy, ({total}) / ({share}) AS v FROM {source if not k else name + '0'} WINDOW w AS (PARTITION BY {a} ORDER BY {b}))".replace("lag(v, -", "lag(v, "))
    return ", ".join(out)


def _ridge_sql(name: str, blurred: str, sigma: float) -> str:
    return f"""{name}d AS (SELECT ix, iy, coalesce(lag(v) OVER r - 2 * v + lead(v) OVER r, 0) AS xx, coalesce(lag(v) OVER c - 2 * v + lead(v) OVER c, 0) AS yy, lead(v) OVER r - lag(v) OVER r AS dx FROM {blurred} WINDOW r AS (PARTITION BY iy ORDER BY ix), c AS (PARTITION BY ix ORDER BY iy)),
{name} AS (SELECT ix, iy, {sigma**2} * greatest(0, sqrt(power((xx - yy) / 2, 2) + power(xy, 2)) - (xx + yy) / 2) AS s FROM (SELECT *, coalesce((lead(dx) OVER c - lag(dx) OVER c) / 4, 0) AS xy FROM {name}d WINDOW c AS (PARTITION BY ix ORDER BY iy)))"""


@query("r12_ridges", f", {_blur_sql('ba', '(SELECT ix, iy, CAST(v AS DOUBLE) AS v FROM ras)', 1.0)}, {_ridge_sql('ra', 'ba1', 1.0)}, {_blur_sql('bb', '(SELECT ix, iy, CAST(v AS DOUBLE) AS v FROM ras)', 2.0)}, {_ridge_sql('rb', 'bb1', 2.0)} SELECT ix, iy, round(greatest(ra.s, rb.s), 5) AS ridge FROM ra JOIN rb USING (ix, iy)")
def _(w):
    """How much each cell is on a crest, at two widths."""
    return contours.ridges(w.ras.select("ix", "iy", F.col("v").cast("double").alias("v")), "v", "ridge").select("ix", "iy", R("ridge", 5).alias("ridge"))


@query("r12_orientation", """, g AS (SELECT ix, iy, CASE WHEN lag(v) OVER r IS NULL THEN lead(v) OVER r - v WHEN lead(v) OVER r IS NULL THEN v - lag(v) OVER r ELSE (lead(v) OVER r - lag(v) OVER r) / 2.0 END AS gx, CASE WHEN lag(v) OVER c IS NULL THEN lead(v) OVER c - v WHEN lead(v) OVER c IS NULL THEN v - lag(v) OVER c ELSE (lead(v) OVER c - lag(v) OVER c) / 2.0 END AS gy FROM ras WINDOW r AS (PARTITION BY iy ORDER BY ix), c AS (PARTITION BY ix ORDER BY iy)),
t AS (SELECT a.ix, a.iy, avg(b.gx * b.gx) AS xx, avg(b.gy * b.gy) AS yy, avg(b.gx * b.gy) AS xy FROM g a JOIN g b ON abs(a.ix - b.ix) <= 1 AND abs(a.iy - b.iy) <= 1 GROUP BY 1, 2)
SELECT ix, iy, round(degrees(0.5 * atan2(2 * xy, xx - yy)), 4) AS angle, round(sqrt(power(xx - yy, 2) + power(2 * xy, 2)), 4) AS strength FROM t""")
def _(w):
    """Direction in degrees (-90 to 90) and strength of the structure tensor, from gradients averaged over 3 by 3 cells."""
    g = raster.gradient(w.ras.select("ix", "iy", F.col("v").cast("double").alias("v")), "v").withColumns({"xx": F.col("gx") * F.col("gx"), "yy": F.col("gy") * F.col("gy"), "xy": F.col("gx") * F.col("gy")})
    for c in ("xx", "yy", "xy"):
        g = raster.blur(g, c, c, 1)
    return g.select("ix", "iy", R(F.degrees(0.5 * F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))), 4).alias("angle"), R(F.hypot(F.col("xx") - F.col("yy"), 2 * F.col("xy")), 4).alias("strength"))


@query("r15_harmonic_fill")
def _(w):
    """Cells from 320 on are unknown; tiles of 32 cells, so that borders are crossed."""
    return fill.harmonic(w.ras.withColumn("known", F.col("v") < 320), "v", "known", "z", 1e-6, 32).withColumn("z", R("z", 4))


@query("r17_erosion")
def _(w):
    return terrain.eroded(w.ras, "v", 5, 0.02, 40.0).withColumn("z", R("z", 6))


def _boxes(w):
    """A box of 12 by 8 at every point, those of one place once, as layer 0; the zones, as layer 1."""
    x, y = F.col("x"), F.col("y")
    points = overlay.edges_of(w.pts.groupBy("x", "y").agg(F.min("id").alias("shape")).select("shape", overlay.box_ring(x, y, x + 12, y + 8).alias("ring")), "ring")
    zones = w.zone.select(F.col("zid").alias("shape"), overlay.box_ring(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("ring")).where("shape % 2 = 0")
    return points, overlay.edges_of(zones, "ring", layer=1)


def _total(found):
    return overlay.measured(found).agg(F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"))


#: Cells of one unit that boxes cover, and the sides of those that have none beyond.
_UNITS = "u AS (SELECT DISTINCT x + i AS x, y + j AS y FROM pts, range(12) a(i), range(8) b(j)), zu AS (SELECT DISTINCT x0 + i AS x, y0 + j AS y FROM zone, range(420) a(i), range(140) b(j) WHERE zid % 2 = 0)"
_RIM = "SELECT CAST((SELECT count(*) FROM s) AS DOUBLE) AS area, CAST(count(*) AS DOUBLE) AS perimeter FROM (SELECT x + dx AS x, y + dy AS y FROM s, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) d(dx, dy)) n LEFT JOIN (SELECT x AS sx, y AS sy FROM s) ON sx = x AND sy = y WHERE sx IS NULL"


@query("u04_union", f", {_UNITS}, s AS (SELECT * FROM u) {_RIM}")
def _(w):
    """Area and perimeter of the union of all boxes."""
    return _total(overlay.union(_boxes(w)[0], 20.0))


@query("u04_difference", f", {_UNITS}, s AS (SELECT * FROM u EXCEPT SELECT * FROM zu) {_RIM}")
def _(w):
    """The boxes without every other zone."""
    a, b = _boxes(w)
    return _total(overlay.difference(a.union(b), 20.0))


@query("u04_intersection", f", {_UNITS}, s AS (SELECT * FROM u INTERSECT SELECT * FROM zu) {_RIM}")
def _(w):
    a, b = _boxes(w)
    return _total(overlay.intersection(a.union(b), 20.0))


@query("k04_street_buffers")
def _(w):
    """Rings of the union of all streets, widened by 6 on either side with round ends."""
    ring = overlay.capsule_ring(*[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")], 6.0, sides=8)
    found = overlay.union(overlay.edges_of(w.street.select(F.col("eid").alias("shape"), ring.alias("ring")), "ring"), 60.0)
    return overlay.measured(found).select("ring", R("area", 3).alias("area"), R("perimeter", 3).alias("perimeter"), "sides")


@query("j11_difference_parts", """, seg AS (SELECT id AS sid, CAST(x AS DOUBLE) AS x0, CAST(y AS DOUBLE) AS y0, CAST(x + id % 37 - 18 AS DOUBLE) AS x1, CAST(y + (id * 7) % 41 - 20 AS DOUBLE) AS y1 FROM pts),
z AS (SELECT * FROM zone WHERE zid % 2 = 0), c AS (SELECT sid, unnest(CASE WHEN s.x1 <> s.x0 THEN [(z.x0 - s.x0) / (s.x1 - s.x0), (z.x1 - s.x0) / (s.x1 - s.x0)] ELSE [] END || CASE WHEN s.y1 <> s.y0 THEN [(z.y0 - s.y0) / (s.y1 - s.y0), (z.y1 - s.y0) / (s.y1 - s.y0)] ELSE [] END || [0.0, 1.0]) AS t FROM (SELECT sid, x0, y0, x1, y1 FROM seg) s, (SELECT x0, x1, y0, y1 FROM z) z),
p AS (SELECT sid, t, lead(t) OVER (PARTITION BY sid ORDER BY t) AS t1 FROM (SELECT DISTINCT sid, t FROM c WHERE t BETWEEN 0 AND 1)),
m AS (SELECT p.sid, p.t1 - p.t AS share, x0 + (p.t + p.t1) / 2 * (x1 - x0) AS x, y0 + (p.t + p.t1) / 2 * (y1 - y0) AS y, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS len FROM p JOIN seg USING (sid) WHERE p.t1 > p.t)
SELECT sid, round(sum(share * len), 4) AS outside FROM m WHERE NOT EXISTS (SELECT 1 FROM z WHERE m.x > z.x0 AND m.x < z.x1 AND m.y > z.y0 AND m.y < z.y1) GROUP BY sid HAVING sum(share * len) > 0.001""")
def _(w):
    """Length of each segment outside of every other zone."""
    s = w.pts.selectExpr("id as sid", "cast(x as double) as x0", "cast(y as double) as y0", "cast(x + id % 37 - 18 as double) as x1", "cast(y + (id * 7) % 41 - 20 as double) as y1")
    parts = overlay.line_parts(s, _boxes(w)[1], 100.0).where("not covered").groupBy("sid").agg(F.sum(F.col("t1") - F.col("t0")).alias("share"))
    out = parts.join(s, "sid").select("sid", (F.col("share") * F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("outside"))
    return out.where("outside > 0.001").select("sid", R("outside", 4).alias("outside"))


@query("r28_river_channels", """, s0 AS (SELECT user_id, seq, x, y, min(y) OVER w AS z, x - coalesce(lag(x) OVER w, x) AS ax, y - coalesce(lag(y) OVER w, y) AS ay, coalesce(lead(x) OVER w, x) - x AS bx, coalesce(lead(y) OVER w, y) - y AS by_ FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
st AS (SELECT user_id, seq, x, y, CAST(z AS DOUBLE) AS z, ax + bx AS tx, ay + by_ AS ty, CASE WHEN (ax * ax + ay * ay) * (bx * bx + by_ * by_) > 0 THEN (ax * by_ - ay * bx) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_)) ELSE 0 END AS turn, coalesce(lag(z) OVER (PARTITION BY user_id ORDER BY seq) - z, 0) AS fell, 12.0 + user_id % 3 * 4 AS half FROM s0),
c AS (SELECT ix, iy, ix * 20 + 10 AS cx, iy * 13 + 6 AS cy FROM ras), n AS (SELECT ix, iy, cx, cy, st.*, sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)) AS d FROM c JOIN st ON abs(cx - x) <= 20 AND abs(cy - y) <= 20),
b AS (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY d, z, user_id, seq) AS rn FROM n WHERE d <= 20), q AS (SELECT *, d / half AS t, -sign(tx * (cy - y) - ty * (cx - x)) * turn AS o FROM b WHERE rn = 1 AND d < half)
SELECT ix, iy, round(CASE WHEN o < -0.4 AND t > 0.5 AND NOT (fell > 60 AND t < 0.8) THEN z - 0.3 * o * (1 - t) ELSE z - (3 * (1 - t * t) * (1 + 0.6 * o) + CASE WHEN fell > 60 AND t < 0.8 THEN 2 ELSE 0 END) END, 5) AS bed, CASE WHEN fell > 60 AND t < 0.8 THEN 'fall' WHEN o < -0.4 AND t > 0.5 THEN 'bar' WHEN o > 0.4 THEN 'pool' ELSE 'run' END AS part FROM q""")
def _(w):
    """Lines as rivers that run down their running minimum; half widths of 12 to 20, falls from 60 on."""
    centre = rivers.stations(w.track, "y").withColumn("half", 12.0 + F.col("user_id") % 3 * 4)
    cells = w.ras.select("ix", "iy", (F.col("ix") * 20 + 10).alias("x"), (F.col("iy") * 13 + 6).alias("y"))
    return rivers.channels(cells, centre, 20.0, 60.0).withColumn("bed", R("bed", 5))
