"""Queries of the data-quality family (Q): each rule over derived relations, the report and the strict gate."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import raster as A
from ..operators import rules as U
from ..operators import sequence as Q
from ..operators import spatial as P
from ..operators import terrain as T
from .graph_queries import _GAPS, _REACH, _legs
from .raster_queries import _GRAD
from .registry import query
from .spatial_queries import _SEG, _X, _segments

R = F.round
L = F.lit
_DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM gedge UNION ALL SELECT dst FROM gedge) GROUP BY node)"


def _out(kind, sev, x, y, msg, ref):
    at = lambda v: f"CAST(round({v}, 1) AS DOUBLE)" if v else "CAST(NULL AS DOUBLE)"
    return f"SELECT '{kind}' AS kind, '{sev}' AS severity, {at(x)} AS x, {at(y)} AS y, {msg} AS msg, CAST({ref} AS VARCHAR) AS ref"


def _s(c):
    return F.col(c).cast("string")


def components_rule(w):
    lengths = G.component_lengths(w.gedge, "len").where("rank > 1")
    at = lengths.join(w.gnode, F.col("component") == F.col("node"))
    return U.issues(at, "components", "error", "component", F.concat(L("isolated piece of "), _s("total")), "x", "y")


@query("q01_components", f", {_REACH}, l AS (SELECT component, CAST(sum(len) AS BIGINT) AS total FROM gedge JOIN comp ON src = node GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY total DESC, component) AS rank FROM l) {_out('components', 'error', 'g.x', 'g.y', chr(39) + 'isolated piece of ' + chr(39) + ' || CAST(total AS VARCHAR)', 'component')} FROM k JOIN gnode g ON g.node = k.component WHERE rank > 1")
def _(w):
    return components_rule(w)


@query("q02_near_miss", f", {_DEG}, {_SEG}, e AS (SELECT g.* FROM gnode g JOIN deg USING (node) WHERE degree = 1), m AS (SELECT e.node, e.x, e.y, s.sid, least(1.0, greatest(0.0, ((e.x - s.x0) * (s.x1 - s.x0) + (e.y - s.y0) * (s.y1 - s.y0)) / greatest(1e-9, power(s.x1 - s.x0, 2) + power(s.y1 - s.y0, 2)))) AS t, s.x0, s.y0, s.x1, s.y1 FROM e JOIN seg s ON abs(e.x - s.x0) <= 30 AND abs(e.y - s.y0) <= 32) {_out('near_miss', 'error', 'x', 'y', chr(39) + 'ends near ' + chr(39) + ' || CAST(min(sid) AS VARCHAR)', 'node')} FROM m WHERE sqrt(power(x - (x0 + t * (x1 - x0)), 2) + power(y - (y0 + t * (y1 - y0)), 2)) < 6 GROUP BY node, x, y")
def _(w):
    ends = w.gnode.join(G.degrees(w.gedge).where("degree = 1"), "node").select(F.col("node").alias("id"), "x", "y")
    near = P.first_segment(ends, _segments(w), 6.0, 40.0)
    return U.issues(near, "near_miss", "error", "id", F.concat(L("ends near "), _s("sid")), "x", "y")


def dead_end_rule(w):
    ends = G.degrees(w.gedge).where("degree = 1")
    e = w.gedge.join(F.broadcast(w.dim.select("kind", "type")), "kind").select("eid", "type", "len", F.explode(F.array("src", "dst")).alias("node")).join(ends, "node").join(w.gnode, "node")
    border = (F.col("x") < 1.6) | (F.col("x") > 1998.4) | (F.col("y") < 1.6) | (F.col("y") > 665.4)
    fine = F.col("type").isin("dirt") | (F.col("type").isin("residential") & (F.col("len") > 15)) | border
    return U.issues(e, "dead_end", "warn", "eid", F.concat("type", L(" ends without reason")), "x", "y", ~fine)


@query("q03_dead_end", f", {_DEG}, e AS (SELECT eid, type, len, src AS node FROM gedge JOIN dim USING (kind) UNION ALL SELECT eid, type, len, dst FROM gedge JOIN dim USING (kind)) {_out('dead_end', 'warn', 'x', 'y', 'type || ' + chr(39) + ' ends without reason' + chr(39), 'eid')} FROM e JOIN deg USING (node) JOIN gnode USING (node) WHERE degree = 1 AND NOT (type = 'dirt' OR type = 'residential' AND len > 15 OR x < 1.6 OR x > 1998.4 OR y < 1.6 OR y > 665.4)")
def _(w):
    return dead_end_rule(w)


def sharp_angle_rule(w):
    g = Q.circular_gaps(_legs(w), "node", "bearing").groupBy("node").agg(F.count("*").alias("n"), F.min("gap").alias("lo"), F.array_join(F.array_sort(F.collect_set("type")), ", ").alias("types"))
    bad = g.where("n >= 3 and lo < 25 and types <> 'freeway'").join(w.gnode, "node")
    return U.issues(bad, "sharp_angle", "error", "node", F.concat(L("legs meet at "), _s("lo"), L(" deg")), "x", "y")


@query("q04_sharp_angle", f", {_GAPS}, s AS (SELECT node, count(*) AS n, min(gap) AS lo, string_agg(DISTINCT type, ', ') AS types FROM gaps GROUP BY node) {_out('sharp_angle', 'error', 'x', 'y', chr(39) + 'legs meet at ' + chr(39) + ' || CAST(lo AS VARCHAR) || ' + chr(39) + ' deg' + chr(39), 'node')} FROM s JOIN gnode USING (node) WHERE n >= 3 AND lo < 25 AND types <> 'freeway'")
def _(w):
    return sharp_angle_rule(w)


def short_edge_rule(w):
    d = G.degrees(w.gedge)
    j = w.gedge.join(d.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    return U.issues(j, "short_edge", "warn", "eid", F.concat(L("only "), _s("len")), where="len < 30 and a >= 2 and b >= 2")


@query("q05_short_edge", f", {_DEG} {_out('short_edge', 'warn', None, None, chr(39) + 'only ' + chr(39) + ' || CAST(len AS VARCHAR)', 'eid')} FROM gedge JOIN deg a ON a.node = src JOIN deg b ON b.node = dst WHERE len < 30 AND a.degree >= 2 AND b.degree >= 2")
def _(w):
    return short_edge_rule(w)


@query("q06_duplicate", f", {_SEG}, s AS (SELECT sid, x0, y0, k, x0 + (x1 - x0) * k / 4.0 AS px, y0 + (y1 - y0) * k / 4.0 AS py FROM seg, range(5) r(k)), t AS (SELECT s.sid AS a, s.x0 AS ax, s.y0 AS ay, b.*, px, py, least(1.0, greatest(0.0, ((px - b.x0) * (b.x1 - b.x0) + (py - b.y0) * (b.y1 - b.y0)) / greatest(1e-9, power(b.x1 - b.x0, 2) + power(b.y1 - b.y0, 2)))) AS t FROM s JOIN seg b ON s.sid < b.sid AND abs(px - b.x0) <= 30 AND abs(py - b.y0) <= 32), m AS (SELECT a, sid, ax, ay, count(*) AS n FROM t WHERE sqrt(power(px - (x0 + t * (x1 - x0)), 2) + power(py - (y0 + t * (y1 - y0)), 2)) <= 3.5 GROUP BY 1, 2, 3, 4) {_out('duplicate', 'error', 'ax', 'ay', chr(39) + 'runs on top of ' + chr(39) + ' || CAST(sid AS VARCHAR)', 'a')} FROM m WHERE n > 3")
def _(w):
    s = _segments(w)
    on = P.running_on(s, s, 3.5, 5, 40.0, 3, F.col("a_sid") < F.col("b_sid"))
    return U.issues(on, "duplicate", "error", "a_sid", F.concat(L("runs on top of "), _s("b_sid")), "a_x0", "a_y0")


@query("q07_ramp_conflict", f", {_SEG}, {_X}, c AS (SELECT a, b, ax0 + d3 / CAST(d3 - d4 AS DOUBLE) * (ax1 - ax0) AS px, ay0 + d3 / CAST(d3 - d4 AS DOUBLE) * (ay1 - ay0) AS py, d1 / CAST(d1 - d2 AS DOUBLE) AS tb FROM q WHERE sign(d1) * sign(d2) < 0 AND sign(d3) * sign(d4) < 0) {_out('ramp_conflict', 'error', 'px', 'py', chr(39) + 'crosses ramp ' + chr(39) + ' || CAST(b AS VARCHAR)', 'a')} FROM c JOIN pts ON pts.id = b AND event_type = 'click' WHERE abs(a % 20 - b % 20) < 4.9 AND tb > 0.1 AND tb < 0.9")
def _(w):
    """Crossings of ramps (lines of kind click) at nearly the same height (line number modulo 20), away from the ramp's ends."""
    s = _segments(w)
    ramps = s.join(w.pts.where("event_type = 'click'").select(F.col("id").alias("sid")), "sid", "left_semi")
    x = P.crossings(s, ramps, 40.0).where("a_sid < b_sid and abs(a_sid % 20 - b_sid % 20) < 4.9")
    d = lambda px, py: P.cross(F.col("a_x0"), F.col("a_y0"), F.col("a_x1"), F.col("a_y1"), F.col(px), F.col(py)).cast("double")
    across = d("b_x0", "b_y0") - d("b_x1", "b_y1")
    tb = d("b_x0", "b_y0") / F.when(across != 0, across)  # the condition on tb may be asked before the crossing is known, of parallel lines too
    return U.issues(x.withColumn("tb", tb), "ramp_conflict", "error", "a_sid", F.concat(L("crosses ramp "), _s("b_sid")), "px", "py", "tb > 0.1 and tb < 0.9")


_RAD = "c AS (SELECT user_id, seq, x, y, lag(x, 2) OVER w AS ax, lag(y, 2) OVER w AS ay, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy, count(*) OVER (PARTITION BY user_id) AS n FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)), rad AS (SELECT *, sqrt(power(x - ax, 2) + power(y - ay, 2)) * sqrt(power(cx - x, 2) + power(cy - y, 2)) * sqrt(power(ax - cx, 2) + power(ay - cy, 2)) / greatest(abs((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) * 2.0, 1e-9) AS radius FROM c)"


@query("q08_radius", f", {_RAD}, f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS rn FROM rad WHERE radius < 350 * 0.85 AND seq > 4 AND seq < n - 4) {_out('radius', 'warn', 'x', 'y', chr(39) + 'curve at ' + chr(39) + ' || CAST(seq AS VARCHAR)', 'user_id')} FROM f WHERE rn = 1")
def _(w):
    n = F.count("*").over(Window.partitionBy("user_id"))
    bad = Q.circumradius(w.track, 2).withColumn("n", n).where("radius < 350 * 0.85 and seq > 4 and seq < n - 4")
    first = bad.withColumn("rn", F.row_number().over(Q.along())).where("rn = 1")
    return U.issues(first, "radius", "warn", "user_id", F.concat(L("curve at "), _s("seq")), "x", "y")


@query("q09_water", f", wet AS (SELECT user_id, count(*) AS wet FROM track JOIN ras ON ix = x // 20 AND iy = y // 14 WHERE ras.v < 290 GROUP BY 1), sp AS (SELECT user_id, sum(s1 - s0) AS dry FROM spans GROUP BY 1) {_out('water', 'error', None, None, chr(39) + 'crosses water without a span' + chr(39), 'user_id')} FROM wet JOIN sp USING (user_id) WHERE wet > 1 AND dry < wet * 4.0")
def _(w):
    wet = w.track.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras.where("v < 290"), ["ix", "iy"]).groupBy("user_id").agg(F.count("*").alias("wet"))
    dry = w.spans.groupBy("user_id").agg(F.sum(F.col("s1") - F.col("s0")).alias("dry"))
    return U.issues(wet.join(dry, "user_id"), "water", "error", "user_id", L("crosses water without a span"), where="wet > 1 and dry < wet * 4.0")


@query("q10_river_uphill", f", m AS (SELECT *, max(y) OVER (PARTITION BY user_id ORDER BY seq DESC) AS top FROM track), k AS (SELECT user_id, max(top - y) AS d, arg_max(seq, (top - y) * 100000 - seq) AS at_ FROM m WHERE top > y + 0.05 GROUP BY 1) {_out('river_uphill', 'error', None, None, chr(39) + 'rises ' + chr(39) + ' || CAST(d AS VARCHAR) || ' + chr(39) + ' after ' + chr(39) + ' || CAST(at_ AS VARCHAR)', 'user_id')} FROM k")
def _(w):
    m = Q.running_extreme(w.track, "y", "top", backwards=True).where("top > y + 0.05").groupBy("user_id").agg(F.max(F.struct((F.col("top") - F.col("y")).alias("d"), (-F.col("seq")).alias("s"))).alias("m"))
    return U.issues(m, "river_uphill", "error", "user_id", F.concat(L("rises "), F.col("m.d").cast("string"), L(" after "), (-F.col("m.s")).cast("string")))


@query("q11_confluence", f", lev AS (SELECT t.user_id, t.seq, t.x, t.y, r.v FROM track t JOIN ras r ON r.ix = t.x // 20 AND r.iy = t.y // 14), mouth AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS rn FROM lev) WHERE rn = 1 AND user_id > 1), n AS (SELECT m.user_id, m.x, m.y, m.v, arg_min(t.v, ((t.x - m.x) * (t.x - m.x) + (t.y - m.y) * (t.y - m.y), t.seq)) AS pv FROM mouth m JOIN lev t ON t.user_id = (m.user_id // 2) GROUP BY 1, 2, 3, 4) {_out('confluence', 'error', 'x', 'y', chr(39) + 'differs ' + chr(39) + ' || CAST(abs(v - pv) AS VARCHAR)', 'user_id')} FROM n WHERE abs(v - pv) > 60")
def _(w):
    """The level at a line's last point against that at the nearest sample of its parent line, levels by the raster."""
    level = w.track.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras.select("ix", "iy", "v"), ["ix", "iy"])
    mouth = level.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("seq")))).where("rn = 1 and user_id > 1").select("user_id", "x", "y", "v", F.expr("user_id div 2").alias("parent"))
    p = level.select(F.col("user_id").alias("parent"), F.col("x").alias("px"), F.col("y").alias("py"), "seq", F.col("v").alias("pv"))
    far = F.expr("(px - x) * (px - x) + (py - y) * (py - y)")
    n = mouth.join(p, "parent").groupBy("user_id", "x", "y", "v").agg(F.min_by("pv", F.struct(far, "seq")).alias("pv"))
    return U.issues(n, "confluence", "error", "user_id", F.concat(L("differs "), F.abs(F.col("v") - F.col("pv")).cast("string")), "x", "y", "abs(v - pv) > 60")


@query("q12_perched_river", f", o AS (SELECT p.id, p.x, p.y, k, r.v FROM pts p, range(1, 6) t(k) JOIN ras r ON r.ix = p.x // 20 + k AND r.iy = p.y // 14 WHERE r.v < 330), f AS (SELECT id, x, y, arg_min(v, k) AS v FROM o GROUP BY 1, 2, 3) {_out('perched_river', 'warn', 'x', 'y', chr(39) + 'bank at ' + chr(39) + ' || CAST(v AS VARCHAR)', 'id')} FROM f WHERE v < 270")
def _(w):
    """The first sample to the side that isn't wet lies below the water."""
    k = w.pts.select("id", "x", "y", F.explode(F.sequence(L(1), L(5))).alias("k")).selectExpr("id", "x", "y", "k", "x div 20 + k as ix", "y div 14 as iy")
    f = k.join(w.ras.where("v < 330").select("ix", "iy", "v"), ["ix", "iy"]).groupBy("id", "x", "y").agg(F.min_by("v", "k").alias("v"))
    return U.issues(f, "perched_river", "warn", "id", F.concat(L("bank at "), _s("v")), "x", "y", "v < 270")


@query("q13_surface_step", f", s AS (SELECT ix, iy, abs(v - lag(v) OVER (PARTITION BY iy ORDER BY ix)) AS d FROM ras) {_out('surface_step', 'warn', 'ix', 'iy', chr(39) + 'step ' + chr(39) + ' || CAST(d AS VARCHAR)', 'iy * 100 + ix')} FROM s WHERE d > 120 AND NOT (ix BETWEEN 40 AND 60 AND iy BETWEEN 10 AND 30)")
def _(w):
    s = w.ras.withColumn("d", F.abs(F.col("v") - F.lag("v").over(A.rows())))
    return U.issues(s, "surface_step", "warn", F.col("iy") * 100 + F.col("ix"), F.concat(L("step "), _s("d")), "ix", "iy", "d > 120 and not (ix between 40 and 60 and iy between 10 and 30)")


@query("q14_ridge_crossing", f", h AS (SELECT DISTINCT p.id, p.x, p.y FROM pts p JOIN gnode g ON power(p.x - g.x, 2) + power(p.y - g.y, 2) <= 9 WHERE p.event_type <> 'view') {_out('ridge_crossing', 'error', 'x', 'y', chr(39) + 'crest on a river' + chr(39), 'id')} FROM h WHERE NOT EXISTS (SELECT 1 FROM zone z WHERE power(h.x - (x0 + x1) / 2.0, 2) + power(h.y - (y0 + y1) / 2.0, 2) <= 3600)")
def _(w):
    crest = w.pts.where("event_type <> 'view'").select("id", "x", "y")
    hit = P.within(crest, w.gnode.select(F.col("x").alias("bx"), F.col("y").alias("by")), 3.0, bx="bx", by="by").select("id", F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    saddles = w.zone.select(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    return U.issues(P.keep_out(hit, saddles, 60.0), "ridge_crossing", "error", "id", L("crest on a river"), "x", "y")


@query("q15_pits", f""", z AS (SELECT ix, iy, v // 40 AS z FROM ras), l AS (SELECT DISTINCT z AS lev FROM z), o(lev, ix, iy) AS (SELECT lev, ix, iy FROM z, l WHERE z <= lev AND (ix IN (0, 99) OR iy IN (0, 49)) UNION SELECT o.lev, c.ix, c.iy FROM o JOIN z c ON abs(c.ix - o.ix) <= 1 AND abs(c.iy - o.iy) <= 1 AND c.z <= o.lev),
p AS (SELECT iy * 100 + ix AS n, ix, iy, f - z AS depth FROM (SELECT ix, iy, min(lev) AS f FROM o GROUP BY 1, 2) JOIN z USING (ix, iy) WHERE f > z), e(a, b) AS (SELECT a.n, b.n FROM p a JOIN p b ON abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1), r(a, b) AS (SELECT n, n FROM p UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT k, count(*) AS cells, max(depth) AS deep FROM (SELECT a AS n, min(b) AS k FROM r GROUP BY a) JOIN p USING (n) GROUP BY k HAVING count(*) >= 2) {_out('pit', 'error', 'k % 100', 'k // 100', "CAST(cells AS VARCHAR) || ' cells, ' || CAST(deep AS VARCHAR) || ' deep'", 'k')} FROM c""")
def _(w):
    """Clusters of cells that stand under water when all pits are filled."""
    wet = T.flooded(w.ras.selectExpr("ix", "iy", "v div 40 as z"), "z").withColumn("depth", (F.col("filled") - F.col("z")).cast("long")).where("depth > 0").select("ix", "iy", "depth")
    c = A.label(wet, 100).join(wet, ["ix", "iy"]).groupBy("label").agg(F.count("*").alias("cells"), F.max("depth").alias("deep")).where("cells >= 2")
    return U.issues(c, "pit", "error", "label", F.concat(_s("cells"), L(" cells, "), _s("deep"), L(" deep")), F.col("label") % 100, F.expr("label div 100"))


@query("q16_spikes", f", {_GRAD}, b AS (SELECT a.ix, a.iy, median(c.v) AS m FROM ras a JOIN ras c ON abs(c.ix - a.ix) <= 1 AND abs(c.iy - a.iy) <= 1 GROUP BY 1, 2) {_out('spike', 'warn', 'ix', 'iy', chr(39) + 'off the median' + chr(39), 'iy * 100 + ix')} FROM b JOIN g USING (ix, iy) WHERE abs(v - m) > 3 + 2.5 * sqrt(gx * gx + gy * gy)")
def _(w):
    j = A.spikes(A.gradient(w.ras, "v", 2.5), "v", 3.0)
    return U.issues(j, "spike", "warn", F.col("iy") * 100 + F.col("ix"), L("off the median"), "ix", "iy", F.abs(F.col("v") - F.col("median")) > F.hypot("gx", "gy") * 2.5 + 3)


@query("q17_zone_slope", f", {_GRAD}, z AS (SELECT zid, avg(CASE WHEN sqrt(gx * gx + gy * gy) > 25 THEN 1.0 ELSE 0 END) AS share FROM g JOIN zone ON ix * 20 + 10 >= x0 AND ix * 20 + 10 < x1 AND iy * 13 + 6 >= y0 AND iy * 13 + 6 < y1 GROUP BY 1) {_out('zone_slope', 'warn', None, None, chr(39) + 'too steep' + chr(39), 'zid')} FROM z WHERE share > 0.03")
def _(w):
    g = A.gradient(w.ras, "v", 2.5).select((F.col("ix") * 20 + 10).alias("x"), (F.col("iy") * 13 + 6).alias("y"), F.hypot("gx", "gy").alias("s"))
    z = g.join(F.broadcast(w.zone), (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))).groupBy("zid").agg(F.avg(F.when(F.col("s") > 25, 1.0).otherwise(0.0)).alias("share"))
    return U.issues(z, "zone_slope", "warn", "zid", L("too steep"), where="share > 0.03")


@query("q18_seam", f", d AS (SELECT ix, iy, abs(v - 2 * lag(v) OVER r + lag(v, 2) OVER r) AS d2 FROM ras WINDOW r AS (PARTITION BY iy ORDER BY ix)) {_out('seam', 'error', 'ix', 'iy', chr(39) + 'jump ' + chr(39) + ' || CAST(d2 AS VARCHAR)', 'iy * 100 + ix')} FROM d WHERE ix % 10 = 0 AND d2 > (SELECT greatest(quantile_cont(d2, 0.9), 3) FROM d)")
def _(w):
    d = w.ras.select("ix", "iy", F.abs(F.col("v") - 2 * F.lag("v").over(A.rows()) + F.lag("v", 2).over(A.rows())).alias("d2"))
    lim = F.broadcast(d.agg(F.greatest(F.percentile("d2", 0.9), L(3.0)).alias("lim")))
    return U.issues(d.crossJoin(lim), "seam", "error", F.col("iy") * 100 + F.col("ix"), F.concat(L("jump "), _s("d2")), "ix", "iy", "ix % 10 = 0 and d2 > lim")


@query("q19_backdrop_rim", f", b AS (SELECT ix // 2 AS bx, iy // 2 AS by_, avg(v) AS m FROM ras GROUP BY 1, 2) {_out('backdrop_rim', 'warn', 'ix', 'iy', chr(39) + 'rim differs' + chr(39), 'iy * 100 + ix')} FROM ras JOIN b ON bx = ix // 2 AND by_ = iy // 2 WHERE (ix IN (0, 99) OR iy IN (0, 49)) AND abs(v - m) > 40")
def _(w):
    from ..operators.aggregate import block_reduce

    b = block_reduce(w.ras, 2, F.avg("v").alias("m"))
    ring = w.ras.where("ix in (0, 99) or iy in (0, 49)").withColumns({"bx": F.expr("ix div 2"), "by": F.expr("iy div 2")}).join(b, ["bx", "by"])
    return U.issues(ring, "backdrop_rim", "warn", F.col("iy") * 100 + F.col("ix"), L("rim differs"), "ix", "iy", "abs(v - m) > 40")


@query("q20_road_corridor", "SELECT cls, round(avg(abs(v - 300)), 4) AS mean, round(quantile_cont(abs(v - 300), 0.95), 4) AS p95, max(abs(v - 300)) AS top FROM ras GROUP BY cls HAVING count(*) > 20")
def _(w):
    d = F.abs(F.col("v") - 300)
    return w.ras.groupBy("cls").agg(R(F.avg(d), 4).alias("mean"), R(F.percentile(d, 0.95), 4).alias("p95"), F.max(d).alias("top"), F.count("*").alias("n")).where("n > 20").drop("n")


_STEP = "st AS (SELECT t.*, abs(y - lag(y) OVER w) / greatest(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 1.0) AS grade FROM track t WINDOW w AS (PARTITION BY user_id ORDER BY seq))"


@query("q21_grade_limit", f", {_STEP}, g AS (SELECT user_id, avg(grade) AS grade FROM st GROUP BY 1) {_out('grade', 'warn', None, None, 'type', 'user_id')} FROM g JOIN dim ON kind = user_id % 6 WHERE grade > max_grade * 1.05 * 5")
def _(w):
    by = Q.along()
    dx, dy = F.col("x") - F.lag("x").over(by), F.col("y") - F.lag("y").over(by)
    g = w.track.withColumn("grade", F.abs(dy) / F.greatest(F.hypot(dx, dy), L(1.0))).groupBy("user_id").agg(F.avg("grade").alias("grade")).withColumn("kind", F.col("user_id") % 6)
    return U.issues(g.join(F.broadcast(w.dim), "kind"), "grade", "warn", "user_id", F.col("type"), where="grade > max_grade * 1.05 * 5")


@query("q22_earthwork", f", e AS (SELECT user_id, max(y - 300) AS fill, max(300 - y) AS cut FROM track GROUP BY 1) {_out('earthwork', 'warn', None, None, 'CAST(cut AS VARCHAR) || ' + chr(39) + '/' + chr(39) + ' || CAST(fill AS VARCHAR)', 'user_id')} FROM e WHERE fill > 360 OR cut > 295")
def _(w):
    e = w.track.groupBy("user_id").agg(F.max(F.col("y") - 300).alias("fill"), F.max(L(300) - F.col("y")).alias("cut"))
    return U.issues(e, "earthwork", "warn", "user_id", F.concat_ws("/", _s("cut"), _s("fill")), where="fill > 360 or cut > 295")


@query("q23_duplicate_ids", f"{_out('duplicate_id', 'error', None, None, 'CAST(count(*) AS VARCHAR)', 'o_custkey')} FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def _(w):
    twice = w.table("orders").groupBy("o_custkey").count().where("count > 1")
    return U.issues(twice, "duplicate_id", "error", "o_custkey", _s("count"))


@query("q24_strict_gate", "SELECT count(*) AS errors, CAST(count(*) > 0 AS BIGINT) AS exit_code FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT p_partkey FROM part GROUP BY 1 HAVING count(*) > 1)")
def _(w):
    """Customers with several orders close the gate; parts, whose keys are unique, don't."""
    found = [U.issues(w.table(t).groupBy(k).count().where("count > 1"), "duplicate_id", "error", k, _s("count")) for t, k in (("orders", "o_custkey"), ("part", "p_partkey"))]
    return U.gate(U.report(*found))


#: Where a footprint is sampled: its middle, the middles of its sides and points near its corners.
_FOOT = ((0, 0), (20, 0), (-20, 0), (0, 14), (0, -14), (14, 10), (-14, 10), (14, -10), (-14, -10))


@query("q25_placement", f", foot(ax, ay) AS (VALUES {', '.join(map(str, _FOOT))}), low AS (SELECT p.id, min(r.v) AS lo FROM pts p CROSS JOIN foot JOIN ras r ON r.ix = least(1999, greatest(0, p.x + ax)) // 20 AND r.iy = least(666, greatest(0, p.y + ay)) // 14 GROUP BY 1) SELECT id, least(lo, p.y) AS base FROM pts p JOIN low USING (id) JOIN ras r ON r.ix = p.x // 20 AND r.iy = p.y // 14 WHERE r.cls <> 4 AND p.y > r.v - 100")
def _(w):
    """Bases are lowered to the lowest ground under their footprint; those on pavement (class 4) are dropped."""
    p = w.pts.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras.select("ix", "iy", "v", "cls"), ["ix", "iy"]).where("cls <> 4 and y > v - 100")
    foot = p.select("id", "x", "y", F.explode(F.array(*[F.struct(L(a).alias("ax"), L(b).alias("ay")) for a, b in _FOOT])).alias("f"))
    foot = foot.selectExpr("id", "y", "least(1999, greatest(0, x + f.ax)) div 20 as ix", "least(666, greatest(0, y + f.ay)) div 14 as iy")
    return foot.join(w.ras.select("ix", "iy", "v"), ["ix", "iy"]).groupBy("id", "y").agg(F.min("v").alias("lo")).select("id", F.least("lo", "y").alias("base"))


@query("q26_ramp_radius", f", {_RAD}, m AS (SELECT user_id, min(radius) AS r FROM rad WHERE seq > 3 AND seq < n - 2 GROUP BY 1) {_out('ramp_radius', 'warn', None, None, chr(39) + 'tight ramp' + chr(39), 'user_id')} FROM m WHERE r < 45")
def _(w):
    n = F.count("*").over(Window.partitionBy("user_id"))
    m = Q.circumradius(w.track, 2).withColumn("n", n).where("seq > 3 and seq < n - 2").groupBy("user_id").agg(F.min("radius").alias("r"))
    return U.issues(m, "ramp_radius", "warn", "user_id", L("tight ramp"), where="r < 45")


@query("q00_report_summary", f", {_DEG}, {_GAPS}, s AS (SELECT node, count(*) AS n, min(gap) AS lo, string_agg(DISTINCT type, ', ') AS types FROM gaps GROUP BY node) SELECT 'sharp_angle' AS kind, 'error' AS severity, count(*) AS n FROM s WHERE n >= 3 AND lo < 25 AND types <> 'freeway' HAVING count(*) > 0 UNION ALL SELECT 'short_edge', 'warn', count(*) FROM gedge JOIN deg a ON a.node = src JOIN deg b ON b.node = dst WHERE len < 30 AND a.degree >= 2 AND b.degree >= 2 HAVING count(*) > 0")
def _(w):
    return U.summary(U.report(sharp_angle_rule(w), short_edge_rule(w)))
