"""Queries of the graph (G) family and of component aggregates."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import graph as G
from ..operators import spatial as P
from .registry import query
from .spatial_queries import _PROJ, _SEG, _X, _segments

R = F.round
_REACH = "und(a, b) AS (SELECT src, dst FROM gedge UNION SELECT dst, src FROM gedge), reach(a, b) AS (SELECT a, a FROM und UNION SELECT r.a, u.b FROM reach r JOIN und u ON u.a = r.b), comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a)"


@query("g01_components", f", {_REACH} SELECT node, component FROM comp")
def _(w):
    return G.components(w.gedge)


@query("a21_component_lengths", f", {_REACH}, l AS (SELECT component, CAST(sum(len) AS BIGINT) AS total, count(*) AS edges FROM gedge JOIN comp ON src = node GROUP BY 1) SELECT component, total, edges, row_number() OVER (ORDER BY total DESC, component) AS rank FROM l")
def _(w):
    return G.component_lengths(w.gedge, "len")


@query("a14_component_boxes", f", {_REACH} SELECT component, count(*) AS n, round(avg(x), 3) AS cx, round(avg(y), 3) AS cy, min(x) AS x0, max(y) AS y1 FROM gnode JOIN comp USING (node) GROUP BY 1")
def _(w):
    c = w.gnode.join(G.components(w.gedge), "node")
    return c.groupBy("component").agg(F.count("*").alias("n"), R(F.avg("x"), 3).alias("cx"), R(F.avg("y"), 3).alias("cy"), F.min("x").alias("x0"), F.max("y").alias("y1"))


@query("g02_drop_small_components", f", {_REACH} SELECT eid FROM gedge JOIN comp ON src = node WHERE component IN (SELECT component FROM gedge JOIN comp ON src = node GROUP BY 1 HAVING count(*) >= 6)")
def _(w):
    c = w.gedge.join(G.components(w.gedge), F.col("src") == F.col("node"))
    large = c.groupBy("component").count().where("count >= 6").select("component")
    return c.join(large, "component", "left_semi").select("eid")


@query("g03_merge_nodes", """, p AS (SELECT id, x, y FROM pts), n(a, b) AS (SELECT a.id, b.id FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 4 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 16),
r(a, b) AS (SELECT id, id FROM p UNION SELECT r.a, n.b FROM r JOIN n ON n.a = r.b) SELECT a AS id, min(b) AS node FROM r GROUP BY a""")
def _(w):
    return G.merge_nodes(w.pts.select("id", "x", "y"), 4.0)


@query("g04_noding", f""", {_SEG}, {_X}, c AS (SELECT a AS sid, d3 / CAST(d3 - d4 AS DOUBLE) AS t FROM q WHERE sign(d1) * sign(d2) < 0 AND sign(d3) * sign(d4) < 0 UNION ALL SELECT b, d1 / CAST(d1 - d2 AS DOUBLE) FROM q WHERE sign(d1) * sign(d2) < 0 AND sign(d3) * sign(d4) < 0),
k AS (SELECT sid, t FROM c UNION ALL SELECT sid, 0.0 FROM seg UNION ALL SELECT sid, 1.0 FROM seg), o AS (SELECT sid, t AS t0, lead(t) OVER (PARTITION BY sid ORDER BY t) AS t1, row_number() OVER (PARTITION BY sid ORDER BY t) AS k FROM k) SELECT sid, k, round(t0, 5) AS t0, round(t1, 5) AS t1 FROM o WHERE t1 IS NOT NULL""")
def _(w):
    """Segments are cut where they cross others; the pieces of each are numbered."""
    return P.noded(_segments(w), 20.0, digits=5)


@query("g05_snap_endpoints", f""", {_SEG}, m AS (SELECT g.node, g.x, g.y, s.*, least(1.0, greatest(0.0, ((g.x - s.x0) * (s.x1 - s.x0) + (g.y - s.y0) * (s.y1 - s.y0)) / greatest(1e-9, power(s.x1 - s.x0, 2) + power(s.y1 - s.y0, 2)))) AS t FROM gnode g JOIN seg s ON abs(g.x - s.x0) <= 30 AND abs(g.y - s.y0) <= 32),
d AS (SELECT *, sqrt(power(x - (x0 + t * (x1 - x0)), 2) + power(y - (y0 + t * (y1 - y0)), 2)) AS d FROM m), b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(d, 9), sid) AS rn FROM d WHERE d <= 6)
SELECT node, sid, round(CASE WHEN power(x - x0, 2) + power(y - y0, 2) <= 16 THEN 0.0 WHEN power(x - x1, 2) + power(y - y1, 2) <= 16 THEN 1.0 ELSE t END, 4) AS t FROM b WHERE rn = 1""")
def _(w):
    """Each node goes to the nearest line within 6, to its end if that is within 4."""
    best = P.nearest_segment(w.gnode.select(F.col("node").alias("id"), "x", "y"), _segments(w), 6.0, 40.0)
    at = lambda k: F.hypot(F.col("x") - F.col(f"x{k}"), F.col("y") - F.col(f"y{k}")) <= 4
    return best.select(F.col("id").alias("node"), "sid", R(F.when(at(0), 0.0).when(at(1), 1.0).otherwise(F.col("t")), 4).alias("t"))


@query("g06_through_chains", """, e AS (SELECT eid, kind % 2 AS kind, src, dst FROM gedge), n AS (SELECT node, min(eid) AS a, max(eid) AS b FROM (SELECT src AS node, eid, kind FROM e UNION ALL SELECT dst, eid, kind FROM e) GROUP BY node HAVING count(*) = 2 AND count(DISTINCT kind) = 1),
u(a, b) AS (SELECT a, b FROM n UNION SELECT b, a FROM n), r(a, b) AS (SELECT eid, eid FROM e UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b) SELECT a AS eid, min(b) AS chain FROM r GROUP BY a""")
def _(w):
    return G.through_chains(w.gedge.withColumn("kind", F.col("kind") % 2), "kind")


_PRUNE = "SELECT * FROM {0} WHERE NOT (len < 60 AND (src IN (SELECT node FROM (SELECT src AS node FROM {0} UNION ALL SELECT dst FROM {0}) GROUP BY 1 HAVING count(*) = 1) OR dst IN (SELECT node FROM (SELECT src AS node FROM {0} UNION ALL SELECT dst FROM {0}) GROUP BY 1 HAVING count(*) = 1)))"


@query("g07_prune_spurs", f", p1 AS ({_PRUNE.format('gedge')}), p2 AS ({_PRUNE.format('p1')}), p3 AS ({_PRUNE.format('p2')}), p4 AS ({_PRUNE.format('p3')}) SELECT eid FROM p4")
def _(w):
    return G.prune_spurs(w.gedge, "len", 60, 4).select("eid")


@query("g11_drop_duplicates", ", e AS (SELECT g.*, d.rank FROM gedge g JOIN dim d USING (kind)) SELECT eid FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.src = a.src AND b.eid <> a.eid AND abs(b.len - a.len) <= 6 AND (b.rank, b.len, b.eid) > (a.rank, a.len, a.eid))")
def _(w):
    """An edge goes if another one from the same node and nearly as long outranks it: the best of its neighbours in order of length."""
    e = w.gedge.join(F.broadcast(w.dim.select("kind", "rank")), "kind")
    near = Window.partitionBy("src").orderBy("len").rangeBetween(-6, 6)
    own = F.struct("rank", "len", "eid")
    return e.withColumn("best", F.max(own).over(near)).where(F.col("best") == own).select("eid")


@query("g12_loop_rules", """, q AS (SELECT user_id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
m AS (SELECT user_id, abs(sum(x * ny - nx * y)) / 2.0 AS area, sum(sqrt(power(nx - x, 2) + power(ny - y, 2))) AS len FROM q GROUP BY 1) SELECT user_id, CASE WHEN len < 40000 THEN 'tiny' WHEN area < 10 * len THEN 'thin' ELSE 'loop' END AS kind FROM m""")
def _(w):
    by = Window.partitionBy("user_id").orderBy("seq")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    q = w.track.withColumns({"nx": F.coalesce(F.lead("x").over(by), F.first("x").over(whole)), "ny": F.coalesce(F.lead("y").over(by), F.first("y").over(whole))})
    m = q.groupBy("user_id").agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2.0).alias("area"), F.sum(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y"))).alias("len"))
    return m.select("user_id", F.when(F.col("len") < 40000, "tiny").when(F.col("area") < 10 * F.col("len"), "thin").otherwise("loop").alias("kind"))


@query("g13_bridge_components", f""", {_REACH}, l AS (SELECT ca.component AS component, a.node AS a, b.node AS b, power(a.x - b.x, 2) + power(a.y - b.y, 2) AS d FROM gnode a JOIN gnode b ON a.x BETWEEN b.x - 50 AND b.x + 50 AND power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 2500 JOIN comp ca ON ca.node = a.node JOIN comp cb ON cb.node = b.node WHERE ca.component <> cb.component)
SELECT component, arg_min(a, (d, a, b)) AS a, arg_min(b, (d, a, b)) AS b FROM l GROUP BY component""")
def _(w):
    """The shortest link within 50 from each component to another one."""
    c = w.gnode.join(G.components(w.gedge), "node")
    m = P.shortest_links(c.select("node", "component", "x", "y"), 50.0)
    return m.select("component", "a", "b")


@query("g14_split_at_station", f", {_SEG}, q AS (SELECT g.node, s.sid, sqrt(power(s.x1 - s.x0, 2) + power(s.y1 - s.y0, 2)) AS len, {_PROJ} AS t, sqrt(power(g.x - (s.x0 + {_PROJ} * (s.x1 - s.x0)), 2) + power(g.y - (s.y0 + {_PROJ} * (s.y1 - s.y0)), 2)) AS d FROM gnode g JOIN seg s ON g.x BETWEEN least(s.x0, s.x1) - 6 AND greatest(s.x0, s.x1) + 6 AND g.y BETWEEN least(s.y0, s.y1) - 6 AND greatest(s.y0, s.y1) + 6) SELECT node, sid, CASE WHEN t * len < 0.3 THEN 'start' WHEN t * len > len - 0.3 THEN 'end' ELSE 'split' END AS place, round(t * len, 3) AS station FROM q WHERE d <= 6")
def _(w):
    """Where each node splits the segments it lies within 6 of."""
    length = F.hypot(F.col("b_x1") - F.col("b_x0"), F.col("b_y1") - F.col("b_y0"))
    at = F.col("t") * length
    place = F.when(at < 0.3, "start").when(at > length - 0.3, "end").otherwise("split")
    return P.all_near_segments(w.gnode.select(F.col("node").alias("id"), "x", "y"), _segments(w), 6.0, 40.0, place=place, station=R(at, 3)).withColumnRenamed("id", "node")


def _legs(w):
    """Legs at both ends of each edge, up to eight at a node, with bearings, types and ranks."""
    there = (F.col("src") * 37 + F.col("dst") * 53) % 360
    ends = F.explode(F.array(F.struct(F.col("dst").alias("node"), there.alias("bearing")), F.struct(F.col("src").alias("node"), ((there + 180) % 360).alias("bearing"))))
    both = w.gedge.select(F.col("eid").alias("leg"), "kind", ends.alias("e")).select("e.node", "leg", "e.bearing", "kind", (F.col("e.node") % 3 == 0).alias("urban"))
    return both.join(F.broadcast(w.dim.select("kind", "type", "rank")), "kind")


_LEGS = "legs AS (SELECT node, leg, bearing, type, rank, node % 3 = 0 AS urban FROM (SELECT dst AS node, eid AS leg, (src * 37 + dst * 53) % 360 AS bearing, kind FROM gedge UNION ALL SELECT src, eid, (src * 37 + dst * 53 + 180) % 360, kind FROM gedge) JOIN dim USING (kind))"
_GAPS = f"{_LEGS}, gaps AS (SELECT *, (coalesce(lead(bearing) OVER (PARTITION BY node ORDER BY bearing, leg), first_value(bearing) OVER (PARTITION BY node ORDER BY bearing, leg)) - bearing + 360) % 360 AS gap FROM legs)"


@query("g16_junction_kind", f""", {_GAPS}, s AS (SELECT node, count(*) AS degree, min(gap) AS lo, max(gap) AS hi, bool_or(abs(gap - 180) < 25) AS straight, bool_and(abs(gap - 90) < 30) AS sq, bool_or(urban) AS urban, bool_or(type = 'freeway') AS sep FROM gaps GROUP BY node)
SELECT node, degree, CASE WHEN degree = 1 THEN 'end' WHEN degree = 2 THEN 'type_change' WHEN sep THEN 'merge' WHEN degree = 3 THEN CASE WHEN lo < 40 THEN 'fork' WHEN abs(hi - 180) < 30 OR straight THEN CASE WHEN urban THEN 'city' ELSE 'T' END WHEN hi > 200 THEN 'fork' ELSE 'angled' END
 WHEN degree = 4 THEN CASE WHEN urban THEN 'city' WHEN sq THEN 'cross' ELSE 'angled' END ELSE 'multi' END AS kind FROM s""")
def _(w):
    return G.junction_kind(_legs(w))


@query("g17_rural_class", ", d AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM gedge UNION ALL SELECT dst FROM gedge) GROUP BY 1) SELECT eid, CASE WHEN (a.n = 1 OR b.n = 1) AND len < 30 THEN 'driveway' WHEN a.n = 1 OR b.n = 1 THEN 'dirt' WHEN len > 70 THEN 'rural' ELSE 'gravel' END AS class FROM gedge JOIN d a ON a.node = src JOIN d b ON b.node = dst")
def _(w):
    d = G.degrees(w.gedge)
    j = w.gedge.join(d.select(F.col("node").alias("src"), F.col("degree").alias("a")), "src").join(d.select(F.col("node").alias("dst"), F.col("degree").alias("b")), "dst")
    dead = (F.col("a") == 1) | (F.col("b") == 1)
    return j.select("eid", F.when(dead & (F.col("len") < 30), "driveway").when(dead, "dirt").when(F.col("len") > 70, "rural").otherwise("gravel").alias("class"))


@query("g22_through_pair", f", {_LEGS}, p AS (SELECT a.node, a.leg AS a, b.leg AS b, a.rank + b.rank - abs(180 - abs((a.bearing - b.bearing + 180 + 360) % 360 - 180)) / 20.0 AS score FROM legs a JOIN legs b ON a.node = b.node AND a.leg < b.leg) SELECT node, arg_max(a, (score, -a, -b)) AS a, arg_max(b, (score, -a, -b)) AS b FROM p GROUP BY node")
def _(w):
    """The pair of legs of a junction that is straightest and highest in rank; a junction has few legs."""
    l = _legs(w)
    a, b = (l.select("node", F.col("leg").alias(c), F.col("bearing").alias(f"{c}b"), F.col("rank").alias(f"{c}r")) for c in "ab")
    score = F.col("ar") + F.col("br") - F.abs(F.lit(180) - S.angle_between("ab", "bb")) / 20.0
    m = a.join(b, "node").where("a < b").groupBy("node").agg(F.max(F.struct(score.alias("s"), (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("m"))
    return m.select("node", (-F.col("m.x")).alias("a"), (-F.col("m.y")).alias("b"))


def _warranted(w):
    """Junctions of three legs or more without a freeway, where big roads meet each other or a collector, with a score."""
    s = _legs(w).groupBy("node").agg(F.count("*").alias("n"), F.bool_or(F.col("type") == "freeway").alias("f"), F.count_if(F.col("type").isin("arterial", "highway")).alias("big"), F.count_if(F.col("type") == "collector").alias("mid"))
    return s.where("n >= 3 and not f and big >= 1 and big + mid >= 2").select("node", (F.col("big") + 3).alias("score"))


_WARRANT = "sig AS (SELECT node, 3 + big AS score FROM (SELECT node, count(*) AS n, bool_or(type = 'freeway') AS f, count(*) FILTER (WHERE type IN ('arterial', 'highway')) AS big, count(*) FILTER (WHERE type = 'collector') AS mid FROM legs GROUP BY 1) WHERE n >= 3 AND NOT f AND big >= 1 AND big + mid >= 2)"


@query("g23_traffic_control", f""", {_LEGS}, {_WARRANT}, k AS (SELECT leg, node, urban, leg % 5 = 0 AND leg // 10000000 = node AS outbound, CASE WHEN leg % 7 = 3 THEN 'ramp' WHEN leg % 11 = 0 THEN 'main_street' ELSE type END AS type, CASE WHEN leg % 7 = 3 THEN 0.5 ELSE rank END AS rank FROM legs),
o AS (SELECT a.*, coalesce((SELECT max(b.rank) FROM k b WHERE b.node = a.node AND b.leg <> a.leg), 0) AS major, count(*) OVER (PARTITION BY node) AS n, sum(CASE WHEN type IN ('arterial', 'main_street') THEN 1 ELSE 0 END) OVER (PARTITION BY node) AS big FROM k a)
SELECT leg, node, CASE WHEN type IN ('driveway', 'freeway') OR outbound THEN NULL WHEN node IN (SELECT node FROM sig WHERE score >= 5) THEN 'signal' WHEN urban AND n >= 4 AND big >= 3 THEN 'all_stop' WHEN type = 'ramp' THEN CASE WHEN major >= 5 THEN 'stop' END WHEN rank >= major THEN NULL WHEN rank <= 4 AND major >= 5 THEN 'stop' WHEN rank = 5 AND major >= 6 THEN 'stop' WHEN rank <= 3 AND major = 4 THEN 'yield' END AS control FROM o""")
def _(w):
    """Some legs are ramps, some main streets, some one-way away from their source; junctions with a warrant of 5 have signals."""
    known = F.when(F.col("leg") % 7 == 3, "ramp").when(F.col("leg") % 11 == 0, "main_street").otherwise(F.col("type"))
    legs = _legs(w).withColumns({"type": known, "dense": F.col("urban"), "outbound": (F.col("leg") % 5 == 0) & (F.expr("leg div 10000000") == F.col("node"))})
    return G.traffic_control(legs, _warranted(w).where("score >= 5")).select("leg", "node", "control")


@query("g24_signal_candidates", f", {_LEGS}, {_WARRANT} SELECT node, score FROM sig")
def _(w):
    return _warranted(w)
