"""Queries of the group kernels (W, G, R, K rows that expressions can't state); tests hold the kernels' properties."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import kernels as K
from ..operators import raster as A
from ..operators import spatial as P
from .graph_queries import _REACH
from .registry import query
from .spatial_queries import _SEG, _segments

PTS = "user_id long, k long, x double, y double"


def _numbered(x, y):
    return {"k": np.arange(len(x)), "x": x, "y": y}


def _line(w, kernel, schema=PTS, columns=("x", "y")):
    return K.per_line(w.track, "user_id", "seq", list(columns), kernel, schema)


@query("w04_robust_smoothing")
def _(w):
    return _line(w, lambda x, y: _numbered(*K.robust_smooth(x, y, 2.0, 200.0)))


@query("w18_turn_easing")
def _(w):
    return K.per_lines(w.track, "user_id", "seq", ["x", "y"], lambda lines: [_numbered(*eased) for eased in K.ease_lines(lines, 1.2)], PTS)


@query("w19_whittaker")
def _(w):
    return _line(w, lambda y: {"k": np.arange(len(y)), "z": K.whittaker(y, np.full(len(y), 10.0))}, "user_id long, k long, z double", ("y",))


@query("w20_simplify")
def _(w):
    def kernel(x, y):
        at = K.simplify(x, y, 150.0)
        return {"k": at, "x": x[at], "y": y[at]}

    return _line(w, kernel)


@query("w24_monotone_cubic")
def _(w):
    def kernel(y):
        s = np.arange(len(y), dtype=float)
        at = np.linspace(0, len(y) - 1, 2 * len(y) - 1)
        return {"k": np.arange(len(at)), "z": K.monotone_cubic(s, y, at)}

    return _line(w, kernel, "user_id long, k long, z double", ("y",))


@query("w25_capped_allocation")
def _(w):
    return _line(w, lambda x, y: {"k": np.arange(len(x)), "z": K.allocate(5000.0, x + 1, y)}, "user_id long, k long, z double")


@query("w26_peaks")
def _(w):
    return _line(w, lambda y: {"k": (p := K.peaks(y, 3, 120.0)), "z": y[p]}, "user_id long, k long, z double", ("y",))


@query("w34_cut_returns")
def _(w):
    def kernel(x, y):
        at = K.cut_returns(x, y, 60.0, 6)
        return {"k": at, "x": x[at], "y": y[at]}

    return _line(w, kernel)


@query("g21_virtual_links", f", {_SEG}, m AS (SELECT g.node, s.sid, power(g.x - (s.x0 + t * (s.x1 - s.x0)), 2) + power(g.y - (s.y0 + t * (s.y1 - s.y0)), 2) AS d FROM (SELECT g.node, g.x, g.y, s.*, CASE WHEN s.x0 = s.x1 AND s.y0 = s.y1 THEN 0 ELSE least(1.0, greatest(0.0, ((g.x - s.x0) * (s.x1 - s.x0) + (g.y - s.y0) * (s.y1 - s.y0)) / (power(s.x1 - s.x0, 2) + power(s.y1 - s.y0, 2)))) END AS t FROM gnode g JOIN seg s ON abs(g.x - s.x0) <= 27 AND abs(g.y - s.y0) <= 29 JOIN pts p ON p.id = s.sid AND p.event_type = 'view') s JOIN gnode g ON g.node = s.node) SELECT node, arg_min(sid, (round(sqrt(d), 9), sid)) AS sid FROM m WHERE d <= 64 GROUP BY node")
def _(w):
    """Each node is linked to the nearest freeway (lines of kind view) within 8."""
    freeways = _segments(w).join(w.pts.where("event_type = 'view'").select(F.col("id").alias("sid")), "sid", "left_semi")
    return P.nearest_segment(w.gnode.select(F.col("node").alias("id"), "x", "y"), freeways, 8.0, 40.0).select(F.col("id").alias("node"), "sid")


@query("r29_ridge_field", """, c AS (SELECT ix, iy, ix * 20 + 10 AS cx, iy * 13 + 6 AS cy FROM ras), n AS (SELECT ix, iy, user_id, min((sqrt((cx - x) * (cx - x) + (cy - y) * (cy - y)), seq)) AS m FROM c JOIN track ON abs(cx - x) <= 60 AND abs(cy - y) <= 60 AND (cx - x) * (cx - x) + (cy - y) * (cy - y) <= 3600 GROUP BY ix, iy, user_id),
h AS (SELECT ix, iy, user_id, power(1 - power(m[1] / 60.0, 2.0), 2.1) * (m[2] % 7 + 10.0) AS h FROM n), l AS (SELECT ix, iy, list_prepend(0.0::DOUBLE, list(h ORDER BY user_id)) AS hs FROM h GROUP BY ix, iy)
SELECT c.ix, c.iy, round(coalesce(list_reduce(hs, lambda a, b: greatest(a, b) + power(greatest(5.0 * greatest(0, least(1, least(a, b) / 10.0)) - abs(a - b), 0) / greatest(5.0 * greatest(0, least(1, least(a, b) / 10.0)), 1e-6), 2) * 5.0 * greatest(0, least(1, least(a, b) / 10.0)) * 0.25), 0), 4) AS h FROM c LEFT JOIN l USING (ix, iy)""")
def _(w):
    """Heights by the nearest crest sample of every line within 60, falling off by the ridge profile, as a smooth union in order of the lines."""
    from ..functions import scalar as S

    cells = w.ras.select("ix", "iy", (F.col("ix") * 20 + 10).alias("x"), (F.col("iy") * 13 + 6).alias("y"))
    crest = w.track.select("user_id", "seq", F.col("x").alias("bx"), F.col("y").alias("by"))
    best = P.within(cells, crest, 60.0, bx="bx", by="by").groupBy("ix", "iy", "user_id").agg(F.min(F.struct("dist", "seq")).alias("m"))
    h = best.select("ix", "iy", "user_id", (S.ridge_profile(F.col("m.dist") / 60.0) * (F.col("m.seq") % 7 + 10.0)).alias("h"))
    a = h.groupBy("ix", "iy").agg(F.transform(F.array_sort(F.collect_list(F.struct("user_id", "h"))), lambda s: s["h"]).alias("a"))  # a height a line
    joined = a.select("ix", "iy", F.aggregate("a", F.lit(0.0), lambda m, v: S.smax(m, v, 5.0)).alias("h"))
    return cells.select("ix", "iy").join(joined, ["ix", "iy"], "left").select("ix", "iy", F.round(F.coalesce("h", F.lit(0.0)), 4).alias("h"))


@query("k04_buffer_dissolve", ", h AS (SELECT DISTINCT r.ix, r.iy FROM ras r JOIN gnode g ON power(r.ix * 20 + 10 - g.x, 2) + power(r.iy * 13 + 6 - g.y, 2) <= 900) SELECT ix, iy FROM h")
def _(w):
    """Union of discs around nodes, as the cells whose centre lies in one."""
    from ..operators import spatial as P

    cells = w.ras.select("ix", "iy", (F.col("ix") * 20 + 10).alias("x"), (F.col("iy") * 13 + 6).alias("y"))
    return P.within(cells, w.gnode.select(F.col("x").alias("bx"), F.col("y").alias("by")), 30.0, bx="bx", by="by").select("ix", "iy").distinct()


@query("u04_dissolved_regions", f", {_REACH} SELECT component, count(DISTINCT (x // 100) * 100 + y // 100) AS chunks FROM gnode JOIN comp USING (node) GROUP BY component")
def _(w):
    from ..operators import graph as G

    return w.gnode.join(G.components(w.gedge), "node").groupBy("component").agg(F.count_distinct(F.expr("(x div 100) * 100 + y div 100")).alias("chunks"))


@query("k05_least_rectangle")
def _(w):
    def kernel(x, y):
        a, b, t = K.least_rectangle(np.stack([x, y], 1))
        return {"width": [a], "height": [b], "angle": [t]}

    return _line(w, kernel, "user_id long, width double, height double, angle double")


@query("k09_alignment_order", """, e AS (SELECT user_id, seq, id, x, y FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM track) WHERE seq = 1 OR seq = n),
b AS (SELECT e.id, arg_min(h.id, (sqrt((h.x - e.x) * (h.x - e.x) + (h.y - e.y) * (h.y - e.y)), h.id)) AS host FROM e JOIN track h ON h.user_id < e.user_id AND abs(h.x - e.x) <= 40 AND abs(h.y - e.y) <= 40 AND (h.x - e.x) * (h.x - e.x) + (h.y - e.y) * (h.y - e.y) <= 1600 GROUP BY e.id) SELECT e.user_id, e.seq, host, coalesce(h.x, e.x) AS x, coalesce(h.y, e.y) AS y FROM e LEFT JOIN b USING (id) LEFT JOIN pts h ON h.id = b.host""")
def _(w):
    """Lines in order of importance (their number): both ends of each are put onto the nearest sample of a more important line within 40."""
    from pyspark.sql import Window

    from ..operators.graph import cut

    n = F.count("*").over(Window.partitionBy("user_id"))
    ends = cut(w.track.withColumn("n", n).where("seq = 1 or seq = n").select("user_id", "seq", "id", "x", "y"))
    host = w.pts.select(F.col("id").alias("host"), F.col("user_id").alias("host_line"), F.col("x").alias("bx"), F.col("y").alias("by"))
    sq = (F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by"))

    def search(rest, r, last):
        met = P.within(rest, host, r, bx="bx", by="by").where("host_line < user_id")
        return met.groupBy("id").agg(F.min(F.struct(sq.alias("sq"), "host", "bx", "by")).alias("m"))

    # a sample within a radius is nearer than all beyond it
    best = P.by_rounds(ends, "id", search, P.start_radius(host, 8.0, "bx", "by"), 40.0).select("id", "m.host", "m.bx", "m.by")
    return ends.join(best, "id", "left").select("user_id", "seq", "host", F.coalesce("bx", "x").alias("x"), F.coalesce("by", "y").alias("y"))


@query("k10_centre_trace")
def _(w):
    """For each point the offset along its normal with the highest raster value, smoothed along the line."""
    from ..operators import sequence as Q

    t = Q.tangent(w.track).where("tx <> 0 or ty <> 0").withColumn("o", F.explode(F.sequence(F.lit(-3), F.lit(3))))
    n = F.hypot("tx", "ty")
    at = t.withColumns({"ix": F.floor((F.col("x") - F.col("ty") / n * F.col("o") * 20) / 20), "iy": F.floor((F.col("y") + F.col("tx") / n * F.col("o") * 20) / 14)})
    best = at.join(w.ras.select("ix", "iy", "v"), ["ix", "iy"]).groupBy("user_id", "seq").agg(F.max_by("o", F.struct("v", (-F.abs("o")).alias("a"), "o")).alias("o"))
    return Q.smooth(best, "o", "offset", Q.gaussian_weights(2, 1.0)).select("user_id", "seq", "offset")


@query("k11_bridge_spans", """, r AS (SELECT t.user_id, t.seq, t.seq - row_number() OVER (PARTITION BY t.user_id ORDER BY t.seq) AS g FROM track t JOIN ras c ON c.ix = t.x // 20 AND c.iy = t.y // 14 WHERE c.v < 290), u AS (SELECT user_id, min(seq) - 1 AS s0, max(seq) + 1 AS s1 FROM r GROUP BY user_id, g),
v AS (SELECT *, CASE WHEN s0 > max(s1) OVER (PARTITION BY user_id ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 OR lag(s0) OVER (PARTITION BY user_id ORDER BY s0, s1) IS NULL THEN 1 ELSE 0 END AS f FROM u), q AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS g FROM v) SELECT user_id, min(s0) AS s0, max(s1) AS s1, count(*) AS n FROM q GROUP BY user_id, g""")
def _(w):
    """Wet runs with padding on both banks, joined where they touch."""
    from ..operators import sequence as Q

    wet = w.track.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras.select("ix", "iy", "v"), ["ix", "iy"], "left")
    runs = Q.runs(wet, F.coalesce(F.col("v") < 290, F.lit(False))).select("user_id", (F.col("first") - 1).alias("s0"), (F.col("last") + 1).alias("s1"))
    return Q.merge_intervals(runs, "s0", "s1", 1)
