"""Queries of the sampling and placement family (N) and greedy selection."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import placement as N
from ..operators import sequence as Q
from ..operators import spatial as P
from .registry import query
from .spatial_queries import _SEG, _X, _segments

R = F.round


def _u(key, salt):
    return f"(CAST('0x' || left(md5({key} || '_{salt}'), 8) AS UBIGINT) / 4294967296.0)"


_K = "CAST(k AS VARCHAR)"
_GRID = f"grid AS (SELECT k, (k % 100 + {_u(_K, 'gridx')}) * 20.0 AS x, (k // 100 + {_u(_K, 'gridy')}) * 13.0 AS y, {_u(_K, 'grid')} AS u FROM range(5000) r(k))"


@query("n01_jittered_bernoulli", f", {_GRID} SELECT k, round(grid.x, 4) AS x, round(grid.y, 4) AS y FROM grid JOIN ras ON ix = k % 100 AND iy = k // 100 WHERE u < v / 900.0")
def _(w):
    g = N.jittered_grid(w.spark, 100, 50, 20.0).withColumn("y", F.col("y") * 13.0 / 20.0).withColumns({"ix": F.col("k") % 100, "iy": F.expr("k div 100")})
    return g.join(w.ras, ["ix", "iy"]).where("u < v / 900.0").select("k", R("x", 4).alias("x"), R("y", 4).alias("y"))


_WSUM = "(1.0 + v / 300.0 + 0.5 + cls)"


@query("n02_weighted_choice", f", c AS (SELECT ix, iy, v, cls, {_u('CAST(iy * 100 + ix AS VARCHAR)', 'species')} AS u FROM ras) SELECT ix, iy, CASE WHEN 1.0 / {_WSUM} > u THEN 'oak' WHEN (1.0 + v / 300.0) / {_WSUM} > u THEN 'pine' WHEN (1.5 + v / 300.0) / {_WSUM} > u THEN 'fir' ELSE 'birch' END AS species FROM c")
def _(w):
    c = w.ras.withColumn("u", N.draw(F.col("iy") * 100 + F.col("ix"), salt="species"))
    weights = {"oak": F.lit(1.0), "pine": F.col("v") / 300.0, "fir": F.lit(0.5), "birch": F.col("cls").cast("double")}
    return N.choose(c, weights, F.col("u"), "species").select("ix", "iy", "species")


def scatter(w, layer, share):
    g = N.jittered_grid(w.spark, 100, 50, 20.0, layer).withColumns({"ix": F.col("k") % 100, "iy": F.expr("k div 100")})
    return g.join(w.ras, ["ix", "iy"]).where(F.col("u") < F.col("v") / 900.0 * share).select(F.lit(layer).alias("layer"), "k")


def _layer(name, share):
    return f"SELECT '{name}' AS layer, k FROM range(5000) r(k) JOIN ras ON ix = k % 100 AND iy = k // 100 WHERE {_u(_K, name)} < v / 900.0 * {share}"


@query("n03_layers", f"{_layer('canopy', 0.5)} UNION ALL {_layer('shrub', 0.3)} UNION ALL {_layer('rock', 0.1)}")
def _(w):
    return scatter(w, "canopy", 0.5).unionByName(scatter(w, "shrub", 0.3)).unionByName(scatter(w, "rock", 0.1))


@query("n04_variants", f"SELECT id, CASE WHEN {_u('CAST(id AS VARCHAR)', 'variant')} < 0.2 THEN event_type || '_dead' ELSE event_type END AS species FROM pts")
def _(w):
    return w.pts.select("id", F.when(N.draw("id", salt="variant") < 0.2, F.concat("event_type", F.lit("_dead"))).otherwise(F.col("event_type")).alias("species"))


@query("n05_lot_frontage")
def _(w):
    """Footprints along both sides of streets, earlier stations first, off the lanes of other streets and of one another."""
    lots = N.frontage(w.street.select("eid", "x0", "y0", "x1", "y1"), 16.0, 4.0, 3.0)
    return lots.select("eid", "side", "k", R("x", 3).alias("x"), R("y", 3).alias("y"), R("w", 3).alias("w"), R("d", 3).alias("d"), R("angle", 4).alias("angle"))


@query("n06_roof_candidates", ", b AS (SELECT x // 40 AS bx, y // 40 AS by_, count(*) AS n, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM pts GROUP BY 1, 2) SELECT bx, by_, n, w * h AS area FROM b WHERE w * h BETWEEN 200 AND 1400 AND n * 1.0 / (w * h) > 0.005 AND greatest(w, h) * 1.0 / least(w, h) < 3")
def _(w):
    b = w.pts.groupBy(F.expr("x div 40").alias("bx"), F.expr("y div 40").alias("by_")).agg(F.count("*").alias("n"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return b.where("w * h between 200 and 1400 and n / (w * h) > 0.005 and greatest(w, h) / least(w, h) < 3").select("bx", "by_", "n", (F.col("w") * F.col("h")).alias("area"))


@query("n07_props", f"{_layer('props', 0.2)} AND cls IN (1, 2)")
def _(w):
    g = scatter(w, "props", 0.2)
    return g.withColumns({"ix": F.col("k") % 100, "iy": F.expr("k div 100")}).join(w.ras.where("cls in (1, 2)"), ["ix", "iy"], "left_semi").select("layer", "k")


@query("n08_rocks", f"SELECT k, least(ras.v, coalesce(n.v, ras.v)) AS base FROM range(5000) r(k) JOIN ras ON ras.ix = k % 100 AND ras.iy = k // 100 LEFT JOIN ras n ON n.ix = ras.ix + 1 AND n.iy = ras.iy WHERE {_u(_K, 'rocks')} < 0.3 AND ras.v > 300")
def _(w):
    """Rocks on high ground, set down to the lower of two cells."""
    c = w.ras.withColumns({"k": F.col("iy") * 100 + F.col("ix"), "next": F.lead("v").over(Window.partitionBy("iy").orderBy("ix"))})
    return c.where((N.draw("k", salt="rocks") < 0.3) & (F.col("v") > 300)).select("k", F.least("v", F.coalesce("next", "v")).alias("base"))


@query("n09_boulders", f", c AS (SELECT id, x, y FROM pts WHERE {_u('CAST(id AS VARCHAR)', 'boulder')} < 0.3) SELECT x // 20 AS ix, y // 20 AS iy, count(*) AS n, max(id % 17) AS wake FROM c WHERE NOT EXISTS (SELECT 1 FROM gnode g WHERE power(c.x - g.x, 2) + power(c.y - g.y, 2) <= 4) GROUP BY 1, 2")
def _(w):
    from ..operators.aggregate import scatter as stamp

    c = P.keep_out(w.pts.where(N.draw("id", salt="boulder") < 0.3), w.gnode, 2.0)
    return stamp(c, 20, F.count("*").alias("n"), F.max(F.col("id") % 17).alias("wake"))


@query("n10_poles_and_wires", ", p AS (SELECT user_id, seq FROM track WHERE seq % 3 = 1) SELECT user_id, f AS \"from\", seq AS \"to\", seq - f AS span FROM (SELECT user_id, seq, lag(seq) OVER (PARTITION BY user_id ORDER BY seq) AS f FROM p) WHERE seq - f <= 4")
def _(w):
    return N.wires(w.track.where("seq % 3 = 1"), "user_id", "seq", 4)


@query("n11_guardrails", """, r AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM track WHERE y > 250), u AS (SELECT user_id, min(seq) AS first, max(seq) AS last FROM r GROUP BY user_id, g),
v AS (SELECT *, CASE WHEN first > max(last) OVER (PARTITION BY user_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 OR lag(first) OVER (PARTITION BY user_id ORDER BY first) IS NULL THEN 1 ELSE 0 END AS f FROM u), q AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY first) AS g FROM v)
SELECT user_id, min(first) AS first, max(last) AS last FROM q GROUP BY user_id, g HAVING max(last) - min(first) >= 4""")
def _(w):
    """Runs beside a drop, short gaps closed, short runs dropped."""
    m = Q.merge_intervals(Q.runs(w.track, F.col("y") > 250).drop("n"), "first", "last", 2)
    return m.where("last - first >= 4").select("user_id", "first", "last")


@query("n12_signs", "SELECT 'speed' AS sign, user_id AS ref, seq AS at FROM track WHERE seq % 20 = 5 UNION ALL SELECT 'curve', user_id, seq FROM (SELECT user_id, seq, x, lag(x, 1) OVER w AS a, lead(x, 1) OVER w AS b FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE abs(a - 2 * x + b) > 3000")
def _(w):
    by = Q.along()
    bend = F.abs(F.lag("x").over(by) - 2 * F.col("x") + F.lead("x").over(by))
    curve = w.track.withColumn("b", bend).where("b > 3000").select(F.lit("curve").alias("sign"), F.col("user_id").alias("ref"), F.col("seq").alias("at"))
    return w.track.where("seq % 20 = 5").select(F.lit("speed").alias("sign"), F.col("user_id").alias("ref"), F.col("seq").alias("at")).unionByName(curve)


@query("n13_fences", ", t AS (SELECT user_id, seq, cls FROM track JOIN ras ON ix = x // 20 AND iy = y // 14), r AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM t WHERE cls IN (0, 1, 2, 4)) SELECT user_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM r GROUP BY user_id, g HAVING count(*) >= 2")
def _(w):
    t = w.track.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras.select("ix", "iy", "cls"), ["ix", "iy"])
    return Q.runs(t, F.col("cls").isin(0, 1, 2, 4), least=2)


@query("n14_culverts", "SELECT user_id, seq, CASE WHEN v < 290 THEN 'crossing' ELSE 'sag' END AS why FROM (SELECT t.user_id, t.seq, t.y, r.v, min(t.y) OVER (PARTITION BY t.user_id ORDER BY t.seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM track t JOIN ras r ON ix = x // 20 AND iy = y // 14) WHERE v < 290 OR y = m")
def _(w):
    t = w.track.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(w.ras.select("ix", "iy", "v"), ["ix", "iy"]).withColumn("m", F.min("y").over(Q.along().rowsBetween(-3, 3)))
    return t.where("v < 290 or y = m").select("user_id", "seq", F.when(F.col("v") < 290, "crossing").otherwise("sag").alias("why"))


@query("n15_retaining_walls", ", t AS (SELECT user_id, seq, a.v - b.v AS d FROM track JOIN ras a ON a.ix = x // 20 AND a.iy = y // 14 JOIN ras b ON b.ix = x // 20 AND b.iy = y // 14 + 1), r AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM t WHERE d > 10) SELECT user_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM r GROUP BY user_id, g")
def _(w):
    c = w.ras.withColumn("d", F.col("v") - F.lead("v").over(Window.partitionBy("ix").orderBy("iy"))).where("d is not null").select("ix", "iy", "d")
    t = w.track.withColumns({"ix": F.expr("x div 20"), "iy": F.expr("y div 14")}).join(c, ["ix", "iy"])
    return Q.runs(t, F.col("d") > 10)


@query("n16_street_lights", ", p AS (SELECT user_id, seq, x, y, row_number() OVER (PARTITION BY user_id ORDER BY x, seq) AS lo, row_number() OVER (PARTITION BY user_id ORDER BY x DESC, seq) AS hi FROM track) SELECT a.user_id, a.seq AS a, b.seq AS b, b.x - a.x AS apart FROM p a JOIN p b ON a.user_id = b.user_id AND a.lo = 1 AND b.hi = 1")
def _(w):
    """The two heads of a span: the points of a line farthest apart along x."""
    m = w.track.groupBy("user_id").agg(F.min(F.struct("x", "seq")).alias("a"), F.max(F.struct("x", (-F.col("seq")).alias("s"))).alias("b"))
    return m.select("user_id", F.col("a.seq").alias("a"), (-F.col("b.s")).alias("b"), (F.col("b.x") - F.col("a.x")).alias("apart"))


@query("t07_spaced_selection")
def _(w):
    """By falling score, none within 10 of another; equal to the one-by-one choice, as tests hold."""
    c = w.gnode.join(w.gedge.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("score")), "node")
    return N.spaced(c, "node", "score", 10.0).select("node", "x", "y", "score")


@query("k08_interchange_ramps", f""", {_SEG}, {_X}, v AS (SELECT id FROM pts WHERE event_type = 'view'), m0 AS MATERIALIZED (SELECT a, b, ax0 + d3 / CAST(d3 - d4 AS DOUBLE) * (ax1 - ax0) AS px, ay0 + d3 / CAST(d3 - d4 AS DOUBLE) * (ay1 - ay0) AS py FROM q WHERE sign(d1) * sign(d2) < 0 AND sign(d3) * sign(d4) < 0),
m AS (SELECT m0.*, va.id IS NOT NULL AS fa, vb.id IS NOT NULL AS fb FROM m0 LEFT JOIN v va ON va.id = a LEFT JOIN v vb ON vb.id = b WHERE a < b),
x AS (SELECT a * 100000 + b AS id, CASE WHEN fb THEN 'wye' ELSE 'diamond' END AS kind, px, py, a, b FROM m WHERE fa UNION ALL SELECT b * 100000 + a, 'diamond', px, py, b, a FROM m WHERE fb AND NOT fa),
u AS (SELECT x.*, (f.x1 - f.x0) / sqrt(power(f.x1 - f.x0, 2) + power(f.y1 - f.y0, 2)) AS fx, (f.y1 - f.y0) / sqrt(power(f.x1 - f.x0, 2) + power(f.y1 - f.y0, 2)) AS fy, (r.x1 - r.x0) / sqrt(power(r.x1 - r.x0, 2) + power(r.y1 - r.y0, 2)) AS rx, (r.y1 - r.y0) / sqrt(power(r.x1 - r.x0, 2) + power(r.y1 - r.y0, 2)) AS ry FROM x JOIN seg f ON f.sid = a JOIN seg r ON r.sid = b),
c(kind, ramp, af, ar, mf, mr, bf, br) AS (VALUES ('diamond', 'exit-1', -80.0, 0.0, -32.0, -20.0, 0.0, -20.0), ('diamond', 'exit+1', -80.0, 0.0, -32.0, 20.0, 0.0, 20.0), ('diamond', 'entrance-1', 80.0, 0.0, 32.0, -20.0, 0.0, -20.0), ('diamond', 'entrance+1', 80.0, 0.0, 32.0, 20.0, 0.0, 20.0), ('wye', 'back', 0.0, 80.0, 0.0, 0.0, -80.0, 0.0), ('wye', 'ahead', 0.0, 80.0, 0.0, 0.0, 80.0, 0.0)),
p AS (SELECT u.*, ramp, k, k / 8.0 AS t, af, ar, mf, mr, bf, br FROM u JOIN c USING (kind), range(9) r(k))
SELECT id, ramp, k, round(px + power(1 - t, 2) * (af * fx + ar * rx) + 2 * t * (1 - t) * (mf * fx + mr * rx) + t * t * (bf * fx + br * rx), 5) AS x, round(py + power(1 - t, 2) * (af * fy + ar * ry) + 2 * t * (1 - t) * (mf * fy + mr * ry) + t * t * (bf * fy + br * ry), 5) AS y FROM p""")
def _(w):
    """Ramps wherever lines of kind view (freeways) cross others: wyes with other freeways, diamonds else."""
    freeway = w.pts.where("event_type = 'view'").select(F.col("id").alias("sid"))
    s = _segments(w)
    both = P.crossings(s.join(freeway, "sid", "left_semi"), s.join(freeway.withColumn("freeway", F.lit(True)), "sid", "left").select("sid", "x0", "y0", "x1", "y1", F.coalesce("freeway", F.lit(False)).alias("freeway")), 40.0)
    met = both.where("not b_freeway or a_sid < b_sid").select((F.col("a_sid") * 100000 + F.col("b_sid")).alias("id"), F.when(F.col("b_freeway"), "wye").otherwise("diamond").alias("kind"), "px", "py", *[(F.col(f"{p}_{c}1") - F.col(f"{p}_{c}0")).cast("double").alias(f"{n}{c}") for n, p in (("f", "a"), ("r", "b")) for c in "xy"])
    return N.ramps(met, 80.0, 20.0).select("id", "ramp", "k", R("x", 5).alias("x"), R("y", 5).alias("y"))
