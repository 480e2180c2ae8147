"""Queries of the ordered-sequence family (W) and joins by station."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import sequence as Q
from .registry import query

R = F.round
_S = "st AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY seq) AS s FROM (SELECT *, coalesce(sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)), 0.0) AS d FROM track WINDOW w AS (PARTITION BY user_id ORDER BY seq)))"
_W = "WINDOW w AS (PARTITION BY user_id ORDER BY seq)"


@query("w01_arclength", f", {_S} SELECT user_id, seq, round(s, 3) AS s FROM st")
def _(w):
    return Q.arclength(w.track).select("user_id", "seq", R("s", 3).alias("s"))


@query("w02_resample", f""", {_S}, t AS (SELECT user_id, max(s) AS L, greatest(2, CAST(ceil(max(s) / 500.0) AS BIGINT) + 1) AS n FROM st GROUP BY 1), p AS (SELECT user_id, k, L * k / (n - 1) AS s, L FROM t, range(1000) r(k) WHERE k < n),
g AS (SELECT user_id, s AS s0, x AS x0, y AS y0, lead(s) OVER w AS s1, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM st {_W}), h AS (SELECT * FROM g WHERE s1 > s0)
SELECT user_id, k, round(x0 + least(1.0, (s - s0) / (s1 - s0)) * (x1 - x0), 3) AS x, round(y0 + least(1.0, (s - s0) / (s1 - s0)) * (y1 - y0), 3) AS y FROM p ASOF JOIN h ON p.user_id = h.user_id AND p.s >= h.s0 ORDER BY 1""".replace("SELECT user_id, k, round", "SELECT p.user_id, k, round"))
def _(w):
    return Q.resample(Q.arclength(w.track), 500.0).select("user_id", "k", R("x", 3).alias("x"), R("y", 3).alias("y"))


@query("w03_gaussian_smoothing", """, g AS (SELECT t.user_id, t.seq, sum(exp(-0.5 * (k / 1.5) * (k / 1.5)) * u.y) / sum(exp(-0.5 * (k / 1.5) * (k / 1.5))) AS v FROM track t, range(-3, 4) r(k), track u WHERE u.user_id = t.user_id AND u.seq = t.seq + k GROUP BY 1, 2) SELECT user_id, seq, round(v, 4) AS v FROM g""")
def _(w):
    return Q.smooth(w.track, "y", "v", Q.gaussian_weights(3, 1.5)).select("user_id", "seq", R("v", 4).alias("v"))


@query("w05_moving_extremes", "SELECT user_id, seq, max(y) OVER r AS top, median(y) OVER r AS med, round(avg(y) OVER r, 4) AS mean FROM track WINDOW r AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def _(w):
    r = Q.along().rowsBetween(-2, 2)
    return w.track.select("user_id", "seq", F.max("y").over(r).alias("top"), F.expr("percentile(y, 0.5)").over(r).alias("med"), R(F.avg("y").over(r), 4).alias("mean"))


@query("w06_running_max_from_end", "SELECT user_id, seq, max(y) OVER (PARTITION BY user_id ORDER BY seq DESC) AS m FROM track")
def _(w):
    return Q.running_extreme(w.track, "y", "m", backwards=True).select("user_id", "seq", "m")


@query("w07_monotone_accumulate", "SELECT user_id, seq, max(x) OVER w AS m FROM track " + _W)
def _(w):
    return Q.running_extreme(w.track, "x", "m").select("user_id", "seq", "m")


@query("w08_raise_only_grade", "SELECT user_id, seq, round(max(y + 8 * seq) OVER w - 8 * seq, 4) AS z FROM track " + _W)
def _(w):
    return Q.raise_only(w.track, "y", 8.0, "z").select("user_id", "seq", R("z", 4).alias("z"))


@query("w08_two_sided_clamp", """, c AS (SELECT user_id, seq, CAST(y AS DOUBLE) AS z FROM track WHERE seq = 1 UNION ALL SELECT t.user_id, t.seq, least(greatest(CAST(t.y AS DOUBLE), c.z - 40.0), c.z + 40.0) FROM c JOIN track t ON t.user_id = c.user_id AND t.seq = c.seq + 1) SELECT user_id, seq, z FROM c""")
def _(w):
    a = w.track.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "y"))), lambda s: s["y"]).alias("a"))
    return a.select("user_id", F.posexplode(Q.two_sided_clamp(F.col("a"), 40.0)).alias("seq", "z")).select("user_id", (F.col("seq") + 1).cast("long").alias("seq"), "z")


_LIMITED = lambda v: f"(greatest(max({v} + s) OVER a - s, max({v} - s) OVER b + s) + least(min({v} - s) OVER a + s, min({v} + s) OVER b - s)) / 2"
_ABOVE = lambda v: f"greatest(max({v} + s) OVER a - s, max({v} - s) OVER b + s)"
_BELOW = lambda v: f"least(min({v} - s) OVER a + s, min({v} + s) OVER b - s)"


@query("w09_pinned_profile", f""", t AS (SELECT user_id, seq, CAST(y AS DOUBLE) AS z, x / 4.0 AS f, seq * CAST(40 AS DOUBLE) AS s, CASE WHEN seq = 1 THEN CAST(y AS DOUBLE) END AS p FROM track),
o AS (SELECT user_id, seq, greatest({_LIMITED('z')}, {_ABOVE('f')}) AS r, {_BELOW('p')} AS most, {_ABOVE('p')} AS lo FROM t WINDOW a AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY user_id ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT user_id, seq, round(greatest(least(r, coalesce(most, r)), coalesce(lo, r - 1e300)), 6) AS z FROM o""")
def _(w):
    """The first sample of a line is pinned; the floor is a quarter of x; at most 40 a sample."""
    t = w.track.select("user_id", "seq", "y", (F.col("x") / 4.0).alias("floor"), (F.col("seq") == 1).alias("pinned"))
    return Q.pinned_profile(t, "y", "floor", "pinned", "seq", 40.0, "z").select("user_id", "seq", F.round("z", 6).alias("z"))


@query("w10_cut_only_envelope", f", {_S} SELECT user_id, seq, round(least(min(y - 0.02 * s) OVER w + 0.02 * s, min(y + 0.02 * s) OVER (PARTITION BY user_id ORDER BY seq DESC) - 0.02 * s), 3) AS z FROM st {_W}")
def _(w):
    return Q.cut_only(Q.arclength(w.track), "y", "s", 0.02, "z").select("user_id", "seq", R("z", 3).alias("z"))


@query("w11_running_min", "SELECT user_id, seq, min(y) OVER w AS z FROM track " + _W)
def _(w):
    return Q.running_extreme(w.track, "y", "z", "min").select("user_id", "seq", "z")


@query("w12_runs", ", r AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM track WHERE x > 700) SELECT user_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM r GROUP BY user_id, g HAVING count(*) >= 3")
def _(w):
    return Q.runs(w.track, F.col("x") > 700, least=3)


@query("w13_fill_short_gaps", """, r AS (SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS g FROM track WHERE x > 700), u AS (SELECT user_id, min(seq) AS first, max(seq) AS last FROM r GROUP BY user_id, g),
v AS (SELECT *, CASE WHEN first > max(last) OVER (PARTITION BY user_id ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2 OR lag(first) OVER (PARTITION BY user_id ORDER BY first) IS NULL THEN 1 ELSE 0 END AS f FROM u),
q AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY first) AS g FROM v) SELECT user_id, min(first) AS first, max(last) AS last, count(*) AS n FROM q GROUP BY user_id, g""")
def _(w):
    return Q.merge_intervals(Q.runs(w.track, F.col("x") > 700).drop("n"), "first", "last", 2)


@query("w14_merge_intervals", """, v AS (SELECT *, CASE WHEN max(s1) OVER p IS NULL OR s0 > max(s1) OVER p + 3 THEN 1 ELSE 0 END AS f FROM spans WINDOW p AS (PARTITION BY user_id ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS g FROM v) SELECT user_id, min(s0) AS s0, max(s1) AS s1, count(*) AS n FROM q GROUP BY user_id, g""")
def _(w):
    return Q.merge_intervals(w.spans, "s0", "s1", 3)


_C = "c AS (SELECT user_id, seq, x, y, lag(x, 2) OVER w AS ax, lag(y, 2) OVER w AS ay, lead(x, 2) OVER w AS cx, lead(y, 2) OVER w AS cy FROM track " + _W + "), rad AS (SELECT user_id, seq, sqrt(power(x - ax, 2) + power(y - ay, 2)) * sqrt(power(cx - x, 2) + power(cy - y, 2)) * sqrt(power(ax - cx, 2) + power(ay - cy, 2)) / greatest(abs((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) * 2.0, 1e-9) AS radius FROM c)"


@query("w15_circumradius", f", {_C} SELECT user_id, seq, round(radius, 2) AS radius FROM rad WHERE radius < 1e6")
def _(w):
    return Q.circumradius(w.track, 2).where("radius < 1e6").select("user_id", "seq", R("radius", 2).alias("radius"))


@query("a25_least_curve_radius", f", {_C} SELECT user_id, round(min(radius), 3) AS radius FROM rad GROUP BY user_id")
def _(w):
    return Q.circumradius(w.track, 2).groupBy("user_id").agg(R(F.min("radius"), 3).alias("radius"))


@query("w16_tangents", "SELECT user_id, seq, CAST(CASE WHEN lag(x) OVER w IS NULL THEN lead(x) OVER w - x WHEN lead(x) OVER w IS NULL THEN x - lag(x) OVER w ELSE (lead(x) OVER w - lag(x) OVER w) / 2.0 END AS DOUBLE) AS tx, CAST(CASE WHEN lag(y) OVER w IS NULL THEN lead(y) OVER w - y WHEN lead(y) OVER w IS NULL THEN y - lag(y) OVER w ELSE (lead(y) OVER w - lag(y) OVER w) / 2.0 END AS DOUBLE) AS ty FROM track " + _W)
def _(w):
    return Q.tangent(w.track).select("user_id", "seq", "tx", "ty")


@query("w17_unwrap", ", u AS (SELECT user_id, seq, CAST(coalesce((x % 360 - lag(x % 360) OVER w + 180 + 720) % 360 - 180, x % 360) AS BIGINT) AS t FROM track " + _W + ") SELECT user_id, seq, CAST(sum(t) OVER w AS BIGINT) AS a FROM u " + _W)
def _(w):
    return Q.unwrap(w.track.withColumn("b", F.col("x") % 360), "b", "a").select("user_id", "seq", "a")


@query("w21_chaikin", """, n AS (SELECT user_id, seq, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM track """ + _W + """) SELECT user_id, seq * 2 - 1 AS k, 0.75 * x + 0.25 * nx AS x, 0.75 * y + 0.25 * ny AS y FROM n WHERE nx IS NOT NULL UNION ALL SELECT user_id, seq * 2, 0.25 * x + 0.75 * nx, 0.25 * y + 0.75 * ny FROM n WHERE nx IS NOT NULL""")
def _(w):
    n = w.track.select("user_id", "seq", "x", "y", F.lead("x").over(Q.along()).alias("nx"), F.lead("y").over(Q.along()).alias("ny")).where("nx is not null")
    cut = lambda t: [(F.col(v) * (1 - t) + F.col("n" + v) * t).alias(v) for v in "xy"]
    return n.select("user_id", F.explode(F.array(F.struct((F.col("seq") * 2 - 1).alias("k"), *cut(0.25)), F.struct((F.col("seq") * 2).alias("k"), *cut(0.75)))).alias("p")).select("user_id", "p.*")


@query("w22_fill_linear", """, v AS (SELECT user_id, seq, CASE WHEN x % 3 = 0 THEN y END AS v FROM track), f AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p,
first_value(CASE WHEN v IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM v)
SELECT f.user_id, f.seq, round(CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE a.v + (b.v - a.v) * (f.seq - p) / greatest(n - p, 1.0) END, 4) AS z FROM f LEFT JOIN v a ON a.user_id = f.user_id AND a.seq = p LEFT JOIN v b ON b.user_id = f.user_id AND b.seq = n""")
def _(w):
    v = w.track.withColumn("v", F.when(F.col("x") % 3 == 0, F.col("y")))
    return Q.fill_linear(v, "v", "z").select("user_id", "seq", R("z", 4).alias("z"))


@query("w23_piecewise_linear", """, k AS (SELECT user_id, s0, k AS v, lead(s0) OVER (PARTITION BY user_id ORDER BY s0) AS n0, lead(k) OVER (PARTITION BY user_id ORDER BY s0) AS nv FROM spans)
SELECT t.user_id, seq, round(v + coalesce((nv - v) * (seq - s0) / (n0 - s0 + 0.0), 0), 5) AS z FROM track t ASOF JOIN k ON t.user_id = k.user_id AND t.seq >= k.s0""")
def _(w):
    by = Window.partitionBy("user_id").orderBy("s0")
    knots = w.spans.select("user_id", "s0", F.col("k").alias("v"), F.lead("s0").over(by).alias("n0"), F.lead("k").over(by).alias("nv")).withColumn("seq", F.col("s0"))
    got = Q.asof(w.track.select("user_id", "seq"), knots, "user_id", "seq", ["s0", "v", "n0", "nv"])
    return got.select("user_id", "seq", R(F.col("v") + F.coalesce((F.col("nv") - F.col("v")) * (F.col("seq") - F.col("s0")) / (F.col("n0") - F.col("s0")), F.lit(0.0)), 5).alias("z"))


@query("w27_sags", "SELECT user_id, seq FROM (SELECT user_id, seq, y, min(y) OVER (PARTITION BY user_id ORDER BY seq RANGE BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m, max(y) OVER (PARTITION BY user_id ORDER BY seq RANGE BETWEEN 4 PRECEDING AND 1 PRECEDING) AS l, max(y) OVER (PARTITION BY user_id ORDER BY seq RANGE BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS r FROM track) WHERE y = m AND l >= y + 60 AND r >= y + 60")
def _(w):
    a = Q.along()
    m = w.track.select("user_id", "seq", "y", F.min("y").over(a.rangeBetween(-4, 4)).alias("m"), F.max("y").over(a.rangeBetween(-4, -1)).alias("l"), F.max("y").over(a.rangeBetween(1, 4)).alias("r"))
    return m.where("y = m and l >= y + 60 and r >= y + 60").select("user_id", "seq")


@query("w28_periodic_placement", f", {_S}, t AS (SELECT user_id, max(s) AS L FROM st GROUP BY 1) SELECT user_id, k, k * 250.0 + 40 AS s FROM t, range(400) r(k) WHERE k * 250.0 + 40 <= L")
def _(w):
    t = Q.arclength(w.track).groupBy("user_id").agg(F.max("s").alias("L")).where("L >= 40")
    k = t.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("L") - 40) / 250.0))))
    return k.select("user_id", "k", (F.col("k") * 250.0 + 40).alias("s"))


@query("w29_spaced_events", """, e AS (SELECT user_id, min(seq) AS seq FROM track WHERE x > 1200 GROUP BY 1 UNION ALL SELECT e.user_id, (SELECT min(t.seq) FROM track t WHERE t.user_id = e.user_id AND t.x > 1200 AND t.seq >= e.seq + 5) FROM e WHERE e.seq IS NOT NULL) SELECT user_id, seq FROM e WHERE seq IS NOT NULL""")
def _(w):
    """At least five apart, as a fold over each line's events."""
    a = w.track.where("x > 1200").groupBy("user_id").agg(F.array_sort(F.collect_list("seq")).alias("a"))
    kept = F.aggregate("a", F.array().cast("array<bigint>"), lambda k, s: F.when((F.size(k) == 0) | (s >= F.try_element_at(k, F.lit(-1)) + 5), F.concat(k, F.array(s))).otherwise(k))
    return a.select("user_id", F.explode(kept).alias("seq"))


@query("w30_angular_gaps", """, l AS (SELECT src AS node, dst AS leg, (src * 37 + dst * 53) % 360 AS b FROM gedge) SELECT node, leg, (coalesce(lead(b) OVER (PARTITION BY node ORDER BY b, leg), first_value(b) OVER (PARTITION BY node ORDER BY b, leg)) - b + 360) % 360 AS gap FROM l""")
def _(w):
    legs = w.gedge.select(F.col("src").alias("node"), F.col("dst").alias("leg"), ((F.col("src") * 37 + F.col("dst") * 53) % 360).alias("b"))
    return Q.circular_gaps(legs, "node", "b").select("node", "leg", "gap")


@query("w32_sliding_count", "SELECT id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM pts")
def _(w):
    by = Window.partitionBy("user_id").orderBy("t").rangeBetween(-3_600_000_000, 0)
    return w.pts.withColumn("t", F.unix_micros(F.col("ts").cast("timestamp"))).select("id", F.count("*").over(by).alias("n"))


@query("w33_predictor_residual", "SELECT ix, iy, v - (coalesce(lag(v) OVER r, 0) + coalesce(lag(v) OVER c, 0) - coalesce(lag(l) OVER c, 0)) AS e FROM (SELECT *, lag(v) OVER (PARTITION BY iy ORDER BY ix) AS l FROM ras) WINDOW r AS (PARTITION BY iy ORDER BY ix), c AS (PARTITION BY ix ORDER BY iy)")
def _(w):
    from ..operators.raster import columns, rows

    left = w.ras.withColumn("l", F.coalesce(F.lag("v").over(rows()), F.lit(0)))
    up = left.withColumns({"u": F.coalesce(F.lag("v").over(columns()), F.lit(0)), "ul": F.coalesce(F.lag("l").over(columns()), F.lit(0))})
    return up.select("ix", "iy", (F.col("v") - (F.col("l") + F.col("u") - F.col("ul"))).alias("e"))


@query("s12_delta_encoding", "SELECT user_id, seq, coalesce(x - lag(x) OVER w, x) AS dx FROM track " + _W)
def _(w):
    return w.track.select("user_id", "seq", F.coalesce(F.col("x") - F.lag("x").over(Q.along()), F.col("x")).alias("dx"))


@query("j17_interval_join", "SELECT t.id, s.k FROM track t JOIN spans s ON t.user_id = s.user_id AND t.seq >= s.s0 - 0.5 AND t.seq <= s.s1 + 0.5")
def _(w):
    return Q.interval_join(w.track, w.spans, "user_id", "seq", "s0", "s1", 0.5).select("id", "k")


@query("j18_asof_join", "SELECT t.id, s.k FROM track t ASOF JOIN spans s ON t.user_id = s.user_id AND t.seq >= s.s0")
def _(w):
    right = w.spans.withColumn("seq", F.col("s0"))
    return Q.asof(w.track.select("id", "user_id", "seq"), right, "user_id", "seq", ["k"]).select("id", "k")


@query("v04_prefix_sums", "SELECT cell, n, CAST(coalesce(sum(n) OVER (ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT (x // 100) * 100 + y // 100 AS cell, count(*) AS n FROM pts GROUP BY 1)")
def _(w):
    """Starts of cells in a sorted table."""
    from ..operators.relational import running_total

    c = w.pts.groupBy(F.expr("(x div 100) * 100 + y div 100").alias("cell")).agg(F.count("*").alias("n"))
    return running_total(c, [F.col("cell")], "start", F.col("n")).select("cell", "n", "start")
