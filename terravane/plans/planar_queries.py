"""Queries of plane graphs: faces and what is made of them."""

from pyspark.sql import functions as F

from ..operators import planar as L
from .registry import query

R = F.round

#: A walk from each half-edge dies at a smaller one, so that one for each ring comes back to its start.
_RINGS = """half AS (SELECT eid * 2 AS h, eid, src AS tail, x0 AS x, y0 AS y, x1 AS ax, y1 AS ay FROM street UNION ALL SELECT eid * 2 + 1, eid, dst, x1, y1, x0, y0 FROM street),
turn AS (SELECT xor(h, 1) AS h, coalesce(lag(h) OVER (PARTITION BY tail ORDER BY atan2(ay - y, ax - x), h), last_value(h) OVER (PARTITION BY tail ORDER BY atan2(ay - y, ax - x), h ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS nxt FROM half),
walk(face, cur) AS (SELECT h, nxt FROM turn UNION ALL SELECT face, nxt FROM walk JOIN turn ON turn.h = cur WHERE cur > face),
ring(face, h) AS (SELECT face, face FROM walk WHERE cur = face UNION ALL SELECT face, nxt FROM ring JOIN turn USING (h) WHERE nxt <> face),
side AS (SELECT * FROM ring JOIN half USING (h))"""


def _sides(w):
    return L.sides(w.street)


@query("g15_faces", f""", {_RINGS}, e AS (SELECT eid, face, count(*) AS n FROM side GROUP BY 1, 2), d AS (SELECT face, sum(n) AS n FROM e WHERE n = 2 GROUP BY 1)
SELECT face, count(*) AS sides, CAST(count(*) - coalesce(any_value(d.n), 0) AS BIGINT) AS border, CAST(sum(x * ay - ax * y) AS DOUBLE) / 2 AS area, round(sum(sqrt(power(ax - x, 2) + power(ay - y, 2))), 3) AS perimeter FROM side LEFT JOIN d USING (face) GROUP BY face""")
def _(w):
    return L.faces(_sides(w)).withColumn("perimeter", R("perimeter", 3))


@query("g15_polygons", f""", {_RINGS}, k(face, place, h) AS (SELECT face, 0, face FROM walk WHERE cur = face UNION ALL SELECT face, place + 1, nxt FROM k JOIN turn USING (h) WHERE nxt <> face), a AS (SELECT face FROM side GROUP BY face HAVING sum(x * ay - ax * y) > 0)
SELECT k.face, CAST(place AS BIGINT) AS place, x, y FROM k JOIN half USING (h) JOIN a ON a.face = k.face""")
def _(w):
    """The corners of the faces inside, in order, a row each."""
    s = _sides(w)
    return s.join(L.faces(s).where("area > 0").select("face"), "face", "left_semi").select("face", "place", "x", "y")


@query("g15_infields", f""", {_RINGS}, f AS (SELECT face, CAST(sum(x * ay - ax * y) AS DOUBLE) / 2 AS area, sum(sqrt(power(ax - x, 2) + power(ay - y, 2))) AS p, sum(CASE WHEN kind = 2 THEN sqrt(power(ax - x, 2) + power(ay - y, 2)) ELSE 0 END) AS rim, sum(CASE WHEN kind = 0 THEN sqrt(power(ax - x, 2) + power(ay - y, 2)) ELSE 0 END) AS inn
  FROM side JOIN (SELECT eid, kind FROM street) USING (eid) GROUP BY face) SELECT face, area, round(rim, 3) AS rim, round(inn, 3) AS inner_length FROM f WHERE area > 30 AND area < 25000 AND rim >= 8 AND rim >= 0.25 * p AND (inn >= 0.6 * rim OR rim >= 0.6 * p)""")
def _(w):
    """Faces that streets of kind 2 enclose together with those of kind 0, as ramps and a freeway do."""
    f = L.enclosed(_sides(w), w.street.withColumn("kind", F.col("kind").cast("string")), "2", "0")
    return f.select("face", "area", R("rim", 3).alias("rim"), R("inner", 3).alias("inner_length"))


@query("g15_cleaned_streets")
def _(w):
    """Streets that stay when blocks under 7000 are opened, dead ends under 60 cut and loose parts under 200 dropped; kind 0 stays."""
    s = w.street.withColumns({"length": F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")), "fixed": F.col("kind") == 0})
    s = s.withColumn("score", (F.col("eid") * 7919 % 1000) / 1000.0 - 0.002 * F.col("length"))
    return L.clean(s, "length", "score", 7000.0, 60.0, 200.0, "fixed")
