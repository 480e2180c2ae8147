"""Plane graphs: faces as rings of half-edges, their cleaning on the dual graph, and the faces that roads of some kinds enclose.

Edges are rows (eid, src, dst, x0, y0, x1, y1), straight and crossing nowhere but at their nodes; noding makes them so. Half-edge 2 * eid runs from src to
dst and 2 * eid + 1 back; the face of a half-edge lies to its left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, cut, degrees
from .pointers import rings


def half_edges(edges: DataFrame) -> DataFrame:
    """half, eid, tail, point (x, y of the tail) and ahead (x, y of the head), for both directions of each edge that isn't a loop."""
    e = edges.where("src <> dst")
    there = e.select((F.col("eid") * 2).alias("half"), "eid", F.col("src").alias("tail"), F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("ax"), F.col("y1").alias("ay"))
    return there.union(e.select(F.col("eid") * 2 + 1, "eid", "dst", "x1", "y1", "x0", "y0"))


def successors(halves: DataFrame) -> DataFrame:
    """node, next: after a half-edge comes, at its head, the one next clockwise from its twin. Edges that leave in one direction go by number."""
    by = Window.partitionBy("tail")
    angle = F.atan2(F.col("ay") - F.col("y"), F.col("ax") - F.col("x"))
    turned = halves.select("half", "tail", angle.alias("angle"))
    before = F.lag("half").over(by.orderBy("angle", "half"))
    last = F.max(F.struct("angle", "half")).over(by)["half"]
    return turned.select(F.col("half").bitwiseXOR(F.lit(1)).alias("node"), F.coalesce(before, last).alias("next"))


def sides(edges: DataFrame) -> DataFrame:
    """half, eid, face, place, x, y, ax, ay: the sides of all faces, numbered along each; a face is named by its smallest half-edge.

    In order of place the points (x, y) are the face's polygon, against the clock; around a component they run with the clock.
    """
    h = cut(half_edges(edges))
    r = rings(successors(h)).select(F.col("node").alias("half"), F.col("ring").alias("face"), "place")
    return h.drop("tail").join(r, "half")


def faces(sides: DataFrame) -> DataFrame:
    """face, sides, border (sides with another face beyond), area and perimeter; the area is negative around a component."""
    cross, length = F.col("x") * F.col("ay") - F.col("ax") * F.col("y"), F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    shared = sides.groupBy("eid", "face").agg(F.count("*").alias("n"), F.sum(cross).alias("twice"), F.sum(length).alias("length"))
    border = F.sum("n") - F.sum(F.when(F.col("n") == 2, F.col("n")).otherwise(0))
    return shared.groupBy("face").agg(F.sum("n").alias("sides"), border.alias("border"), (F.sum("twice") / 2).alias("area"), F.sum("length").alias("perimeter"))


def borders(sides: DataFrame) -> DataFrame:
    """eid, a, b: the faces on either side of each edge, a <= b; equal for edges that end inside a face or join two parts of it."""
    return sides.groupBy("eid").agg(F.min("face").alias("a"), F.max("face").alias("b"))


def clean(edges: DataFrame, length: str, score: str, least_area: float, spur: float, fragment: float, fixed: str, rounds: int = 6) -> DataFrame:
    """The edges that stay when small faces are opened, short spurs cut and small loose parts dropped.

    In each round every face smaller than least_area loses the edge of lowest score (then lowest eid) that has another face beyond, all at
    once, and dead ends shorter than spur go, until nothing changes or rounds are up; then components without a fixed edge whose edges are shorter than
    fragment together go. Fixed edges stay. Faces are traced once: an edge that is taken away joins the two faces beside it, so the rounds
    work on the dual graph, whose faces only merge.
    """
    traced = cut(sides(edges))
    area = cut(faces(traced).select("face", "area", (F.col("area") < 0).alias("outer")))
    border = cut(borders(traced))
    now = cut(edges.select("eid", "src", "dst", F.col(length).alias("length"), F.col(score).alias("score"), F.col(fixed).alias("fixed")).join(border, "eid", "left"))
    for _ in range(rounds):
        small = area.where(~F.col("outer") & (F.col("area") < least_area)).select("face")
        open_to = now.where("a <> b and not fixed").select("eid", "score", "a", "b", F.explode(F.array("a", "b")).alias("face"))
        chosen = open_to.join(small, "face").groupBy("face").agg(F.min_by(F.struct("eid", "a", "b"), F.struct("score", "eid")).alias("e")).select("e.*").distinct()
        chosen = cut(chosen)
        ends = degrees(now).where("degree = 1").select("node")
        spurs = now.where((F.col("length") < spur) & ~F.col("fixed")).select("eid", F.explode(F.array("src", "dst")).alias("node")).join(ends, "node").select("eid")
        gone = cut(chosen.select("eid").union(spurs).distinct())
        if gone.isEmpty():
            break
        # faces beside the edges that go become one, of both areas
        label = components(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("node").alias("face"), F.col("component").alias("into"))
        label = cut(label)
        into = lambda df, c: df.join(label.withColumnsRenamed({"face": c, "into": f"{c}_"}), c, "left").withColumn(c, F.coalesce(f"{c}_", c)).drop(f"{c}_")
        area = cut(into(area, "face").groupBy("face").agg(F.sum("area").alias("area"), F.bool_or("outer").alias("outer")))
        now = cut(reduce(into, ("a", "b"), now.join(gone, "eid", "left_anti")).select(*now.columns))
    part = components(now.select("src", "dst"))
    sized = now.join(part, F.col("src") == F.col("node")).select("eid", "component", "length", "fixed")
    loose = sized.groupBy("component").agg(F.sum("length").alias("total"), F.bool_or("fixed").alias("held")).where((F.col("total") < fragment) & ~F.col("held"))
    return sized.join(loose, "component", "left_anti").select("eid")


def enclosed(sides: DataFrame, kinds: DataFrame, rim: str, inner: str, least: float = 8.0, share: float = 0.25, smallest: float = 30.0, largest: float = 25_000.0) -> DataFrame:
    """Faces between edges of kind `rim` and kind `inner` (kinds: eid, kind): face, area, rim and inner lengths.

    A face counts if its rim is at least `least` long and `share` of its perimeter, and it has 0.6 times as much inner as rim
    or its rim is 0.6 of its perimeter.
    """
    length = F.hypot(F.col("ax") - F.col("x"), F.col("ay") - F.col("y"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("length")).otherwise(0.0))
    twice = F.sum(F.col("x") * F.col("ay") - F.col("ax") * F.col("y"))
    f = sides.withColumn("length", length).join(kinds.select("eid", "kind"), "eid").groupBy("face").agg((twice / 2).alias("area"), F.sum("length").alias("perimeter"), of(rim).alias("rim"), of(inner).alias("inner"))
    within = (F.col("area") > smallest) & (F.col("area") < largest)
    rimmed = (F.col("rim") >= least) & (F.col("rim") >= share * F.col("perimeter"))
    return f.where(within & rimmed & ((F.col("inner") >= 0.6 * F.col("rim")) | (F.col("rim") >= 0.6 * F.col("perimeter")))).select("face", "area", "rim", "inner")
