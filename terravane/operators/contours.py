"""Shapes from masks and back: rings around set cells with nesting and simplification (R09), skeletons (R11) and their graphs (G19), ridges."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import raster
from .graph import components, cut
from .pointers import rings
from .tiles import Tile, cell_number, cell_place, per_tile

#: Sides of a cell, against the clock with the cell to the left: neighbour across, and the corners from which to which they run.
SIDES = (((0, -1), (0, 0), (1, 0)), ((1, 0), (1, 0), (1, 1)), ((0, 1), (1, 1), (0, 1)), ((-1, 0), (0, 1), (0, 0)))


def outlines(cells: DataFrame, width: int) -> DataFrame:
    """ring, place, region, x, y, side, corner: the sides of set cells (ix, iy) that have no set cell across, in order along rings.

    A region is what is joined over sides, named by its smallest cell; rings around it run against the clock, those around its holes with it, so
    holes belong to the shell of the same region. corner tells the points (x, y) at which a ring turns.
    """
    here = cut(raster.label(cells.select("ix", "iy").distinct(), width).withColumn("cell", cell_number()))
    sides = here.select("ix", "iy", "cell", "label", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), (F.col("ix") + dx).alias("nx"), (F.col("iy") + dy).alias("ny"), (F.col("ix") + a).alias("x"), (F.col("iy") + b).alias("y"), (F.col("ix") + c).alias("tx"), (F.col("iy") + d).alias("ty")) for s, ((dx, dy), (a, b), (c, d)) in enumerate(SIDES)])).alias("s"))
    free = sides.select("cell", "label", "s.*").join(here.select(F.col("ix").alias("nx"), F.col("iy").alias("ny")), ["nx", "ny"], "left_anti")
    edge = cut(free.select((F.col("cell") * 4 + F.col("side")).alias("edge"), "cell", "label", "side", "x", "y", "tx", "ty"))
    # where two cells meet at a corner only, a ring stays with its own
    after = edge.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("edge").alias("next"), F.col("cell").alias("other"))
    links = edge.join(after, ["tx", "ty"]).groupBy("edge").agg(F.min(F.struct((F.col("other") != F.col("cell")).alias("far"), "next")).alias("m")).select(F.col("edge").alias("node"), "m.next")
    links = cut(links)
    turned = links.select(F.col("next").alias("edge"), (F.col("node") % 4 != F.col("next") % 4).alias("corner"))
    placed = rings(links).select(F.col("node").alias("edge"), "ring", "place")
    return edge.join(placed, "edge").join(turned, "edge").select("ring", "place", F.col("label").alias("region"), "x", "y", "side", "corner")


def ring_areas(outline: DataFrame) -> DataFrame:
    """ring, region, area (negative for holes), sides and corners of each ring."""
    dx = F.when(F.col("side") == 0, 1).when(F.col("side") == 2, -1).otherwise(0)
    dy = F.when(F.col("side") == 1, 1).when(F.col("side") == 3, -1).otherwise(0)
    return outline.groupBy("ring").agg(F.min("region").alias("region"), (F.sum(F.col("x") * dy - F.col("y") * dx) / 2).alias("area"), F.count("*").alias("sides"), F.count_if("corner").alias("corners"))


def polygons(cells: DataFrame, width: int, least: float = 0.0, tolerance: float = 0.0) -> DataFrame:
    """region, ring, hole, place, x, y: corners of the regions' shells and holes of at least the least area, holes of a dropped shell left out, rings
    simplified to the tolerance (R09). Places go up along a ring, with gaps."""
    o = cut(outlines(cells, width))
    big = cut(ring_areas(o).where(F.abs("area") >= least).select("ring", "region", (F.col("area") < 0).alias("hole")))
    kept = big.join(big.where("not hole").select("region").distinct(), "region", "left_semi")
    points = o.where("corner").drop("region").join(kept, "ring").select("region", "ring", "hole", "place", "x", "y")
    return points if tolerance <= 0 else simplified(points, tolerance)


def simplified(points: DataFrame, tolerance: float, rounds: int = 200) -> DataFrame:
    """Rings without the points whose triangle with both neighbours is smaller than tolerance squared, down to four points of a ring.

    Points go in rounds, those whose triangle is smaller than their neighbours', so that no two that go are neighbours; the others are linked anew.
    """
    from pyspark.sql import Window

    by = Window.partitionBy("ring")
    order = by.orderBy("place")
    n = F.count("*").over(by)
    now = points.withColumns({"before": F.coalesce(F.lag("place").over(order), F.max("place").over(by)), "after": F.coalesce(F.lead("place").over(order), F.min("place").over(by)), "left": n})
    now = cut(now)
    for _ in range(rounds):
        at = now.select("ring", "place", "x", "y")
        near = lambda k: at.select("ring", F.col("place").alias(k), F.col("x").alias(f"{k}_x"), F.col("y").alias(f"{k}_y"))
        area = F.abs((F.col("x") - F.col("before_x")) * (F.col("after_y") - F.col("before_y")) - (F.col("y") - F.col("before_y")) * (F.col("after_x") - F.col("before_x"))) / 2
        sized = cut(now.join(near("before"), ["ring", "before"]).join(near("after"), ["ring", "after"]).select(*now.columns, F.struct(area.alias("area"), "place").alias("size")))
        sizes = sized.select("ring", "place", "size")
        beside = lambda k: sizes.select("ring", F.col("place").alias(k), F.col("size").alias(f"{k}_size"))
        goes = (F.col("size.area") < tolerance**2) & (F.col("size") < F.col("before_size")) & (F.col("size") < F.col("after_size")) & (F.col("left") > 4)
        marked = sized.join(beside("before"), ["ring", "before"]).join(beside("after"), ["ring", "after"])
        gone = cut(marked.where(goes).select("ring", "place", "before", "after", "left"))
        # of a ring with few points left only so many may go: the smallest, one at a time
        few = gone.where("left < 12").groupBy("ring").agg(F.min("place").alias("place"))
        gone = cut(gone.where("left >= 12").unionByName(gone.join(few, ["ring", "place"], "left_semi").select(*gone.columns)))
        if gone.isEmpty():
            return now.select(*points.columns)
        lost = gone.groupBy("ring").agg(F.count("*").alias("lost"))
        back = gone.select("ring", F.col("after").alias("place"), F.col("before").alias("_before"))
        ahead = gone.select("ring", F.col("before").alias("place"), F.col("after").alias("_after"))
        now = now.join(gone.select("ring", "place"), ["ring", "place"], "left_anti").join(back, ["ring", "place"], "left").join(ahead, ["ring", "place"], "left").join(lost, "ring", "left")
        now = cut(now.select(*points.columns, F.coalesce("_before", "before").alias("before"), F.coalesce("_after", "after").alias("after"), (F.col("left") - F.coalesce("lost", F.lit(0))).alias("left")))
    raise RuntimeError(f"rings have not settled in {rounds} rounds")


def _thinned(m: np.ndarray, steps: int) -> np.ndarray:
    """A mask after so many steps, odd and even ones by turns: border cells go that aren't ends and whose neighbours stay joined."""
    m = m.astype(np.uint8)
    for step in range(steps):
        p = np.pad(m, 1)
        h, w = m.shape
        n, ne, e, se, s, sw, we, nw = (p[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx, dy in ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)))
        around = (n, ne, e, se, s, sw, we, nw)
        count = sum(a.astype(int) for a in around)
        rises = sum((a < b).astype(int) for a, b in zip(around, around[1:] + around[:1]))
        free = (n & e & s) | (e & s & we) if step % 2 == 0 else (n & e & we) | (n & s & we)
        m = np.where((count >= 2) & (count <= 6) & (rises == 1) & (free == 0), 0, m).astype(np.uint8)
    return m


def skeleton(cells: DataFrame, side: int | None = None, steps: int = 16, rounds: int = 10_000) -> DataFrame:
    """The set cells (ix, iy) that are left when borders are thinned until nothing changes (R11). Each pass does `steps` steps, exact
    across tiles, as tiles come with a halo as wide."""
    if steps % 2:
        raise ValueError("an even number of steps")

    def kernel(tile: Tile):
        before = tile.there
        return tile.rows(left=_thinned(before, steps))

    now = cut(cells.select("ix", "iy").distinct())
    for _ in range(rounds):
        after = cut(per_tile(now, [], steps, kernel, "ix long, iy long, left int", side))
        now = after.where("left = 1").select("ix", "iy")
        if after.where("left = 0").isEmpty():
            return now
    raise RuntimeError(f"skeletons have not settled in {rounds} passes")


def skeleton_graph(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, x, y, cells, degree) and edges (edge, a, b, cells, length) of a skeleton's cells (ix, iy).

    Cells with other than two neighbours are nodes, those that touch are one; what joins them are edges, named by their smallest cell and found as
    components of the cells between. A ring without a node is an edge from null to null.
    """
    here = cut(cells.select("ix", "iy").withColumn("cell", cell_number()))
    near = raster.shifted(here, "cell", raster.EIGHT).join(here.select("ix", "iy", F.col("cell").alias("own")), ["ix", "iy"]).select(F.col("own").alias("a"), F.col("v").alias("b"), F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double")).alias("step"))
    near = cut(near)
    kind = cut(here.select("cell").join(near.groupBy(F.col("a").alias("cell")).agg(F.count("*").alias("n")), "cell", "left").select("cell", (F.coalesce("n", F.lit(0)) == 2).alias("way")))
    both = near.join(kind.toDF("a", "wa"), "a").join(kind.toDF("b", "wb"), "b")
    both = cut(both)

    def parts(of: DataFrame, links: DataFrame) -> DataFrame:
        c = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        return of.select("cell").join(c, F.col("cell") == F.col("node"), "left").select("cell", F.coalesce("component", "cell").alias("part"))

    knots = cut(parts(kind.where("not way"), both.where("not wa and not wb")))
    ways = cut(parts(kind.where("way"), both.where("wa and wb")))
    touch = both.where("wa and not wb").join(ways.toDF("a", "edge"), "a").join(knots.toDF("b", "node"), "b")
    ends = touch.groupBy("edge").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.sum("step").alias("joined"))
    inner = both.where("wa and wb and a < b").join(ways.toDF("a", "edge"), "a").groupBy("edge").agg(F.sum("step").alias("inner"))
    sizes = ways.groupBy(F.col("part").alias("edge")).agg(F.count("*").alias("cells"))
    edges = cut(sizes.join(ends, "edge", "left").join(inner, "edge", "left").select("edge", "a", "b", "cells", (F.coalesce("inner", F.lit(0.0)) + F.coalesce("joined", F.lit(0.0))).alias("length")))
    met = touch.groupBy("node").agg(F.count("*").alias("degree"))
    x, y = cell_place("cell")
    nodes = knots.select("part", x, y).groupBy(F.col("part").alias("node")).agg(F.avg("ix").alias("x"), F.avg("iy").alias("y"), F.count("*").alias("cells"))
    return nodes.join(met, "node", "left").select("node", "x", "y", "cells", F.coalesce("degree", F.lit(0)).alias("degree")), edges


def gaussian_weights(sigma: float) -> list[float]:
    """Weights at distances 0, 1 ... of a bell of three sigmas."""
    return [math.exp(-0.5 * (k / sigma) ** 2) for k in range(math.ceil(3 * sigma) + 1)]


def blurred(cells: DataFrame, value: str, out: str, sigma: float) -> DataFrame:
    """Adds weighted means along rows, then along columns; at the rim over the cells that are there."""
    weights, now, name = gaussian_weights(sigma), cells, value
    for w in (raster.rows(), raster.columns()):
        at = [(abs(k), F.lag(name, -k).over(w) if k else F.col(name)) for k in range(1 - len(weights), len(weights))]
        total = sum(F.coalesce(v * weights[k], F.lit(0.0)) for k, v in at)
        share = sum(F.when(v.isNotNull(), weights[k]).otherwise(0.0) for k, v in at)
        now, name = now.withColumn(out, total / share), out
    return now


def ridges(cells: DataFrame, value: str, out: str, sigmas: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Adds how much each cell is on a crest: the largest, over blurs by the sigmas, of sigma squared times the downward curvature across
    the ridge, from the eigenvalues of the second derivatives (R12). Derivatives are 0 at the rim."""
    now, found = cells, []
    for i, sigma in enumerate(sigmas):
        now = blurred(now, value, "_b", sigma)
        second = lambda w: F.coalesce(F.lag("_b").over(w) - 2 * F.col("_b") + F.lead("_b").over(w), F.lit(0.0))
        now = now.withColumns({"_xx": second(raster.rows()), "_yy": second(raster.columns()), "_x": F.lead("_b").over(raster.rows()) - F.lag("_b").over(raster.rows())})
        now = now.withColumn("_xy", F.coalesce((F.lead("_x").over(raster.columns()) - F.lag("_x").over(raster.columns())) / 4, F.lit(0.0)))
        least = (F.col("_xx") + F.col("_yy")) / 2 - F.hypot((F.col("_xx") - F.col("_yy")) / 2, F.col("_xy"))
        now = now.withColumn(f"_r{i}", sigma**2 * F.greatest(-least, F.lit(0.0)))
        found.append(f"_r{i}")
    strongest = F.greatest(*found) if len(found) > 1 else F.col(found[0])
    return now.withColumn(out, strongest).drop("_b", "_xx", "_yy", "_x", "_xy", *found)
