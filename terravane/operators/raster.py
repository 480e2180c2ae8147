"""Raster operators on long cells (ix, iy, value): windows along rows and columns, joins with shifted cells, and fixpoints."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components, cut



def rows():
    return Window.partitionBy("iy").orderBy("ix")


def columns():
    return Window.partitionBy("ix").orderBy("iy")


FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))
EIGHT = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)


def cascade(masks: list[tuple[str, Column]]) -> Column:
    """The name of the last mask that holds."""
    return F.coalesce(*[F.when(mask, name) for name, mask in reversed(masks)])


def separable(cells: DataFrame, value: str, out: str, radius: int, f: Callable[[Column], Column]) -> DataFrame:
    """A window function over 2 radius + 1 cells along rows, then along columns: box sums, maxima, minima."""
    once = cells.withColumn(out, f(F.col(value)).over(rows().rowsBetween(-radius, radius)))
    return once.withColumn(out, f(F.col(out)).over(columns().rowsBetween(-radius, radius)))


def blur(cells: DataFrame, value: str, out: str, radius: int) -> DataFrame:
    """Mean over a box; at the rim over the cells there are."""
    n = cells.withColumn("_1", F.lit(1))
    return separable(separable(n, value, "_s", radius, F.sum), "_1", "_n", radius, F.sum).withColumn(out, F.col("_s") / F.col("_n")).drop("_1", "_s", "_n")


def gaussian(cells: DataFrame, value: str, out: str, weights: list[float]) -> DataFrame:
    from .sequence import smooth

    return smooth(smooth(cells, value, "_g", weights, "iy", "ix"), "_g", out, weights, "ix", "iy").drop("_g")


def dilate(cells: DataFrame, value: str, out: str, radius: int) -> DataFrame:
    return separable(cells, value, out, radius, F.max)


def erode(cells: DataFrame, value: str, out: str, radius: int) -> DataFrame:
    return separable(cells, value, out, radius, F.min)


def opened(cells: DataFrame, value: str, out: str, radius: int) -> DataFrame:
    return dilate(erode(cells, value, "_e", radius), "_e", out, radius).drop("_e")


def closed(cells: DataFrame, value: str, out: str, radius: int) -> DataFrame:
    return erode(dilate(cells, value, "_d", radius), "_d", out, radius).drop("_d")


def gradient(cells: DataFrame, value: str, size: float = 1.0) -> DataFrame:
    """Adds gx, gy: central differences, one-sided at the rim."""
    out = cells
    for w, name in ((rows(), "gx"), (columns(), "gy")):
        a, b, v = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        out = out.withColumn(name, F.when(a.isNull(), (b - v) / size).when(b.isNull(), (v - a) / size).otherwise((b - a) / (2.0 * size)))
    return out


def hillshade(gx: Column, gy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    import math

    a, h = math.radians(azimuth), math.radians(altitude)
    return (F.lit(math.sin(h)) - gx * (math.cos(h) * math.sin(a)) - gy * (math.cos(h) * math.cos(a))) / F.sqrt(gx * gx + gy * gy + 1)


def shifted(cells: DataFrame, value: str, offsets: tuple[tuple[int, int], ...]) -> DataFrame:
    """(ix, iy, v, dx, dy): for each cell the values of its neighbours."""
    return cells.select(F.explode(F.array(*[F.struct((F.col("ix") - i).alias("ix"), (F.col("iy") - j).alias("iy"), F.col(value).alias("v"), F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i, j in offsets])).alias("c")).select("c.*")


def spikes(cells: DataFrame, value: str, limit: float) -> DataFrame:
    """Cells that differ by more than limit from the median of their 3 by 3 cells."""
    med = shifted(cells, value, EIGHT + ((0, 0),)).groupBy("ix", "iy").agg(F.percentile("v", 0.5).alias("median"))
    return cells.join(med, ["ix", "iy"]).where(F.abs(F.col(value) - F.col("median")) > limit)


def label(cells: DataFrame, width: int) -> DataFrame:
    """ix, iy, label of set cells joined over edges; the label is the smallest iy * width + ix."""
    c = cells.select("ix", "iy", (F.col("iy") * width + F.col("ix")).alias("node"))
    right = c.select((F.col("ix") - 1).alias("ix"), "iy", F.col("node").alias("dst"))
    below = c.select("ix", (F.col("iy") - 1).alias("iy"), F.col("node").alias("dst"))
    edges = c.join(right.union(below), ["ix", "iy"]).select(F.col("node").alias("src"), "dst")
    return c.join(components(edges), "node", "left").select("ix", "iy", F.coalesce("component", "node").alias("label"))


def hysteresis(cells: DataFrame, value: str, low: float, high: float, width: int) -> DataFrame:
    """Cells above low whose component has one above high."""
    weak = label(cells.where(F.col(value) > low), width)
    strong = weak.join(cells.where(F.col(value) > high).select("ix", "iy"), ["ix", "iy"], "left_semi").select("label").distinct()
    return weak.join(strong, "label", "left_semi").select("ix", "iy")


def fill_holes(cells: DataFrame, mask: str, nx: int, ny: int, smaller: int | None = None) -> DataFrame:
    """Cells of the complement that don't reach the rim, if given only those of components of fewer cells."""
    back = label(cells.where(~F.col(mask)), nx)
    rim = (F.col("ix") == 0) | (F.col("iy") == 0) | (F.col("ix") == nx - 1) | (F.col("iy") == ny - 1)
    size = back.groupBy("label").agg(F.count("*").alias("n"), F.bool_or(rim).alias("rim"))
    inner = size.where(~F.col("rim") & (F.col("n") < smaller if smaller else F.lit(True)))
    return back.join(inner, "label").select("ix", "iy", "label", "n")


def distance_transform(cells: DataFrame, mask: str, reach: int) -> DataFrame:
    """Adds d2, the squared distance to the nearest set cell if within reach, by columns and then by rows."""
    up, down = columns().rowsBetween(Window.unboundedPreceding, 0), columns().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(mask), F.col("iy"))
    col = cells.withColumn("_d", F.least(F.col("iy") - F.max(at).over(up), F.min(at).over(down) - F.col("iy")))
    best = F.lit(None).cast("long")
    for k in range(-reach, reach + 1):
        v = F.lag("_d", -k).over(rows()) if k else F.col("_d")
        best = F.least(best, F.when(v <= reach, v * v + k * k))
    return col.withColumn("d2", F.when(best <= reach * reach, best)).drop("_d")


def receivers(cells: DataFrame, value: str) -> DataFrame:
    """ix, iy, rx, ry, drop: the neighbour with the steepest fall, the first in order of (dy, dx) of those that tie; null in pits."""
    near = shifted(cells, value, EIGHT).join(cells.select("ix", "iy", F.col(value).alias("own")), ["ix", "iy"])
    fall = (F.col("own") - F.col("v")) / F.sqrt((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).cast("double"))
    best = near.withColumn("drop", fall).groupBy("ix", "iy").agg(F.max(F.struct("drop", (-F.col("dy")).alias("a"), (-F.col("dx")).alias("b"))).alias("m"))
    down = F.col("m.drop") > 0
    return best.select("ix", "iy", F.when(down, F.col("ix") - F.col("m.b")).alias("rx"), F.when(down, F.col("iy") - F.col("m.a")).alias("ry"), F.when(down, F.col("m.drop")).alias("drop"))


def accumulate(flow: DataFrame, rounds: int = 40) -> DataFrame:
    """ix, iy, area: cells that drain through each cell, itself included.

    By doubling: after k rounds area counts the cells fewer than 2^k steps upstream, and to leads 2^k steps down, so rounds grow with the
    logarithm of the longest way. Receivers are cells of flow and form no circle.
    """
    total = cut(flow.select("ix", "iy", F.lit(1).cast("long").alias("area")))
    to = cut(flow.where("rx is not null").select("ix", "iy", "rx", "ry"))
    for _ in range(rounds):
        if to.isEmpty():
            break
        more = total.join(to, ["ix", "iy"]).select(F.col("rx").alias("ix"), F.col("ry").alias("iy"), "area")
        total = cut(total.union(more).groupBy("ix", "iy").agg(F.sum("area").alias("area")))
        to = cut(to.join(to.toDF("rx", "ry", "jx", "jy"), ["rx", "ry"]).select("ix", "iy", F.col("jx").alias("rx"), F.col("jy").alias("ry")))
    else:
        raise RuntimeError(f"water still flows after 2^{rounds} steps")
    return total


def lit_height(cells: DataFrame, value: str, out: str, fall: float, steps: int) -> DataFrame:
    """Height below which a cell lies in the shadow of cells to its left, by doubling: M(p) = max(M(p), M(p + L) - L * fall)."""
    now = cells.withColumn(out, F.col(value).cast("double"))
    for k in range(steps):
        length = 1 << k
        now = now.withColumn(out, F.greatest(F.col(out), F.lag(out, length).over(rows()) - length * fall))
    return now


def pull_push(cells: DataFrame, value: str, known: str, out: str) -> DataFrame:
    """Adds out: the value where it is known, else the mean of the known cells of the smallest block of 2, 4, 8 ... cells a side that has one, each
    block's mean being that of its four parts' means (R16).

    Levels are sums by block, a quarter of the cells each; blocks of all levels together are a third of the raster.
    """
    number = lambda c, k: F.shiftright(c, k)
    level = cells.select("ix", "iy", F.when(F.col(known), F.col(value).cast("double")).alias("_v"))
    top = level.agg(F.greatest(F.max("ix"), F.max("iy"))).first()[0] or 0
    filled, blocks, k = cells.withColumn(out, F.when(F.col(known), F.col(value).cast("double"))), level, 0
    while top >> k:
        k += 1
        # a block without known cells is null, and isn't counted in the mean of the next
        blocks = cut(blocks.groupBy(number("ix", 1).alias("ix"), number("iy", 1).alias("iy")).agg(F.avg("_v").alias("_v")))
        here = blocks.where("_v is not null").select(F.col("ix").alias("_bx"), F.col("iy").alias("_by"), F.col("_v").alias("_m"))
        filled = filled.join(here, (number("ix", k) == F.col("_bx")) & (number("iy", k) == F.col("_by")), "left").withColumn(out, F.coalesce(out, "_m")).drop("_bx", "_by", "_m")
    return filled
