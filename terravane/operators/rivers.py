"""River channels on a raster: sections across the stream with pools, bars and falls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spatial import within

#: Depth in the middle, its share that bends move to their outer bank, height of bars, depth of the pool below a fall.
DEPTH, SKEW, BAR, PLUNGE = 3.0, 0.6, 0.3, 2.0


def stations(samples: DataFrame, level: str, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Samples of centre lines with what sections need: z, the lowest level so far along the flow; the direction (tx, ty) and the turn
    there, from the samples before and after (-1 to 1, positive to the left); and drop, the fall from the sample before."""
    w = Window.partitionBy(line).orderBy(order)
    z = F.min(level).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ax, ay = F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x")), F.col("y") - F.coalesce(F.lag("y").over(w), F.col("y"))
    bx, by = F.coalesce(F.lead("x").over(w), F.col("x")) - F.col("x"), F.coalesce(F.lead("y").over(w), F.col("y")) - F.col("y")
    s = samples.withColumns({"z": z, "_ax": ax, "_ay": ay, "_bx": bx, "_by": by})
    size = F.hypot("_ax", "_ay") * F.hypot("_bx", "_by")
    turn = F.when(size > 0, (F.col("_ax") * F.col("_by") - F.col("_ay") * F.col("_bx")) / F.when(size > 0, size)).otherwise(0.0)
    s = s.withColumns({"tx": F.col("_ax") + F.col("_bx"), "ty": F.col("_ay") + F.col("_by"), "turn": turn, "drop": F.coalesce(F.lag("z").over(w) - F.col("z"), F.lit(0))})
    return s.drop("_ax", "_ay", "_bx", "_by")


def channels(cells: DataFrame, centre: DataFrame, widest: float, fall: float, line: str = "user_id", order: str = "seq") -> DataFrame:
    """ix, iy, bed, part: the bed of cells (ix, iy, x, y) within the half width of their nearest station (line, order, x, y, z, tx, ty, turn, drop, half).

    Across the stream the bed is a parabola, deeper toward the outer bank of a bend (pool) and raised to a bar along the inner one; below a drop
    of more than `fall` a plunge pool is cut (fall). Of stations as near the lower one counts, then the smaller line and place.
    """
    s = centre.select(line, order, F.col("x").alias("bx"), F.col("y").alias("by"), *[F.col(c).cast("double").alias(c) for c in ("z", "tx", "ty", "turn", "drop", "half")])
    met = within(cells.select("ix", "iy", "x", "y"), s, widest, bx="bx", by="by")
    carried = ["bx", "by", "tx", "ty", "turn", "drop", "half", "ax", "ay"]
    best = met.groupBy("ix", "iy").agg(F.min(F.struct("dist", "z", line, order, *carried)).alias("m")).select("ix", "iy", "m.*")
    side = F.signum(F.col("tx") * (F.col("ay") - F.col("by")) - F.col("ty") * (F.col("ax") - F.col("bx")))  # 1 to the left of the stream
    t = F.col("dist") / F.col("half")
    at = best.where("dist < half").withColumns({"t": t, "outer": -side * F.col("turn")})
    bar = (F.col("outer") < -0.4) & (F.col("t") > 0.5)
    plunge = (F.col("drop") > fall) & (F.col("t") < 0.8)
    depth = DEPTH * (1 - F.col("t") * F.col("t")) * (1 + SKEW * F.col("outer")) + F.when(plunge, PLUNGE).otherwise(0.0)
    bed = F.when(bar & ~plunge, F.col("z") - BAR * F.col("outer") * (1 - F.col("t"))).otherwise(F.col("z") - depth)
    part = F.when(plunge, "fall").when(bar, "bar").when(F.col("outer") > 0.4, "pool").otherwise("run")
    return at.select("ix", "iy", bed.alias("bed"), part.alias("part"))
