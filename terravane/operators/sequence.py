"""Operators on ordered rows of a line: windows in closed form, runs, intervals and joins by station.

Each takes the columns that name a line and order its rows; lines are independent, so work is spread by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(line: str = "user_id", order: str = "seq"):
    return Window.partitionBy(line).orderBy(order)


def arclength(df: DataFrame, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Adds s, the length from the line's start."""
    w = along(line, order)
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return df.withColumn("_d", F.coalesce(step, F.lit(0.0))).withColumn("s", F.sum("_d").over(w)).drop("_d")


def running_extreme(df: DataFrame, value: str, out: str, kind: str = "max", line: str = "user_id", order: str = "seq", backwards: bool = False) -> DataFrame:
    """Largest or smallest value so far, from either end."""
    w = Window.partitionBy(line).orderBy(F.desc(order) if backwards else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, (F.max if kind == "max" else F.min)(value).over(w))


def raise_only(df: DataFrame, value: str, grade: float, out: str, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Lifts values so that none lies more than grade a step below the one before: max over j <= i of z(j) - grade * (i - j)."""
    w = along(line, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max(F.col(value) + F.col(order) * grade).over(w) - F.col(order) * grade)


def cut_only(df: DataFrame, value: str, station: str, grade: float, out: str, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Lowers values to the largest profile below them that no step climbs or falls by more than grade for each unit of station."""
    s = F.col(station) * grade
    fore = along(line, order).rowsBetween(Window.unboundedPreceding, 0)
    back = along(line, order).rowsBetween(0, Window.unboundedFollowing)
    return df.withColumn(out, F.least(F.min(F.col(value) - s).over(fore) + s, F.min(F.col(value) + s).over(back) - s))


def pinned_profile(df: DataFrame, value: str, floor: str, pinned: str, station: str, grade: float, out: str, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Adds a profile near the values that nowhere climbs or falls by more than grade for each unit of station, lies above the floor, and keeps pinned values.

    It is the middle between the lowest such profile above the values and the highest below them, raised to the lowest one above the floor and held
    within the cones of the pinned values. Where pins and floor can't both be met pins win; pins that contradict each other aren't met.
    """
    ahead = along(line, order).rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(line).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    s = F.col(station) * grade
    above = lambda v: F.greatest(F.max(v + s).over(ahead) - s, F.max(v - s).over(back) + s)
    below = lambda v: F.least(F.min(v - s).over(ahead) + s, F.min(v + s).over(back) - s)
    z, f = F.col(value).cast("double"), F.col(floor).cast("double")
    held = F.when(F.col(pinned), z)
    parts = df.withColumns({"_up": above(z), "_down": below(z), "_floor": above(f), "_most": below(held), "_least": above(held)})
    raised = F.greatest((F.col("_up") + F.col("_down")) / 2, F.col("_floor"))
    return parts.withColumn(out, F.greatest(F.least(raised, F.coalesce("_most", raised)), F.coalesce("_least", raised - 1e300))).drop("_up", "_down", "_floor", "_most", "_least")


def two_sided_clamp(values: Column, grade: float) -> Column:
    """Forward pass z(i) = clip(z(i), z(i-1) - g, z(i-1) + g) over an array, as a fold."""
    return F.aggregate(values, F.array().cast("array<double>"), lambda a, z: F.concat(a, F.array(F.when(F.size(a) == 0, z.cast("double")).otherwise(F.least(F.greatest(z.cast("double"), F.try_element_at(a, F.lit(-1)) - grade), F.try_element_at(a, F.lit(-1)) + grade)))))


def runs(df: DataFrame, flag: Column, line: str = "user_id", order: str = "seq", least: int = 1) -> DataFrame:
    """line, first, last, n of each run of rows whose flag is true, of at least `least` rows."""
    marked = df.select(line, order, flag.alias("_f"))
    by_flag = Window.partitionBy(line, "_f").orderBy(order)
    grouped = marked.withColumn("_g", F.row_number().over(along(line, order)) - F.row_number().over(by_flag)).where("_f")
    return grouped.groupBy(line, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_g")


def merge_intervals(df: DataFrame, start: str, end: str, near: float, line: str = "user_id") -> DataFrame:
    """Joins intervals of a line that overlap or lie within `near` of each other."""
    w = Window.partitionBy(line).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + near), 1).otherwise(0)
    grouped = df.withColumn("_new", fresh).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(line, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_g")


def circumradius(df: DataFrame, lag: int = 1, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Adds radius, of the circle through a point and those `lag` before and after; null at the ends."""
    w = along(line, order)
    ax, ay, cx, cy = F.lag("x", lag).over(w), F.lag("y", lag).over(w), F.lead("x", lag).over(w), F.lead("y", lag).over(w)
    named = df.withColumns({"_ax": ax, "_ay": ay, "_cx": cx, "_cy": cy})
    ab, bc, ca = F.hypot(F.col("x") - F.col("_ax"), F.col("y") - F.col("_ay")), F.hypot(F.col("_cx") - F.col("x"), F.col("_cy") - F.col("y")), F.hypot(F.col("_ax") - F.col("_cx"), F.col("_ay") - F.col("_cy"))
    area2 = F.abs((F.col("x") - F.col("_ax")) * (F.col("_cy") - F.col("_ay")) - (F.col("y") - F.col("_ay")) * (F.col("_cx") - F.col("_ax")))
    return named.withColumn("radius", ab * bc * ca / F.greatest(area2 * 2.0, F.lit(1e-9))).drop("_ax", "_ay", "_cx", "_cy")


def tangent(df: DataFrame, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Adds tx, ty: half the step between neighbours, whole steps at the ends."""
    w = along(line, order)
    out = df
    for v, t in (("x", "tx"), ("y", "ty")):
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        out = out.withColumn(t, F.when(before.isNull(), (after - F.col(v)).cast("double")).when(after.isNull(), (F.col(v) - before).cast("double")).otherwise((after - before) / 2))
    return out


def unwrap(df: DataFrame, angle: str, out: str, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Angles in degrees without jumps of over half a turn."""
    w = along(line, order)
    d = F.col(angle) - F.lag(angle).over(w)
    turn = F.coalesce(F.pmod(d + 180, F.lit(360)) - 180, F.col(angle))
    return df.withColumn("_t", turn).withColumn(out, F.sum("_t").over(w)).drop("_t")


def fill_linear(df: DataFrame, value: str, out: str, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Interpolates nulls between their neighbours, and carries the ends outwards."""
    fore, back = along(line, order).rowsBetween(Window.unboundedPreceding, 0), along(line, order).rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    p, n = F.last(at, ignorenulls=True).over(fore), F.first(at, ignorenulls=True).over(back)
    held = df.withColumns({"_p": p, "_n": n})
    mid = F.col("_p.v") + (F.col("_n.v") - F.col("_p.v")) * (F.col(order) - F.col("_p.o")) / F.greatest(F.col("_n.o") - F.col("_p.o"), F.lit(1))
    return held.withColumn(out, F.coalesce(mid, F.col("_p.v").cast("double"), F.col("_n.v").cast("double"))).drop("_p", "_n")


def gaussian_weights(radius: int, sigma: float) -> list[float]:
    import math

    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def smooth(df: DataFrame, value: str, out: str, weights: list[float], line: str = "user_id", order: str = "seq") -> DataFrame:
    """Weighted mean over neighbours; weights beyond the ends are left out and the rest made to sum to 1."""
    w, r = along(line, order), len(weights) // 2
    top, total = F.lit(0.0), F.lit(0.0)
    for k, wk in zip(range(-r, r + 1), weights):
        v = F.lag(value, -k).over(w) if k else F.col(value)
        top, total = top + F.coalesce(v * wk, F.lit(0.0)), total + F.when(v.isNotNull(), wk).otherwise(0.0)
    return df.withColumn(out, top / total)


def asof(left: DataFrame, right: DataFrame, line: str, at: str, payload: list[str]) -> DataFrame:
    """Each left row with the payload of the last right row of the same line at or before it; nulls if there is none.

    One union and one sorted window: no pairs are made, and a line's rows are read once.
    """
    tagged = left.withColumns({"_l": F.lit(1), "_p": F.lit(None).cast(right.select(F.struct(*payload).alias("p")).schema["p"].dataType)}).unionByName(right.select(line, at, F.lit(0).alias("_l"), F.struct(*payload).alias("_p")), allowMissingColumns=True)
    w = Window.partitionBy(line).orderBy(at, "_l").rowsBetween(Window.unboundedPreceding, 0)
    return tagged.withColumn("_p", F.last("_p", ignorenulls=True).over(w)).where("_l = 1").select(*left.columns, "_p.*")


def interval_join(samples: DataFrame, spans: DataFrame, line: str, at: str, start: str, end: str, pad: float, cell: int = 64) -> DataFrame:
    """Samples within a span of their line, padded on both sides (J17). Spans are listed by the cells of station they touch, so one long
    line does not meet as all pairs."""
    listed = spans.withColumn("_c", F.explode(F.sequence(F.floor((F.col(start) - pad) / cell), F.floor((F.col(end) + pad) / cell))))
    keyed = samples.withColumn("_c", F.floor(F.col(at) / cell))
    return keyed.join(listed, [line, "_c"]).where((F.col(at) >= F.col(start) - pad) & (F.col(at) <= F.col(end) + pad)).drop("_c")


def resample(df: DataFrame, spacing: float, line: str = "user_id", order: str = "seq") -> DataFrame:
    """Points at n = max(2, ceil(L / spacing) + 1) even stations of each line (W02). df has s from arclength()."""
    total = df.groupBy(line).agg(F.max("s").alias("L"))
    stations = total.withColumn("n", F.greatest(F.lit(2), F.ceil(F.col("L") / spacing).cast("int") + 1)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("s", F.col("L") * F.col("k") / (F.col("n") - 1))
    w = along(line, order)
    segments = df.select(line, "s", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("s").alias("s0"), F.lead("s").over(w).alias("s1"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("s1 > s0 or s1 is null")
    segments = segments.where("s1 is not null")
    t = F.when(F.col("s1") > F.col("s0"), F.least(F.lit(1.0), (F.col("s") - F.col("s0")) / (F.col("s1") - F.col("s0")))).otherwise(0.0)
    return asof(stations, segments, line, "s", ["x0", "y0", "s0", "s1", "x1", "y1"]).select(line, F.col("k").cast("long").alias("k"), "s", (F.col("x0") + t * (F.col("x1") - F.col("x0"))).alias("x"), (F.col("y0") + t * (F.col("y1") - F.col("y0"))).alias("y"))


def circular_gaps(legs: DataFrame, node: str, angle: str) -> DataFrame:
    """Adds gap, the turn from a leg to the next one around its node."""
    w = Window.partitionBy(node).orderBy(angle, "leg")
    after = F.coalesce(F.lead(angle).over(w), F.first(angle).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return legs.withColumn("gap", F.pmod(after - F.col(angle), F.lit(360)))
