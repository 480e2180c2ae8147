"""Column expressions: coordinates, profiles, angles, lookups, classes, identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def px_to_world(x, y) -> tuple[Column, Column]:
    """World metres with the origin in the middle of the image."""
    return (col(x) - fixed.WIDTH / 2) * fixed.METRES, (col(y) - fixed.HEIGHT / 2) * fixed.METRES


def world_to_px(wx, wz) -> tuple[Column, Column]:
    return col(wx) / fixed.METRES + fixed.WIDTH / 2, col(wz) / fixed.METRES + fixed.HEIGHT / 2


def px_to_norm(x, y) -> tuple[Column, Column]:
    return col(x) / fixed.WIDTH, col(y) / fixed.HEIGHT


def chunk_id(x, y) -> Column:
    """C{cx:02d}_{cy:02d} of the chunk that holds a pixel."""
    part = [F.lpad(F.floor(col(v) / fixed.CHUNK).cast("string"), 2, "0") for v in (x, y)]
    return F.concat(F.lit("C"), part[0], F.lit("_"), part[1])


def clip(x, lo, hi) -> Column:
    return F.greatest(col(lo), F.least(col(hi), col(x)))


def smoothstep(e0: float, e1: float, x) -> Column:
    t = clip((col(x) - e0) / (e1 - e0), F.lit(0.0), F.lit(1.0))
    return t * t * (F.lit(3.0) - t * 2)


def smax(a, b, k: float) -> Column:
    """Smooth maximum that is exact where either is near 0."""
    a, b = col(a), col(b)
    kk = clip(F.least(a, b) / (2 * k), F.lit(0.0), F.lit(1.0)) * k
    h = F.greatest(kk - F.abs(a - b), F.lit(0.0)) / F.greatest(kk, F.lit(1e-6))
    return F.greatest(a, b) + h * h * kk * 0.25


def smin(a, b, k: float) -> Column:
    a, b = col(a), col(b)
    h = F.greatest(F.lit(k) - F.abs(a - b), F.lit(0.0)) / k
    return F.least(a, b) - h * h * k * 0.25


def ridge_profile(t, p: float = 2.0, q: float = 2.1) -> Column:
    return F.pow(F.lit(1.0) - F.pow(clip(t, F.lit(0.0), F.lit(1.0)), F.lit(p)), F.lit(q))


def distance(x0, y0, x1, y1) -> Column:
    return F.sqrt(F.pow((col(x1) - col(x0)).cast("double"), 2) + F.pow((col(y1) - col(y0)).cast("double"), 2))


def bearing(dx, dy) -> Column:
    """Degrees from 0 to 360, along x first."""
    return F.pmod(F.degrees(F.atan2(col(dy).cast("double"), col(dx).cast("double"))), F.lit(360.0))


def angle_between(a, b) -> Column:
    """Smallest turn between two bearings."""
    return F.abs(F.pmod(col(a) - col(b) + 180, F.lit(360.0)) - 180)


def half_turn(a) -> Column:
    """An orientation in [-90, 90)."""
    return F.pmod(col(a) + 90, F.lit(180.0)) - 90


def compass(dx, dy) -> Column:
    """Name of the nearest of four directions; y grows downwards."""
    north_up = F.pmod(F.degrees(F.atan2(-col(dy).cast("double"), col(dx).cast("double"))), F.lit(360.0))
    return F.element_at(F.array(*map(F.lit, fixed.COMPASS)), F.floor(F.pmod(north_up + 45, F.lit(360.0)) / 90).cast("int") + 1)


def crossing_angle(ax, ay, bx, by) -> Column:
    """Angle in [0, 90] between two directions; null for a zero one (P10)."""
    dot, la, lb = F.abs(col(ax) * col(bx) + col(ay) * col(by)), F.hypot(ax, ay), F.hypot(bx, by)
    return F.when(la * lb > 0, F.degrees(F.acos(F.least(F.lit(1.0), dot / (la * lb)))))


def side(ax, ay, bx, by) -> Column:
    """Sign of the cross product."""
    return F.signum((col(ax) * col(by) - col(ay) * col(bx)).cast("double"))


def lookup(key, values: dict, default) -> Column:
    """A small dictionary as a map expression."""
    pairs = [F.lit(v) for kv in values.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(key)), F.lit(default))


def finished_width(lanes, own_lanes, width, lane_width: float = 3.6, side_width: float = 1.2, median: float = 0.0) -> Column:
    """Width for an explicit number of lanes, else the type's own."""
    return F.when(col(lanes).isNull() | (col(lanes) == col(own_lanes)), col(width)).otherwise(F.round(col(lanes) * lane_width + 2 * side_width + median, 1))


def crossing_kind(road, water, width) -> Column:
    """viaduct, ford, culvert or bridge."""
    r, w, m = col(road), col(water), col(width)
    return (
        F.when(w == "valley", "viaduct")
        .when(r.isin("dirt", "driveway") & (w == "creek") & (m < 8), "ford")
        .when((w == "creek") & (m < 7) & ~r.isin("freeway", "highway"), "culvert")
        .otherwise("bridge")
    )


def crossing_structure(road, water, width) -> Column:
    r, m, kind = col(road), col(width), crossing_kind(road, water, width)
    heavy = r.isin("freeway", "highway", "ramp", "arterial")
    return (
        F.when(kind == "viaduct", F.when(heavy, "concrete girder viaduct").otherwise("steel trestle"))
        .when(kind == "ford", "ford")
        .when(kind == "culvert", F.when(r.isin("arterial", "collector", "main_street"), "box culvert").otherwise("pipe culvert"))
        .when(heavy, F.when(m < 120, "concrete girder").otherwise("steel plate girder"))
        .when(r.isin("rural", "gravel", "dirt") & (m > 25), "steel truss")
        .otherwise(F.when(m < 20, "concrete slab").otherwise("concrete girder"))
    )


def clearance(road, water, width) -> Column:
    """Height that a crossing keeps above water; null for fords."""
    r, w, m = col(road), col(water), col(width)
    full = lookup(water, fixed.CLEARANCE, 4.0) + F.when(r.isin("freeway", "highway"), 1.5).otherwise(0.0)
    capped = F.when(r.isin("gravel", "dirt", "driveway"), F.least(full, F.lit(1.3))).when(r == "residential", F.least(full, F.lit(2.5))).when(r.isin("rural", "urban_street"), F.least(full, F.lit(4.5))).otherwise(full)
    return F.when(r.isin("dirt", "driveway") & (w == "creek") & (m < 8), F.lit(None)).when((w == "creek") & (m < 7) & ~r.isin("freeway", "highway"), 1.8).otherwise(capped)


def building_class(zone_kind, area, red, glass) -> Column:
    """Class of a detected building by zone, area and colour shares."""
    k, a, r, g = col(zone_kind), col(area), col(red), col(glass)
    return (
        F.when(k == "downtown", F.when((g > 0.25) & (a > 250), "tower").when(a > 900, "urban_midrise").otherwise("downtown_lowrise"))
        .when(k == "industrial", F.when(a > 500, "industrial").otherwise("commercial_small"))
        .when(k == "town_center", F.when(a < 900, "commercial_small").otherwise("civic"))
        .when(k.isin("town", "city"), F.when(a > 1500, F.when(r < 0.2, "industrial").otherwise("civic")).when(a > 450, "commercial_small").otherwise("house_large"))
        .when(r > 0.35, "barn")
        .otherwise(F.when(a < 450, "house_large").otherwise("barn"))
    )


def hash_unit(text) -> Column:
    """A number in [0, 1] from the first eight hex digits of md5 (P20)."""
    return F.conv(F.substring(F.md5(col(text).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967295.0


def char_sum(text) -> Column:
    """Sum of character codes."""
    return F.aggregate(F.split(col(text), ""), F.lit(0).cast("long"), lambda s, c: s + F.when(c == "", 0).otherwise(F.ascii(c)))


def rgb(hex_colour) -> list[Column]:
    """Three numbers of #rrggbb."""
    return [F.conv(F.substring(col(hex_colour), at, 2), 16, 10).cast("long") for at in (2, 4, 6)]


def catenary(z0, z1, t, span, sag: float) -> Column:
    """Height on a hanging wire."""
    return col(z0) + (col(z1) - col(z0)) * col(t) - col(span) * sag * 4 * col(t) * (F.lit(1.0) - col(t))


def quadratic(p0, p1, p2, t) -> Column:
    u = F.lit(1.0) - col(t)
    return u * u * col(p0) + u * col(t) * 2 * col(p1) + col(t) * col(t) * col(p2)


def cubic(p0, p1, p2, p3, t) -> Column:
    t, u = col(t), F.lit(1.0) - col(t)
    return u * u * u * col(p0) + u * u * t * 3 * col(p1) + u * t * t * 3 * col(p2) + t * t * t * col(p3)


def catmull_rom(p0, p1, p2, p3, t) -> Column:
    p0, p1, p2, p3, t = map(col, (p0, p1, p2, p3, t))
    return (p1 * 2 + (p2 - p0) * t + (p0 * 2 - p1 * 5 + p2 * 4 - p3) * t * t + (p1 * 3 - p0 - p2 * 3 + p3) * t * t * t) * 0.5


def hermite(p0, m0, p1, m1, t) -> Column:
    p0, m0, p1, m1, t = map(col, (p0, m0, p1, m1, t))
    t2, t3 = t * t, t * t * t
    return (t3 * 2 - t2 * 3 + 1) * p0 + (t3 - t2 * 2 + t) * m0 + (t2 * 3 - t3 * 2) * p1 + (t3 - t2) * m1


def water_mask(h, s, v, r, b) -> Column:
    """Whether a pixel's colour is that of water."""
    return (col(h) >= 180) & (col(h) <= 230) & (col(s) > 0.35) & (col(v) > 0.22) & (col(b) > col(r) + 15)


def cream_score(h, s, v) -> Column:
    """How much a colour looks like pavement or gravel."""
    hue = F.greatest(smoothstep(0, 12, h) * (F.lit(1.0) - smoothstep(58, 75, h)), F.lit(1.0) - smoothstep(0.10, 0.2, s))
    return smoothstep(0.42, 0.62, v) * (F.lit(1.0) - smoothstep(0.30, 0.50, s)) * hue


def cost_of_score(s) -> Column:
    return F.lit(1.0) / F.pow(clip(s, F.lit(0.0), F.lit(1.0)) + 0.03, F.lit(1.6))


def quantise(v, lo, hi, levels: int = 65535) -> Column:
    """v between lo and hi as a whole number from 0 to levels."""
    return clip(F.round((col(v) - col(lo)) / (col(hi) - col(lo)) * levels), F.lit(0.0), F.lit(float(levels))).cast("long")


def dequantise(q, lo, hi, levels: int = 65535) -> Column:
    return col(lo) + col(q) / levels * (col(hi) - col(lo))
