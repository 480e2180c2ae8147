"""What the third round's findings on growth asked for: less moved and written, the same results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F


def _walks(succ):
    """low, low_at, last, steps and size of each node, one by one."""
    out = {}
    for n in succ:
        way, at = [], n
        while at is not None and at not in way:
            way.append(at)
            at = succ[at]
        low = min(way)
        out[n] = (low, way.index(low), way[-1] if at is None else None, len(way) - 1 if at is None else None, len(way) if at is not None else None)
    return out


def test_splicing_gives_what_following_gives(spark, monkeypatch):
    """Rings and lists of many lengths; fewer rows go on to doubling, so less is written than by doubling all."""
    from terravane.operators import graph, pointers

    rng, succ, n = np.random.default_rng(4), {}, 0
    for k, size in enumerate([1, 1, 2, 2, 3, 4, 5, 8, 13, 40, 301] * 2):
        nodes = [int(v) - 300 for v in n + rng.permutation(size)]
        succ |= dict(zip(nodes, nodes[1:] + ([nodes[0]] if k % 2 else [None])))
        n += size
    links = spark.createDataFrame(list(succ.items()), "node long, next long")
    doubled = []
    real = pointers._doubled
    monkeypatch.setattr(pointers, "_doubled", lambda state, *a: doubled.append(state.count()) or real(state, *a))
    want = _walks(succ)
    for few in (20, 10_000):
        got = {r.node: (r.low, r.low_at, r.last, r.steps, r.size) for r in pointers.places(links, few).collect()}
        assert got == want
    assert doubled[0] <= 20 and doubled[1] == len(succ)


def test_lines_eased_together_are_as_alone(spark):
    from terravane.operators import kernels as K

    def alone(x, y, most, rounds=4000):
        if len(x) < 4:
            return x, y
        d = np.hypot(np.diff(x), np.diff(y))
        a = np.unwrap(np.arctan2(np.diff(y), np.diff(x)))
        turn = np.diff(a)
        for _ in range(rounds):
            over = np.sign(turn) * np.maximum(np.abs(turn) - most, 0)
            if np.abs(over).max(initial=0) < 1e-9:
                break
            turn = turn - over
            turn[1:] += over[:-1] / 2
            turn[:-1] += over[1:] / 2
        b = a[0] + np.concatenate([[0.0], np.cumsum(turn)])
        px, py = x[0] + np.concatenate([[0.0], np.cumsum(d * np.cos(b))]), y[0] + np.concatenate([[0.0], np.cumsum(d * np.sin(b))])
        t = np.linspace(0, 1, len(px))
        return px + t * (x[-1] - px[-1]), py + t * (y[-1] - py[-1])

    rng = np.random.default_rng(1)
    lines = [(rng.integers(0, 2000, n).astype(float), rng.integers(0, 667, n).astype(float)) for n in (1, 2, 3, 4, 5, 30, 67, 90, 20, 4)]
    lines.append((np.arange(9.0), np.zeros(9)))
    for got, (x, y) in zip(K.ease_lines(lines, 1.2), lines):
        want = alone(x, y, 1.2)
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])


def test_boxes_over_boxes_make_few_pieces(spark):
    """2000 boxes on a small area: only edges near what no box fills are cut, and union, difference and intersection are those of unit cells."""
    from terravane.operators import overlay

    rng = np.random.default_rng(7)
    at = sorted({(int(x), int(y)) for x, y in zip(rng.integers(0, 90, 2000), rng.integers(0, 50, 2000))} | {(120, 0), (131, 3), (120, 20)})
    zones = [(-5, 10, 40, 33), (60, 0, 128, 9)]
    box = lambda rows: spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], "shape long, x0 double, y0 double, x1 double, y1 double").select("shape", overlay.box_ring(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]).alias("ring"))
    a, b = overlay.edges_of(box([(x, y, x + 12, y + 8) for x, y in at]), "ring"), overlay.edges_of(box(zones), "ring", layer=1)
    assert overlay._pieces(a, 20.0).count() < 5000
    u = {(x + i, y + j) for x, y in at for i in range(12) for j in range(8)}
    z = {(x, y) for x0, y0, x1, y1 in zones for x in range(x0, x1) for y in range(y0, y1)}
    for found, cells in ((overlay.union(a, 20.0), u), (overlay.difference(a.union(b), 20.0), u - z), (overlay.intersection(a.union(b), 20.0), u & z)):
        rim = sum((x + i, y + j) not in cells for x, y in cells for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        r = overlay.measured(found).agg(F.sum("area"), F.sum("perimeter")).first()
        assert math.isclose(r[0], len(cells)) and math.isclose(r[1], rim)


def test_noding_moves_segments_not_cuts(spark):
    """Segments shorter and longer than a tile, many crossings each: the parts of brute force, and no exchange of cuts for the short ones."""
    from terravane.operators import spatial

    rng = np.random.default_rng(3)
    rows = [(k, int(x), int(y), int(x + dx), int(y + dy)) for k, (x, y, dx, dy) in enumerate(zip(rng.integers(-40, 40, 300), rng.integers(-40, 40, 300), rng.integers(-10, 11, 300), rng.integers(-10, 11, 300)))]
    rows += [(900, -40, -30, 50, 33), (901, 0, -50, 3, 50), (902, -20, 5, 20, 5)]
    schema = "sid long, x0 long, y0 long, x1 long, y1 long"
    want = []
    for s, x0, y0, x1, y1 in rows:
        cuts = [0.0, 1.0]
        for _, u0, v0, u1, v1 in rows:
            d1, d2 = ((x1 - x0) * (v - y0) - (y1 - y0) * (u - x0) for u, v in ((u0, v0), (u1, v1)))
            d3, d4 = ((u1 - u0) * (y - v0) - (v1 - v0) * (x - u0) for x, y in ((x0, y0), (x1, y1)))
            if d1 * d2 < 0 and d3 * d4 < 0:
                cuts.append(d3 / (d3 - d4))
        cuts.sort()
        want += [(s, k + 1, round(a, 9), round(b, 9)) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = spatial.noded(spark.createDataFrame(rows, schema), 20.0, 10)
    assert sorted((r.sid, r.k, round(r.t0, 9), round(r.t1, 9)) for r in got.collect()) == sorted(want)
    plan = spatial.noded(spark.createDataFrame(rows[:300], schema), 20.0, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
