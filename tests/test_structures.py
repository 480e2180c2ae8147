"""Operators on plane graphs, routes and tiles against versions that hold everything in one array."""

import collections
import heapq
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terravane.operators import paths, planar, pointers, terrain


def lattice(seed, wide, high, p=0.8):
    """A shaken grid with edges left out: (eid, src, dst, x0, y0, x1, y1)."""
    rng = random.Random(seed)
    at = {k: (k % wide * 100 + rng.randrange(60), k // wide * 100 + rng.randrange(60)) for k in range(wide * high)}
    pairs = [(k, k + 1) for k in at if k % wide < wide - 1] + [(k, k + wide) for k in at if k + wide in at]
    rng.shuffle(pairs)
    return [(i, *(e if rng.random() < 0.5 else e[::-1])) for i, e in enumerate(pairs) if rng.random() < p], at


def traced(edges, at):
    """Faces by walking, as lists of half-edges."""
    around = collections.defaultdict(list)
    for e, a, b in edges:
        around[a].append((math.atan2(at[b][1] - at[a][1], at[b][0] - at[a][0]), 2 * e, b))
        around[b].append((math.atan2(at[a][1] - at[b][1], at[a][0] - at[b][0]), 2 * e + 1, a))
    follows, tail = {}, {}
    for n, out in around.items():
        out.sort()
        for i, (_, h, _) in enumerate(out):
            follows[h ^ 1], tail[h] = out[i - 1][1], n
    found, left = [], set(follows)
    while left:
        h, ring = min(left), []
        while h in left:
            left.discard(h)
            ring.append(h)
            h = follows[h]
        found.append(ring)
    return found, tail


def area(ring, tail, at):
    pts = [at[tail[h]] for h in ring]
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1])) / 2


def frame(spark, edges, at):
    return spark.createDataFrame([(e, a, b, *at[a], *at[b]) for e, a, b in edges], "eid long, src long, dst long, x0 long, y0 long, x1 long, y1 long")


def test_follow(spark):
    rng = random.Random(4)
    node = list(range(300))
    rng.shuffle(node)
    nxt = {}
    for low, high, ring in ((0, 1, False), (1, 2, True), (2, 130, False), (130, 137, True), (137, 300, True)):
        part = node[low:high]
        nxt |= dict(zip(part, part[1:] + [part[0] if ring else None]))
    got = {r.node: r for r in pointers.follow(spark.createDataFrame(list(nxt.items()), "node long, next long")).collect()}
    assert set(got) == set(nxt)
    for n in nxt:
        seen = [n]
        while nxt[seen[-1]] is not None and nxt[seen[-1]] != n:
            seen.append(nxt[seen[-1]])
        ended = nxt[seen[-1]] is None
        assert (got[n].low, got[n].low_at) == (min(seen), seen.index(min(seen)))
        assert (got[n].last, got[n].steps) == ((seen[-1], len(seen) - 1) if ended else (None, None))
    assert pointers.follow(spark.createDataFrame([], "node long, next long")).count() == 0


@pytest.mark.parametrize("seed, wide, high, p", [(1, 9, 7, 0.8), (2, 12, 12, 0.6), (3, 3, 60, 0.95)])
def test_faces(spark, seed, wide, high, p):
    edges, at = lattice(seed, wide, high, p)
    want, tail = traced(edges, at)
    s = planar.sides(frame(spark, edges, at))
    got = collections.defaultdict(dict)
    for r in s.collect():
        got[r.face][r.place] = (r.half, r.x, r.y)
    assert {f: [v[k] for k in range(len(v))] for f, v in got.items()} == {min(r): [(h, *at[tail[h]]) for h in r[r.index(min(r)) :] + r[: r.index(min(r))]] for r in want}
    rows = {r.face: r for r in planar.faces(s).collect()}
    for ring in want:
        r = rows[min(ring)]
        assert (r.sides, r.area, r.border) == (len(ring), area(ring, tail, at), sum(h ^ 1 not in ring for h in ring))
    # Euler: faces of a component are its edges less its nodes and two
    parts = {}
    for _, a, b in edges:
        parts.setdefault(a, {a}), parts.setdefault(b, {b})
        if parts[a] is not parts[b]:
            parts[a] |= parts[b]
            for n in parts[b]:
                parts[n] = parts[a]
    assert len(want) == sum(2 for _ in {id(x) for x in parts.values()}) + len(edges) - len(parts)


def cleaned(edges, at, fixed, score, least, spur, fragment, rounds=6):
    """As planar.clean, but traced again in every round."""
    size = {e: math.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) for e, a, b in edges}
    now = list(edges)
    for _ in range(rounds):
        rings, tail = traced(now, at)
        face = {h: i for i, r in enumerate(rings) for h in r}
        gone = set()
        for i, r in enumerate(rings):
            if 0 <= area(r, tail, at) < least:
                open_to = [h >> 1 for h in r if face[h ^ 1] != i and (h >> 1) not in fixed]
                if open_to:
                    gone.add(min(open_to, key=lambda e: (score[e], e)))
        degree = collections.Counter(n for _, a, b in now for n in (a, b))
        gone |= {e for e, a, b in now if e not in fixed and size[e] < spur and 1 in (degree[a], degree[b])}
        if not gone:
            break
        now = [x for x in now if x[0] not in gone]
    part = {n: n for _, a, b in now for n in (a, b)}

    def root(n):
        while part[n] != n:
            n = part[n]
        return n

    for _, a, b in now:
        part[root(a)] = root(b)
    total, held = collections.Counter(), collections.Counter()
    for e, a, b in now:
        total[root(a)] += size[e]
        held[root(a)] += e in fixed
    return {e for e, a, b in now if total[root(a)] >= fragment or held[root(a)]}


def test_cleaning(spark):
    edges, at = lattice(5, 10, 9, 0.85)
    rng = random.Random(6)
    fixed, score = {e for e, _, _ in edges if rng.random() < 0.2}, {e: rng.randrange(50) / 50 for e, _, _ in edges}
    extra = spark.createDataFrame([(e, score[e], e in fixed) for e, _, _ in edges], "eid long, score double, fixed boolean")
    df = frame(spark, edges, at).join(extra, "eid").withColumn("length", F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    got = {r.eid for r in planar.clean(df, "length", "score", 9000.0, 80.0, 250.0, "fixed").collect()}
    want = cleaned(edges, at, fixed, score, 9000.0, 80.0, 250.0)
    assert got == want and 10 < len(got) < len(edges) - 10


@pytest.mark.parametrize("edges", [[(1, 1, 2), (2, 2, 3), (3, 3, 1)], [(5, 1, 2), (3, 3, 2), (9, 3, 4), (4, 2, 7), (6, 8, 8)], None])
def test_routes(spark, edges):
    edges = edges or [(e, a, b) for e, a, b in lattice(8, 40, 30, 0.8)[0]]
    got = collections.defaultdict(dict)
    for r in paths.routes(spark.createDataFrame(edges, "eid long, src long, dst long")).collect():
        got[r.trail][r.place] = (r.eid, r.turned)
    by = {e: (a, b) for e, a, b in edges}
    assert sorted(e for t in got.values() for e, _ in t.values()) == sorted(by)
    degree, opened = collections.Counter(n for _, a, b in edges for n in (a, b)), 0
    for name, t in got.items():
        walk = [by[e][::-1] if turned else by[e] for e, turned in (t[k] for k in range(len(t)))]
        assert name == min(e for e, _ in t.values()) and all(a[1] == b[0] for a, b in zip(walk, walk[1:]))
        opened += walk[0][0] != walk[-1][1]
    assert opened == sum(d % 2 for d in degree.values()) / 2


def raster(spark, **arrays):
    iy, ix = np.indices(next(iter(arrays.values())).shape)
    return spark.createDataFrame(pd.DataFrame({"ix": ix.ravel(), "iy": iy.ravel()} | {k: v.ravel() for k, v in arrays.items()}))


def array_of(df, shape, column):
    got, out = df.toPandas(), np.full(shape, np.nan)
    out[got.iy, got.ix] = got[column]
    return out


def searched(start, shape, through):
    """Least values over ways from the start cells, by a queue."""
    best = np.full(shape, np.inf)
    queue = [(v, c) for c, v in start.items()]
    for v, c in queue:
        best[c] = v
    heapq.heapify(queue)
    while queue:
        v, (y, x) = heapq.heappop(queue)
        if v == best[y, x]:
            for p in range(max(0, y - 1), min(shape[0], y + 2)):
                for q in range(max(0, x - 1), min(shape[1], x + 2)):
                    n = through(v, (y, x), (p, q))
                    if n < best[p, q]:
                        best[p, q] = n
                        heapq.heappush(queue, (n, (p, q)))
    return best


@pytest.mark.parametrize("seed, shape, side", [(0, (20, 26), 7), (1, (33, 18), 16)])
def test_flood_and_breach(spark, seed, shape, side):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 9, shape).astype(float) if seed == 0 else rng.random(shape) * 8
    wet = rng.random(shape) < 0.01
    rim = wet.copy()
    rim[[0, -1], :] = rim[:, [0, -1]] = True
    df = raster(spark, v=z, wet=wet)
    want = searched({c: z[c] for c in zip(*np.nonzero(rim))}, shape, lambda v, a, b: max(v, z[b]))
    assert np.array_equal(array_of(terrain.flooded(df, "v", "f", F.col("wet"), side), shape, "f"), want)
    most, step = 2.0, 0.002
    b = array_of(terrain.breached(df, "v", most, step, F.col("wet"), side), shape, "z")
    p = np.pad(b, 1, constant_values=np.inf)
    lowest = np.min([p[1 + dy : 1 + dy + shape[0], 1 + dx : 1 + dx + shape[1]] for dx, dy in terrain.AROUND], axis=0)
    assert (lowest[~rim] <= b[~rim] - step + 1e-9).all() and (z - b).max() <= most and np.array_equal(b[wet], z[wet])
    assert (b < z).any() and (b > z + 0.5).sum() < (want > z + 0.5).sum()  # rims are cut, so less is filled


def test_least_cost_paths(spark):
    shape, rng = (40, 31), np.random.default_rng(3)
    cost = rng.random(shape) ** 4 * 20 + 0.05
    cost[10, :-2] = cost[20, 2:] = cost[30, :-2] = 400.0  # walls that make the way long
    a, b = (0, 0), (39, 2)
    want = searched({a: 0.0}, shape, lambda v, p, q: v + math.hypot(p[0] - q[0], p[1] - q[1]) * (cost[p] + cost[q]) / 2)
    at = lambda c: spark.createDataFrame([(c[1], c[0])], "ix long, iy long")
    ways = paths.Ways(raster(spark, cost=cost), at(a), at(b), 8)
    assert np.allclose(array_of(ways.costs(), shape, "d"), want, rtol=1e-12)
    path = sorted((r.d, r.iy, r.ix) for r in ways.path().collect())
    assert path[0] == (0.0, *a) and path[-1][1:] == b and math.isclose(path[-1][0], want[b], rel_tol=1e-12)
    assert all(max(abs(p[1] - q[1]), abs(p[2] - q[2])) == 1 for p, q in zip(path, path[1:])) and len(path) > 80
    assert all(math.isclose(q[0] - p[0], math.hypot(p[1] - q[1], p[2] - q[2]) * (cost[p[1:]] + cost[q[1:]]) / 2, rel_tol=1e-6, abs_tol=1e-9) for p, q in zip(path, path[1:]))


def test_heights_keep_limits_and_pins(spark):
    from terravane.operators import heights

    rng = random.Random(12)
    edges = [(a, b, rng.uniform(0.5, 4.0)) for _, a, b in lattice(9, 9, 8, 0.8)[0]]
    z = {n: rng.uniform(0, 30) for n in range(80)}
    way = {(a, b): min(w for p, q, w in edges if {p, q} == {a, b}) for a, b, _ in edges}
    d = np.full((80, 80), np.inf)
    np.fill_diagonal(d, 0)
    for (a, b), w in way.items():
        d[a, b] = d[b, a] = min(w, d[a, b])
    for k in range(80):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    pins = {}
    for n in rng.sample(range(72), 30):  # heights that don't contradict those before
        lo = max((v - d[n, p] for p, v in pins.items()), default=-np.inf)
        hi = min((v + d[n, p] for p, v in pins.items()), default=np.inf)
        pins[n] = float(min(max(z[n], lo), hi))
    z |= pins
    nodes = spark.createDataFrame([(n, v, n in pins) for n, v in z.items()], "node long, z double, pinned boolean")
    got = {r.node: r.z for r in heights.relaxed(nodes, spark.createDataFrame(edges, "src long, dst long, limit double")).collect()}
    assert set(got) == set(z) and all(math.isclose(got[n], v, abs_tol=1e-9) for n, v in pins.items())
    assert all(abs(got[a] - got[b]) <= w + 1e-9 for a, b, w in edges) and sum(abs(got[n] - z[n]) > 0.1 for n in z) > 10
    hi = np.array([min([z[n]] + [v + d[n, p] for p, v in pins.items()]) for n in range(80)])
    c = np.maximum(hi, [max([-np.inf] + [v - d[n, p] for p, v in pins.items()]) for n in range(80)])
    want = ((c[:, None] + d).min(0) + (c[:, None] - d).max(0)) / 2
    assert all(math.isclose(got[n], want[n], abs_tol=1e-9) for n in got)
    bad = spark.createDataFrame([(1, 0.0, True), (2, 9.0, True)], "node long, z double, pinned boolean")
    with pytest.raises(ValueError):
        heights.relaxed(bad, spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, limit double"))


@pytest.mark.parametrize("share, side", [(0.05, 16), (0.002, 20)])
def test_harmonic_fill_over_tiles(spark, share, side):
    from terravane.operators import fill, kernels

    rng, shape = np.random.default_rng(5), (44, 50)
    z, known = rng.random(shape) * 100, rng.random(shape) < share
    known[0, 0] = known[-1, -1] = True
    got = array_of(fill.harmonic(raster(spark, v=z, known=known), "v", "known", "z", 1e-7, side), shape, "z")
    assert np.array_equal(got[known], z[known]) and np.abs(got - kernels.harmonic_fill(z, known)).max() < 1e-3
    p, n = np.pad(got, 1), np.pad(np.ones(shape), 1)
    around = lambda a: a[:-2, 1:-1] + a[2:, 1:-1] + a[1:-1, :-2] + a[1:-1, 2:]
    assert np.abs(around(p) - around(n) * got)[~known].max() <= 1e-7 + 1e-12


def test_skeletons_over_tiles(spark):
    from terravane.operators import contours

    rng = np.random.default_rng(6)
    mask = np.kron(rng.random((9, 8)) < 0.6, np.ones((5, 6))) > 0
    whole = mask
    while True:
        after = contours._thinned(whole, 2).astype(bool)
        if np.array_equal(after, whole):
            break
        whole = after
    got = np.zeros(mask.shape, bool)
    found = contours.skeleton(raster(spark, m=mask).where("m"), 9, 4)
    for r in found.collect():
        got[r.iy, r.ix] = True
    assert np.array_equal(got, whole) and 0 < got.sum() < mask.sum()
    nodes, edges = contours.skeleton_graph(found)
    n, e = nodes.collect(), edges.collect()
    assert sum(r.cells for r in n) + sum(r.cells for r in e) == got.sum()
    ids = {r.node for r in n}
    assert all(r.a in ids and r.b in ids for r in e if r.a is not None) and len(e) > 5


def test_outlines_and_simplification(spark):
    from terravane.operators import contours

    mask = np.zeros((30, 40), bool)
    mask[3:27, 3:37] = True
    mask[8:20, 8:30] = False  # a hole with an island, and cells that touch at a corner
    mask[12:15, 12:16] = True
    mask[27, 37] = True
    rows = contours.polygons(raster(spark, m=mask).where("m"), 40).collect()
    rings = {}
    for r in rows:
        rings.setdefault((r.ring, r.region, r.hole), []).append((r.place, r.x, r.y))
    areas = {}
    for k, v in rings.items():
        p = [x[1:] for x in sorted(v)]
        areas[k] = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2
    big = 3 * 40 + 3
    assert sorted(areas.values()) == [-264.0, 1.0, 12.0, 816.0]
    assert {k[1] for k, a in areas.items() if a in (-264.0, 816.0)} == {big} and all(k[2] == (a < 0) for k, a in areas.items())
    assert all(len(v) == 4 for v in rings.values())
    assert {r.region for r in contours.polygons(raster(spark, m=mask).where("m"), 40, 15.0).collect()} == {big}
    iy, ix = np.indices((60, 60))
    disc = np.hypot(ix - 30, iy - 30) < 25
    full = contours.polygons(raster(spark, m=disc).where("m"), 60)
    few = [(r.place, r.x, r.y) for r in contours.simplified(full, 1.5).collect()]
    p = [x[1:] for x in sorted(few)]
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2
    assert 4 <= len(few) < full.count() / 3 and abs(area - disc.sum()) < 0.05 * disc.sum()


def test_lots_keep_off_streets_and_each_other(spark):
    from terravane.operators import placement

    edges, at = lattice(3, 5, 5, 0.9)
    df = frame(spark, edges, at)
    got = placement.frontage(df.select("eid", "x0", "y0", "x1", "y1"), 16.0, 4.0, 3.0).collect()
    every = placement.lots(df, 16.0, 4.0, 3.0).collect()

    def corners(r):
        u, v = (math.cos(r.angle), math.sin(r.angle)), (-math.sin(r.angle), math.cos(r.angle))
        return [(r.x + a * r.w / 2 * u[0] + b * r.d / 2 * v[0], r.y + a * r.w / 2 * u[1] + b * r.d / 2 * v[1]) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]

    def apart(p, q):
        for ring in (p, q):
            for k in range(4):
                n = (ring[k][1] - ring[k - 1][1], ring[k - 1][0] - ring[k][0])
                a, b = ([x * n[0] + y * n[1] for x, y in s] for s in (p, q))
                if max(a) <= min(b) + 1e-9 or max(b) <= min(a) + 1e-9:
                    return True
        return False

    def off(r):
        def dist(a, b):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = min(1, max(0, ((r.x - a[0]) * dx + (r.y - a[1]) * dy) / (dx * dx + dy * dy)))
            return math.hypot(r.x - a[0] - t * dx, r.y - a[1] - t * dy)

        return all(e == r.eid or dist(at[a], at[b]) >= 4 + math.hypot(r.w, r.d) / 2 for e, a, b in edges)

    want = []
    for r in sorted((r for r in every if off(r)), key=lambda r: (r.k, r.id)):
        if all(apart(corners(r), corners(q)) for q in want):
            want.append(r)
    assert sorted(r.id for r in got) == sorted(r.id for r in want) and 20 < len(got) < len(every)
