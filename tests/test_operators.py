"""Rules with one planted violation and one clean case, ties, nulls, empty inputs, and properties of kernels."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terravane.functions import scalar as S
from terravane.operators import aggregate, graph, kernels, placement, pointers, raster, rules, sequence, spatial, terrain
from terravane.sources import files


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_point_on_a_border_is_in_one_of_two_neighbours(spark):
    z = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 10, 0, 20, 10)], "zid long, x0 long, y0 long, x1 long, y1 long").withColumn("ring", spatial.rectangle_ring("x0", "y0", "x1", "y1"))
    p = spark.createDataFrame([(1, 10, 5), (2, 0, 0), (3, 20, 5), (4, 5, 5)], "id long, x long, y long")
    assert values(spatial.first_zone(p, z), "id", "zid") == [(1, 2), (2, 1), (3, None), (4, 1)]


def test_hole_of_a_polygon(spark):
    ring = lambda lo, hi: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((lo, lo), (hi, lo), (hi, hi), (lo, hi))])
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 5.0), (11.0, 1.0)], "x double, y double").withColumn("rings", F.array(ring(0, 10), ring(4, 6)))
    assert [r[0] for r in df.select(spatial.in_polygon(F.col("x"), F.col("y"), F.col("rings"))).collect()] == [True, False, False]


def test_within_finds_each_pair_once_whatever_the_cell(spark):
    rng = np.random.default_rng(1)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-50, 50, (120, 2)))]
    a = spark.createDataFrame(p, "a long, x double, y double")
    b = spark.createDataFrame(p, "b long, bx double, by double")
    want = sorted((i, j) for i, x, y in p for j, u, v in p if np.hypot(x - u, y - v) <= 9)
    for cell in (None, 5.0, 40.0):
        assert values(spatial.within(a, b, 9.0, bx="bx", by="by", cell=cell), "a", "b") == want


def test_nearest_with_ties_and_few_targets(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 1.0, 0.0), (5, -1.0, 0.0)], "t long, x double, y double")
    assert values(spatial.nearest(a, b, "id", "t", 2.0), "id", "t", "rank") == [(1, 5, 1), (2, 7, 1)]
    assert values(spatial.nearest(a, b, "id", "t", 2.0, k=3), "id", "t", "rank") == [(1, 5, 1), (1, 7, 2), (2, 5, 2), (2, 7, 1)]
    assert spatial.nearest(a, b.limit(0), "id", "t", 2.0).count() == 0


def test_segments_that_touch_do_not_cross(spark):
    s = spark.createDataFrame([(1, 0, 0, 10, 10), (2, 0, 10, 10, 0), (3, 10, 10, 20, 10)], "sid long, x0 long, y0 long, x1 long, y1 long")
    x = spatial.crossings(s, s, 8.0).where("a_sid < b_sid")
    assert values(x, "a_sid", "b_sid", "px", "py") == [(1, 2, 5.0, 5.0)]


def test_components_of_a_long_path_and_a_loop(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 501), (900, 900)], "src long, dst long")
    got = dict(values(graph.components(e), "node", "component"))
    assert got == {**{i: 0 for i in range(101)}, 500: 500, 501: 500, 900: 900}
    assert graph.components(e.limit(0)).count() == 0


def test_asof_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 5.0), ("b", 9.0)], "k string, t double")
    right = spark.createDataFrame([("a", 2.0, 1), ("a", 5.0, 2)], "k string, t double, v long")
    assert values(sequence.asof(left, right, "k", "t", ["v"]), "k", "t", "v") == [("a", 1.0, None), ("a", 5.0, 2), ("b", 9.0, None)]


def test_runs_and_merging(spark):
    df = spark.createDataFrame([(1, i, b) for i, b in enumerate([1, 1, 0, 1, 1, 1, 0, 0])], "user_id long, seq long, b long")
    assert values(sequence.runs(df, F.col("b") == 1, least=3), "first", "last", "n") == [(3, 5, 3)]
    iv = spark.createDataFrame([(1, 0, 5), (1, 4, 6), (1, 9, 10), (1, 20, 21)], "user_id long, s0 long, s1 long")
    assert values(sequence.merge_intervals(iv, "s0", "s1", 3), "s0", "s1", "n") == [(0, 10, 3), (20, 21, 1)]


def test_majority_ties_go_to_the_smallest(spark):
    df = spark.createDataFrame([(1, 3), (1, 2), (1, 3), (1, 2), (2, 9)], "k long, c long")
    assert values(aggregate.majority(df, ["k"], "c"), "k", "majority") == [(1, 2), (2, 9)]


def test_registry_gives_each_identity_once_and_to_the_nearest(spark):
    old = spark.createDataFrame([(1, 0.0, 0.0, 10.0), (2, 1.0, 0.0, 10.0)], "id long, x double, y double, len double")
    new = spark.createDataFrame([(11, 0.9, 0.0, 10.0), (12, 0.4, 0.0, 10.0), (13, 0.0, 0.0, 30.0)], "id long, x double, y double, len double")
    assert values(spatial.match_registry(old, new, 2.0), "new_id", "old_id") == [(11, 2), (12, 1)]


def test_spaced_selection_equals_one_by_one(spark):
    rng = np.random.default_rng(3)
    p = [(i, int(s), float(x), float(y)) for i, (s, x, y) in enumerate(zip(rng.integers(0, 9, 150), rng.uniform(0, 100, 150), rng.uniform(0, 100, 150)))]
    want = []
    for k, s, x, y in sorted(p, key=lambda r: (-r[1], r[0])):
        if all(np.hypot(x - a, y - b) > 12 for _, a, b in want):
            want.append((k, x, y))
    got = placement.spaced(spark.createDataFrame(p, "k long, s long, x double, y double"), "k", "s", 12.0)
    assert values(got, "k") == sorted((k,) for k, _, _ in want)


def test_pit_filling_and_flow(spark):
    z = np.full((5, 5), 9)
    z[2, 2], z[0, 2], z[1, 2] = 1, 3, 5
    cells = spark.createDataFrame([(x, y, int(z[y, x])) for y in range(5) for x in range(5)], "ix long, iy long, v long")
    filled = {(r.ix, r.iy): r.filled for r in terrain.flooded(cells, "v").collect()}
    assert filled[2, 2] == 5 and filled[2, 1] == 5 and filled[1, 1] == 9
    area = {(r.ix, r.iy): r.area for r in raster.accumulate(raster.receivers(cells, "v")).collect()}
    assert sum(area.values()) >= 25 and area[2, 2] > 1


def test_flow_along_a_long_way_in_few_rounds(spark):
    flow = spark.createDataFrame([(i, 0, i + 1 if i < 99 else None, 0 if i < 99 else None) for i in range(100)] + [(5, 1, 5, 0), (6, 1, 5, 0), (50, 1, None, None)], "ix long, iy long, rx long, ry long")
    area = {(r.ix, r.iy): r.area for r in raster.accumulate(flow, 8).collect()}
    assert area == {(i, 0): i + 1 + 2 * (i >= 5) for i in range(100)} | {(5, 1): 1, (6, 1): 1, (50, 1): 1}


def test_rules_report_planted_violations_only(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 50.0)], "id long, grade double")
    found = rules.issues(df, "grade", "error", "id", F.lit("too steep"), where="grade > 10")
    assert values(found, "kind", "ref") == [("grade", "2")]
    assert values(rules.summary(rules.report(found, found)), "kind", "n") == [("grade", 2)]
    with pytest.raises(Exception, match="errors: 1"):
        rules.strict(found).collect()
    assert rules.strict(found.limit(0)).first().errors == 0
    assert rules.gate(found).first().exit_code == 1 and tuple(rules.gate(found.limit(0)).first()) == (0, 0)


def test_duplicate_keys_fail(spark):
    df = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    with pytest.raises(Exception, match="duplicate key 2"):
        rules.unique(df, "k").collect()
    assert rules.unique(df.distinct(), "k").count() == 2


def test_degenerate_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    r = df.select(S.crossing_angle(F.col("x"), F.col("y"), F.lit(1.0), F.lit(0.0)).alias("a"), spatial.project("x", "y", F.lit(3.0), F.lit(4.0), F.lit(3.0), F.lit(4.0))[1].alias("d")).first()
    assert r.a is None and r.d == 5.0


def test_raw_raster(spark, tmp_path):
    np.arange(12, dtype="<f4").tofile(tmp_path / "a.bin")
    got = values(files.read_raw_raster(spark, f"file://{tmp_path}/a.bin", 4), "iy", "ix", "v")
    assert got == [(i // 4, i % 4, float(i)) for i in range(12)]


def test_stream_drops_what_is_too_late(spark, tmp_path):
    from terravane.streaming.windows import counts

    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-05 00:00:00", "a"), ("2024-01-01 00:20:00", "a")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, event_type string").write.json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("ts string, event_type string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = counts(stream).writeStream.outputMode("append").format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination()
    assert values(spark.table("late"), "n") == [(1,)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=4, max_size=30), st.floats(0.5, 5))
def test_profile_kernels(z, g):
    z = np.array(z)
    d, p = np.diff(np.eye(len(z)), 2, axis=0), 3.0 + np.arange(len(z)) % 4
    assert np.allclose(kernels.whittaker(z, p), np.linalg.solve(np.eye(len(z)) + d.T @ (p[1:-1, None] * d), z))
    x = np.arange(len(z), dtype=float)
    keep = kernels.simplify(x, z, 1.0)
    assert keep[0] == 0 and keep[-1] == len(z) - 1
    assert np.allclose(kernels.monotone_cubic(x, z, x), z)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.1, 9), st.floats(0.1, 9)), min_size=1, max_size=12), st.floats(0, 60))
def test_allocation_keeps_totals_and_caps(pairs, total):
    weight, cap = np.array(pairs).T
    out = kernels.allocate(total, weight, cap)
    assert (out <= cap + 1e-6).all() and abs(out.sum() - min(total, cap.sum())) < 0.05 * max(1, total)


def test_search_and_fill_kernels():
    known = np.zeros((4, 4), bool)
    known[:, [0, 3]] = True
    z = np.tile([0.0, 0, 0, 3.0], (4, 1))
    assert np.allclose(kernels.harmonic_fill(z, known)[1], [0, 1, 2, 3])
    w, h, _ = kernels.least_rectangle(np.array([[0, 0], [4, 0], [4, 2], [0, 2], [1, 1.0]]))
    assert sorted((round(w, 6), round(h, 6))) == [2.0, 4.0]


def test_nearest_reaches_any_distance(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 50_000.0, 10.0), (3, -3e6, 4e6)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 0.0, 1.0), (8, 0.0, 1.0)], "oid long, x double, y double")
    assert values(spatial.nearest(a, b, "id", "oid", 5.0), "id", "oid", "rank") == [(1, 7, 1), (2, 7, 1), (3, 7, 1)]
    assert values(spatial.nearest(a, b, "id", "oid", 5.0, 3), "id", "oid", "rank") == [(i, 6 + k, k) for i in (1, 2, 3) for k in (1, 2)]
    assert spatial.nearest(a, b.limit(0), "id", "oid", 5.0).count() == 0


def test_unfinished_loops_fail(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError):
        graph.components(e, rounds=1)
    flow = spark.createDataFrame([(0, 0, 1, 0), (1, 0, 2, 0), (2, 0, None, None)], "ix long, iy long, rx long, ry long")
    with pytest.raises(RuntimeError):
        raster.accumulate(flow, 1)
    with pytest.raises(RuntimeError):
        pointers.follow(spark.createDataFrame([(i, i + 1 if i < 39 else None) for i in range(40)], "node long, next long"), 3)
    line = spark.createDataFrame([(i, float(i), float(i), 0.0) for i in range(9)], "id long, s double, x double, y double")
    with pytest.raises(RuntimeError):
        placement.spaced(line, "id", "s", 1.5, 1)


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 9), st.integers(2, 9), st.integers(0, 10**6))
def test_harmonic_fill_is_the_mean_of_neighbours(h, w, seed):
    rng = np.random.default_rng(seed)
    z, known = rng.random((h, w)) * 100, rng.random((h, w)) < 0.3
    known[0, 0] = True
    out = kernels.harmonic_fill(z, known)
    assert (out[known] == z[known]).all()
    for y, x in zip(*np.nonzero(~known)):
        near = [out[b, a] for b, a in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= b < h and 0 <= a < w]
        assert abs(out[y, x] - np.mean(near)) < 1e-5


def test_pinned_profiles_keep_grade_floor_and_pins(spark):
    rng = np.random.default_rng(2)
    z, floor = rng.random(60) * 50, rng.random(60) * 20
    pins = {0: 10.0, 30: 25.0, 59: 5.0}
    rows = [(1, i, pins.get(i, float(z[i])), float(floor[i]) if min(abs(i - p) for p in pins) > 8 else -5.0, i in pins) for i in range(60)]
    df = spark.createDataFrame(rows, "user_id long, seq long, z double, floor double, pinned boolean")
    got = sorted((r.seq, r.out, r.floor) for r in sequence.pinned_profile(df, "z", "floor", "pinned", "seq", 3.0, "out").collect())
    out = np.array([g[1] for g in got])
    assert np.abs(np.diff(out)).max() <= 3 + 1e-9 and all(abs(out[p] - v) < 1e-9 for p, v in pins.items())
    assert (out >= np.array([g[2] for g in got]) - 1e-9).all()


def test_erosion_is_that_of_one_array(spark):
    z = np.random.default_rng(4).integers(0, 60, (9, 11)).astype(float)
    cells = spark.createDataFrame([(x, y, float(z[y, x])) for y in range(9) for x in range(11)], "ix long, iy long, v double")
    want = z.copy()
    for _ in range(2):
        to, fall = {}, {}
        for y in range(9):
            for x in range(11):
                near = [(want[y, x] - want[b, a], k, (b, a)) for k, (b, a) in enumerate(((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1))) if 0 <= b < 9 and 0 <= a < 11]
                drop, k, at = max(near, key=lambda n: (n[0], -n[1]))
                to[y, x], fall[y, x] = (at, drop) if drop > 0 else (None, 0.0)
        area = {c: 1 for c in to}
        for c in sorted(to, key=lambda c: -want[c]):
            if to[c]:
                area[to[c]] += area[c]
        want = np.array([[want[y, x] - min(0.02 * np.sqrt(area[y, x]) * fall[y, x], 0.5 * fall[y, x]) for x in range(11)] for y in range(9)])
        for axis in (1, 0):
            d = np.diff(want, axis=axis)
            over = np.sign(d) * np.maximum(np.abs(d) - 8.0, 0) / 4
            want = want + np.pad(over, [(0, 1) if k == axis else (0, 0) for k in (0, 1)]) - np.pad(over, [(1, 0) if k == axis else (0, 0) for k in (0, 1)])
    got = {(r.iy, r.ix): r.z for r in terrain.eroded(cells, "v", 2, 0.02, 8.0).collect()}
    assert all(abs(got[y, x] - want[y, x]) < 1e-9 for y in range(9) for x in range(11))


def test_collections_are_one_text(spark, tmp_path):
    import glob
    import json

    df = spark.createDataFrame([(k, json.dumps({"type": "Feature", "k": k})) for k in range(50)], "k long, f string").repartition(5)
    files.write_collection(df, "f", "k", "all", f"{tmp_path}/c")
    text = "".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/c/part-*")))
    assert [f["k"] for f in json.loads(text)["features"]] == list(range(50))
    files.write_collection(df.limit(0), "f", "k", "all", f"{tmp_path}/d")
    assert json.loads("".join(open(p).read() for p in sorted(glob.glob(f"{tmp_path}/d/part-*"))))["features"] == []


def test_running_totals_over_ranges(spark):
    from terravane.operators.relational import running_total

    rng = np.random.default_rng(8)
    rows = [(int(k), int(v)) for k, v in zip(rng.permutation(3000), rng.integers(0, 9, 3000))]
    df = spark.createDataFrame(rows, "k long, v long").repartition(7)
    total, want = 0, {}
    for k, v in sorted(rows, reverse=True):
        want[k], total = total, total + v
    assert {r.k: r.before for r in running_total(df, [F.desc("k")], "before", F.col("v")).collect()} == want
    assert running_total(df.limit(0), [F.asc("k")], "n").count() == 0
