"""What the findings of the fourth round asked for: the same results from fewer rows moved, tested and written."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def _events(spark, at, rows):
    """A folder with events only, of (id, user, kind)."""
    t = pd.DataFrame(rows, columns=["event_id", "user_id", "event_type"])
    spark.createDataFrame(t).withColumns({"ts": F.timestamp_seconds("event_id"), "value": F.col("event_id").cast("double")}).write.parquet(f"{at}/events.parquet")
    return str(at)


def _same_as_sql(spark, at, name):
    """The query's rows on a folder of events, equal to its SQL's."""
    import duckdb

    import __spark_entry__ as entry
    from conftest import rows

    c = duckdb.connect()
    c.execute(f"create view events as select * from '{at}/events.parquet/*.parquet'")
    for n, columns in (("nation", "1 as n_nationkey, 'x' as n_name"), ("orders", "1 as o_orderkey, 1 as o_custkey"), ("lineitem", "1 as l_orderkey, 1 as l_partkey, 1 as l_suppkey, 1 as l_linenumber, 1.0 as l_quantity")):
        c.execute(f"create view {n} as select {columns}")
    got = entry.queries()[name](spark, at).toPandas()
    assert rows(got) == rows(c.execute(entry.oracle_sql()[name]).df())
    return got


def _crowded(ids, wide):
    """Events whose places lie in a square so wide."""
    users = np.arange(20000)
    for n, i in enumerate(ids):
        near = ((i * 7919 + users * 104729) % 2000 < wide) & ((i * 6101 + users * 15485863) % 667 < wide)
        yield int(i), int(users[near][n % near.sum()]), ("click", "click", "view")[n % 3]


def test_parallel_ramps_are_no_error(spark, tmp_path):
    """lines 1517 apart by number are parallel, and may lie side by side."""
    made = list(_crowded([*range(1, 60), *range(1518, 1560)], 60))
    assert len(_same_as_sql(spark, _events(spark, tmp_path, made), "q07_ramp_conflict")) > 0


def test_points_of_one_place_are_compared_once(spark, monkeypatch):
    """Pairs are looked for between places, each with its points."""
    from terravane.operators import spatial

    seen = []
    real = spatial._once
    monkeypatch.setattr(spatial, "_once", lambda df, **c: seen.append(df.count()) or real(df, **c))
    a = spark.range(900).selectExpr("id", "id % 3 * 100 as x", "0L as y")
    b = spark.range(600).selectExpr("id as other", "id % 3 * 100 + 3 as x", "4L as y")
    got = [tuple(r) for r in spatial.all_within(a, b, 5.0).collect()]
    assert sorted(got) == [(i, k) for i in range(900) for k in range(600) if i % 3 == k % 3]
    lines = spark.createDataFrame([(7, 0, 1, 50, 1), (8, 90, 2, 210, 2)], "sid long, x0 long, y0 long, x1 long, y1 long")
    near = spatial.all_near_segments(a, lines, 4.0, 40.0, F.col("t") < 0.9, t=F.round("t", 3), dist=F.col("dist"))
    want = [(i, 7, 0.0, 1.0) for i in range(0, 900, 3)] + [(i, 8, 0.083, 2.0) for i in range(1, 900, 3)]
    assert sorted(tuple(r) for r in near.collect()) == sorted(want)
    assert sum(seen) < 60


def test_only_edges_that_meet_are_cut(spark, monkeypatch):
    """pairs are judged step by step, and those that don't meet go before any point is made."""
    from terravane.operators import overlay

    kept = []
    real = overlay.cut
    monkeypatch.setattr(overlay, "cut", lambda df: kept.append(df.count()) or real(df) if "on_a" in df.columns else real(df))
    e = spark.createDataFrame([(0, k, 0, float(a), float(b), float(c), float(d)) for k, (a, b, c, d) in enumerate([(0, 0, 10, 10), (1, 0, 11, 10), (0, 8, 8, 0), (0, 9, 1, 10), (20, 20, 20, 30)])], "layer int, shape long, eid long, x0 double, y0 double, x1 double, y1 double")
    got = sorted((r["shape"], r.x0, r.y0, r.x1, r.y1) for r in overlay._pieces(e, 60.0).collect())
    assert kept == [2] and got == [(0, 0, 0, 4, 4), (0, 4, 4, 10, 10), (1, 1, 0, 4.5, 3.5), (1, 4.5, 3.5, 11, 10), (2, 0, 8, 4, 4), (2, 4, 4, 4.5, 3.5), (2, 4.5, 3.5, 8, 0), (3, 0, 9, 1, 10), (4, 20, 20, 20, 30)]


def test_shares_are_rounded_where_they_are_made(spark):
    """no rounding of all rows by Spark after the tiles; segments within a tile and wider ones are rounded alike."""
    from terravane.operators import spatial

    rows = [(1, 0, 0, 9, 9), (2, 0, 7, 9, 0), (3, 0, 3, 70, 4)]
    got = spatial.noded(spark.createDataFrame(rows, "sid long, x0 long, y0 long, x1 long, y1 long"), 20.0, 1, digits=3)
    assert "round" not in got.limit(0)._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]
    assert sorted(tuple(r) for r in got.where("sid < 3").collect()) == [(1, 1, 0.0, 0.338), (1, 2, 0.338, 0.438), (1, 3, 0.438, 1.0), (2, 1, 0.0, 0.438), (2, 2, 0.438, 0.561), (2, 3, 0.561, 1.0)]
