"""Graph operators as joins and loops over edges (src, dst)."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from .rules import first_of


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only if that is unset in local mode, as executors elsewhere wouldn't see it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/terravane-shared"
    return at.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a frame to the shared folder and reads it back, which ends its lineage and outlives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree; a loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


#: Edges that a task holds to join what they connect.
CHUNK = 1 << 20


def _least_ahead(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """nodes of edges (a, b) and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    top = np.arange(len(nodes))
    while len(a):
        high, low = np.maximum(a, b), np.minimum(a, b)
        np.minimum.at(top, high, low)
        while True:
            up = top[top]
            if (up == top).all():
                break
            top = up
        a, b = top[high], top[low]
        left = a != b
        a, b = a[left], b[left]
    return nodes, nodes[top]


def _stars(frames):
    """Of each chunk of edges (a, b) a row for each node, with the smallest node (maybe itself) that the chunk connects it with."""

    def made(held):
        nodes, low = _least_ahead(*(np.concatenate([f[c].to_numpy() for f in held]) for c in "ab"))
        return pd.DataFrame({"a": nodes, "b": low})

    held, n = [], 0
    for f in frames:
        held.append(f)
        n += len(f)
        if n >= CHUNK:
            yield made(held)
            held, n = [], 0
    if held:
        yield made(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (G01), by large-star and small-star steps, whose rounds grow with the
    logarithm of the longest path.

    Before that each task joins what its edges, a range of them by their nodes, connect, and a node keeps the smallest node that it was joined with; the steps
    take only what several tasks joined a node with, so that edges of near numbers leave them little.
    """
    kind = edges.schema["src"].dataType
    edge = cut(edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).where("a is not null and b is not null"))
    low = edge.repartitionByRange("a", "b").mapInPandas(_stars, "a long, b long")
    joined = cut(low.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("of")).select(F.col("a").alias("node"), "m", F.when(F.size("of") > 1, F.array_remove("of", F.col("m"))).alias("others")))
    between = joined.where("others is not null").select("m", F.explode("others").alias("other"))
    named = joined.select("node", "m")
    if not between.isEmpty():
        named = named.join(_settled(between.toDF("src", "dst"), rounds), "m", "left").withColumn("m", F.coalesce("component", "m"))
    return named.select(F.col("node").cast(kind).alias("node"), F.col("m").cast(kind).alias("component"))


def _settled(edges: DataFrame, rounds: int) -> DataFrame:
    """m, component of the nodes of edges, but for those that are their component's smallest."""
    now = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = now.union(now.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        now = cut(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if mark == seen:
            return now.select(F.col("a").alias("m"), F.col("b").alias("component"))
        seen = mark
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def component_lengths(edges: DataFrame, length: str) -> DataFrame:
    """component, total length, edges and rank by length, longest first."""
    c = edges.join(components(edges), F.col("src") == F.col("node")).groupBy("component").agg(F.sum(length).alias("total"), F.count("*").alias("edges"))
    from .relational import running_total

    return running_total(c, [F.desc("total"), F.asc("component")], "rank").withColumn("rank", (F.col("rank") + 1).cast("long"))


def prune_spurs(edges: DataFrame, length: str, shorter: float, rounds: int) -> DataFrame:
    """Takes away, in rounds, the edges with a dead end that are shorter than given, until none is or rounds are up."""
    now = edges
    for _ in range(rounds):
        ends = degrees(now).where("degree = 1").select("node")
        dead = now.where(F.col(length) < shorter).select("eid", F.explode(F.array("src", "dst")).alias("node")).join(ends, "node").select("eid").distinct()
        now = cut(now.join(dead, "eid", "left_anti"))
        if degrees(now).where("degree = 1").isEmpty():
            break
    return now


def merge_nodes(points: DataFrame, tolerance: float) -> DataFrame:
    """id, node: points within the tolerance of each other, and of those in turn, become the one with the smallest id.

    Points of a cell whose diagonal is less than the tolerance are one node anyway, so cells are linked, a pair once, however many points they hold.
    """
    from .spatial import within

    size = 0.7 * tolerance
    cell = {"_x": F.floor(F.col("x") / size), "_y": F.floor(F.col("y") / size)}
    placed = points.where("x is not null and y is not null").select("id", "x", "y").withColumns(cell)
    cells = cut(placed.groupBy("_x", "_y").agg(F.min("id").alias("cell")))
    places = cut(placed.select("x", "y", "_x", "_y").distinct().join(cells, ["_x", "_y"]).select("x", "y", "cell"))
    near = within(places.select(F.col("cell").alias("src"), "x", "y"), places.select(F.col("cell").alias("dst"), F.col("x").alias("bx"), F.col("y").alias("by")), tolerance, bx="bx", by="by").where("src < dst")
    named = cells.join(components(near.select("src", "dst").distinct()), F.col("cell") == F.col("node"), "left").select("_x", "_y", F.coalesce("component", "cell").alias("node"))
    return points.select("id", "x", "y").withColumns(cell).join(named, ["_x", "_y"], "left").select("id", F.coalesce("node", "id").alias("node"))


def through_chains(edges: DataFrame, attribute: str) -> DataFrame:
    """eid, chain: edges that meet at a node of degree 2 and share the attribute belong to one chain, named by its smallest edge."""
    ends = edges.select("eid", attribute, F.explode(F.array("src", "dst")).alias("node"))
    pairs = ends.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct(attribute).alias("kinds"), F.min("eid").alias("src"), F.max("eid").alias("dst")).where("n = 2 and kinds = 1 and src <> dst")
    return edges.select("eid").join(components(pairs.select("src", "dst")), F.col("eid") == F.col("node"), "left").select("eid", F.coalesce("component", "eid").alias("chain"))


def junction_kind(legs: DataFrame, separated: tuple[str, ...] = ("freeway",)) -> DataFrame:
    """node, degree and kind from legs (node, leg, bearing, type, urban), by the table of kinds."""
    from .sequence import circular_gaps

    seen = circular_gaps(legs, "node", "bearing").groupBy("node").agg(
        F.count("*").alias("degree"), F.min("gap").alias("lo"), F.max("gap").alias("hi"), F.bool_or(F.abs(F.col("gap") - 180) < 25).alias("straight"), F.bool_and(F.abs(F.col("gap") - 90) < 30).alias("square"),
        F.bool_or("urban").alias("urban"), F.bool_or(F.col("type").isin(*separated)).alias("separated"),
    )
    named = seen.withColumn("kind", first_of(fixed.JUNCTION_KINDS))
    choice = F.col("kind")
    for name, (town, square, other) in fixed.KIND_CHOICES.items():
        choice = F.when(F.col("kind") == name, F.when(F.col("urban"), town).when(F.col("square"), square).otherwise(other)).otherwise(choice)
    return named.select("node", "degree", choice.alias("kind"))


def traffic_control(legs: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Adds rank, major and control to legs (node, leg, type, rank, dense, outbound) by the table of controls.

    dense counts for a junction if it does for one of its legs; outbound legs are one-way away from the node; signals lists nodes.
    """
    by = Window.partitionBy("node")
    known = legs.withColumns({"rank": F.when(F.col("type") == "ramp", fixed.RAMP_RANK).otherwise(F.col("rank")), "legs": F.count("*").over(by), "big": F.count_if(F.col("type").isin(*fixed.BIG_TYPES)).over(by), "dense": F.max("dense").over(by)})
    # the highest rank of the other legs is the node's highest, or its second for the leg that has it
    place = F.row_number().over(by.orderBy(F.desc("rank"), "leg"))
    known = known.withColumn("_place", place).withColumn("_top", F.max("rank").over(by)).withColumn("_next", F.max(F.when(F.col("_place") > 1, F.col("rank"))).over(by))
    known = known.withColumn("major", F.coalesce(F.when(F.col("_place") == 1, F.col("_next")).otherwise(F.col("_top")), F.lit(0.0)))
    lit = known.withColumn("signals", F.lit(False)) if signals is None else known.join(signals.select("node", F.lit(True).alias("signals")).distinct(), "node", "left").withColumn("signals", F.coalesce("signals", F.lit(False)))
    return lit.withColumn("control", first_of(fixed.CONTROLS)).drop("_place", "_top", "_next", "legs", "big", "signals")
