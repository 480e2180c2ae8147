"""Heights of a graph's nodes under limits on the difference along each edge."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut


#: Nodes of near numbers that a task holds with their edges.
BLOCK = 1 << 18


def _block(node: str, size: int, blocks: int) -> Column:
    return F.pmod(F.floor(F.col(node) / size), F.lit(blocks)).alias("_b")


def _settle(bound: float | None, rounds: int, first: bool):
    """A kernel on the edges out of a block's nodes and its rows (node, c, came): settles the block's own nodes. Gives their values and, for nodes of other
    blocks (there), what they can be reached with from nodes that became lower."""

    def run(edges: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        came = rows.came.to_numpy(bool)
        nodes, at = np.unique(rows.node.to_numpy("int64"), return_inverse=True)
        given, own = rows.c.to_numpy(float, na_value=np.inf), np.full(len(nodes), np.inf)
        np.minimum.at(own, at[~came], given[~came])
        held = np.zeros(len(nodes), bool)
        held[at[~came]] = True
        src, dst, w = edges.src.to_numpy("int64"), edges.dst.to_numpy("int64"), edges.limit.to_numpy(float)
        inside = edges._own.to_numpy(bool)
        # nodes without a value stand in edges only
        every = np.unique(np.concatenate([nodes, src, dst[inside]]))
        c = np.full(len(every), np.inf)
        c[np.searchsorted(every, nodes)] = own
        before = c.copy()
        np.minimum.at(c, np.searchsorted(every, nodes[at[came]]), given[came])
        sent = np.isfinite(c) if first else c < before
        i, j = np.searchsorted(every, src), np.searchsorted(every, np.where(inside, dst, src))
        moved = sent.copy()
        for _ in range(rounds):
            use = inside & sent[i]
            if not use.any():
                break
            there, to = c[i[use]] + w[use], j[use]
            if bound is not None:
                there, to = there[there < bound], to[there < bound]
            was = c.copy()
            np.minimum.at(c, to, there)
            sent = c < was
            moved |= sent
        else:
            raise RuntimeError(f"heights have not settled in {rounds} rounds")
        out = ~inside & moved[i]
        there, to = c[i[out]] + w[out], dst[out]
        if bound is not None:
            there, to = there[there < bound], to[there < bound]
        known = np.isfinite(c)
        known[np.searchsorted(every, nodes[held])] = True
        values = pd.DataFrame({"node": every[known], "c": c[known], "came": False})
        return pd.concat([values, pd.DataFrame({"node": to, "c": there, "came": True})], ignore_index=True).astype({"node": "int64", "c": "float64", "came": "bool"})

    return run


def envelope(values: DataFrame, edges: DataFrame, bound: float | None = None, rounds: int = 10_000) -> DataFrame:
    """node, c: for each node the least c(u) + way(u, node) over all nodes u, ways along edges (src, dst, limit) in both directions.

    Blocks of nodes with near numbers are settled by themselves, in rounds: only what leads to another block and became lower is sent on to the next, and
    nothing that isn't below the bound. So rounds grow with the blocks that a way leads through, not with its edges.
    """
    return _envelope(values, _by_blocks(edges, values.count()), bound, rounds)


def _by_blocks(edges: DataFrame, n: int) -> tuple[DataFrame, int, int]:
    """Edges in both directions with whether they stay in a block, for about n nodes; the nodes of a block; the number of blocks."""
    size = min(BLOCK, max(n // 32, 4096))
    blocks = n // size + 1
    both = edges.select("src", "dst", F.col("limit").cast("double").alias("limit")).union(edges.select("dst", "src", F.col("limit").cast("double"))).where("src is not null and dst is not null and limit is not null")
    both = both.select("src", "dst", "limit", (_block("src", size, blocks) == _block("dst", size, blocks)).alias("_own"))
    return cut(both.groupBy("src", "dst", "_own").agg(F.min("limit").alias("limit")).select("src", "dst", "limit", "_own")), size, blocks


def _envelope(values: DataFrame, by_blocks: tuple[DataFrame, int, int], bound: float | None = None, rounds: int = 10_000) -> DataFrame:
    both, size, blocks = by_blocks
    rows = values.select("node", F.col("c").cast("double").alias("c"), F.lit(False).alias("came")).where("node is not null")
    for k in range(rounds):
        run = _settle(bound, rounds, k == 0)
        done = cut(both.groupBy(_block("src", size, blocks)).cogroup(rows.groupBy(_block("node", size, blocks))).applyInPandas(run, "node long, c double, came boolean"))
        now = done.where("not came").select("node", F.when(F.col("c") < math.inf, F.col("c")).alias("c"))
        came = done.where("came").groupBy("node").agg(F.min("c").alias("c")).join(now.withColumnRenamed("c", "_c"), "node", "left").where("_c is null or c < _c")
        came = cut(came.select("node", "c", F.lit(True).alias("came")))
        if came.isEmpty():
            return now
        rows = now.withColumn("came", F.lit(False)).union(came)
    raise RuntimeError(f"heights have not settled in {rounds} rounds")


def relaxed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, z: heights near those of nodes (node, z, pinned) such that no edge (src, dst, limit) climbs more than its limit and pinned nodes stay.

    Free nodes are put between what the pinned ones allow; z is the mean of the highest heights below these and the lowest above that keep the limits, each of which
    does. Pinned nodes that contradict each other can't be met; they fail.
    """
    top, low = nodes.agg(F.max("z"), F.min("z")).first()
    if top is None:
        return nodes.select("node", F.col("z").cast("double").alias("z"))
    edges = _by_blocks(cut(edges.select("src", "dst", "limit")), nodes.count())
    base = cut(nodes.select("node", F.col("z").cast("double").alias("z"), "pinned"))
    pins = base.where("pinned")
    negative = lambda df: df.withColumn("c", -F.col("c"))
    above = _envelope(pins.select("node", F.col("z").alias("c")), edges, float(top) + 1e-9).withColumnRenamed("c", "_hi")
    below = negative(_envelope(pins.select("node", (-F.col("z")).alias("c")), edges, -float(low) + 1e-9)).withColumnRenamed("c", "_lo")
    held = cut(base.join(above, "node", "left").join(below, "node", "left"))
    if not held.where(F.col("pinned") & ((F.col("z") > F.col("_hi") + 1e-9) | (F.col("z") < F.col("_lo") - 1e-9))).isEmpty():
        raise ValueError("pinned heights differ by more than the edges between them allow")
    within = cut(held.select("node", F.greatest(F.least("z", "_hi"), "_lo").alias("c")))
    down = _envelope(within, edges).withColumnRenamed("c", "_d")
    up = negative(_envelope(negative(within), edges)).withColumnRenamed("c", "_u")
    return down.join(up, "node").select("node", ((F.col("_d") + F.col("_u")) / 2).alias("z"))
