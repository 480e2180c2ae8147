"""Least-cost ways over rasters of any size, and the order of edges along routes.

A step to one of eight neighbours costs its length times the mean of both cells' costs. Tiles relax the costs of ways from what is known along
their borders, and only cells along borders are kept from round to round; tiles beside a border that has become cheaper are relaxed again. The way is then
traced within all tiles at once, from each border cell to where it enters its tile, and followed from tile to tile by doubling.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut
from .pointers import follow
from .terrain import AROUND, _ends, _leads
from .tiles import SIDE, Tile, cell_number, cell_place

TILE = ["_tx", "_ty"]


def _near(a: np.ndarray, dx: int, dy: int, beyond: float) -> np.ndarray:
    """The values of the neighbours in one direction."""
    h, w = a.shape
    return np.pad(a, 1, constant_values=beyond)[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]


def _relax(cost: np.ndarray, d: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of the cheapest ways to the cells of a tile's core by way of it, and the flat place from which each comes (its own at a start)."""
    steps = [(math.hypot(dx, dy) * (cost + _near(cost, dx, dy, np.inf)) / 2, dx, dy) for dx, dy in AROUND]
    while True:
        before = d
        for step, dx, dy in steps:
            d = np.where(core, np.minimum(d, _near(d, dx, dy, np.inf) + step), d)
        if np.array_equal(before, d):
            break
    own = np.arange(d.size).reshape(d.shape)
    came, least = own.copy(), np.full(d.shape, np.inf)
    for step, dx, dy in steps:
        by = _near(d, dx, dy, np.inf) + step
        better = core & (d > 0) & (by < least)
        came, least = np.where(better, own + dy * d.shape[1] + dx, came), np.where(better, by, least)
    return d, came


def _tiled(df: DataFrame, side: int) -> DataFrame:
    return df.withColumns({"_tx": F.floor(F.col("ix") / side), "_ty": F.floor(F.col("iy") / side)})


def _sent(border: DataFrame, side: int) -> DataFrame:
    """Border rows for all tiles that they lie in or beside."""
    reach = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + k) / side) for k in (-1, 0, 1)]))
    return border.withColumn("_tx", F.explode(reach("ix"))).withColumn("_ty", F.explode(reach("iy")))


class Ways:
    """The cheapest ways from sources (ix, iy) over cells (ix, iy, cost), costs above 0; cells without a way aren't reached."""

    def __init__(self, cells: DataFrame, sources: DataFrame, targets: DataFrame, side: int | None = None, rounds: int = 100_000):
        self.side = side = SIDE if side is None else side
        self.base = cut(_tiled(cells.select("ix", "iy", F.col("cost").cast("double").alias("cost")), side))
        marked = lambda df, name: df.select("ix", "iy", F.lit(True).alias(name)).distinct()
        self.starts = cut(self.base.join(marked(sources, "_s"), ["ix", "iy"], "left_semi"))
        self.targets = cut(self.base.join(marked(targets, "_t"), ["ix", "iy"], "left_semi").select("ix", "iy").withColumn("cell", cell_number()))
        border = cut(self.starts.select("ix", "iy", "cost", F.lit(0.0).alias("d")))
        active = cut(self.starts.select(*TILE).distinct())
        for _ in range(rounds):
            if active.isEmpty():
                break
            new = cut(self._pass(active, border, "ix long, iy long, cost double, d double", self._border_rows(side)))
            best = cut(border.withColumn("_old", F.lit(True)).union(new.withColumn("_old", F.lit(False))).groupBy("ix", "iy", "cost").agg(F.min("d").alias("d"), F.min(F.when(F.col("_old"), F.col("d"))).alias("was")))
            changed = best.where("was is null or d < was")
            active = cut(_sent(changed, side).where((F.floor(F.col("ix") / side) != F.col("_tx")) | (F.floor(F.col("iy") / side) != F.col("_ty"))).select(*TILE).distinct().join(self.base.select(*TILE).distinct(), TILE, "left_semi"))
            border = best.drop("was")
        else:
            raise RuntimeError(f"ways still become cheaper after {rounds} rounds")
        self.border = border

    def _pass(self, tiles: DataFrame | None, border: DataFrame, schema: str, kernel, more: DataFrame | None = None) -> DataFrame:
        """Runs kernel(tile, cost, d, came, wanted) on tiles, wanted the rows of `more` in the tile."""
        side, base = self.side, self.base if tiles is None else self.base.join(tiles, TILE, "left_semi")
        known = _sent(border, side).select(*TILE, "ix", "iy", "cost", "d", F.lit(0).alias("what"))
        if more is not None:
            known = known.union(_tiled(more, side).select(*TILE, "ix", "iy", F.lit(0.0), F.lit(0.0), F.lit(1)))

        def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
            if not len(own):
                return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])
            tile = Tile(int(own._tx.iloc[0]) * side, int(own._ty.iloc[0]) * side, side, 1, own, ["cost"])
            cost, d = np.where(tile.there, tile.values["cost"], np.inf), np.full(tile.there.shape, np.inf)
            at, wanted = given[given.what == 0], given[given.what == 1]
            place = (at.iy.to_numpy() - tile.y0, at.ix.to_numpy() - tile.x0)
            cost[place], d[place] = at.cost.to_numpy(), at.d.to_numpy()
            d, came = _relax(cost, d, tile.core)
            return kernel(tile, cost, d, came, (wanted.iy.to_numpy() - tile.y0, wanted.ix.to_numpy() - tile.x0))

        return base.groupBy(*TILE).cogroup(known.groupBy(*TILE)).applyInPandas(run, schema)

    @staticmethod
    def _border_rows(side: int):
        def rows(tile, cost, d, came, wanted):
            rim = tile.core.copy()
            rim[2:-2, 2:-2] = False
            iy, ix = np.nonzero(rim & np.isfinite(d))
            return pd.DataFrame({"ix": ix + tile.x0, "iy": iy + tile.y0, "cost": cost[iy, ix], "d": d[iy, ix]})

        return rows

    def costs(self) -> DataFrame:
        """ix, iy, d of every cell that a way leads to."""

        def rows(tile, cost, d, came, wanted):
            return tile.rows(d=d).query("d < inf")

        return self._pass(None, self.border, "ix long, iy long, d double", rows)

    def path(self) -> DataFrame:
        """ix, iy, d of the cells on the cheapest ways to the targets; in order of d they are the way to one."""

        def entries(tile, cost, d, came, wanted):
            rim = tile.core.copy()
            rim[2:-2, 2:-2] = False
            rim[wanted] = True
            rim &= np.isfinite(d)
            number, to = tile.numbers(), _ends(came.ravel())
            return pd.DataFrame({"cell": number[rim], "to": number.ravel()[to].reshape(rim.shape)[rim]})

        links = cut(self._pass(None, self.border, "cell long, to long", entries, self.targets))
        links = links.select("cell", F.when(F.col("to") != F.col("cell"), F.col("to")).alias("to"))
        met = _leads(links, self.targets.join(links, "cell", "left_semi").select("cell"))
        at = cut(met.select(*cell_place("cell")))

        def cells(tile, cost, d, came, wanted):
            on, here = np.zeros(d.size, bool), np.unique(wanted[0] * d.shape[1] + wanted[1])
            flat, inside = came.ravel(), tile.core.ravel()
            while len(here := here[inside[here] & ~on[here]]):
                on[here] = True
                here = np.unique(flat[here])
            tile.core &= on.reshape(d.shape)
            return tile.rows(d=d)

        tiles = _tiled(at, self.side).select(*TILE).distinct()
        return self._pass(tiles, self.border, "ix long, iy long, d double", cells, at)


def routes(edges: DataFrame) -> DataFrame:
    """trail, place, eid, turned: edges (eid, src, dst) in the order of trails that go on wherever they can.

    At each node edges are paired in order of eid, so that a trail ends only where a node has an edge left over, and there are as few open trails as
    the graph allows. A trail is named by its smallest edge; it starts at the end whose edge is smaller, a closed one with that edge as it is.
    Edges that are walked from dst to src are turned. No group holds a trail: places come from doubling.
    """
    ends = edges.select("eid", F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("k")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("k")))).alias("e")).select("eid", "e.*")
    by = Window.partitionBy("node").orderBy("eid", "k")
    out = F.struct((F.col("eid") * 2 + F.col("k")).alias("h"))
    odd = F.row_number().over(by) % 2 == 1
    # the half-edge that comes to an end goes on with the one that leaves by its partner
    links = ends.select((F.col("eid") * 2 + 1 - F.col("k")).alias("node"), F.when(odd, F.lead(out).over(by)).otherwise(F.lag(out).over(by))["h"].alias("next"))
    f = cut(follow(links))
    twin = f.select(F.col("node").bitwiseXOR(F.lit(1)).alias("node"), F.col("low").alias("t_low"), F.col("last").alias("t_last"), F.col("steps").alias("t_steps"))
    both = cut(f.join(twin, "node"))
    eid, turned = F.shiftright("node", 1).alias("eid"), (F.col("node").bitwiseAND(F.lit(1)) == 1).alias("turned")
    name = F.shiftright(F.least("low", "t_low"), 1).alias("trail")
    started = F.col("t_last").bitwiseXOR(F.lit(1)) < F.col("last").bitwiseXOR(F.lit(1))
    opened = both.where(F.col("last").isNotNull() & started).select(name, F.col("t_steps").alias("place"), eid, turned)
    closed = both.where(F.col("last").isNull() & (F.col("low") < F.col("t_low")))
    sizes = closed.groupBy("low").agg(F.count("*").alias("size"))
    return opened.union(closed.join(sizes, "low").select(name, ((F.col("size") - F.col("low_at")) % F.col("size")).alias("place"), eid, turned))
