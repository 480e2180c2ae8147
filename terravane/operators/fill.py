"""Harmonic filling of rasters of any size: unknown cells become the mean of their neighbours.

A cycle solves every tile with a halo of HALO cells at once, the cells beyond as they were, and keeps what it gives for the tile's own cells; that settles
what is near. What cells still lack of the mean of their neighbours is summed over blocks of BLOCK cells a side: the right side of the same
problem on the blocks, which is solved in one task once the blocks fit a tile, else by cycles of its own. Its solution is laid between the middles of blocks
and added in the measure that helps most, which settles what is far. So cycles converge whatever the sizes and however few cells are known.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .tiles import SIDE, Tile, per_tile

BLOCK, HALO = 4, 16
CELLS = "ix long, iy long, known int, f double, u double"


def _around(u: np.ndarray) -> np.ndarray:
    p = np.pad(u, 1)
    return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]


def _lack(u: np.ndarray, free: np.ndarray, there: np.ndarray, f: np.ndarray) -> np.ndarray:
    inside = there.astype(float)
    return np.where(free, f + _around(u * inside) - _around(inside) * u, 0.0)


def _solved(u: np.ndarray, free: np.ndarray, there: np.ndarray, f: np.ndarray, close: float) -> np.ndarray:
    """Free cells by conjugate gradients; parts that reach no known cell are left near where they are."""
    inside = there.astype(float)
    degree = _around(inside)
    applied = lambda a: np.where(free, degree * a - _around(np.where(free, a, 0.0)), 0.0)
    rest = np.where(free, f + _around(u * inside) - degree * u, 0.0)
    way, size = rest.copy(), float((rest * rest).sum())
    first = size
    for _ in range(4 * int(free.sum()) + 10):
        if size <= (close * close) * first or size == 0:
            break
        pushed = applied(way)
        bend = float((way * pushed).sum())
        if bend <= 0:
            break
        u, rest = u + size / bend * way, rest - size / bend * pushed
        last, size = size, float((rest * rest).sum())
        way = rest + size / last * way
    return u


def _prolonged(tile: Tile, coarse: pd.DataFrame) -> np.ndarray:
    """The blocks' corrections at a tile's cells, bilinear between the middles of blocks."""
    if not len(coarse):
        return np.zeros(tile.there.shape)
    x0, y0 = (tile.x0 // BLOCK) - 1, (tile.y0 // BLOCK) - 1
    n = tile.there.shape[0] // BLOCK + 4
    e, there = np.zeros((n, n)), np.zeros((n, n))
    at = (coarse.iy.to_numpy() - y0, coarse.ix.to_numpy() - x0)
    on = (at[0] >= 0) & (at[0] < n) & (at[1] >= 0) & (at[1] < n)
    e[at[0][on], at[1][on]], there[at[0][on], at[1][on]] = coarse.u.to_numpy()[on], 1.0
    place = lambda start, zero: (np.arange(tile.there.shape[0]) + start + 0.5) / BLOCK - 0.5 - zero
    py, px = place(tile.y0, y0), place(tile.x0, x0)
    iy, ix = np.floor(py).astype(int), np.floor(px).astype(int)
    ty, tx = (py - iy)[:, None], (px - ix)[None, :]
    total, weight = np.zeros(tile.there.shape), np.zeros(tile.there.shape)
    for dy, wy in ((0, 1 - ty), (1, ty)):
        for dx, wx in ((0, 1 - tx), (1, tx)):
            rows, columns = np.clip(iy + dy, 0, n - 1)[:, None], np.clip(ix + dx, 0, n - 1)[None, :]
            total, weight = total + wy * wx * e[rows, columns], weight + wy * wx * there[rows, columns]
    return np.where(weight > 0, total / np.maximum(weight, 1e-12), 0.0)


def _fits(cells: DataFrame, side: int) -> bool:
    """Whether all cells lie in the first tile."""
    top = cells.agg(F.max("ix"), F.max("iy")).first()
    return max(top[0] or 0, top[1] or 0) < side


def _arrays(tile: Tile) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    v = {k: np.nan_to_num(a) for k, a in tile.values.items()}
    return v["u"], tile.there & (v["known"] == 0), v["f"], v["known"].astype(int)


def _near(cells: DataFrame, side: int, halo: int, close: float) -> DataFrame:
    """Every tile solved with its halo, whose outermost cells stay where there are more beyond."""

    def kernel(tile: Tile) -> pd.DataFrame:
        u, free, f, known = _arrays(tile)
        if halo:
            rim = np.ones(u.shape, bool)
            rim[1:-1, 1:-1] = False
            free = free & ~rim
        u = _solved(u, free, tile.there, f, close)
        return tile.rows(known=known, f=f, u=u)

    return cut(per_tile(cells, ["known", "f", "u"], halo, kernel, CELLS, side))


def _lacking(cells: DataFrame, side: int) -> DataFrame:
    def kernel(tile: Tile) -> pd.DataFrame:
        u, free, f, known = _arrays(tile)
        return tile.rows(known=known, f=f, u=u, lack=_lack(u, free, tile.there, f))

    return cut(per_tile(cells, ["known", "f", "u"], 1, kernel, CELLS + ", lack double", side))


def _far(cells: DataFrame, coarse: DataFrame, side: int) -> DataFrame:
    """u with the blocks' solution added in the measure that leaves least."""
    schema = CELLS + ", p double, rp double, pap double"

    def listed(df: DataFrame, of: int, halo: int) -> DataFrame:
        reach = lambda c: F.sequence(F.floor((F.col(c) * of - halo) / side), F.floor((F.col(c) * of + of - 1 + halo) / side))
        return df.withColumn("_tx", F.explode(reach("ix"))).withColumn("_ty", F.explode(reach("iy")))

    def run(own: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        if not len(own):
            return pd.DataFrame(columns=names)
        tile = Tile(int(own._tx.iloc[0]) * side, int(own._ty.iloc[0]) * side, side, 1, own, ["known", "f", "u", "lack"])
        if not tile.core.any():
            return pd.DataFrame(columns=names)
        u, free, f, known = _arrays(tile)
        p = np.where(free, _prolonged(tile, given), 0.0)
        bent = -_lack(p, free, tile.there, np.zeros(p.shape))
        return tile.rows(known=known, f=f, u=u, p=p, rp=p * np.nan_to_num(tile.values["lack"]), pap=p * bent)[names]

    tiles = listed(cells, 1, 1).groupBy("_tx", "_ty")
    near = listed(coarse.select("ix", "iy", "u"), BLOCK, 1 + 2 * BLOCK).groupBy("_tx", "_ty")
    moved = cut(tiles.cogroup(near).applyInPandas(run, schema))
    rp, pap = moved.agg(F.sum("rp"), F.sum("pap")).first()
    share = rp / pap if pap and pap > 0 else 0.0
    return moved.select("ix", "iy", "known", "f", (F.col("u") + share * F.col("p")).alias("u"))


def _cycles(cells: DataFrame, side: int, close: float, rounds: int, most: float | None) -> DataFrame:
    """Cells (ix, iy, known, f, u) with u changed until no cell lacks more than `most`, or for so many rounds if that is None."""
    if _fits(cells, side):
        return _near(cells, side, 0, close)
    now = cells
    for k in range(rounds):
        now = _lacking(_near(now, side, HALO, close), side)
        if (most is None and k == rounds - 1) or (most is not None and (now.agg(F.max(F.abs("lack"))).first()[0] or 0.0) <= most):
            return now.drop("lack")
        block = [F.expr(f"{c} div {BLOCK}").alias(c) for c in ("ix", "iy")]
        blocks = cut(now.groupBy(*block).agg(F.max("known").alias("known"), F.sum("lack").alias("f")).withColumn("u", F.lit(0.0)))
        now = _far(now, _cycles(blocks, side, close, 2, None), side)
    raise RuntimeError(f"cells still lack more than {most} after {rounds} cycles")


def harmonic(cells: DataFrame, value: str, known: str, out: str, most: float = 1e-6, side: int | None = None, rounds: int = 200) -> DataFrame:
    """ix, iy and out: known cells as they are; unknown ones the mean of the up to four neighbours that are there, to within `most` a neighbour.

    Cells start from the means of known cells in ever larger blocks; parts that reach no known cell stay there. Without a known cell out is null.
    """
    from .raster import pull_push

    side = SIDE if side is None else side
    start = pull_push(cells.select("ix", "iy", F.col(value).cast("double").alias("v"), F.col(known).alias("is_known")), "v", "is_known", "u")
    if cells.where(F.col(known)).isEmpty():
        return cells.select("ix", "iy", F.lit(None).cast("double").alias(out))
    base = cut(start.select("ix", "iy", F.col("is_known").cast("int").alias("known"), F.lit(0.0).alias("f"), "u"))
    return _cycles(base, side, min(1e-10, most * 1e-3), rounds, most).select("ix", "iy", F.col("u").alias(out))
