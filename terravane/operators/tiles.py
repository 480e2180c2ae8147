"""Square tiles of a raster with a rim of their neighbours' cells, for kernels on arrays: a task holds one tile, whatever the raster's size.

Cells are rows (ix, iy, values) with ix, iy >= 0. A tile's rows are its own and those within `halo` of it; each cell is sent to the
few tiles that need it, in one shuffle. A kernel that looks no further than the halo gives what it would give on the whole raster.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a side of a tile: with a few arrays of doubles some MB.
SIDE = 256
#: A cell's number is iy << SHIFT | ix.
SHIFT = 31


def cell_number(ix: str | Column = "ix", iy: str | Column = "iy") -> Column:
    ix, iy = (F.col(c) if isinstance(c, str) else c for c in (ix, iy))
    return F.shiftleft(iy.cast("long"), SHIFT).bitwiseOR(ix.cast("long"))


def cell_place(number: str) -> list[Column]:
    return [F.col(number).bitwiseAND(F.lit((1 << SHIFT) - 1)).alias("ix"), F.shiftright(number, SHIFT).alias("iy")]


class Tile:
    """Arrays of a tile: rows along iy, columns along ix, the halo included, NaN where there is no cell."""

    def __init__(self, x0: int, y0: int, side: int, halo: int, frame: pd.DataFrame, columns: list[str]):
        self.x0, self.y0, self.halo, self.side = x0 - halo, y0 - halo, halo, side
        wide = side + 2 * halo
        at = (frame.iy.to_numpy() - self.y0, frame.ix.to_numpy() - self.x0)
        self.there = np.zeros((wide, wide), bool)
        self.there[at] = True
        self.values = {}
        for c in columns:
            a = np.full((wide, wide), np.nan)
            a[at] = frame[c].to_numpy(float, na_value=np.nan)
            self.values[c] = a
        self.core = np.zeros((wide, wide), bool)
        self.core[halo : halo + side, halo : halo + side] = True
        self.core &= self.there

    def numbers(self) -> np.ndarray:
        iy, ix = np.indices(self.there.shape)
        return (iy + self.y0 << SHIFT) | (ix + self.x0)

    def rows(self, **arrays: np.ndarray) -> pd.DataFrame:
        """The tile's own cells with values from arrays."""
        iy, ix = np.nonzero(self.core)
        return pd.DataFrame({"ix": ix + self.x0, "iy": iy + self.y0} | {c: a[iy, ix] for c, a in arrays.items()})


def per_tile(cells: DataFrame, columns: list[str], halo: int, kernel: Callable[[Tile], pd.DataFrame], schema: str, side: int | None = None) -> DataFrame:
    """Runs kernel(Tile) -> frame of the schema on every tile that has cells of its own."""
    side = SIDE if side is None else side
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / side), F.floor((F.col(c) + halo) / side))
    sent = cells.select("ix", "iy", *columns)
    if halo:
        sent = sent.withColumn("_tx", F.explode(reach("ix"))).withColumn("_ty", F.explode(reach("iy")))
    else:
        sent = sent.withColumns({"_tx": F.floor(F.col("ix") / side), "_ty": F.floor(F.col("iy") / side)})

    names = [c.split()[0] for c in schema.split(", ")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        tile = Tile(int(frame._tx.iloc[0]) * side, int(frame._ty.iloc[0]) * side, side, halo, frame, columns)
        return (kernel(tile) if tile.core.any() else pd.DataFrame()).reindex(columns=names)

    return sent.groupBy("_tx", "_ty").applyInPandas(run, schema)
