"""Water on a raster of any size: the level to which pits fill, the way that water takes out of them, and rims that are cut.

Water runs from a cell to its lowest neighbour, if that is lower, down to a cell that has none: its basin. Basins are found in tiles and joined over their borders.
What is between two basins is the lowest pass from one to the other. A basin's level is the lowest, over all ways out, of the
highest pass on the way; it is found in rounds in which all basins that don't drain yet take their lowest pass and become one with what lies
beyond, so that rounds grow with the logarithm of their number. Outlets are the cells at the raster's rim and those that are given (water).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .pointers import follow
from .tiles import SIDE, Tile, cell_number, cell_place, per_tile

#: The basin that all outlets drain to.
OUT = -1
AROUND = ((-1, -1), (0, -1), (1, -1), (-1, 0), (1, 0), (-1, 1), (0, 1), (1, 1))
ROWS = "what int, a long, b long, z double, p long, q long"


def _lowest(z: np.ndarray, still: np.ndarray) -> np.ndarray:
    """Flat places that cells drain to: the lowest lower neighbour, the first around a cell of those that tie; still cells stay."""
    h, w = z.shape
    padded = np.pad(np.where(np.isnan(z), np.inf, z), 1, constant_values=np.inf)
    own = np.arange(z.size).reshape(h, w)
    low, to = np.where(np.isnan(z), -np.inf, z), own.copy()
    for dx, dy in AROUND:
        near = padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w]
        better = (near < low) & ~still
        low, to = np.where(better, near, low), np.where(better, own + dy * w + dx, to)
    return to.ravel()


def _ends(to: np.ndarray) -> np.ndarray:
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def _passes(z: np.ndarray, label: np.ndarray, core: np.ndarray, number: np.ndarray) -> pd.DataFrame:
    """The lowest pass (z) between each two labels a < b that meet, from cell p of a to cell q of b, with a cell in the core."""
    h, w = z.shape
    found = []
    for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
        here = (slice(0, h - dy), slice(max(0, -dx), w - max(0, dx)))
        there = (slice(dy, h), slice(max(0, dx), w + min(0, dx)))
        a, b = label[here], label[there]
        go = (a != b) & ~np.isnan(z[here]) & ~np.isnan(z[there]) & (core[here] | core[there])
        over = np.maximum(z[here], z[there])[go]
        a, b, p, q = a[go], b[go], number[here][go], number[there][go]
        turn = a > b
        found.append((np.where(turn, b, a), np.where(turn, a, b), over, np.where(turn, q, p), np.where(turn, p, q)))
    a, b, over, p, q = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((q, p, over, b, a))
    a, b, over, p, q = (x[order] for x in (a, b, over, p, q))
    first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return pd.DataFrame({"a": a[first], "b": b[first], "z": over[first], "p": p[first], "q": q[first]})


def _join_closed(label: np.ndarray, shut: np.ndarray, passes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Basins that lie within a tile take their lowest pass, and again, until none is left: (basins, the label each now has, its level)."""
    basins = np.unique(np.r_[label, passes.a.to_numpy(), passes.b.to_numpy()])
    u, v = np.searchsorted(basins, passes.a), np.searchsorted(basins, passes.b)
    n, over = len(basins), passes.z.to_numpy()
    part, level, closed = np.arange(n), np.full(n, -np.inf), np.isin(basins, shut)
    while True:
        a, b = part[u], part[v]
        go = np.flatnonzero(a != b)
        order = go[np.lexsort((np.maximum(a, b)[go], np.minimum(a, b)[go], over[go]))]
        ends = np.r_[a[order], b[order]]
        which = np.r_[order, order]
        turn = np.argsort(np.r_[np.arange(len(order)), np.arange(len(order))], kind="stable")
        at, first = np.unique(ends[turn], return_index=True)  # the lowest pass of each part
        mine = closed[at]
        at, edge = at[mine], which[turn][first[mine]]
        if not len(at):
            return basins, basins[part], level
        to = np.arange(n)
        to[at] = np.where(a[edge] == at, b[edge], a[edge])
        back = (to[to[at]] == at) & (at < to[at])
        to[at[back]] = at[back]  # of two that take the same pass the smaller stays
        up = np.full(n, -np.inf)
        up[at] = over[edge]
        level = np.maximum(level, up[part])
        to = _ends(to)
        opened = np.zeros(n, bool)
        opened[to[np.flatnonzero((part == np.arange(n)) & ~closed)]] = True
        part = to[part]
        closed = ~opened


def _kernel(join: bool):
    """Rows of a tile: cells (0: cell, label, level; its receiver as p), and passes between labels (1). A cell beyond the border stands for its own label."""

    def run(tile: Tile) -> pd.DataFrame:
        z, core, number = tile.values["_z"], tile.core, tile.numbers()
        near = np.pad(tile.there, 1)
        whole = np.logical_and.reduce([near[1 + dy : 1 + dy + len(z), 1 + dx : 1 + dx + len(z)] for dx, dy in AROUND])
        outlet = core & (~whole | (tile.values["_out"] > 0))
        to = _lowest(z, outlet | ~core)
        label = number.ravel()[_ends(to)].reshape(z.shape)
        passes = _passes(z, label, core, number)
        out = pd.DataFrame({"a": OUT, "b": number[outlet], "z": -np.inf, "p": OUT, "q": number[outlet]})
        cells = pd.DataFrame({"what": 0, "a": number[core], "b": label[core], "z": -np.inf, "p": number.ravel()[to].reshape(z.shape)[core], "q": 0})
        if join:
            edge = ~core.copy()
            edge[1:-1, 1:-1] |= ~(core[:-2, 1:-1] & core[2:, 1:-1] & core[1:-1, :-2] & core[1:-1, 2:] & core[:-2, :-2] & core[:-2, 2:] & core[2:, :-2] & core[2:, 2:])
            shut = np.setdiff1d(label[core], np.r_[label[edge | outlet]])
            basins, into, level = _join_closed(label[core], shut, passes)
            at = np.searchsorted(basins, cells.b)
            cells["z"], cells["b"] = level[at], into[at]
            passes["a"], passes["b"] = into[np.searchsorted(basins, passes.a)], into[np.searchsorted(basins, passes.b)]
            passes = passes[passes.a != passes.b]
        return pd.concat([cells, pd.concat([passes, out]).assign(what=1)])

    return run


class Basins:
    """cells: cell, basin, level (of what was joined within a tile), to (the cell it drains to). passes: a, b, z, p, q between basins, both ways."""

    def __init__(self, cells: DataFrame, value: str, outlet: Column | None, join: bool, side: int | None = None):
        self.side = SIDE if side is None else side
        given = F.lit(0) if outlet is None else F.coalesce(outlet.cast("int"), F.lit(0))
        rows = cut(per_tile(cells.select("ix", "iy", F.col(value).cast("double").alias("_z"), given.alias("_out")), ["_z", "_out"], 1, _kernel(join), ROWS, self.side))
        found = rows.where("what = 0").select(F.col("a").alias("cell"), F.col("b").alias("label"), F.col("z").alias("level"), F.col("p").alias("to"))
        passes = rows.where("what = 1").select("a", "b", "z", "p", "q")
        names = cut(self._names(found))
        named = lambda df, c: df.join(names.select(F.col("cell").alias(c), F.col("basin").alias("_n")), c, "left").withColumn(c, F.coalesce("_n", c)).drop("_n")
        self.cells = named(found, "label").select("cell", F.col("label").alias("basin"), "level", "to")
        both = named(named(passes, "a"), "b").where("a <> b").select("a", "b", "z", "p", "q")
        both = both.union(both.select("b", "a", "z", "q", "p"))
        self.passes = cut(both.groupBy("a", "b").agg(F.min(F.struct("z", F.least("p", "q").alias("_l"), F.greatest("p", "q").alias("_h"), "p", "q")).alias("m")).select("a", "b", "m.z", "m.p", "m.q"))

    def _names(self, found: DataFrame) -> DataFrame:
        """cell, basin of the cells along the borders of tiles: their own basins, or where the cells beyond drain to in turn."""
        tile = lambda c: F.struct(*[F.floor(p / self.side) for p in cell_place(c)])
        along = [(p % self.side).isin(0, self.side - 1) for p in cell_place("cell")]
        at = found.where(along[0] | along[1]).select("cell", "label", (tile("cell") != tile("label")).alias("out"))
        ends = follow(at.select(F.col("cell").alias("node"), F.when(F.col("out"), F.col("label")).alias("next")))
        last = at.where("not out").select(F.col("cell").alias("last"), F.col("label").alias("basin"))
        return ends.select(F.col("node").alias("cell"), "last").join(last, "last").select("cell", "basin")


def drain(passes: DataFrame, rounds: int = 60) -> tuple[DataFrame, DataFrame]:
    """(basin, level) of every basin that a way leads out of, and the passes (u, v, p, q) that were taken, which make a tree with OUT."""
    edges = cut(passes.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("a").alias("cu"), F.col("b").alias("cv"), "z", "p", "q"))
    part = cut(passes.select(F.col("a").alias("basin")).distinct().select("basin", F.col("basin").alias("part"), F.lit(float("-inf")).alias("level")))
    taken = None
    for _ in range(rounds):
        # both ends see a pass under one name, so that ways round can't come about but by two parts that take the same
        name = F.struct("z", F.least("cu", "cv").alias("l"), F.greatest("cu", "cv").alias("h"), F.least("p", "q").alias("pl"), F.greatest("p", "q").alias("ph"))
        best = cut(edges.where(F.col("cu") != OUT).groupBy("cu").agg(F.min(F.struct(name.alias("name"), "cv", "u", "v", "p", "q")).alias("m")).select("cu", "m.name", "m.cv", "m.u", "m.v", "m.p", "m.q", F.col("m.name.z").alias("z")))
        if best.isEmpty():
            break
        other = best.select(F.col("cu").alias("cv"), F.col("cv").alias("_back"))
        top = (F.col("_back") == F.col("cu")) & (F.col("cu") < F.col("cv"))
        hooked = best.join(other, "cv", "left").withColumn("next", F.when(F.coalesce(top, F.lit(False)), F.lit(None)).otherwise(F.col("cv")))
        links = hooked.where("next is not null").select("u", "v", "p", "q")
        taken = cut(links if taken is None else taken.union(links))
        joined = follow(hooked.select(F.col("cu").alias("node"), "next").union(part.sparkSession.createDataFrame([(OUT, None)], "node long, next long"))).select(F.col("node").alias("part"), F.col("last").alias("into"))
        joined = cut(joined)
        part = cut(part.join(joined, "part", "left").join(best.select(F.col("cu").alias("part"), "z"), "part", "left").select("basin", F.coalesce("into", "part").alias("part"), F.greatest("level", F.coalesce("z", F.lit(float("-inf")))).alias("level")))
        for c in ("cu", "cv"):
            edges = edges.join(joined.withColumnRenamed("part", c), c, "left").withColumn(c, F.coalesce("into", c)).drop("into")
        # of several passes between two parts the lowest will do
        edges = edges.where("cu <> cv").groupBy("cu", "cv").agg(F.min(F.struct("z", F.least("p", "q").alias("_l"), F.greatest("p", "q").alias("_h"), "u", "v", "p", "q")).alias("m")).select("m.u", "m.v", "cu", "cv", "m.z", "m.p", "m.q")
        edges = cut(edges)
    else:
        raise RuntimeError(f"basins have not drained in {rounds} rounds")
    if taken is None:
        taken = edges.select("u", "v", "p", "q")
    return part.where((F.col("part") == OUT) & (F.col("basin") != OUT)).select("basin", "level"), taken


def flooded(cells: DataFrame, value: str, out: str = "filled", outlet: Column | None = None, side: int | None = None) -> DataFrame:
    """Adds the lowest level from which water runs to an outlet: the lowest, over all ways there, of the highest cell on the way."""
    b = Basins(cells, value, outlet, join=True, side=side)
    levels, _ = drain(b.passes)
    up = b.cells.join(levels.withColumnRenamed("level", "_l"), "basin").select("cell", F.greatest("level", "_l").alias("_level"))
    return cells.withColumn("cell", cell_number()).join(up, "cell").withColumn(out, F.greatest(F.col(value).cast("double"), "_level")).drop("cell", "_level")


def _rooted(taken: DataFrame) -> DataFrame:
    """basin, p, q: the pass by which each basin drains, from its cell p to q, on the tree of passes with OUT as its root.

    A tour goes along every pass and back; from which end it comes first is the end that is nearer to the root.
    """
    from pyspark.sql import Window

    t = taken.select("u", "v", "p", "q").distinct()
    number = F.xxhash64(F.least("u", "v"), F.greatest("u", "v"))
    there = t.select(number.alias("e"), F.col("u").alias("tail"), F.col("v").alias("head"), "p", "q")
    halves = cut(there.union(there.select("e", "head", "tail", "q", "p")))
    by = Window.partitionBy("tail").orderBy("head")
    onward = halves.select("tail", "head", F.lead("head").over(by).alias("next"), F.first("head").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("first"), F.row_number().over(by).alias("k"))
    # after coming from `head` to `tail` the tour leaves for the next head; at the root it ends after the last
    step = onward.select(F.col("head").alias("a"), F.col("tail").alias("b"), F.when(F.col("next").isNotNull(), F.col("next")).when(F.col("tail") != OUT, F.col("first")).alias("c"))
    numbered = lambda a, b: F.xxhash64(F.col(a), F.col(b))
    ranks = follow(step.select(numbered("a", "b").alias("node"), F.when(F.col("c").isNotNull(), numbered("b", "c")).alias("next"))).select("node", "steps")
    placed = halves.withColumns({"go": numbered("tail", "head"), "come": numbered("head", "tail")})
    placed = placed.join(ranks.toDF("go", "go_left"), "go").join(ranks.toDF("come", "come_left"), "come")
    # the way up from a basin comes after the way down to it
    return placed.where("go_left < come_left").select(F.col("tail").alias("basin"), "p", "q")


def _leads(pointers: DataFrame, starts: DataFrame, rounds: int = 60) -> DataFrame:
    """The cells (cell) that water from starts runs through, by doubling; pointers are (cell, to), to null at the ends."""
    jump, met = cut(pointers.where("to is not null")), cut(starts.select("cell").distinct())
    for _ in range(rounds):
        if jump.isEmpty():
            return met
        met = cut(met.union(met.join(jump, "cell").select(F.col("to").alias("cell"))).distinct())
        jump = cut(jump.join(jump.select(F.col("cell").alias("to"), F.col("to").alias("_t")), "to").select("cell", F.col("_t").alias("to")))
    raise RuntimeError(f"water still flows after 2^{rounds} steps")


def drainage(cells: DataFrame, value: str, outlet: Column | None = None, side: int | None = None) -> DataFrame:
    """cell, to: a receiver for every cell on the way to an outlet, null at outlets.

    Cells drain to their lowest neighbour, but those between a pit and the pass by which its water leaves drain to the pass.
    """
    b = Basins(cells, value, outlet, join=False, side=side)
    _, taken = drain(b.passes)
    ways = cut(_rooted(taken))
    down = cut(b.cells.select("cell", F.when(F.col("to") != F.col("cell"), F.col("to")).alias("to")))
    inner = ways.where(F.col("q") != OUT)
    up = _leads(down, inner.select(F.col("p").alias("cell")))
    turned = down.join(up, "cell", "left_semi").where("to is not null").select(F.col("to").alias("cell"), F.col("cell").alias("_up"))
    over = inner.select(F.col("p").alias("cell"), F.col("q").alias("_over"))
    kept = down.join(up.withColumn("_on", F.lit(True)), "cell", "left")
    return cut(kept.join(over, "cell", "left").join(turned, "cell", "left").select("cell", F.coalesce("_over", "_up", F.when(F.col("_on").isNull(), F.col("to"))).alias("to")))


def upstream_least(cells: DataFrame, pointers: DataFrame, step: float, rounds: int = 60) -> DataFrame:
    """cell, z: of all cells upstream, the cell itself included, the least z - step * distance; cells are (cell, z), pointers (cell, to)."""
    now, jump = cut(cells.select("cell", "z")), cut(pointers.where("to is not null"))
    for k in range(rounds):
        if jump.isEmpty():
            return now
        sent = now.join(jump, "cell").select(F.col("to").alias("cell"), (F.col("z") - step * (1 << k)).alias("z"))
        now = cut(now.union(sent).groupBy("cell").agg(F.min("z").alias("z")))
        jump = cut(jump.join(jump.select(F.col("cell").alias("to"), F.col("to").alias("_t")), "to").select("cell", F.col("_t").alias("to")))
    raise RuntimeError(f"water still flows after 2^{rounds} steps")


def downstream_most(cells: DataFrame, pointers: DataFrame, step: float, rounds: int = 60) -> DataFrame:
    """cell, z: of all cells downstream, the cell itself included, the greatest z + step * distance."""
    now, jump = cut(cells.select("cell", "z")), cut(pointers.where("to is not null"))
    for k in range(rounds):
        if jump.isEmpty():
            return now
        ahead = jump.join(now.select(F.col("cell").alias("to"), F.col("z").alias("_z")), "to").select("cell", (F.col("_z") + step * (1 << k)).alias("_z"))
        now = cut(now.join(ahead, "cell", "left").select("cell", F.greatest("z", "_z").alias("z")))
        jump = cut(jump.join(jump.select(F.col("cell").alias("to"), F.col("to").alias("_t")), "to").select("cell", F.col("_t").alias("to")))
    raise RuntimeError(f"water still flows after 2^{rounds} steps")


def breached(cells: DataFrame, value: str, most: float, step: float, outlet: Column | None = None, side: int | None = None) -> DataFrame:
    """ix, iy, z: terrain on which every cell lies at least `step` above the cell that it drains to.

    Along its way out water cuts the cells that stand in its way, if by no more than `most`; what is deeper is filled. Outlets that are given (water) keep
    their heights, and what lies behind them ends there.
    """
    given = F.lit(False) if outlet is None else F.coalesce(outlet, F.lit(False))
    z = cut(cells.select(cell_number().alias("cell"), F.col(value).cast("double").alias("z"), given.alias("wet")))
    to = drainage(cells, value, outlet, side)
    carved = upstream_least(z, to, step).withColumnRenamed("z", "_low")
    shallow = ~F.col("wet") & (F.col("z") - F.col("_low") <= most)
    trimmed = z.join(carved, "cell").select("cell", F.when(shallow, F.col("_low")).otherwise(F.col("z")).alias("z"))
    return downstream_most(trimmed, to, step).select(*cell_place("cell"), "z")


def eroded(cells: DataFrame, value: str, steps: int, rate: float, talus: float) -> DataFrame:
    """ix, iy, z after so many steps in which streams cut and slopes settle.

    A cell is cut by rate times the root of the area that drains through it times its fall to the lowest of its four neighbours, by half the fall at most; then
    a quarter of what neighbours along rows, then along columns, differ by beyond the talus moves from the higher to the lower. Areas come by doubling.
    """
    from .raster import accumulate, columns, rows

    z = cut(cells.select("ix", "iy", F.col(value).cast("double").alias("z")))
    for _ in range(steps):
        near = [(F.lag("z").over(columns()), 0, -1), (F.lead("z").over(columns()), 0, 1), (F.lag("z").over(rows()), -1, 0), (F.lead("z").over(rows()), 1, 0)]
        # the first of those that tie
        falls = [F.when(v.isNotNull(), F.struct((F.col("z") - v).alias("fall"), F.lit(-k).alias("k"), (F.col("ix") + dx).alias("rx"), (F.col("iy") + dy).alias("ry"))) for k, (v, dx, dy) in enumerate(near)]
        best = z.withColumns({f"_f{k}": f for k, f in enumerate(falls)}).withColumn("_best", F.greatest(*[f"_f{k}" for k in range(4)]))
        down = F.col("_best.fall") > 0
        flow = cut(best.select("ix", "iy", "z", F.when(down, F.col("_best.rx")).alias("rx"), F.when(down, F.col("_best.ry")).alias("ry"), F.when(down, F.col("_best.fall")).otherwise(0.0).alias("fall")))
        cutting = flow.join(accumulate(flow.select("ix", "iy", "rx", "ry")), ["ix", "iy"])
        z = cutting.select("ix", "iy", (F.col("z") - F.least(rate * F.sqrt(F.col("area").cast("double")) * F.col("fall"), 0.5 * F.col("fall"))).alias("z"))
        for w in (rows(), columns()):
            ahead = F.lead("z").over(w) - F.col("z")
            over = F.signum(ahead) * F.greatest(F.abs(ahead) - talus, F.lit(0.0)) / 4
            moved = z.withColumn("_o", F.coalesce(over, F.lit(0.0)))
            z = moved.select("ix", "iy", (F.col("z") + F.col("_o") - F.coalesce(F.lag("_o").over(w), F.lit(0.0))).alias("z"))
        z = cut(z)
    return z
