"""Numeric kernels for one group (a line or a tile), run side by side by applyInPandas.

They are for what column expressions can't state: recurrences that look both ways, searches with a queue, small solves. A group is
a line or a tile and fits a task; groups are never made of unrelated rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_line(df: DataFrame, line: str, order: str, columns: list[str], kernel: Callable[..., dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Runs kernel(*columns of a line in order) -> named arrays; the schema starts with the line's column."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out = kernel(*[pdf[c].to_numpy(float) for c in columns])
        return pd.DataFrame({line: pdf[line].iloc[0], **out})

    return df.select(line, order, *columns).groupBy(line).applyInPandas(run, schema)


def per_lines(df: DataFrame, line: str, order: str, columns: list[str], kernel: Callable[..., list[dict[str, np.ndarray]]], schema: str, most: int = 64) -> DataFrame:
    """per_line for kernels that take a list of lines, `most` at once at most: those whose numbers have the same quotient."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([line, order])
        at = np.nonzero(np.diff(pdf[line].to_numpy()))[0] + 1
        parts = zip(*[np.split(pdf[c].to_numpy(float), at) for c in columns])
        names = pdf[line].to_numpy()[np.concatenate([[0], at])]
        return pd.concat([pd.DataFrame({line: name, **out}) for name, out in zip(names, kernel(list(parts)))])

    return df.select(line, order, *columns).groupBy(F.floor(F.col(line) / most).alias("_lines")).applyInPandas(run, schema)


def robust_smooth(x: np.ndarray, y: np.ndarray, sigma: float, scale: float, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Gaussian means over five sigmas whose weights fall with the distance from the last result; ends stay."""
    n, reach = len(x), int(np.ceil(5 * sigma))
    if n < 5:
        return x, y
    near = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    mean = lambda v: np.convolve(v, near)[reach : reach + n]
    w, px, py = np.ones(n), x, y
    for _ in range(rounds):
        total = mean(w)
        px, py = mean(w * x) / total, mean(w * y) / total
        px[[0, -1]], py[[0, -1]] = x[[0, -1]], y[[0, -1]]
        w = 1 / (1 + (np.hypot(x - px, y - py) / scale) ** 2)
    return px, py


def ease_turns(x: np.ndarray, y: np.ndarray, most: float, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Shares turns over `most` radians at a vertex with its neighbours until none is left; the ends and the length of steps stay."""
    return ease_lines([(x, y)], most, rounds)[0]


def ease_lines(lines: list[tuple[np.ndarray, np.ndarray]], most: float, rounds: int = 4000) -> list[tuple[np.ndarray, np.ndarray]]:
    """ease_turns of many lines, whose turns stand one after the other in one array, so that a round costs few calls; a line that has none left rests."""
    long = [k for k, (x, _) in enumerate(lines) if len(x) >= 4]
    bearings = [np.unwrap(np.arctan2(np.diff(lines[k][1]), np.diff(lines[k][0]))) for k in long]
    turns = [np.diff(a) for a in bearings]
    going = list(range(len(long)))
    while going and rounds > 0:
        turn, starts = np.concatenate([turns[k] for k in going]), np.concatenate([[0], np.cumsum([len(turns[k]) for k in going])])
        first, last, of = starts[:-1], starts[1:] - 1, np.repeat(np.arange(len(going)), np.diff(starts))
        done = np.zeros(len(going), bool)
        while rounds > 0 and 2 * done.sum() < len(going):  # those that rest are left out once they are half
            rounds -= 1
            over = np.sign(turn) * np.maximum(np.abs(turn) - most, 0)
            done |= np.maximum.reduceat(np.abs(over), first) < 1e-9
            over[done[of]] = 0
            turn = turn - over
            ahead, back = over / 2, over / 2
            ahead[last], back[first] = 0, 0  # nothing goes from line to line
            turn[1:] += ahead[:-1]
            turn[:-1] += back[1:]
        for k, part in zip(going, np.split(turn, starts[1:-1])):
            turns[k] = part
        going = [k for k, d in zip(going, done) if not d]
    out = list(lines)
    for k, a, turn in zip(long, bearings, turns):
        x, y = lines[k]
        d = np.hypot(np.diff(x), np.diff(y))
        b = a[0] + np.concatenate([[0.0], np.cumsum(turn)])
        px, py = x[0] + np.concatenate([[0.0], np.cumsum(d * np.cos(b))]), y[0] + np.concatenate([[0.0], np.cumsum(d * np.sin(b))])
        t = np.linspace(0, 1, len(px))
        out[k] = px + t * (x[-1] - px[-1]), py + t * (y[-1] - py[-1])
    return out


def whittaker(z: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Minimises sum (z - v)^2 + sum penalty * (second difference of v)^2 by a solve within five bands."""
    n = len(z)
    if n < 3:
        return z
    p = penalty[1:-1].astype(float)
    bands = np.zeros((3, n))  # of the symmetric matrix: the diagonal and those one and two above it
    bands[0] = 1
    for k, c in enumerate((1.0, -2.0, 1.0)):
        bands[0, k : n - 2 + k] += c * c * p
    bands[1, : n - 2] -= 2 * p
    bands[1, 1 : n - 1] -= 2 * p
    bands[2, : n - 2] += p
    d, one, two = bands[0].tolist(), bands[1].tolist(), bands[2].tolist()
    v = z.astype(float).tolist()
    for i in range(n):  # down
        for k, row in ((1, one), (2, two)):
            if i + k < n:
                share = row[i] / d[i]
                d[i + k] -= share * row[i]
                if k == 1 and i + 2 < n:
                    one[i + 1] -= share * two[i]
                v[i + k] -= share * v[i]
    for i in range(n - 1, -1, -1):  # and up
        v[i] = (v[i] - (one[i] * v[i + 1] if i + 1 < n else 0.0) - (two[i] * v[i + 2] if i + 2 < n else 0.0)) / d[i]
    return np.array(v)


def simplify(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the points that stay when those within the tolerance of the chord are dropped, farthest first."""
    keep, todo = {0, len(x) - 1}, [(0, len(x) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        dx, dy = x[b] - x[a], y[b] - y[a]
        px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
        long = np.hypot(dx, dy)
        off = np.abs(dx * py - dy * px) / long if long > 1e-12 else np.hypot(px, py)
        k = int(off.argmax())
        if off[k] > tolerance:
            m = a + 1 + k
            keep.add(m)
            todo += [(a, m), (m, b)]
    return np.array(sorted(keep))


def monotone_cubic(s: np.ndarray, z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Shape-preserving cubic interpolation with harmonic-mean slopes."""
    h, d = np.diff(s), np.diff(z) / np.diff(s)
    if len(d) == 1:
        return np.interp(at, s, z)
    m = np.zeros(len(s))
    same = d[:-1] * d[1:] > 0
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / d[:-1] + w2 / d[1:]), 0)
    for end, near, far, hn, hf in ((0, d[0], d[1], h[0], h[1]), (-1, d[-1], d[-2], h[-1], h[-2])):
        v = ((2 * hn + hf) * near - hn * far) / (hn + hf)
        m[end] = 0 if v * near <= 0 else 3 * near if near * far <= 0 and abs(v) > abs(3 * near) else v
    i = np.clip(np.searchsorted(s, at, "right") - 1, 0, len(h) - 1)
    t = (at - s[i]) / h[i]
    return (2 * t**3 - 3 * t**2 + 1) * z[i] + (t**3 - 2 * t**2 + t) * h[i] * m[i] + (3 * t**2 - 2 * t**3) * z[i + 1] + (t**3 - t**2) * h[i] * m[i + 1]


def allocate(total: float, weight: np.ndarray, cap: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Shares a total by weight, none above its cap, what is cut off going to the rest."""
    out, free = np.zeros(len(weight)), np.ones(len(weight), bool)
    left = min(total, cap.sum())
    for _ in range(rounds):
        if left <= 1e-9 or not free.any():
            break
        share = np.where(free, weight, 0)
        if share.sum() <= 0:
            share = free.astype(float)
        give = np.minimum(left * share / share.sum(), cap - out)
        out += give
        left -= give.sum()
        free &= cap - out > 1e-9
    return out


def peaks(v: np.ndarray, apart: int, prominence: float) -> np.ndarray:
    """Places of local maxima that stand out by the prominence, the highest first and none closer than `apart`."""
    inner = np.flatnonzero((v[1:-1] > v[:-2]) & (v[1:-1] >= v[2:])) + 1
    out: list[int] = []
    for i in sorted(inner, key=lambda k: (-v[k], k)):
        higher = np.flatnonzero(v > v[i])
        left, right = higher[higher < i], higher[higher > i]
        base = max(v[(left[-1] if len(left) else 0) : i + 1].min(), v[i : (right[0] + 1 if len(right) else len(v))].min())
        if v[i] - base >= prominence and all(abs(i - k) >= apart for k in out):
            out.append(int(i))
    return np.array(sorted(out), int)


def cut_returns(x: np.ndarray, y: np.ndarray, tolerance: float, gap: int) -> np.ndarray:
    """Places that stay when a path that comes back to a point jumps to the last return."""
    keep, i = [], 0
    while i < len(x):
        keep.append(i)
        later = np.flatnonzero(np.hypot(x[i + gap + 1 :] - x[i], y[i + gap + 1 :] - y[i]) <= tolerance)
        i = i + gap + 1 + int(later[-1]) if len(later) else i + 1
    return np.array(keep)


def harmonic_fill(z: np.ndarray, known: np.ndarray, close: float = 1e-9) -> np.ndarray:
    """Unknown cells as the mean of their neighbours, known ones fixed, by conjugate gradients in arrays of the raster's size.

    Without a known cell the raster stays as it is, as do unknown cells that reach none.
    """
    free = ~known
    if not free.any() or not known.any():
        return z

    def around(a):
        p = np.pad(a, 1)
        return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]

    degree = around(np.ones(z.shape))
    applied = lambda u: np.where(free, degree * u - around(u), 0.0)
    u = np.where(free, z[known].mean(), 0.0)
    rest = np.where(free, around(np.where(known, z, 0.0)), 0.0) - applied(u)
    way, size = rest.copy(), float((rest * rest).sum())
    first = size
    for _ in range(20 * max(z.shape) + 1000):
        if size <= close**2 * max(first, 1e-300):
            break
        pushed = applied(way)
        step = size / float((way * pushed).sum())
        u, rest = u + step * way, rest - step * pushed
        last, size = size, float((rest * rest).sum())
        way = rest + size / last * way
    return np.where(known, z, u)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, against the clock, of points (n, 2)."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(q):
        out: list[np.ndarray] = []
        for v in q:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (v[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (v[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def least_rectangle(points: np.ndarray) -> tuple[float, float, float]:
    """Width, height and angle of the smallest rectangle around points, one of its sides on the hull."""
    h = hull(points)
    if len(h) < 3:
        span = h.max(0) - h.min(0)
        return float(np.hypot(*span)), 0.0, float(np.degrees(np.arctan2(span[1], span[0])))
    best = None
    for a, b in zip(h, np.roll(h, -1, 0)):
        t = np.arctan2(b[1] - a[1], b[0] - a[0])
        r = h @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]])
        s = r.max(0) - r.min(0)
        if best is None or s[0] * s[1] < best[0]:
            best = (s[0] * s[1], float(s[0]), float(s[1]), float(np.degrees(t) % 180))
    return best[1:]
