"""Aggregations with a defined tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def majority(df: DataFrame, keys: list[str], value: str, out: str = "majority") -> DataFrame:
    """The most frequent value of each group, the smallest of those that tie."""
    counts = df.groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.max(F.struct("count", (-F.col(value)).alias("neg"))).alias("m")).select(*keys, (-F.col("m.neg")).alias(out))


def nearest_index_quantile(values: Column, p: float) -> Column:
    """sorted[min(n - 1, floor(p * n))] of an array: not the interpolated percentile."""
    a = F.array_sort(values)
    return F.element_at(a, F.least(F.size(a) - 1, F.floor(F.size(a) * p).cast("int")) + 1)


def weighted_histogram(df: DataFrame, value: Column, weight: Column, width: float) -> DataFrame:
    """bin, summed weight, count and mean weight."""
    return df.groupBy(F.floor(value / width).alias("bin")).agg(F.sum(weight).alias("w"), F.count("*").alias("n")).withColumn("mean", F.col("w") / F.col("n"))


def second_orientation(hist: DataFrame, keys: list[str], angle: str, weight: str, apart: float) -> DataFrame:
    """Of each group the heaviest angle, and the heaviest one at least `apart` degrees from it around a half turn."""
    best = lambda df, name: df.groupBy(*keys).agg(F.max(F.struct(F.col(weight), (-F.col(angle)).alias("neg"))).alias("m")).select(*keys, (-F.col("m.neg")).alias(name))
    first = best(hist, "first")
    gap = F.abs(F.pmod(F.col(angle) - F.col("first") + 90, F.lit(180)) - 90)
    return first.join(best(hist.join(first, keys).where(gap >= apart), "second"), keys, "left")


def block_reduce(cells: DataFrame, size: int, *aggregates: Column) -> DataFrame:
    """Cells of size by size blocks of a raster."""
    return cells.groupBy(F.expr(f"ix div {size}").alias("bx"), F.expr(f"iy div {size}").alias("by")).agg(*aggregates)


def scatter(points: DataFrame, cell: int, *aggregates: Column) -> DataFrame:
    """Points summed into the cells they fall in."""
    return points.groupBy(F.expr(f"x div {cell}").alias("ix"), F.expr(f"y div {cell}").alias("iy")).agg(*aggregates)


def distinct_by_longest(df: DataFrame, name: str, length: str, order: str) -> DataFrame:
    """One row for each name, the longest, then the first."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(name).orderBy(F.desc(length), order))).where("_rn = 1").drop("_rn")


def nth(df: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    """The n-th row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("_rn") == n).drop("_rn")
