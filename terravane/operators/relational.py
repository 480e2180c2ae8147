"""Relational helpers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: list[Column], out: str, value: Column | None = None) -> DataFrame:
    """Adds out: the sum of a value over all rows that come before in the order, or their number without one.

    Rows are dealt out by ranges of the order; sums run within a range, and over the ranges' totals, which are as many as Spark has partitions. Rows that tie
    come in any order, so the order should tell rows apart.
    """
    from .graph import cut

    value = F.lit(1) if value is None else value
    placed = cut(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.select("_range", F.coalesce(F.sum("_total").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.coalesce(F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_within", within).join(F.broadcast(before), "_range").withColumn(out, F.col("_before") + F.col("_within")).drop("_range", "_value", "_within", "_before")


def dictionary_codes(df: DataFrame, value: str, code: str) -> DataFrame:
    """Adds the rank, from 1, of a row's value among the distinct ones."""
    codes = running_total(df.select(value).distinct(), [F.col(value)], code).withColumn(code, (F.col(code) + 1).cast("long"))
    return df.join(codes, df[value].eqNullSafe(codes[value]), "left").drop(codes[value])
