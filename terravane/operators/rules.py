"""Data-quality rules: each is a frame of issues (kind, severity, x, y, msg, ref); reports are their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["kind", "severity", "x", "y", "msg", "ref"]


def issues(df: DataFrame, kind: str, severity: str, ref, msg: Column, x=None, y=None, where: Column | str | None = None) -> DataFrame:
    """The rows of df that break a rule, as issues."""
    bad = df if where is None else df.where(where)
    at = [F.lit(None).cast("double") if v is None else F.round((F.col(v) if isinstance(v, str) else v).cast("double"), 1) for v in (x, y)]
    return bad.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), at[0].alias("x"), at[1].alias("y"), msg.alias("msg"), (F.col(ref) if isinstance(ref, str) else ref).cast("string").alias("ref"))


def first_of(table: list[tuple[str, str | None]]) -> Column:
    """What stands beside the first condition of a table that holds; null if none does, or if null stands there."""
    found = F.array(*[F.struct(F.expr(condition).alias("holds"), F.lit(value).cast("string").alias("value")) for condition, value in table])
    return F.get(F.filter(found, lambda r: r["holds"]), 0)["value"]


def report(*rules: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), rules)


def summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def strict(found: DataFrame) -> DataFrame:
    """The summary; a query on it fails if any issue is an error (Q24)."""
    total = summary(found).agg(F.sum(F.when(F.col("severity") == "error", F.col("n"))).alias("errors"))
    return total.select(F.when(F.coalesce("errors", F.lit(0)) > 0, F.raise_error(F.concat(F.lit("errors: "), F.col("errors").cast("string"))).cast("long")).otherwise(F.lit(0).cast("long")).alias("errors"))


def gate(found: DataFrame) -> DataFrame:
    """errors and the exit code that a strict run ends with: 1 if any issue is an error, else 0 (Q24)."""
    errors = F.count_if(F.col("severity") == "error")
    return found.agg(errors.alias("errors")).withColumn("exit_code", (F.col("errors") > 0).cast("long"))


def unique(df: DataFrame, key: str) -> DataFrame:
    """df itself; a query on it fails if a key occurs twice."""
    twice = df.groupBy(key).count().where("count > 1").agg(F.min(key).alias("k"))
    check = twice.select(F.when(F.col("k").isNotNull(), F.raise_error(F.concat(F.lit("duplicate key "), F.col("k").cast("string"))).cast("boolean")).otherwise(F.lit(True)).alias("_ok"))
    return df.crossJoin(F.broadcast(check)).where("_ok").drop("_ok")
