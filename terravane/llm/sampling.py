"""Bounded samples of labelled rows, for fitting classifiers only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

_UNIT = 1 << 30


def balanced(rows: DataFrame, label: str, key: str, per_class: int, most: int = 500) -> DataFrame:
    """About per_class rows of each of the `most` most frequent labels, or all if there are fewer; which ones depends on the hash of key alone.

    The expected size is at most per_class times `most`, whatever the size of rows and the number of labels. Rows without a label or key don't count.
    """
    n = fresh(rows, "n")
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias(n)).orderBy(F.desc(n), label).limit(most)
    place = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(_UNIT))
    # at most `most` rows are sent to all tasks
    return rows.where(F.col(key).isNotNull()).join(F.broadcast(counts), label).where(place * F.col(n) < F.lit(per_class * _UNIT)).select(*rows.columns)
