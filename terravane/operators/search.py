"""Substring search over labels."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search(items: DataFrame, label: str, sub: str, needles: tuple[str, str], order: str, most: int = 12) -> DataFrame:
    """The first `most` items, in order, whose label or sub-label holds its needle, whatever the case."""
    hit: Column = F.lower(F.col(label)).contains(needles[0].lower()) | F.lower(F.col(sub)).contains(needles[1].lower())
    return items.where(hit).orderBy(order).limit(most)
