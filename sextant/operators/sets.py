"""Set operations on tables of ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def intersect_all(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.intersect, sets)


def union_all(sets: list[DataFrame]) -> DataFrame:
    """Set union: every id once."""
    return reduce(DataFrame.union, sets).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)
