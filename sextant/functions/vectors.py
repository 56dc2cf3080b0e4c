"""Vector functions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What euclidean distance gives for vectors of different size: the largest single-precision number.
FLT_MAX = 3.4028234663852886e38


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays."""
    length = F.when(norm(a) == 0, 1.0).otherwise(norm(a))
    # The array of one element binds the length, so that it is computed once and not for each element.
    return F.get(F.transform(F.array(length), lambda n: F.transform(a, lambda x: x.cast("double") / n)), 0)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for vectors that differ in size, are empty or have no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (size == 0), 0.0).otherwise(dot(a, b) / size)


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.when(F.size(a) != F.size(b), FLT_MAX).otherwise(F.sqrt(squared_distance(a, b)))


def distance(metric: str, a: Column, b: Column) -> Column:
    """cosine: 1 - cosine; ip: 1 - dot; l2: squared distance."""
    if metric == "cosine":
        return 1 - cosine_similarity(a, b)
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "l2":
        return squared_distance(a, b)
    raise ValueError(f"unknown metric: {metric}")


def to_similarity(metric: str, distance_: Column) -> Column:
    return F.exp(-distance_) if metric == "l2" else 1 - distance_
