"""Vectors as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scaled(a: Column) -> Column:
    """A vector of length 1."""
    n = norm(a)
    return F.transform(a, lambda x: F.try_divide(x.cast("double"), n))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def resampled(a: Column, points: int) -> Column:
    """An array interpolated linearly at so many even steps from its first to its last element."""
    last = F.size(a) - 1

    def at(i: Column) -> Column:
        place = i * last / F.lit(max(1, points - 1))
        low = F.floor(place).cast("int")
        high = F.least(low + 1, last)
        share = place - low
        return F.get(a, low) * (1 - share) + F.get(a, high) * share

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def sums(vector: Column, dims: int) -> list[Column]:
    """Aggregates that sum a vector column element by element."""
    return [F.sum(F.get(vector, i).cast("double")).alias(f"s{i}") for i in range(dims)]
