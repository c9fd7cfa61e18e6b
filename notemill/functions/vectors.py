"""Vectors as arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector of length 1 in the same direction; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: F.try_divide(x, n)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))
