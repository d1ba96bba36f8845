"""Vector functions on arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """The array divided by its length, or itself if that is zero.

    The length is handed in as an array: inside a lambda it would be computed again for every element.
    """
    n = norm(a)
    return F.zip_with(a, F.array_repeat(F.when(n == 0, 1.0).otherwise(n), F.size(a)), lambda x, y: x.cast("double") / y)


def usable(a: Column, dim: int) -> Column:
    """Whether a vector is non-null, of length ``dim`` and not all zero."""
    return F.coalesce((F.size(a) == dim) & F.exists(a, lambda x: x != 0), F.lit(False))
