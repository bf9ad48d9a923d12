"""Vector functions over array<double>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_valid(a: Column, dimension: int) -> Column:
    """Of the dimension, finite and not zero."""
    finite = ~F.exists(a, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(a.isNotNull() & (F.size(a) == dimension) & finite & F.exists(a, lambda v: v != 0), F.lit(False))
