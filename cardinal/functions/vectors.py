"""Functions on array<double> columns. A zero vector has no direction: its cosine is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def unit(a: Column) -> Column:
    """The vector at length 1; null for a zero vector."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda v: v / length))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column, signed: bool = True) -> Column:
    """1 - s, or 1 - |s| if not signed, where s is the cosine similarity."""
    lengths = norm(a) * norm(b)
    s = F.when(lengths > 0, dot(a, b) / lengths)
    return 1 - (s if signed else F.abs(s))


def finite(a: Column) -> Column:
    return F.forall(a, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
