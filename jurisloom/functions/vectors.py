"""Vectors as arrays of floats, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: list[float]) -> Column:
    return F.lit([float(x) for x in vector]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """``a . b / (|a| |b|)``, in [-1, 1]; null where a length is 0 or lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)))


def normalised(a: Column) -> Column:
    """The vector over its length; a zero vector as it is."""
    length = norm(a)
    return F.when(length == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / length))
