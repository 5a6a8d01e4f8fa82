"""Columns for embeddings held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms."""
    both = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (both > 0)
    return F.when(usable, dot(a, b) / both).otherwise(0.0)


def level_threshold(level: Column, start: float = 0.90, decay: float = 0.05, floor: float = 0.70) -> Column:
    return F.greatest(F.lit(floor), F.lit(start) - F.lit(decay) * level)
