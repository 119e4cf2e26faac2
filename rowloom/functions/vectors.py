"""Vector arithmetic on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    product = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column, left_norm: Column | None = None, right_norm: Column | None = None) -> Column:
    """Cosine similarity; a zero vector is similar to nothing (0). Pass norms that are known already."""
    scale = (norm(left) if left_norm is None else left_norm) * (norm(right) if right_norm is None else right_norm)
    return F.when(scale > 0, dot(left, right) / scale).otherwise(F.lit(0.0))
