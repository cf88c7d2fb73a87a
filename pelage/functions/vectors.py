"""Vector expressions over ``ARRAY<FLOAT|DOUBLE>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column, eps: float = 1e-12) -> Column:
    """v / max(|v|, eps): a zero vector stays zero."""
    length = F.greatest(l2_norm(v), F.lit(eps))
    return F.transform(_doubles(v), lambda x: x / length)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where either of them has no length."""
    scale = l2_norm(a) * l2_norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    squares = F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))
