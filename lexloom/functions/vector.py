"""Vector scalars as column expressions (double arithmetic whatever the element type)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in array order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a norm is 0, or if the vectors can't be compared (null, other length)."""
    bottom = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (bottom == 0), F.lit(0.0)).otherwise(F.coalesce(dot(a, b) / bottom, F.lit(0.0)))


def unit(a: Column) -> Column:
    """The vector scaled to norm 1 (a zero vector stays), so that cosine becomes a plain inner product."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))
