"""Vector maths on array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """dot / (|a| |b|); 0 for a zero norm or when the lengths differ."""
    scale = norm(a) * norm(b)
    usable = (F.size(a) == F.size(b)) & (scale != 0)
    return F.when(usable, dot(a, b) / F.nullif(scale, F.lit(0.0))).otherwise(F.lit(0.0))
