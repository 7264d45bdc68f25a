"""Vector similarity as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine in double; 0.0 for different lengths, empty or zero vectors; NULL for NULL."""
    size = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    usable = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(usable & (size > 0), _dot(a, b) / size).otherwise(F.lit(0.0))
