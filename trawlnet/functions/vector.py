"""Vector column expressions over ``array<double>`` (or float) columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision; NULL if the lengths differ."""
    products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(left: Column, right: Column) -> Column:
    """Cosine similarity; NULL where a vector has norm zero."""
    return F.try_divide(dot(left, right), l2_norm(left) * l2_norm(right))
