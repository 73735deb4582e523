"""Vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stored vectors are single precision: a cosine has no more reliable digits, so
# ranks are taken on scores rounded to this many, with the id breaking ties.
SCORE_DIGITS = 6


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine of two array columns; null if either has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / F.nullif(norms, F.lit(0.0)))
