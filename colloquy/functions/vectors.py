"""Vector functions over ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def relevance(distance: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance))


def unit(a: Column) -> Column:
    """``a`` of length 1. The length is a lambda's variable, as it would be computed for each component otherwise."""
    of = lambda n: F.when(n == 0, doubles(a)).otherwise(F.transform(doubles(a), lambda x: x / n))
    return F.element_at(F.transform(F.array(norm(a)), of), 1)


def literal(values: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])
