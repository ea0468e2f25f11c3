"""Vectors as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, digits: int = 9) -> Column:
    """Inner product of unit vectors, within [-1, 1], rounded so that the order of summation doesn't show."""
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))), digits)


def is_unit(a: Column, tolerance: float = 1e-4) -> Column:
    """All numbers finite, and of norm 1."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return finite & (F.abs(norm(a) - 1) <= tolerance)


def l2_normalize(a: Column) -> Column:
    both = F.array(F.struct(a.alias("values"), norm(a).alias("norm")))  # so that the norm is computed once
    return F.transform(both, lambda s: F.transform(s['values'], lambda x: x.cast("double") / s['norm']))[0]
