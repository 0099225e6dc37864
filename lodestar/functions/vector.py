"""Vectors as arrays of numbers: products, norms and cosine, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a norm is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 0 where a norm is zero."""
    return F.coalesce(1 - cosine(a, b), F.lit(0.0))


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def stored(a: Column, digits: int = 7) -> Column:
    """The text form of a stored vector: so many significant digits; nine bring single precision back as it was."""
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: F.format_string(f"%.{digits}g", x.cast("double"))), ","), F.lit("]"))
