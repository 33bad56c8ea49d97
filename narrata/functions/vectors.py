"""Vectors as array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def bound(value: Column, use) -> Column:
    """use(value), with value computed once a row even where `use` has it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def unit(a: Column | str) -> Column:
    """Length 1; a zero vector stays."""
    return bound(norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n > 0, n).otherwise(1.0)))


def mean_vector(column: str, width: int) -> Column:
    """An aggregate: the mean of fixed-width vectors, without exploding them."""
    return F.array(*(F.avg(F.col(column)[i].cast("double")) for i in range(width)))
