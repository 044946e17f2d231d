"""Vector expressions on ARRAY<FLOAT|DOUBLE> columns, computed in double."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once; inside a lambda an unbound expression runs again per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays zero."""
    return let(
        v,
        lambda u: let(
            norm(u), lambda n: F.when(n > 0, F.transform(u, lambda x: x / n)).otherwise(u)
        ),
    )
