"""Vector arithmetic in double precision on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a, b) -> Column:
    """Over the shorter of the two."""
    a, b = _d(a), _d(b)
    n = F.least(F.size(a), F.size(b))
    return _sum(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x * y))


def norm(v) -> Column:
    v = _d(v)
    return F.sqrt(_sum(F.transform(v, lambda x: x * x)))


def cosine(a, b) -> Column:
    """0 where either vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def l2_normalise(v) -> Column:
    n = norm(v)
    return F.when(n == 0, _d(v)).otherwise(F.transform(_d(v), lambda x: x / n))


def rounded(x: Column, places: int) -> Column:
    """Halves away from zero, as SQL engines round doubles; what is rounded to zero keeps its sign (Spark's round drops it)."""
    scale = F.lit(10.0**places)
    return F.signum(x) * (F.round(F.abs(x) * scale) / scale)
