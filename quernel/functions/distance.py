"""Vector distances as column expressions, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean")


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """Over the common prefix, if lengths differ."""
    return _sum(F.filter(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), lambda x: x.isNotNull()))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cosine similarity; a zero or empty vector has similarity 0. Different lengths count up to the shorter one."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    scale = norm(x) * norm(y)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).otherwise(F.lit(1.0) - F.when(scale > 0, dot(x, y) / scale).otherwise(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Infinite for empty vectors."""
    squares = F.filter(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y)), lambda x: x.isNotNull())
    return F.when(F.least(F.size(a), F.size(b)) == 0, F.lit(float("inf"))).otherwise(F.sqrt(_sum(squares)))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return cosine(a, b) if metric == "cosine" else euclidean(a, b)
