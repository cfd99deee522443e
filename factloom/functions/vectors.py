"""Vector expressions on array columns, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("l2", "cosine", "dot")


def fit_dimension(v: Column, dim: int) -> Column:
    """Pad with zeros or cut to ``dim`` numbers."""
    padded = F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim))
    return F.when(F.size(v) == dim, v).otherwise(F.slice(padded, 1, dim))


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def distance(a: Column, b: Column, metric: str) -> Column:
    """``l2`` is the squared sum, ``cosine`` 1 - similarity, ``dot`` 1 - product."""
    if metric == "l2":
        squares = F.zip_with(
            a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))
        )
        return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)
    if metric == "cosine":
        return F.lit(1.0) - F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    if metric == "dot":
        return F.lit(1.0) - _dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; use one of {METRICS}")


def score(d: Column, metric: str) -> Column:
    if metric == "cosine":
        return F.lit(1.0) - d
    if metric == "l2":
        return F.lit(1.0) / (F.lit(1.0) + d)
    return d
