"""Vector expressions: dot products, norms, unit vectors. All sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """The dot product over the shorter of two arrays; for unit vectors, their cosine."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return _total(pairs)


def norm(v: Column | str) -> Column:
    """The Euclidean length."""
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalise(v: Column | str, epsilon: float = 1e-12) -> Column:
    """The vector divided by its length; a length up to ``epsilon`` leaves it as it is."""
    length = norm(v)
    return F.when(length <= epsilon, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))
