"""Vector functions over ARRAY columns, in DOUBLE arithmetic whatever the stored type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """A zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def is_valid(a: Column, dim: int) -> Column:
    """Of the right length, without nulls, NaN or infinities."""
    return F.coalesce((F.size(a) == dim) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def is_sparse(indices: Column, values: Column) -> Column:
    """Equal lengths and strictly ascending indices."""
    n = F.size(indices)
    up = F.when(n > 1, F.forall(F.sequence(F.lit(1), n - 1), lambda i: F.get(indices, i - 1) < F.get(indices, i))).otherwise(F.lit(True))
    return F.coalesce((n == F.size(values)) & up, F.lit(False))


def int8_scale(a: Column) -> Column:
    """Largest magnitude over 127; 0 for a zero vector."""
    return F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / F.lit(127.0)


def int8_codes(a: Column) -> Column:
    """Rounded half away from zero, within -127..127."""
    scale = int8_scale(a)
    return F.transform(a, lambda x: F.when(scale > 0, F.least(F.lit(127.0), F.greatest(F.lit(-127.0), F.round(x.cast("double") / scale)))).otherwise(F.lit(0.0)).cast("tinyint"))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda total, x: total + x)


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: the sum over query vectors of the best dot product among the document's vectors."""
    return _sum(F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(document, lambda d: dot(q, d))), F.lit(0.0))))
