"""Vector expressions."""

from pyspark.sql import functions as F


def dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a):
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def cosine(a, b):
    """Cosine similarity; null for null, unequal in length, or all-zero vectors."""
    return F.when(F.size(a) == F.size(b), F.try_divide(dot(a, b), norm(a) * norm(b)))


def is_valid(a, dim: int):
    """Exactly ``dim`` finite numbers that are not all zero."""
    bad = F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(a) == dim) & ~bad & F.exists(a, lambda x: x != 0)
