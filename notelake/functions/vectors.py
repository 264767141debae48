"""Column expressions on embedding vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantize(v: Column) -> Column:
    """Numbers clamped to [-1, 1], times 127, halves rounded up, as bytes."""
    return F.transform(v, lambda x: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 127 + 0.5).cast("tinyint"))


def dequantize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 127)


def dot(a: Column, b: Column) -> Column:
    """Inner product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shorter length; 0 for an empty or zero vector."""
    n = F.least(F.size(a), F.size(b))
    a, b = F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n <= 0, 0.0).when(size == 0, 0.0).otherwise(dot(a, b) / size)


def is_numeric(v: Column) -> Column:
    """A vector of finite numbers only."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite, F.lit(False))
