"""Vectors of floats as arrays, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, in order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once a row, as the variable of a lambda, however often it occurs."""
    return F.transform(F.array(value), use)[0]


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for vectors of different size or without length."""

    def of(p: Column) -> Column:
        x, y = p["a"], p["b"]
        quotient = _once(norm(x) * norm(y), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(dot(x, y) / n))
        return F.when(F.size(x) != F.size(y), F.lit(0.0)).otherwise(quotient)

    return _once(F.struct(a.alias("a"), b.alias("b")), of)


def unit(a: Column) -> Column:
    """The vector at length one; one without length as it is."""
    return _once(a, lambda v: _once(norm(v), lambda n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))))


def hash_embedding(text: Column, size: int, normalised: bool = True) -> Column:
    """A reproducible stand-in for an embedding: bytes of a SHA-256, repeated, as numbers from -1 to 1."""
    raw = _once(F.sha2(text, 256), lambda h: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.conv(F.substring(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * 2.0 - 1.0))
    return unit(raw) if normalised else raw


def is_valid(a: Column) -> Column:
    """Neither empty nor with a value that isn't a finite number."""
    return (F.size(a) > 0) & ~F.exists(a, lambda x: F.isnan(x) | (F.abs(x) == float("inf")) | x.isNull())
