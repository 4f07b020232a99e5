"""Scalar numeric and vector functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Security levels from open to strict.
LEVELS = ("public", "internal", "confidential", "restricted")


def level_rank(c: Column | str) -> Column:
    """Rank of a security level, null for an unknown one."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.when(c == LEVELS[0], 0)
    for i, name in enumerate(LEVELS[1:], 1):
        out = out.when(c == name, i)
    return out


def level_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), c + 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity; 0 for empty vectors, different lengths and zero norms."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == 0) | (F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def backoff(attempt: Column, base: float, cap: float, jitter: float = 0.0, noise: Column | None = None) -> Column:
    """exponential delay before an attempt, up to a share ``jitter`` longer or shorter, by ``noise`` (0 to 1; random, if not given)."""
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1), F.lit(cap))
    return delay if not jitter else delay * (1 + jitter * (2 * (F.rand() if noise is None else noise) - 1))


def vector_fault(c: Column, dimension: int) -> Column:
    """why a vector can't be stored (null: it can)."""
    return (
        F.when(c.isNull(), "missing")
        .when(F.size(c) != dimension, "dimension")
        .when(F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
    )


def bounding_box(xs: Column, ys: Column) -> Column:
    """least and largest coordinates of a polygon."""
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
