"""Vector and score expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def finite(v: Column) -> Column:
    """NaN and infinite components as 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x))


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each query token vector the best dot product, added up."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)


def reciprocal(rank: Column, constant: int = 60) -> Column:
    """Reciprocal-rank weight of a rank from 1."""
    return 1.0 / (rank + constant)


def inverse_frequency(n_docs: Column, frequency: Column) -> Column:
    return F.log((n_docs - frequency + 0.5) / (frequency + 0.5) + 1)


def bm25(idf: Column, tf: Column, length: Column, mean_length: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.greatest(mean_length, F.lit(1.0))))
