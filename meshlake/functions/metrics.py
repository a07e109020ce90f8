"""Dissimilarities of two feature arrays, as column expressions inside the JVM.

Names and definitions are those of the usual numerical libraries. A quotient with a
zero denominator is null (jaccard and canberra: 0, as defined there).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(u: Column, v: Column, term) -> Column:
    """Sum of term(x, y) over the entries of two arrays."""
    return F.aggregate(F.zip_with(u, v, term), F.lit(0.0), lambda acc, x: acc + x)


def array_sum(u: Column) -> Column:
    return F.aggregate(u, F.lit(0.0), lambda acc, x: acc + x)


def flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def bound(value: Column, use) -> Column:
    """use(value), with the value worked out once a row and not wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scaled(u: Column) -> Column:
    """Entries divided by their sum (null entries where that is 0)."""
    return bound(array_sum(u), lambda s: F.transform(u, lambda x: F.try_divide(x, s)))


def centred(u: Column) -> Column:
    return bound(F.try_divide(array_sum(u), F.size(u)), lambda m: F.transform(u, lambda x: x - m))


def of_pair(u: Column, v: Column, metric) -> Column:
    """metric(u, v) of two arrays that are worked out once."""
    return bound(F.struct(u.alias("u"), v.alias("v")), lambda s: metric(s["u"], s["v"]))


def cosine(u: Column, v: Column) -> Column:
    return 1 - F.try_divide(total(u, v, lambda x, y: x * y), F.sqrt(total(u, u, lambda x, y: x * y) * total(v, v, lambda x, y: x * y)))


def jensenshannon(u: Column, v: Column) -> Column:
    """Square root of the mean divergence of two distributions from their mean, natural logarithm."""

    def half(x, y):
        return F.when(x > 0, x * F.ln(F.try_divide(2 * x, x + y))).otherwise(0.0)

    both = of_pair(scaled(u), scaled(v), lambda p, q: total(p, q, lambda x, y: half(x, y) + half(y, x)))
    return F.sqrt(F.greatest(F.lit(0.0), both / 2))


def sqeuclidean(u: Column, v: Column) -> Column:
    return total(u, v, lambda x, y: (x - y) * (x - y))


METRICS = {
    "histogram_intersection": lambda u, v: of_pair(scaled(u), scaled(v), lambda p, q: total(p, q, lambda x, y: F.least(x, y))),
    "braycurtis": lambda u, v: F.try_divide(total(u, v, lambda x, y: F.abs(x - y)), total(u, v, lambda x, y: F.abs(x + y))),
    "canberra": lambda u, v: total(u, v, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))),
    "cityblock": lambda u, v: total(u, v, lambda x, y: F.abs(x - y)),
    "correlation": lambda u, v: of_pair(centred(u), centred(v), cosine),
    "cosine": cosine,
    "euclidean": lambda u, v: F.sqrt(sqeuclidean(u, v)),
    "hamming": lambda u, v: F.try_divide(total(u, v, lambda x, y: flag(x != y)), F.size(u)),
    "jaccard": lambda u, v: F.coalesce(F.try_divide(total(u, v, lambda x, y: flag((x != y) & ((x != 0) | (y != 0)))), total(u, v, lambda x, y: flag((x != 0) | (y != 0)))), F.lit(0.0)),
    "jensenshannon": jensenshannon,
    "minkowski": lambda u, v: F.sqrt(sqeuclidean(u, v)),
    "sqeuclidean": sqeuclidean,
}


def dissimilarity(metric: str, u: Column, v: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}; one of {', '.join(METRICS)}")
    return METRICS[metric](u, v)
