"""Scalar functions on columns: logistic regression, impurity, vectors, distances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a probability of 0 or 1 counts as in a log-likelihood.
LEAST_PROBABILITY = 4.9e-324
MOST_PROBABILITY = 0.9999999


def logistic(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def classify(p: Column, threshold: float = 0.5) -> Column:
    """1 iff p >= 1 - threshold."""
    return F.floor(p + threshold).cast("int")


def log_likelihood(y: Column, p: Column) -> Column:
    """y ln p + (1 - y) ln(1 - p) with p clamped away from 0 and 1."""
    inside = F.when(p == 0, F.lit(LEAST_PROBABILITY)).when(p == 1, F.lit(MOST_PROBABILITY)).otherwise(p)
    return y * F.log(inside) + (1 - y) * F.log(1 - inside)


def squared_error(y: Column, p: Column) -> Column:
    return F.pow(p - y, F.lit(2))


def gradient_term(y: Column, p: Column, x: Column) -> Column:
    return (p - y) * x


def curvature_term(p: Column, x: Column, other: Column | None = None) -> Column:
    return x * (x if other is None else other) * p * (1 - p)


def logit(p: Column) -> Column:
    return F.log(F.nullif(p, F.lit(0.0)) / F.nullif(1 - p, F.lit(0.0)))


def is_regular(x: Column, allow_zero: bool = False) -> Column:
    fine = ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return fine if allow_zero else fine & (x != 0)


def gini(shares: Column) -> Column:
    return 1.0 - F.aggregate(shares, F.lit(0.0), lambda acc, q: acc + q * q)


def entropy(shares: Column) -> Column:
    return -F.aggregate(shares, F.lit(0.0), lambda acc, q: acc + F.when(q > 0, q * F.log(q)).otherwise(0.0))


def heap_children(node: Column) -> tuple[Column, Column]:
    return 2 * (node + 1) - 1, 2 * (node + 1)


def add_padded(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, factor: Column | float) -> Column:
    return F.transform(a, lambda x: x * factor)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def _total(a: Column, b: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: term(x - y)), F.lit(0.0), lambda acc, v: acc + v)


def distance(name: str, a: Column, b: Column, *, p: float = 3.0, weights: Column | None = None, inverse: list[list[float]] | None = None) -> Column:
    """Distance of two arrays by name; ``p`` is for minkowski, ``weights`` for the weighted ones, ``inverse`` (covariance) for mahalanobis."""
    if name == "squared_euclidean":
        return _total(a, b, lambda d: d * d)
    if name == "cosine":
        return 1.0 - dot(a, b) / F.nullif(norm2(a) * norm2(b), F.lit(0.0))
    if name == "chebyshev":
        return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))
    if name == "euclidean":
        return F.sqrt(_total(a, b, lambda d: d * d))
    if name == "manhattan":
        return _total(a, b, F.abs)
    if name == "mahalanobis":
        if inverse is None:
            raise ValueError("mahalanobis needs the inverse covariance")
        diff = minus(a, b)
        rows = [dot(F.array(*map(F.lit, row)), diff) for row in inverse]
        return F.sqrt(dot(diff, F.array(*rows)))
    if name == "minkowski":
        return F.pow(_total(a, b, lambda d: F.pow(F.abs(d), F.lit(p))), F.lit(1.0 / p))
    if name == "tanimoto":
        both = dot(a, b)
        return 1.0 - both / F.nullif(dot(a, a) + dot(b, b) - both, F.lit(0.0))
    if name in ("weighted_euclidean", "weighted_manhattan"):
        diff = minus(a, b)
        size = F.transform(diff, (lambda d: d * d) if name == "weighted_euclidean" else F.abs)
        total = dot(size, weights) if weights is not None else F.aggregate(size, F.lit(0.0), lambda acc, v: acc + v)
        return F.sqrt(total) if name == "weighted_euclidean" else total
    raise ValueError(f"unknown distance: {name}")


# The codes by which distances are chosen.
DISTANCE_CODES = ("squared_euclidean", "cosine", "chebyshev", "euclidean", "manhattan", "mahalanobis", "minkowski", "tanimoto", "weighted_euclidean", "weighted_manhattan")
