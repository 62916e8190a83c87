"""Distances between an array column and a query vector, as column expressions and as NumPy twins for batches.

``euclidean`` is squared, ``dot`` is negated, ``cosine`` doesn't normalise, ``haversine`` is in metres between
[latitude, longitude] in degrees; ``hamming`` and ``jaccard`` compare bits (elements above a threshold).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6_371_000.0
BIT = 0.5


def vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]).cast("array<double>")


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def inner(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def euclidean(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))


def haversine(a: Column, b: Column) -> Column:
    lat_a, lon_a, lat_b, lon_b = (F.radians(c.getItem(i).cast("double")) for c in (a, b) for i in (0, 1))
    s, t = F.sin((lat_b - lat_a) / 2), F.sin((lon_b - lon_a) / 2)
    h = s * s + F.cos(lat_a) * F.cos(lat_b) * t * t
    return 2 * EARTH * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bits(a: Column, threshold: float | Sequence[float] = BIT) -> Column:
    """Booleans: element above the threshold, one for all or one for each place."""
    if isinstance(threshold, (int, float)):
        return F.transform(a, lambda x: x > F.lit(float(threshold)))
    return F.zip_with(a, vector(threshold), lambda x, t: x.cast("double") > t)


def hamming(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.when(x != y, 1.0).otherwise(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    both = _sum(F.zip_with(a, b, lambda x, y: F.when(x & y, 1.0).otherwise(0.0)))
    any_ = _sum(F.zip_with(a, b, lambda x, y: F.when(x | y, 1.0).otherwise(0.0)))
    return F.when(any_ == 0, 0.0).otherwise(1 - both / any_)


FLOAT: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "dot": lambda a, b: -inner(a, b), "cosine": lambda a, b: 1 - inner(a, b), "haversine": haversine}
BITS: dict[str, Callable[[Column, Column], Column]] = {"hamming": hamming, "jaccard": jaccard}


def distance(metric: str, a: Column, query: Sequence[float], threshold: float | Sequence[float] = BIT) -> Column:
    """``metric`` between a column and a query vector; null where the column is."""
    q = vector(query)
    if metric in FLOAT:
        return FLOAT[metric](a, q)
    return BITS[metric](bits(a, threshold), bits(q, threshold))


def packed(a: Column, size: int, threshold: float | Sequence[float] = BIT) -> Column:
    """Bits in 64-bit words, the first element lowest."""
    on = bits(a, threshold)
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(min(64, size - 64 * w) - 1)), F.lit(0).cast("long"), lambda s, i: s.bitwiseOR(F.when(F.element_at(on, i + 64 * w + 1), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return F.array(*(word(w) for w in range(-(-size // 64))))


def distances(metric: str, x: np.ndarray, q: np.ndarray, threshold: float = BIT) -> np.ndarray:
    """All distances of the rows of ``x`` to the rows of ``q``."""
    if metric == "euclidean":
        return np.maximum(0, (x * x).sum(1)[:, None] - 2 * (x @ q.T) + (q * q).sum(1)[None])
    if metric in ("dot", "cosine"):
        return (1.0 if metric == "cosine" else 0.0) - x @ q.T
    if metric == "haversine":
        a, b = np.radians(x)[:, None], np.radians(q)[None]
        s, t = np.sin((b[..., 0] - a[..., 0]) / 2), np.sin((b[..., 1] - a[..., 1]) / 2)
        return 2 * EARTH * np.arcsin(np.sqrt(np.minimum(1, s * s + np.cos(a[..., 0]) * np.cos(b[..., 0]) * t * t)))
    xb, qb = (x > threshold).astype(np.float64), (q > threshold).astype(np.float64)
    both = xb @ qb.T
    if metric == "hamming":
        return xb.sum(1)[:, None] + qb.sum(1)[None] - 2 * both
    union = xb.sum(1)[:, None] + qb.sum(1)[None] - both
    return np.where(union == 0, 0.0, 1 - both / np.maximum(union, 1))
