"""Quantizers: bits by thresholds, product quantization, and the deterministic k-means behind it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import distance as D
from ..plans.schema import Quantizer

FIT_ROWS = 10_000


def mean_thresholds(df: DataFrame, vec: Column) -> DataFrame:
    """(dim, threshold): the mean of each dimension over all vectors."""
    return df.where(vec.isNotNull()).select(F.posexplode(vec).alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("threshold"))


def fit_binary(df: DataFrame, vec: Column, q: Quantizer) -> float | list[float] | None:
    """The thresholds of a binary quantizer; None below its trigger, when vectors are still kept as they are."""
    if q.threshold is not None:
        return q.threshold
    if df.where(vec.isNotNull()).limit(max(1, q.trigger)).count() < max(1, q.trigger):
        return None
    return [r["threshold"] for r in mean_thresholds(df, vec).orderBy("dim").collect()]  # at most 4096 rows


def words_distance(metric: str, code: Column, query: list[int]) -> Column:
    """Hamming or jaccard distance between 64-bit words of ``code`` and of a query."""
    def ones(f) -> Column:
        total = F.lit(0)
        for i, w in enumerate(query):
            total = total + F.bit_count(f(code.getItem(i), F.lit(w).cast("long")))
        return total.cast("double")

    if metric == "hamming":
        return ones(lambda a, b: a.bitwiseXOR(b))
    any_ = ones(lambda a, b: a.bitwiseOR(b))
    return F.when(any_ == 0, 0.0).otherwise(1 - ones(lambda a, b: a.bitwiseAND(b)) / any_)


def packed_query(query, threshold) -> list[int]:
    """The words of ``functions.distance.packed`` of a query vector."""
    on = np.asarray(query, np.float64) > np.asarray(threshold, np.float64)
    bits = np.zeros(-(-len(on) // 64) * 64, bool)
    bits[: len(on)] = on
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def kmeans(x: np.ndarray, k: int, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and labels by Lloyd's rounds, begun at the first row and then always the farthest from those chosen.

    A cluster that empties keeps its centroid; ties go to the lower number; rounds end when no label changes.
    """
    x = np.asarray(x, np.float64)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    centroids = x[chosen].copy()
    labels = np.full(len(x), -1)
    for _ in range(rounds):
        new = ((x[:, None] - centroids[None]) ** 2).sum(2).argmin(1) if len(x) * len(centroids) * x.shape[1] < 5e7 else D.distances("euclidean", x, centroids).argmin(1)
        if (new == labels).all():
            break
        labels = new
        for c in np.unique(labels):
            centroids[c] = x[labels == c].mean(0)
    return centroids, labels


@dataclass
class Product:
    """``books``: of each sub-vector its centroids."""

    books: list[np.ndarray]
    metric: str

    @property
    def width(self) -> int:
        return self.books[0].shape[1]

    def encode(self, vec: Column) -> Column:
        """The number of the nearest centroid of each sub-vector, in batches; null for null."""
        book = self

        @F.pandas_udf("array<int>")
        def codes(v: pd.Series) -> pd.Series:
            full = [i for i, x in enumerate(v) if x is not None]
            out: list = [None] * len(v)
            if full:
                for i, c in zip(full, book.encode_rows(np.stack([v.iloc[i] for i in full]).astype(np.float64)).astype(np.int32)):
                    out[i] = c
            return pd.Series(out, dtype=object)

        return codes(vec)

    def encode_rows(self, x: np.ndarray) -> np.ndarray:
        """The codes of many vectors."""
        return np.stack([D.distances("euclidean", x[:, i * self.width : (i + 1) * self.width], b).argmin(1) for i, b in enumerate(self.books)], 1)

    def asymmetric(self, codes: Column, query) -> Column:
        """Distance of a query to coded vectors: a table of its distance to every centroid, summed up by code."""
        q = np.asarray(query, np.float64)
        # cosine is measured as squared euclidean distance by this quantizer
        metric = "euclidean" if self.metric == "cosine" else self.metric
        table = [D.distances(metric, b, q[None, i * self.width : (i + 1) * self.width])[:, 0].tolist() for i, b in enumerate(self.books)]
        out = F.lit(0.0)
        for i, row in enumerate(table):
            out = out + F.element_at(F.lit(row), codes.getItem(i) + 1)
        return F.when(codes.isNotNull(), out)


    def symmetric(self, a: Column, b: Column) -> Column:
        """Distance between two codes: of the centroids they stand for, from a table for each sub-vector."""
        metric = "euclidean" if self.metric == "cosine" else self.metric
        out = F.lit(0.0)
        for i, book in enumerate(self.books):
            table = F.lit(D.distances(metric, book, book).reshape(-1).tolist())
            out = out + F.element_at(table, a.getItem(i) * len(book) + b.getItem(i) + 1)
        return F.when(a.isNotNull() & b.isNotNull(), out)

    def plain(self) -> list:
        """As lists, to be stored; ``Product.of`` reads them."""
        return [b.tolist() for b in self.books]

    @staticmethod
    def of(plain: list, metric: str) -> Product:
        return Product([np.array(b, np.float64) for b in plain], metric)


def fit_product(df: DataFrame, id_col: str, vec: Column, q: Quantizer, metric: str, rounds: int = 100, rows: int = FIT_ROWS) -> Product | None:
    """Codebooks from the first ``rows`` vectors by id; None below the trigger."""
    sample = df.where(vec.isNotNull()).select(F.col(id_col).alias("i"), vec.alias("v")).orderBy("i").limit(rows).toPandas()
    if len(sample) < max(1, q.trigger):
        return None
    x = np.stack(sample["v"].to_numpy()).astype(np.float64)
    width = x.shape[1] // q.subvectors
    return Product([kmeans(x[:, i * width : (i + 1) * width], q.centroids, rounds)[0] for i in range(q.subvectors)], metric)
