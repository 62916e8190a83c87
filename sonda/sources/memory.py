"""An index over vectors that the driver has at hand: fit them, then query one or many, without a collection on disk."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distance as D
from ..operators import ivf, vector
from ..plans.schema import METRICS, need


class VectorIndex:
    """Vectors by number, 0 and up; exact, or by ``lists`` of which ``probes`` are looked at.

    Vectors of an ``angular`` index are brought to length 1 first, queries too.
    """

    def __init__(self, spark: SparkSession, metric: str = "euclidean", lists: int = 0, probes: int = 0, angular: bool = False):
        need(metric in METRICS, f"unknown distance metric {metric!r}")
        self.spark, self.metric, self.lists, self.angular = spark, metric, lists, angular
        self.probes = probes or -(-3 * lists // 4)
        self.df: DataFrame | None = None
        self.index: ivf.Lists | None = None

    def _unit(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return x / np.where(norm == 0, 1, norm) if self.angular else x

    def _frame(self, x: np.ndarray, name: str) -> DataFrame:
        return self.spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], f"{name} int, v array<double>")

    def fit(self, vectors: Sequence[Sequence[float]]) -> VectorIndex:
        """Take the vectors, in place of those fitted before; they stay in the memory of the executors."""
        if self.df is not None:
            self.df.unpersist()
        self.df = self._frame(self._unit(np.asarray(vectors, np.float64)), "id").persist()
        self.index = None
        if self.lists:
            built = ivf.build(self.df, "id", "v", self.lists, self.metric)
            self.df.unpersist()
            self.df = built.df.persist()
            self.index = ivf.Lists(self.df, "id", "v", self.metric, built.centroids)
        return self

    def query(self, query: Sequence[float], k: int) -> list[int]:
        """The numbers of the k nearest, the nearest first."""
        need(self.df is not None, "the index has no vectors yet")
        q = self._unit(np.asarray([query], np.float64))[0].tolist()
        if self.index:
            return [r["id"] for r in self.index.search(q, k, self.probes).orderBy("distance", "id").collect()]
        return [r["id"] for r in vector.nearest(self.df, "id", D.distance(self.metric, F.col("v"), q), k).orderBy("distance", "id").collect()]

    def query_many(self, queries: Sequence[Sequence[float]], k: int) -> list[list[int]]:
        """``query`` of each, over one scan."""
        need(self.df is not None, "the index has no vectors yet")
        q = self._frame(self._unit(np.asarray(queries, np.float64)), "query")
        q = q.withColumnRenamed("v", "q")
        if self.index:
            got = self.index.search_batch(q, "query", "q", k, self.probes)
        else:
            got = vector.nearest_batch(self.df, "id", "v", q, "query", "q", k, self.metric)
        out: list[list[int]] = [[] for _ in range(len(queries))]
        for r in got.orderBy("query", "rank").collect():
            out[r["query"]].append(r["id"])
        return out
