"""An index for approximate nearest neighbours: vectors in lists around centroids, so a query reads a few lists only.

Centroids come from k-means over at most ``FIT_ROWS`` vectors, those of the least id hashes; every vector of the
table is then put into the list of its nearest centroid. Stored, the lists are Parquet folders by list number, and
a search reads only the folders it probes. Collections keep the list of a point in a column beside it, for graph-indexed
properties whose schema names ``lists``: inserts go to the nearest list, deletes are tombstones as everywhere, and the
centroids stay as they were fitted. Exact search (``vector``) stays the default; recall is measured by ``recall``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import distance as D
from . import vector
from .quantize import kmeans

FIT_ROWS, ROUNDS = 10_000, 20


def fit(df: DataFrame, id_col: str, vec_col: str, lists: int, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Centroids from at most ``fit_rows`` vectors, those of the least id hashes."""
    sample = df.where(F.col(vec_col).isNotNull()).select(F.xxhash64(id_col).alias("h"), F.col(id_col).alias("i"), F.col(vec_col).alias("v")).orderBy("h", "i").limit(fit_rows).toPandas()
    x = np.stack(sample["v"].to_numpy()).astype(np.float64) if len(sample) else np.zeros((1, 1))
    return kmeans(x, lists, ROUNDS)[0]


def nearest_lists(centroids, metric: str, query: Sequence[float], lists: int) -> list[int]:
    """The numbers of the lists nearest to a query."""
    d = D.distances("euclidean" if metric == "euclidean" else "dot", np.asarray([query], np.float64), np.asarray(centroids, np.float64))[0]
    return np.argsort(d, kind="stable")[:lists].tolist()


def list_of(vec: Column, centroids, metric: str) -> Column:
    """The list of each vector, in batches; null for null."""
    c = np.asarray(centroids, np.float64)

    @F.pandas_udf("int")
    def number(v: pd.Series) -> pd.Series:
        full = v.notna().to_numpy()
        out = pd.Series([None] * len(v), dtype="Int32")
        if full.any():
            out[full] = D.distances("euclidean", np.stack(v[full].to_numpy()).astype(np.float64), c).argmin(1).astype(np.int32)
        return out

    return number(vec)


@dataclass
class Lists:
    """``df``: all rows with their list number in ``list``."""

    df: DataFrame
    id: str
    vec: str
    metric: str
    centroids: np.ndarray

    def probe(self, query: Sequence[float], lists: int) -> list[int]:
        """The numbers of the lists nearest to a query."""
        return nearest_lists(self.centroids, self.metric, query, lists)

    def search(self, query: Sequence[float], k: int, lists: int) -> DataFrame:
        """(id, distance) of the k nearest in the ``lists`` nearest lists."""
        part = self.df.where(F.col("list").isin(self.probe(query, lists)))
        return vector.nearest(part, self.id, D.distance(self.metric, F.col(self.vec), query), k)

    def search_batch(self, queries: DataFrame, query_id: str, query_vec: str, k: int, lists: int) -> DataFrame:
        """(query id, id, distance, rank) of the k nearest of every query in its ``lists`` nearest lists, over one scan.

        Takes as many queries as the driver holds; more are searched in several calls.
        """
        rows = queries.select(query_id, query_vec).orderBy(query_id).toPandas()
        probes = np.array([self.probe(v, lists) for v in rows[query_vec]], np.int64).reshape(len(rows), -1)
        return vector.nearest_batch(self.df, self.id, self.vec, queries, query_id, query_vec, k, self.metric, probed=("list", probes))

    def write(self, path: str) -> Lists:
        """Store the lists, one folder each, and search them from there."""
        self.df.repartition("list").write.partitionBy("list").parquet(path)
        return Lists(self.df.sparkSession.read.parquet(path), self.id, self.vec, self.metric, self.centroids)


def build(df: DataFrame, id_col: str, vec_col: str, lists: int, metric: str = "euclidean", fit_rows: int = FIT_ROWS) -> Lists:
    """Fit the centroids on a bounded sample and assign every row; rows without a vector are in no list."""
    rows = df.where(F.col(vec_col).isNotNull())
    centroids = fit(rows, id_col, vec_col, lists, fit_rows)
    names = rows.columns

    def run(batches):
        for batch in batches:
            v = batch.column(vec_col)
            d = D.distances("euclidean", v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1), centroids) if len(v) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(d.argmin(1).astype(np.int32))], [*names, "list"])

    return Lists(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])), id_col, vec_col, metric, centroids)


def recall(index: Lists, queries: Sequence[Sequence[float]], k: int, lists: int) -> float:
    """The share of the true k nearest of each query that the probed lists give."""
    found = 0
    for q in queries:
        true = {r[0] for r in vector.nearest(index.df, index.id, D.distance(index.metric, F.col(index.vec), q), k).collect()}
        found += len(true & {r[0] for r in index.search(q, k, lists).collect()})
    return found / (k * len(queries))
