"""Nearest-neighbour ranking: exact top-k for one query, and for batches of queries in one pass."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import distance as D
from ..plans.schema import Index
from .quantize import fit_binary, fit_product


def measured(df: DataFrame, id_col: str, vec: Column, index: Index, query: Sequence[float]) -> Column:
    """The distance column of an indexed property: by bits, product codes or the vectors themselves."""
    q = index.quantizer
    if index.metric in D.BITS:  # bits at one half, whatever the quantizer
        return D.distance(index.metric, vec, query)
    if q.kind == "binary":
        threshold = fit_binary(df, vec, q)
        return D.distance(index.metric, vec, query) if threshold is None else D.distance(q.metric, vec, query, threshold)
    if q.kind == "product":
        book = fit_product(df, id_col, vec, q, index.metric)
        if book is None:
            return D.distance("euclidean" if index.metric == "cosine" else index.metric, vec, query)
        return F.when(vec.isNotNull(), book.asymmetric(book.encode(vec), query))
    return D.distance(index.metric, vec, query)


def nearest(df: DataFrame, id_col: str, dist: Column, k: int) -> DataFrame:
    """(id, distance) of the k nearest; ties go to the lower id. One pass, k rows kept in each task."""
    rows = df.select(F.col(id_col), dist.alias("distance")).where(F.col("distance").isNotNull())
    return rows.orderBy("distance", id_col).limit(k)


#: Numbers in the table of distances that a task holds at a time, whatever the number of queries.
CELLS = 4 << 20


def _best(d: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` least of each row of ``d``, in order; ties go to the lower of ``ids``."""
    if d.shape[1] > k:
        part = np.argpartition(d, k - 1, axis=1)[:, :k]
        last = np.take_along_axis(d, part, 1).max(1)
        tied = np.flatnonzero((d <= last[:, None]).sum(1) > k)
        for r in tied.tolist():
            at = np.flatnonzero(d[r] <= last[r])
            part[r] = at[np.lexsort((ids[r, at], d[r, at]))[:k]]
    else:
        part = np.broadcast_to(np.arange(d.shape[1]), d.shape)
    order = np.lexsort((np.take_along_axis(ids, part, 1), np.take_along_axis(d, part, 1)), axis=1)
    return np.take_along_axis(part, order, 1)


def nearest_batch(df: DataFrame, id_col: str, vec_col: str, queries: DataFrame, query_id: str, query_vec: str, k: int, metric: str = "euclidean", block: int = 1024, most_bytes: int = 16 << 20, probed: tuple[str, np.ndarray] | None = None) -> DataFrame:
    """(query id, id, distance, rank) of the k nearest of every query vector, over one scan of ``df``.

    The queries are counted, then sent to all tasks; each task multiplies blocks of its vectors with all of them and
    keeps k rows for each query, and a window over those picks the k best. Queries of more than ``most_bytes`` in all
    are taken in blocks, each with its own scan; a block of rows is so small that its distances have ``CELLS`` numbers.

    ``probed``: the column of list numbers, and of each query, in the order of ids, the lists it looks at.
    """
    spark = df.sparkSession
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size(query_vec) * 8), F.lit(0))).first()
    if size > most_bytes and n > 1 and probed is None:
        parts = min(n, -(-size // most_bytes))
        split = [queries.where(F.pmod(F.xxhash64(query_id), F.lit(parts)) == p) for p in range(parts)]
        out = [nearest_batch(df, id_col, vec_col, p, query_id, query_vec, k, metric, block, size) for p in split]
        whole = out[0]
        for o in out[1:]:
            whole = whole.unionByName(o)
        return whole
    got = queries.select(query_id, query_vec).orderBy(query_id).toPandas()
    ids, q = got[query_id].tolist(), np.stack(got[query_vec].to_numpy()).astype(np.float64) if n else np.zeros((0, 0))
    looks = None
    if probed is not None:
        looks = np.zeros((len(ids), int(probed[1].max(initial=0)) + 1), bool)
        np.put_along_axis(looks, probed[1], True, 1)
    shared = spark.sparkContext.broadcast((ids, q, looks))
    id_type, q_type = df.schema[id_col].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    kinds = [to_arrow_type(queries.schema[query_id].dataType), to_arrow_type(df.schema[id_col].dataType), pa.float64()]
    numbers = pa.types.is_integer(kinds[1])
    columns = [id_col, vec_col, *([probed[0]] if probed else [])]

    def run(batches):
        names, qs, lists = shared.value
        best_d = np.full((len(names), 0), np.inf)
        best_i = np.empty((len(names), 0), np.int64 if numbers else object)
        step = max(1, min(block, CELLS // max(1, len(names))))
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                part = part.filter(part.column(vec_col).is_valid())
                if not part.num_rows or not len(names):
                    continue
                x = part.column(vec_col).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                row_ids = part.column(id_col).to_numpy() if numbers else np.array(part.column(id_col).to_pylist(), object)
                d = D.distances(metric, x, qs).T
                if lists is not None:
                    at = part.column(probed[0]).to_numpy()
                    d = np.where(lists[:, np.minimum(at, lists.shape[1] - 1)] & (at < lists.shape[1]), d, np.inf)
                d = np.concatenate([best_d, d], 1)
                i = np.concatenate([best_i, np.broadcast_to(row_ids, (len(names), len(row_ids)))], 1)
                top = _best(d, i, k)
                best_d, best_i = np.take_along_axis(d, top, 1), np.take_along_axis(i, top, 1)
        who, place = np.nonzero(np.isfinite(best_d))
        yield pa.RecordBatch.from_arrays([pa.array([names[a] for a in who.tolist()], kinds[0]), pa.array(best_i[who, place].tolist(), kinds[1]), pa.array(best_d[who, place])], ["query", "neighbour", "distance"])

    found = df.select(*columns).mapInArrow(run, f"query {q_type}, neighbour {id_type}, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(query_id), F.col("neighbour").alias(id_col), "distance", "rank")


def normalised(vec: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(vec, lambda x: x.cast("double"))).otherwise(F.transform(vec, lambda x: x.cast("double") / norm))
