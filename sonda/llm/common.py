"""Shared folder, staged tables and Arrow helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``). On one machine (local mode) an own one, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="sonda-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sonda-{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors.

    ``release`` deletes the table when nothing reads it any more.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(*tables: DataFrame) -> None:
    """Delete the staged ones of ``tables``, and those that a table names as ``reads``; others are left alone."""
    for t in tables:
        if path := t.__dict__.pop("staged_at", None):
            delete(t.sparkSession, path)
        release(*t.__dict__.pop("reads", ()))


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text (null: empty), so that other columns of any name never clash."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, key: str, order: list[str], spread: Column) -> DataFrame:
    """``number``: gapless from 0 among the rows of each ``key``, which has few values or many rows of one, or both.

    Rows are ranked within (key, bucket of ``spread``); the buckets' sizes are summed up before. No key is sorted in
    one task. ``df`` is read twice and must give the same rows again.
    """
    buckets = 4 * partitions(df.sparkSession)
    at = df.withColumn("__bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    sizes = at.groupBy(key, "__bucket").agg(F.count("*").alias("__n"))
    base = sizes.select(key, "__bucket", (F.sum("__n").over(Window.partitionBy(key).orderBy("__bucket")) - F.col("__n")).alias("__base"))
    place = F.row_number().over(Window.partitionBy(key, "__bucket").orderBy(*order)) - 1
    ranked = at.withColumn("__place", place).join(base, [key, "__bucket"])
    return ranked.select(*df.columns, (F.col("__base") + F.col("__place")).cast("long").alias("number"))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the n + 1 row offsets, without copies."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    if pa.types.is_string(col.type):
        kind = np.int32
    else:
        col, kind = col.cast(pa.large_string()), np.int64
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if off is not None and len(col) else np.zeros(len(col) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes at a time; a longer row goes alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def strings(col: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The strings of a column, of which only so many rows at a time are Python objects."""
    for a in range(0, len(col), rows):
        yield from col.slice(a, rows).to_pylist()


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole key groups from a stream that is sorted by ``keys``; a table holds many small groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            c = batch.column(k)
            if batch.num_rows > 1:
                change[1:] |= ~np.asarray(pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False), bool)
        cuts = np.flatnonzero(change)
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(cuts):
            held.append(batch.slice(0, int(cuts[-1])))
            yield pa.Table.from_batches(held)
            held = [batch.slice(int(cuts[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


_LOADED: dict = {}


def per_worker(make: Callable, key: object):
    """One object for each Python worker, e.g. a loaded tokenizer; another key drops it, so that a worker that serves one
    operator after another doesn't gather the tables of all."""
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def unloaded() -> None:
    """Drop what ``per_worker`` keeps; operators call it that use no such object."""
    _LOADED.clear()
