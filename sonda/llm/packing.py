"""Best-fit packing of tokenized documents into sequences of a fixed length.

Documents are encoded, ended by an end id and, only where longer than a sequence, cut into full pieces behind a
first one that may be shorter. The histogram of piece lengths, which has at most one entry for each length, is
packed by bin completion (``bins``); the plan says how many sequences have which filling. Pieces are then numbered
within their length, by prefix sums over hash buckets, and each number has its place in the plan; the rows of a
frequent length are in many buckets, never in one task.

Null and empty texts are the end id alone. Null ids, equal ids and repeated rows are packed like any other rows.
Columns other than id and text are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bins import NODES, pack
from .common import id_text, numbered, per_worker, staged, strings
from .encoding import Encoder

LENGTH = 2048


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """id, key (of the row), piece, start, length, ids_crc32 of every piece, and its ids (little-endian, 32 bits)."""
    rows = id_text(docs, id_col, text_col).withColumn("key", F.xxhash64("id", "text"))
    names = ["id", "key", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches):
        encoder = per_worker(lambda: Encoder(tokenizer), (tokenizer, "<u4"))
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * length
        for batch in batches:
            row, piece, start, size, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(strings(batch.column("text"))):
                b = encoder.ids(text) + end
                at, k = 0, len(b) % step or step
                while at < len(b):
                    part = b[at : at + k]
                    row.append(i)
                    piece.append(piece[-1] + 1 if at else 0)
                    start.append(at // 4)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                    at, k = at + k, step
            take = pa.array(row, pa.int32())
            cols = [batch.column("id").take(take), batch.column("key").take(take), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(ids, pa.binary())] * with_ids], names)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def places(plan) -> dict[str, np.ndarray]:
    """The plan by numbers within a length: numbers from ``first`` on of ``size`` are in sequences from ``sequence``
    on, ``each`` in a sequence, from ``offset`` on. At most one row for each filling and length."""
    done: dict[int, int] = {}
    rows, sequence = [], 0
    for filling, times in plan:
        offset = 0
        for s in sorted(set(filling), reverse=True):
            each = filling.count(s)
            rows.append((s, done.get(s, 0), sequence, each, offset))
            done[s] = done.get(s, 0) + each * times
            offset += each * s
        sequence += times
    rows.sort()
    return dict(zip(("size", "first", "sequence", "each", "offset"), np.array(rows, np.int64).reshape(-1, 5).T))


def packed(parts: DataFrame, length: int = LENGTH, nodes: int = NODES, report: Callable[[int, int], None] | None = None) -> DataFrame:
    """``parts`` (of ``pieces``; staged, as they are read twice) with sequence_id and offset.

    ``report`` gets the number of sequences and the lower bound of any packing.
    """
    spark = parts.sparkSession
    counts = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # one row for each length
    plan, bound = pack(counts, length, nodes)
    if report:
        report(sum(n for _, n in plan), bound)
    table = spark.sparkContext.broadcast(places(plan))
    ranked = numbered(parts, "length", ["id", "key", "piece"], F.xxhash64("key", "piece"))
    kept = parts.columns
    names = [*kept, "sequence_id", "offset"]
    shape = T.StructType([*parts.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        t = table.value
        key = t["size"] * (1 << 44) + t["first"]
        for batch in batches:
            size, n = batch.column("length").to_numpy(), batch.column("number").to_numpy()
            i = np.searchsorted(key, size * (1 << 44) + n, "right") - 1
            k = n - t["first"][i]
            new = [t["sequence"][i] + k // t["each"][i], t["offset"][i] + k % t["each"][i] * size]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, new)], names)

    return ranked.mapInArrow(run, shape)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return packed(staged(pieces(docs, tokenizer, length, end_id, id_col, text_col, with_ids), "pieces"), length)


def sequences(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences themselves: sequence_id, n_tokens, ids (array of int). A sequence holds ``length`` pieces at most."""
    got = pack_documents(docs, tokenizer, length, end_id, id_col, text_col)
    rows = got.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    rows = rows.select("sequence_id", F.col("p.ids").alias("ids"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(x), "<u4").astype(np.int32) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "n_tokens", "ids"])

    return rows.mapInArrow(run, "sequence_id bigint, n_tokens bigint, ids array<int>")
