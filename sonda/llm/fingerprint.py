"""Fingerprint tables, edited texts and near pairs on Spark; the walk itself is in ``edit``.

Null texts are empty. Ids may be numbers or strings. Rows with a null id come last in the order of ids; equal ids are
ordered by a hash of their texts.
Repeated rows are rows like any other. Columns other than id and text are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, id_text, partitions, slices, sorted_groups, staged
from .components import components
from .edit import bands, fingerprints, likeness, likenesses, padded

SIMILARITY = 0.8
#: Nodes of a band in a block.
BLOCK = 512


def _chunks(texts: pa.Array, most: int):
    _, offsets = buffers(texts)
    yield from slices(offsets, most)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of every row."""
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in _chunks(batch.column("text"), 16 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(fingerprints(texts[a:b]), pa.string())], ["id", "fingerprint"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def _bounds(ids: DataFrame, count: int) -> list:
    """About ``count`` - 1 ids, descending, that part the rows evenly: quantiles of numbers; of other ids, quantiles of a
    sample of ``8 * count`` distinct ones, those of the least hashes."""
    if isinstance(ids.schema["id"].dataType, T.NumericType):
        found = ids.approxQuantile("id", [i / count for i in range(1, count)], 0.1 / count)
    else:
        some = sorted(r["id"] for r in ids.where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(8 * count).collect())
        found = some[8::8]
    return sorted(set(found), reverse=True)


def _passed(bounds: list, x):
    """How many of the descending ``bounds`` are at least ``x``, found in two steps of about the root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    whole = F.size(F.filter(F.lit([p[-1] for p in parts]), lambda b: b >= x))
    found = whole * step + F.coalesce(F.size(F.filter(F.get(F.array(*(F.lit(p) for p in parts)), whole), lambda b: b >= x)), F.lit(0))
    return F.least(F.when(whole == len(parts), F.lit(len(bounds))).otherwise(found), F.lit(len(bounds)))  # the last part may be shorter


def chained(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt in runs of descending ids, each run followed by the row that comes after it (``extra``).

    Columns: run, extra, id, text. After the last row comes the first. Bounds of the runs are quantiles of the
    ids; of the ids alone, the first of each run is found, and that row is also dealt to the run before.
    """
    spark = docs.sparkSession
    rows = id_text(docs, id_col, text_col)
    count = 4 * partitions(spark)
    bounds = _bounds(rows.select("id"), count)
    # runs count up as ids go down; null ids are in the last
    rows = rows.withColumn("run", F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(_passed(bounds, F.col("id"))).cast("int"))
    # at most one row for each run
    hashed = rows.select("run", "id", F.xxhash64("text").alias("h"))
    heads = hashed.groupBy("run").agg(F.max_by(F.struct("id", "h"), F.struct(F.col("id").isNotNull(), "id", F.bitwise_not("h"))).alias("head")).orderBy("run").collect()
    if not heads:
        return rows.select("run", F.lit(False).alias("extra"), "id", "text").where("false")
    used = [r["run"] for r in heads]
    to = [(used[i - 1], r["head"]["id"], r["head"]["h"]) for i, r in enumerate(heads)]
    sent = spark.createDataFrame([(a, b, c) for a, b, c in to], f"to int, hid {rows.schema['id'].dataType.simpleString()}, h bigint")
    extra = rows.join(F.broadcast(sent), rows["id"].eqNullSafe(sent["hid"]) & (F.xxhash64("text") == sent["h"])).dropDuplicates(["to"])
    both = rows.select("run", F.lit(False).alias("extra"), "id", "text").unionByName(extra.select(F.col("to").alias("run"), F.lit(True).alias("extra"), "id", "text"))
    return both.repartition(partitions(spark), "run").sortWithinPartitions("run", "extra", F.col("id").desc_nulls_last(), F.xxhash64("text"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row its fingerprint, and that of its text with the last third taken from the next document.

    Columns: id, n_chars, edited (the text), fingerprint, edited_fingerprint, near_edited, near_next.
    """
    rows = chained(docs, id_col, text_col)
    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches):
        held = None  # the row before, whose next one is still to come
        for batch in batches:
            ids, texts, runs, extras = (batch.column(c).to_pylist() for c in ("id", "text", "run", "extra"))
            for a, b in _chunks(batch.column("text"), 16 << 20):
                prints = fingerprints(texts[a:b])
                out, edited = [], []
                for i in range(a, b):
                    if held is not None and held[0] == runs[i]:
                        old, k = held[2], len(held[2]) // 3
                        edited.append(old[: len(old) - k] + texts[i][:k])
                        out.append([held[1], len(old), held[3], prints[i - a]])
                    held = None if extras[i] else (runs[i], ids[i], texts[i], prints[i - a])
                if not out:
                    continue
                new = fingerprints(edited)
                cols = [[o[0] for o in out], [o[1] for o in out], [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], [o[2] for o in out], new, [likeness(o[2], e) for o, e in zip(out, new)], [likeness(o[2], o[3]) for o in out]]
                kinds = [batch.column("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed("id", id_col)


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", count: int = 12, bits: int = 8, block: int = BLOCK) -> DataFrame:
    """One row per row: id and class_id, the least id of its class of fingerprints with likeness ``similarity`` or more.

    Equal fingerprints are one node. All pairs of nodes that share a band are verified by likeness, and linked nodes
    form classes. A band is dealt over blocks of about ``block`` nodes, and each task holds the pairs of two blocks, so
    no band is gathered, but its work is the square of its size. A link is lost only where two share no band.
    """
    spark = docs.sparkSession
    prints = staged(with_fingerprints(docs, id_col, text_col).withColumnRenamed(id_col, "id"), "prints")
    nodes = prints.groupBy("fingerprint").agg(F.min("id").alias("id")).where("id is not null")

    def banded(batches):
        for batch in batches:
            f = batch.column("fingerprint").to_pylist()
            b = [bands(x, count, bits) for x in f]
            yield pa.RecordBatch.from_arrays([pa.array([y for x in b for y in x], pa.int64()), pa.array([f[i] for i, x in enumerate(b) for _ in x], pa.string())], ["band", "fingerprint"])

    rows = staged(nodes.select("fingerprint").mapInArrow(banded, "band bigint, fingerprint string").dropDuplicates(), "bands")
    sizes = rows.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(sizes, "band").withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    cells = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fingerprint")
    cells = cells.repartition(partitions(spark), "band", "i", "j").sortWithinPartitions("band", "i", "j", "fingerprint")

    def edges(batches):
        for t in sorted_groups(batches, ["band", "i", "j"]):
            band, i, j, at = (t.column(c).to_numpy() for c in ("band", "i", "j", "block"))
            f = t.column("fingerprint").to_pylist()
            new = np.flatnonzero((band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            a, b = [], []
            for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(f)]):
                group = padded(f[lo:hi])
                left, right = np.flatnonzero(at[lo:hi] == i[lo]), np.flatnonzero(at[lo:hi] == j[lo])
                for x in left.tolist():
                    to = right[right > x] if i[lo] == j[lo] else right
                    hit = to[likenesses(x, to, group) >= similarity]
                    a += [f[lo + x]] * len(hit)
                    b += [f[lo + y] for y in hit.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])

    found = components(cells.mapInArrow(edges, "a string, b string").distinct())
    known = nodes.join(found, nodes["fingerprint"] == found["node"], "left").select("fingerprint", "id", F.coalesce("root", "fingerprint").alias("root"))
    named = known.join(known.groupBy("root").agg(F.min("id").alias("class_id")), "root").select("fingerprint", "class_id")
    return prints.join(named, "fingerprint", "left").select(F.col("id").alias(id_col), "class_id")
