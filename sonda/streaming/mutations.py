"""A stream of mutations applied to a collection, batch by batch and once each.

Rows have ``op`` (insert, update or delete), ``_id`` and ``_doc`` (JSON). All rows of an id are applied one after
another by ``order``, so the outcome doesn't depend on how the stream is cut into batches. A row that can't be applied
is rejected and written, with its reason, to the collection's ``rejected`` folder: an insert of an id that is there, an
update or delete of one that isn't, an unknown op, a null id, a document that the schema or the size limit refuses. A
batch that would exceed the quota raises ``QuotaReached`` and changes nothing. The manifest remembers the last batch of
a stream, so a batch that is replayed changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..errors import QuotaReached, ValidationError
from ..plans.schema import UUID, Schema, checked_point, need
from ..sources import files
from ..sources.collection import REMOVE, Collection, parsed

LIVE = "live"


def _mutated(op: str, state: dict | None, text, pid, schema: Schema, size: int) -> tuple[dict | None, dict]:
    """The document after one mutation (None: deleted) and its indexed values; raises where it can't be applied."""
    need(isinstance(pid, str) and UUID.fullmatch(pid) is not None, f"_id must be a UUID: {pid!r}")
    need(op in ("insert", "update", "delete"), f"unknown op {op!r}")
    need(op != "insert" or state is None, "already exists")
    need(op == "insert" or state is not None, "not found")
    if op == "delete":
        return None, {}
    change = {k: v for k, v in parsed(text, size).items() if k != "_id"}
    new = change if op == "insert" else {k: v for k, v in (state | change).items() if v != REMOVE}
    _, new, indexed = checked_point(schema, new, False)
    need(len(json.dumps(new, ensure_ascii=False).encode()) <= size, f"a point has more than {size} bytes")
    return new, indexed


def _folded(rows: Iterator[tuple], schema: Schema, size: int, seq: int) -> Iterator[tuple]:
    """Rows (id, op, document, order), sorted by id and order, each id's live document first, to rows of the outcome.

    Only the document at hand is held, however many mutations an id has.
    """
    now: object = object()
    state = indexed = None
    there = changed = False

    def done() -> Iterator[tuple]:
        if changed and there:
            yield "gone", None, now, None, seq, *[None] * len(schema)
        if changed and state is not None:
            yield "row", None, now, json.dumps(state, ensure_ascii=False), seq, *(indexed.get(p) for p in schema)

    for pid, op, text, _ in rows:
        key = pid.lower() if isinstance(pid, str) else None
        if key != now or key is None:
            yield from done()
            now, state, indexed, there, changed = key, None, {}, False, False
        if op == LIVE:
            state, there = json.loads(text), True
            continue
        try:
            state, indexed = _mutated(op, state, text, key, schema, size)
            changed = True
        except ValidationError as e:
            yield "rejected", f"{op}: {e}", key, text if isinstance(text, str) else None, seq, *[None] * len(schema)
    yield from done()


def apply_batch(collection: Collection, batch: DataFrame, epoch: int, stream: str, order: str = "order") -> None:
    """Fold a batch over the live rows of its ids, and commit one part and one set of tombstones."""
    m = collection.manifest
    if m["epochs"].get(stream, -1) >= epoch:
        return
    spark, seq, schema, size = collection.spark, m["seq"] + 1, collection.schema, collection.plan.max_point_size
    kind = batch.schema[order].dataType.simpleString()
    changes = batch.select(F.lower("_id").alias("_id"), F.coalesce("op", F.lit("null")).alias("op"), "_doc", F.col(f"`{order}`").alias("at"))
    # a stream's own mark of a live row is no op
    changes = changes.withColumn("op", F.when(F.col("op") == LIVE, F.lit("op live")).otherwise(F.col("op")))
    live = collection.df().select("_id", "_doc").join(changes.select("_id").distinct(), "_id", "left_semi")
    live = live.select("_id", F.lit(LIVE).alias("op"), "_doc", F.lit(None).cast(kind).alias("at"))
    rows = changes.unionByName(live).withColumn("last", F.col("op") != LIVE).repartition("_id")
    rows = rows.sortWithinPartitions("_id", "last", "at", "op", "_doc").select("_id", "op", "_doc", "at")
    shape = T.StructType([T.StructField("kind", T.StringType()), T.StructField("reason", T.StringType()), *collection.base.fields])

    def run(batches):
        import pandas as pd

        each = (r for pdf in batches for r in zip(pdf["_id"], pdf["op"], pdf["_doc"], pdf["at"]))
        out: list[tuple] = []
        for r in _folded(each, schema, size, seq):
            out.append(r)
            if len(out) == 1000:
                yield pd.DataFrame(out, columns=shape.names, dtype=object)
                out = []
        yield pd.DataFrame(out, columns=shape.names, dtype=object)

    name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
    work = f"{collection.path}/work/{name}"
    rows.mapInPandas(run, shape).write.partitionBy("kind").parquet(work)
    got = spark.read.schema(shape).parquet(work)
    count = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    n_new, n_gone = count.get("row", 0), count.get("gone", 0)
    if m["count"] + n_new - n_gone > collection.plan.max_points:
        files.remove(spark, work)
        raise QuotaReached(f"{m['count']} + {n_new} - {n_gone} points are more than {collection.plan.max_points}")
    change = {"seq": seq, "count": m["count"] + n_new - n_gone, "epochs": m["epochs"] | {stream: epoch}}
    if n_new:
        collection._write(got.where("kind = 'row'").select(*(F.col(f"`{n}`") for n in collection.base.names)), name, collection.fits(m), n_new <= 10_000)
        change |= collection._with_part(m, name, n_new)
    if n_gone:
        got.where("kind = 'gone'").select("_id", "_seq").write.parquet(f"{collection.path}/tombstones/{name}")
        change |= {"tombstones": [*m["tombstones"], name], "dead": m["dead"] + n_gone}
    if count.get("rejected", 0):
        got.where("kind = 'rejected'").select("_id", "reason", "_doc").write.parquet(f"{collection.path}/rejected/{name}")
    collection._commit(m | change)
    files.remove(spark, work)
    collection._upkeep()


def rejected(collection: Collection) -> DataFrame:
    """(_id, reason, _doc) of all mutations that were rejected."""
    names = files.children(collection.spark, f"{collection.path}/rejected")
    if not names:
        return collection.spark.createDataFrame([], "_id string, reason string, _doc string")
    return collection.spark.read.parquet(*(f"{collection.path}/rejected/{n}" for n in names))


def apply_stream(collection: Collection, stream: DataFrame, checkpoint: str, name: str = "mutations", order: str = "order") -> StreamingQuery:
    """Start applying a streaming frame to the collection."""
    writer = stream.writeStream.foreachBatch(lambda df, epoch: apply_batch(collection, df, epoch, name, order))
    return writer.option("checkpointLocation", checkpoint).start()
