"""Collections of schemaless documents in a folder that Spark can write to.

A collection is a manifest and the immutable Parquet parts it names. A row has the document as JSON, one typed
column for each indexed path, and what the indexes derive from them when the part is written: codes of quantized
vectors, list numbers of approximate indexes, and the number of terms of texts, whose postings are a table beside the
part, sorted by term. Quantizers and lists are fitted once, when the collection first has enough points, and kept;
the parts that were there already are then written anew, and later points don't move them.

Inserts add a part; deletes add tombstones; an update is a tombstone and a part. The manifest is replaced in one move,
so a reader sees a mutation wholly or not at all; parts of a failed one are never named. Beyond ``Plan.max_parts`` parts the
smaller half of them becomes one, and so do tombstones; ``compact`` writes all live rows anew. One writer at a time.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import AlreadyExists, NotFound, QuotaReached, ValidationError
from ..functions import distance as D
from ..functions.analysis import tokens
from ..operators import ivf, quantize
from ..operators import text as text_ops
from ..plans import compiler
from ..plans.request import Request
from ..plans.schema import SPARK_TYPES, UUID, Index, Schema, checked_point, need, parse_schema
from . import files

REMOVE = "_delete"
BROADCAST_TOMBSTONES = 100_000
#: Lists are fitted when a collection has so many points for each.
LISTS_TRIGGER = 16


@dataclass(frozen=True)
class Plan:
    """What a user may have."""

    max_collections: int = 10
    max_points: int = 1_000_000_000
    max_point_size: int = 1 << 20
    max_parts: int = 64


def column_name(path: str, mark: str = "p") -> str:
    """``p``: the property; ``c``: its codes; ``l``: its list; ``n``: its number of terms."""
    return f"{mark}:" + path.replace(".", ":")


def words_of(index: Index) -> bool:
    """Whether codes are 64-bit words of bits."""
    return index.quantizer.kind == "binary" and index.metric not in D.BITS


def base_type(schema: Schema) -> T.StructType:
    """Documents and indexed properties."""
    out = T.StructType().add("_id", "string").add("_doc", "string").add("_seq", "long")
    for path, index in schema.items():
        out = out.add(column_name(path), SPARK_TYPES[index.kind])
    return out


def table_type(schema: Schema) -> T.StructType:
    """``base_type`` and the derived columns."""
    out = base_type(schema)
    for path, index in schema.items():
        if words_of(index):
            out = out.add(column_name(path, "c"), T.ArrayType(T.LongType()))
        elif index.quantizer.kind == "product":
            out = out.add(column_name(path, "c"), T.ArrayType(T.IntegerType()))
        if index.lists:
            out = out.add(column_name(path, "l"), T.IntegerType())
        if index.kind == "text":
            out = out.add(column_name(path, "n"), T.IntegerType())
    return out


POSTINGS = "path string, term string, _id string, tf int, length int, _seq long"


class Documents(compiler.Source):
    """Documents as JSON: predicates and rankers read the typed columns, selection and sorting the documents.

    With ``fits`` and ``postings`` of a collection, rankers read stored codes, lists and postings.
    """

    def __init__(self, df: DataFrame, schema: Schema, fits: dict | None = None, postings: DataFrame | None = None):
        super().__init__(df, "_id", schema, lambda path: F.col(f"`{column_name(path)}`"))
        self.fits, self.postings = fits or {}, postings

    def distance(self, path: str, query) -> Column:
        index, fit = self.schema[path], self.fits.get(path, {})
        code = F.col(f"`{column_name(path, 'c')}`")
        if "thresholds" in fit:
            got = quantize.words_distance(index.quantizer.metric, code, quantize.packed_query(query, fit["thresholds"]))
            return F.when(code.isNotNull(), got)
        if "books" in fit:
            return F.when(code.isNotNull(), quantize.Product.of(fit["books"], index.metric).asymmetric(code, query))
        if index.quantizer.kind != "none" and index.metric not in D.BITS and column_name(path, "c") in self.df.columns:
            # not fitted yet: vectors as they are
            metric = "euclidean" if index.quantizer.kind == "product" and index.metric == "cosine" else index.metric
            return D.distance(metric, self.of(path), query)
        return super().distance(path, query)

    def probed(self, path: str, query) -> Column | None:
        index, fit = self.schema[path], self.fits.get(path, {})
        if "centroids" not in fit:
            return None
        return F.col(f"`{column_name(path, 'l')}`").isin(ivf.nearest_lists(fit["centroids"], index.metric, query, index.probes))

    def text_scores(self, path: str, query: str, every: bool, within: Column | None, restrict: DataFrame | None) -> DataFrame:
        if self.postings is None:
            return super().text_scores(path, query, every, within, restrict)
        if within is not None:
            restrict = self.df.where(within).select("_id")
        n = self.df.where(F.col(f"`{column_name(path, 'n')}`") > 0).agg(F.count("*"))
        return text_ops.from_postings(self.postings.where(F.col("path") == path), "_id", n, query, every, restrict)

    def payload(self, select: tuple[str, ...]) -> tuple[list[Column], set[str] | None]:
        if not select:
            return [], set()
        if "*" in select:
            return [F.col("_doc")], None

        def build(path: str, sub) -> Column:
            if sub is True:
                return self.at(path, "variant")
            inner = [build(f"{path}.{k}", v).alias(k) for k, v in sub.items()]
            return F.when(self.at(path, "variant").isNotNull(), F.struct(*inner))

        tree = compiler.nested(list(select))
        return [F.to_json(F.struct(*(build(k, v).alias(k) for k, v in tree.items()))).alias("_doc")], set(select)

    def at(self, path: str, kind: str) -> Column:
        steps = "$" + "".join(f"['{p}']" for p in path.replace("'", "").split("."))
        return F.try_variant_get(F.parse_json("_doc"), steps, kind)

    def sort(self, path: str, descending: bool) -> list[Column]:
        """By kind of value first (booleans, numbers, objects, arrays, strings), then by number or string; missing last."""
        value = self.at(path, "variant")
        kind = F.schema_of_variant(value)
        rank = F.when(value.isNull() | (kind == "VOID"), F.lit(None)).when(kind == "BOOLEAN", 1).when(kind.startswith("OBJECT"), 3).when(kind.startswith("ARRAY"), 4).when(kind == "STRING", 5).otherwise(2)
        keys = [rank, F.when(rank == 2, self.at(path, "double")), F.when(rank == 5, self.at(path, "string"))]
        return [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]


def parsed(text, size: int) -> dict:
    """A point from its JSON; raises where it isn't an object or too large."""
    need(isinstance(text, str), "a point is a JSON object, not null")
    need(len(text.encode()) <= size, f"a point has more than {size} bytes")
    try:
        point = json.loads(text)
    except ValueError as e:
        raise ValidationError(f"a point is not JSON: {e}") from e
    need(isinstance(point, dict), "a point is an object")
    return point


class Collection:
    """One collection of a user; made by a ``Catalog``."""

    def __init__(self, spark: SparkSession, path: str, plan: Plan):
        self.spark, self.path, self.plan = spark, path, plan
        self.meta = json.loads(files.read_text(spark, f"{path}/meta.json"))
        self.schema = parse_schema(self.meta["schema"])
        self.type, self.base = table_type(self.schema), base_type(self.schema)
        self.texts = [path for path, index in self.schema.items() if index.kind == "text"]

    @property
    def manifest(self) -> dict:
        return json.loads(files.read_text(self.spark, f"{self.path}/manifest.json"))

    def _commit(self, manifest: dict) -> None:
        files.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(manifest))

    def fits(self, m: dict | None = None) -> dict:
        """What was fitted: thresholds, books or centroids by path."""
        name = (m or self.manifest).get("fits")
        return json.loads(files.read_text(self.spark, f"{self.path}/{name}")) if name else {}

    def _live(self, rows: DataFrame, m: dict) -> DataFrame:
        """Rows of parts or postings that no tombstone covers."""
        if not m["tombstones"]:
            return rows
        dead = self.spark.read.schema("_id string, _seq long").parquet(*(f"{self.path}/tombstones/{p}" for p in m["tombstones"]))
        dead = dead.groupBy("_id").agg(F.max("_seq").alias("__dead"))
        dead = F.broadcast(dead) if m["dead"] <= BROADCAST_TOMBSTONES else dead
        return rows.join(dead, "_id", "left").where("__dead is null or __dead <= _seq").drop("__dead")

    def df(self) -> DataFrame:
        """All live rows."""
        m = self.manifest
        if not m["parts"]:
            return self.spark.createDataFrame([], self.type)
        return self._live(self.spark.read.schema(self.type).parquet(*(f"{self.path}/parts/{p}" for p in m["parts"])), m)

    def postings(self) -> DataFrame | None:
        """(path, term, _id, tf, length) of all live texts; None where no text is indexed."""
        m = self.manifest
        if not self.texts:
            return None
        if not m["parts"]:
            return self.spark.createDataFrame([], POSTINGS)
        return self._live(self.spark.read.schema(POSTINGS).parquet(*(f"{self.path}/postings/{p}" for p in m["parts"])), m)

    def _derived(self, rows: DataFrame, fits: dict) -> DataFrame:
        """``rows`` of the base columns with the columns that indexes derive."""
        out = rows.select(*(F.col(f"`{n}`") for n in self.base.names))
        for path, index in self.schema.items():
            value, fit = F.col(f"`{column_name(path)}`"), fits.get(path, {})
            if words_of(index) or index.quantizer.kind == "product":
                code = F.lit(None)
                if "thresholds" in fit:
                    code = F.when(value.isNotNull(), D.packed(value, index.size, fit["thresholds"]))
                elif "books" in fit:
                    code = quantize.Product.of(fit["books"], index.metric).encode(value)
                out = out.withColumn(column_name(path, "c"), code.cast(self.type[column_name(path, "c")].dataType))
            if index.lists:
                number = ivf.list_of(value, fit["centroids"], index.metric) if "centroids" in fit else F.lit(None)
                out = out.withColumn(column_name(path, "l"), number.cast("int"))
            if index.kind == "text":
                out = out.withColumn(column_name(path, "n"), F.when(value.isNotNull(), F.size(tokens(value))))
        return out.select(*(F.col(f"`{n}`") for n in self.type.names))

    def _write(self, rows: DataFrame, part: str, fits: dict, small: bool) -> DataFrame:
        """A part of ``rows`` (base columns) and its postings; the part is read back."""
        rows = self._derived(rows, fits)
        listed = [f"`{column_name(path, 'l')}`" for path, index in self.schema.items() if index.lists]
        if small:
            rows = rows.coalesce(1)
        elif listed:
            rows = rows.repartitionByRange(*listed, "_id")
        if listed:  # files know the least and greatest list of each of their groups of rows
            rows = rows.sortWithinPartitions(*listed)
        rows.write.parquet(f"{self.path}/parts/{part}")
        written = self.spark.read.schema(self.type).parquet(f"{self.path}/parts/{part}")
        if self.texts:
            each = None
            for path in self.texts:
                terms = written.select(F.lit(path).alias("path"), F.explode(tokens(F.col(f"`{column_name(path)}`"))).alias("term"), "_id", F.col(f"`{column_name(path, 'n')}`").alias("length"), "_seq")
                terms = terms.groupBy("path", "term", "_id", "length", "_seq").agg(F.count("*").cast("int").alias("tf"))
                each = terms if each is None else each.unionByName(terms)
            each = each.select("path", "term", "_id", "tf", "length", "_seq")
            # by term, so that a query reads few files and groups of rows; the id parts the postings of a frequent term
            each = each.coalesce(1) if small else each.repartitionByRange("path", "term", "_id")
            each.sortWithinPartitions("path", "term").write.parquet(f"{self.path}/postings/{part}")
        return written

    def _drop(self, *parts: str) -> None:
        for p in parts:
            files.remove(self.spark, f"{self.path}/parts/{p}")
            files.remove(self.spark, f"{self.path}/postings/{p}")

    def _fit(self) -> None:
        """Fit, once, what has no fit yet and enough vectors; then all parts are written anew with what it derives."""
        m = self.manifest
        fits, new = self.fits(m), {}
        for path, index in self.schema.items():
            q, column, fit = index.quantizer, F.col(f"`{column_name(path)}`"), fits.get(path, {})
            got: dict = {}
            if words_of(index) and "thresholds" not in fit and (q.threshold is not None or m["count"] >= max(1, q.trigger)):
                found = quantize.fit_binary(self.df(), column, q)
                got |= {} if found is None else {"thresholds": found if isinstance(found, list) else [found] * index.size}
            if q.kind == "product" and "books" not in fit and m["count"] >= max(1, q.trigger):
                book = quantize.fit_product(self.df(), "_id", column, q, index.metric)
                got |= {} if book is None else {"books": book.plain()}
            if index.lists and "centroids" not in fit and m["count"] >= LISTS_TRIGGER * index.lists:
                rows = self.df().where(column.isNotNull()).select("_id", column.alias("v"))
                got |= {"centroids": ivf.fit(rows, "_id", "v", index.lists).tolist()}
            if got:
                new[path] = fit | got
        if new:
            name = f"fits-{m['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}.json"
            files.write_text(self.spark, f"{self.path}/{name}", json.dumps(fits | new))
            self.compact(fits=name)

    def count(self) -> int:
        return self.manifest["count"]

    def describe(self) -> dict:
        """Id, schema, number of points, and points in each part."""
        parts = self.df().groupBy(F.input_file_name().alias("file")).count().collect() if self.manifest["parts"] else []
        return {"id": self.meta["id"], "indexSchema": self.meta["schema"], "pointCount": self.count(), "parts": [{"file": r["file"], "pointCount": r["count"]} for r in parts]}

    def _rows(self, points: list[tuple[str, dict, dict]], seq: int) -> DataFrame:
        rows = [(pid, json.dumps(doc, ensure_ascii=False), seq, *(indexed.get(path) for path in self.schema)) for pid, doc, indexed in points]
        return self.spark.createDataFrame(rows, self.base)

    def _sized(self, doc: dict, n: int | str) -> dict:
        size = len(json.dumps(doc, ensure_ascii=False).encode())
        need(size <= self.plan.max_point_size, f"point {n} has {size} bytes, more than {self.plan.max_point_size}")
        return doc

    def insert(self, points: list[dict]) -> list[str]:
        """Insert 1 to 10,000 points; returns their ids. Ids that are there already, or twice in the batch, refuse it all."""
        need(1 <= len(points) <= 10_000, "1 to 10000 points at a time")
        checked = []
        for n, p in enumerate(points):
            pid, doc, indexed = checked_point(self.schema, p, False)
            checked.append((pid or str(uuid.uuid4()), self._sized(doc, n), indexed))
        ids = [c[0] for c in checked]
        if len(set(ids)) < len(ids):
            raise AlreadyExists("an _id occurs twice in the batch")
        m = self.manifest
        rows = self._rows(checked, m["seq"] + 1)
        self._insert(rows, len(ids), m)
        return ids

    def insert_frame(self, df: DataFrame) -> int:
        """Insert a frame of ``_id`` (or null: made) and ``_doc`` (JSON objects) of any size; returns the number of rows.

        One bad row refuses the frame. Rows without an id get a new one each, equal documents too.
        """
        m = self.manifest
        schema, size = self.schema, self.plan.max_point_size
        names = self.base.names
        seq = m["seq"] + 1

        def run(batches):
            import pandas as pd

            for pdf in batches:
                out = []
                for pid, text in zip(pdf["_id"], pdf["_doc"]):
                    point = parsed(text, size)
                    key, doc, indexed = checked_point(schema, point | ({"_id": pid} if isinstance(pid, str) else {}), False)
                    # the part that is written is what is read from then on, so an id made here stays
                    out.append((key or str(uuid.uuid4()), json.dumps(doc, ensure_ascii=False), seq, *(indexed.get(p) for p in schema)))
                yield pd.DataFrame(out, columns=names, dtype=object)

        part = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        try:
            rows = self._write(df.select("_id", "_doc").mapInPandas(run, self.base), part, self.fits(m), False)
            n = rows.count()
            self._insert(rows, n, m, part)
        except Exception as e:
            self._drop(part)
            if found := re.search(r"ValidationError: (.*)", str(e)):
                raise ValidationError(found[1]) from e
            raise
        return n

    def _insert(self, rows: DataFrame, n: int, m: dict, part: str | None = None) -> None:
        if m["count"] + n > self.plan.max_points:
            raise QuotaReached(f"{m['count']} + {n} points are more than {self.plan.max_points}")
        if part and not rows.groupBy("_id").count().where("count > 1").isEmpty():
            raise AlreadyExists("an _id occurs twice in the batch")
        known = rows.select("_id") if part else F.broadcast(rows.select("_id"))  # a batch has 10,000 at most
        found = self.df().select("_id").join(known, "_id", "left_semi").limit(1).collect()
        if found:
            raise AlreadyExists(f"point {found[0]['_id']} is there already")
        if not part:
            part = f"{m['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            self._write(rows, part, self.fits(m), True)
        self._commit(m | {"seq": m["seq"] + 1, "count": m["count"] + n} | self._with_part(m, part, n))
        self._upkeep()

    @staticmethod
    def _with_part(m: dict, part: str, n: int) -> dict:
        """What the manifest says of parts once there is another one, of ``n`` rows."""
        return {"parts": [*m["parts"], part], "sizes": m.get("sizes", {}) | {part: n}}

    def _upkeep(self) -> None:
        self._fit()
        m = self.manifest
        if len(m["tombstones"]) > self.plan.max_parts:
            name = f"{m['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
            dead = self.spark.read.schema("_id string, _seq long").parquet(*(f"{self.path}/tombstones/{p}" for p in m["tombstones"]))
            dead.groupBy("_id").agg(F.max("_seq").alias("_seq")).write.parquet(f"{self.path}/tombstones/{name}")
            self._commit(m := m | {"seq": m["seq"] + 1, "tombstones": [name]})
        if len(m["parts"]) <= self.plan.max_parts:
            return
        # the smaller half of the parts, written as one; their rows keep their numbers, so tombstones still hold
        sizes = m.get("sizes", {})
        few = sorted(m["parts"], key=lambda p: sizes.get(p, 0))[: self.plan.max_parts // 2 + 1]
        rows = self._live(self.spark.read.schema(self.type).parquet(*(f"{self.path}/parts/{p}" for p in few)), m)
        total = sum(sizes.get(p, 0) for p in few)
        part = f"{m['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        n = self._write(rows.select(*(F.col(f"`{n}`") for n in self.base.names)), part, self.fits(m), total <= 10_000).count()
        left = {"parts": [p for p in m["parts"] if p not in few], "sizes": {p: k for p, k in sizes.items() if p not in few}}
        self._commit(m | {"seq": m["seq"] + 1} | self._with_part(left, part, n))

    def _bury(self, ids: list[str], m: dict, seq: int) -> dict:
        name = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
        self.spark.createDataFrame([(i, seq) for i in ids], "_id string, _seq long").coalesce(1).write.parquet(f"{self.path}/tombstones/{name}")
        return {"seq": seq, "tombstones": [*m["tombstones"], name], "dead": m["dead"] + len(ids)}

    def _of(self, ids: list[str]) -> DataFrame:
        return self.df().where(F.col("_id").isin(ids))

    def update(self, points: list[dict]) -> list[dict]:
        """Lay 1 to 100 points over those of the same id, top-level keys only; the value ``_delete`` removes a key.

        Returns the ids that weren't found, each with its error; the rest are updated.
        """
        need(1 <= len(points) <= 100, "1 to 100 points at a time")
        changes = {}
        for n, p in enumerate(points):
            pid, doc, _ = checked_point(self.schema, p, True, skip=REMOVE)
            changes[pid] = self._sized(doc, n)
        m = self.manifest
        rows = []
        for r in self._of(list(changes)).select("_id", "_doc").collect():  # 100 at most
            doc = json.loads(r["_doc"]) | changes[r["_id"]]
            doc = {k: v for k, v in doc.items() if v != REMOVE}
            _, doc, indexed = checked_point(self.schema, doc, False)
            rows.append((r["_id"], self._sized(doc, r["_id"]), indexed))
        if rows:
            seq = m["seq"] + 1
            change = self._bury([r[0] for r in rows], m, seq)
            part = f"{seq:08d}-{uuid.uuid4().hex[:8]}"
            self._write(self._rows(rows, seq), part, self.fits(m), True)
            self._commit(m | change | self._with_part(m, part, len(rows)))
            self._upkeep()
        done = {r[0] for r in rows}
        return [{"id": i, "error": "not found"} for i in changes if i not in done]

    def delete(self, ids: list[str]) -> list[dict]:
        """Delete 1 to 100 points by id; returns those that weren't found."""
        need(1 <= len(ids) <= 100, "1 to 100 ids at a time")
        for i in ids:
            need(isinstance(i, str) and UUID.fullmatch(i) is not None, f"not a UUID: {i!r}")
        ids = list(dict.fromkeys(i.lower() for i in ids))
        m = self.manifest
        found = [r["_id"] for r in self._of(ids).select("_id").collect()]
        if found:
            self._commit(m | self._bury(found, m, m["seq"] + 1) | {"count": m["count"] - len(found)})
            self._upkeep()
        return [{"id": i, "error": "not found"} for i in ids if i not in set(found)]

    def search(self, request: Request | dict | str, rank: bool = False) -> DataFrame:
        return compiler.search(Documents(self.df(), self.schema, self.fits(), self.postings()), request, rank)

    def results(self, request: Request | dict | str) -> list[dict[str, Any]]:
        """The hits as documents with ``_id`` and the score fields, which win over fields of their names."""
        out = []
        for r in self.search(request, rank=True).orderBy("_rank").collect():  # one page
            doc = json.loads(r["_doc"]) if "_doc" in r and r["_doc"] else {}
            doc["_id"] = r["_id"]
            doc |= {k: r[k] for k in ("_distance", "_score") if r[k] is not None}
            out.append(doc | {"_hybridScore": r["_hybridScore"]})
        return out

    def compact(self, rows_per_file: int = 1_000_000, fits: str | None = None) -> None:
        """Write the live rows anew, without tombstones, in files of at most ``rows_per_file``; ``fits``: what to derive by.

        Parts that are no longer named stay until ``vacuum``, for readers that still have them.
        """
        m = self.manifest
        fits = fits or m.get("fits")
        part = f"{m['seq'] + 1:08d}-{uuid.uuid4().hex[:8]}"
        files_now = max(1, -(-m["count"] // rows_per_file))
        rows = self.df().select(*(F.col(f"`{n}`") for n in self.base.names))
        listed = [f"`{column_name(path, 'l')}`" for path, index in self.schema.items() if index.lists]
        # with lists, rows of one list lie together, so that a search reads few of them
        self._write(rows if listed else rows.repartition(files_now), part, self.fits({"fits": fits}), False)
        self._commit(m | {"seq": m["seq"] + 1, "parts": [part], "sizes": {part: m["count"]}, "tombstones": [], "dead": 0, "fits": fits})

    def vacuum(self) -> int:
        """Delete parts, postings and tombstones that the manifest doesn't name; returns how many folders went."""
        m, gone = self.manifest, 0
        for kind, named in (("parts", m["parts"]), ("postings", m["parts"]), ("tombstones", m["tombstones"])):
            for name in set(files.children(self.spark, f"{self.path}/{kind}")) - set(named):
                files.remove(self.spark, f"{self.path}/{kind}/{name}")
                gone += 1
        return gone

    def dump(self, path: str) -> None:
        """All live documents as JSON lines, each with its ``_id``."""
        self.df().select(F.to_json(F.struct("_id", F.col("_doc").alias("doc"))).alias("value")).write.text(path)

    def load_dump(self, path: str) -> int:
        """Insert what ``dump`` wrote; returns the number of points."""
        rows = self.spark.read.text(path).select(F.from_json("value", "_id string, doc string").alias("r"))
        return self.insert_frame(rows.select("r._id", F.col("r.doc").alias("_doc")))

    def backup(self, folder: str, keep: int = 3, least_seconds: float = 0) -> str | None:
        """A snapshot under ``folder``, named by the time; the last ``keep`` stay. None if the last is too recent."""
        old = files.children(self.spark, folder)
        now = time.time()
        if old and now - float(old[-1].rpartition("-")[2]) < least_seconds:
            return None
        name = f"{self.meta['id']}-{now:020.6f}"
        self.df().write.parquet(f"{folder}/{name}")
        for x in [*old, name][: -keep or None]:
            files.remove(self.spark, f"{folder}/{x}")
        return f"{folder}/{name}"


class Catalog:
    """The collections under a folder, by user."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, user: str, name: str) -> str:
        return f"{self.root}/{user}/{name}"

    def create(self, user: str, name: str, schema: dict, plan: Plan | None = None) -> Collection:
        """3 to 24 lower-case letters or digits name a collection; its schema can't be changed later."""
        plan = plan or Plan()
        need(re.fullmatch(r"[a-z0-9]{3,24}", name) is not None, f"a collection can't be named {name!r}")
        parse_schema(schema)
        names = self.list(user)
        if name in names:
            raise AlreadyExists(f"collection {name}")
        if len(names) >= plan.max_collections:
            raise QuotaReached(f"{user} has {len(names)} collections")
        path = self._path(user, name)
        files.write_text(self.spark, f"{path}/meta.json", json.dumps({"id": name, "user": user, "schema": schema}))
        files.write_text(self.spark, f"{path}/manifest.json", json.dumps({"seq": 0, "parts": [], "tombstones": [], "dead": 0, "count": 0, "epochs": {}}))
        return Collection(self.spark, path, plan)

    def create_vectors(self, user: str, name: str, size: int, metric: str = "euclidean", plan: Plan | None = None) -> Collection:
        """A collection with the one graph-indexed property ``vector`` (build 75, degree 64, alpha 1.2)."""
        need(metric in ("euclidean", "cosine", "dot"), f"unknown distance metric {metric!r}")
        p = {"vectorSize": size, "distanceMetric": metric, "searchSize": 75, "degreeBound": 64, "alpha": 1.2}
        return self.create(user, name, {"vector": {"type": "vectorVamana", "vectorVamana": p}}, plan)

    def list(self, user: str) -> list[str]:
        return files.children(self.spark, f"{self.root}/{user}")

    def get(self, user: str, name: str, plan: Plan | None = None) -> Collection:
        path = self._path(user, name)
        if not files.exists(self.spark, f"{path}/meta.json"):
            raise NotFound(f"collection {name}")
        return Collection(self.spark, path, plan or Plan())

    def drop(self, user: str, name: str) -> None:
        self.get(user, name)
        files.remove(self.spark, self._path(user, name))


def migrate_vectors(rows: DataFrame, to: Collection, vector: str = "vector", metadata: str = "metadata", id_col: str = "id") -> int:
    """Points of the vector-only form (id, vector, metadata as JSON or null) as documents of ``to``.

    The keys of the metadata become top-level fields beside ``vector``; metadata that is no object is kept as ``metadata``.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for pid, vec, text in zip(pdf["id"], pdf["vector"], pdf["metadata"]):
                meta = json.loads(text) if isinstance(text, str) else {}
                doc = (meta if isinstance(meta, dict) else {"metadata": meta}) | {"vector": [float(v) for v in vec]}
                out.append((pid, json.dumps(doc, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["_id", "_doc"], dtype=object)

    old = rows.select(F.col(id_col).cast("string").alias("id"), F.col(vector).alias("vector"), F.col(metadata).cast("string").alias("metadata"))
    return to.insert_frame(old.mapInPandas(run, "_id string, _doc string"))


def vector_search(collection: Collection, vector: list[float], limit: int = 10) -> DataFrame:
    """The vector-only search of ``create_vectors`` collections: nearest points with their documents and distances."""
    need(0 <= limit <= 75, "limit must be from 0 to 75")
    return collection.search({"query": {"property": "vector", "vectorVamana": {"vector": vector, "operator": "near", "searchSize": 75, "limit": limit or 10}}, "select": ["*"], "limit": limit or 10})
