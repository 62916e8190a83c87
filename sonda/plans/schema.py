"""Index schemas: which dotted paths of a document are indexed, and how; validation of schemas and points."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import types as T

from ..errors import ValidationError

VECTOR_TYPES = ("vectorFlat", "vectorVamana")
INDEX_TYPES = (*VECTOR_TYPES, "text", "string", "integer", "float", "stringArray")
METRICS = ("euclidean", "cosine", "dot", "hamming", "jaccard", "haversine")
UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
SPARK_TYPES = {"vectorFlat": T.ArrayType(T.FloatType()), "vectorVamana": T.ArrayType(T.FloatType()), "text": T.StringType(), "string": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "stringArray": T.ArrayType(T.StringType())}


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValidationError(message)


def number(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


@dataclass(frozen=True)
class Quantizer:
    """How vectors are stored: as they are, as bits, or as centroid numbers of sub-vectors."""

    kind: str = "none"
    threshold: float | None = None
    trigger: int = 0
    metric: str | None = None
    centroids: int = 0
    subvectors: int = 0

    @staticmethod
    def parse(x: dict | None) -> Quantizer:
        if not x:
            return Quantizer()
        kind = x.get("type")
        need(kind in ("none", "binary", "product"), f"unknown quantizer {kind!r}")
        if kind == "none":
            return Quantizer()
        p = x.get(kind)
        need(isinstance(p, dict), f"{kind} quantizer parameters are missing")
        trigger = p.get("triggerThreshold", 0)
        if kind == "binary":
            need(p.get("threshold") is not None or 0 <= trigger <= 50_000, "binary triggerThreshold must be from 0 to 50000")
            need(p.get("distanceMetric") in ("hamming", "jaccard"), "a binary quantizer measures hamming or jaccard")
            return Quantizer(kind, p.get("threshold"), trigger, p["distanceMetric"])
        need(2 <= p.get("numCentroids", 0) <= 256, "numCentroids must be from 2 to 256")
        need(p.get("numSubVectors", 0) >= 2, "numSubVectors must be 2 or more")
        need(1000 <= trigger <= 10_000, "product triggerThreshold must be from 1000 to 10000")
        return Quantizer(kind, None, trigger, None, p["numCentroids"], p["numSubVectors"])


@dataclass(frozen=True)
class Index:
    """One indexed property."""

    kind: str
    size: int = 0
    metric: str = ""
    quantizer: Quantizer = field(default_factory=Quantizer)
    search_size: int = 0
    degree_bound: int = 0
    alpha: float = 0.0
    #: Lists of an approximate index and how many a search looks at; 0: graph-indexed properties are searched exactly.
    lists: int = 0
    probes: int = 0
    case_sensitive: bool = False

    @staticmethod
    def parse(x: dict) -> Index:
        kind = x.get("type")
        need(kind in INDEX_TYPES, f"unknown index type {kind!r}")
        p = x.get(kind)
        if kind in ("integer", "float"):
            return Index(kind)
        need(isinstance(p, dict), f"{kind} parameters are missing")
        if kind == "text":
            need(p.get("analyser") == "standard", "the analyser must be standard")
            return Index(kind)
        if kind in ("string", "stringArray"):
            return Index(kind, case_sensitive=bool(p.get("caseSensitive", False)))
        size, metric = p.get("vectorSize", 0), p.get("distanceMetric")
        need(number(size) and 1 <= size <= 4096, "vectorSize must be from 1 to 4096")
        need(metric in METRICS, f"unknown distance metric {metric!r}")
        need(metric != "haversine" or size == 2, "haversine vectors have two elements")
        q = Quantizer.parse(p.get("quantizer"))
        if q.kind == "product":
            need(size % q.subvectors == 0, "vectorSize must be a multiple of numSubVectors")
            need(metric in ("euclidean", "cosine", "dot"), "a product quantizer measures euclidean, cosine or dot")
        if kind == "vectorFlat":
            return Index(kind, int(size), metric, q)
        need(25 <= p.get("searchSize", 0) <= 75, "searchSize must be from 25 to 75")
        need(32 <= p.get("degreeBound", 0) <= 64, "degreeBound must be from 32 to 64")
        need(1.1 <= p.get("alpha", 0) <= 1.5, "alpha must be from 1.1 to 1.5")
        lists = p.get("lists", 0)
        need(lists == 0 or 2 <= lists <= 65_536, "lists must be from 2 to 65536")
        need(lists == 0 or metric in ("euclidean", "cosine", "dot"), "lists are for euclidean, cosine or dot")
        probes = p.get("probes", -(-3 * lists // 4))
        need(lists == 0 or 1 <= probes <= lists, "probes must be from 1 to lists")
        return Index(kind, int(size), metric, q, p["searchSize"], p["degreeBound"], p["alpha"], lists, probes)

    def checked(self, path: str, value: Any) -> Any:
        """``value`` as it is indexed; raises where a point can't hold it."""
        if self.kind in VECTOR_TYPES:
            need(isinstance(value, list) and all(number(v) for v in value), f"{path} must be an array of numbers")
            need(len(value) == self.size, f"{path} must have {self.size} elements, not {len(value)}")
            return [float(v) for v in value]
        if self.kind in ("text", "string"):
            need(isinstance(value, str), f"{path} must be a string")
            return value
        if self.kind == "integer":
            need(number(value), f"{path} must be a number")
            return int(value)  # fractions are cut off
        if self.kind == "float":
            need(number(value), f"{path} must be a number")
            return float(value) + 0.0
        need(isinstance(value, list) and all(isinstance(v, str) for v in value), f"{path} must be an array of strings")
        return value


Schema = dict[str, Index]


def parse_schema(x: dict | str) -> Schema:
    """From the JSON form: dotted path -> {"type": ..., <type>: {parameters}}."""
    x = json.loads(x) if isinstance(x, str) else x
    need(isinstance(x, dict), "an index schema is an object")
    return {path: Index.parse(v) for path, v in x.items()}


MISSING = object()


def at_path(point: dict, path: str) -> Any:
    """The value at a dotted path; MISSING where a key or map on the way is."""
    now: Any = point
    for key in path.split("."):
        if not isinstance(now, dict) or key not in now:
            return MISSING
        now = now[key]
    return now


def checked_point(schema: Schema, point: dict, id_required: bool, skip: str | None = None) -> tuple[str | None, dict, dict]:
    """(_id, document without it, indexed values). An explicit null on an indexed path is refused, as is a wrong type.

    ``skip``: a value that is let through anywhere, e.g. the mark that removes a key in updates.
    """
    need(isinstance(point, dict), "a point is an object")
    doc = {k: v for k, v in point.items() if k != "_id"}
    pid = point.get("_id")
    need(pid is not None or not id_required, "_id is required")
    need(pid is None or (isinstance(pid, str) and UUID.fullmatch(pid) is not None), f"_id must be a UUID: {pid!r}")
    indexed = {}
    for path, index in schema.items():
        value = at_path(doc, path)
        if value is MISSING or (skip is not None and value == skip):
            continue
        parents = path.split(".")[:-1]
        need(not parents or isinstance(at_path(doc, ".".join(parents)), dict), f"the parents of {path} must be objects")
        indexed[path] = index.checked(path, value)
    return pid.lower() if pid else None, doc, indexed
