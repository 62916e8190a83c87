"""JSON schemas of index schemas and search requests, for editors and clients. ``python -m sonda.plans.json_schema`` prints both."""

from __future__ import annotations

import json

from .request import ORDERED, SET
from .schema import METRICS


def _object(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "required": required, "properties": properties}


def _between(low: float, high: float, kind: str = "integer") -> dict:
    return {"type": kind, "minimum": low, "maximum": high}


def index_schema() -> dict:
    """Of ``plans.schema.parse_schema``: dotted path -> type and its parameters."""
    binary = _object(["distanceMetric"], threshold={"type": "number"}, triggerThreshold=_between(0, 50_000), distanceMetric={"enum": ["hamming", "jaccard"]})
    product = _object(["numCentroids", "numSubVectors", "triggerThreshold"], numCentroids=_between(2, 256), numSubVectors={"type": "integer", "minimum": 2}, triggerThreshold=_between(1000, 10_000))
    quantizer = _object(["type"], type={"enum": ["none", "binary", "product"]}, binary=binary, product=product)
    vector = {"vectorSize": _between(1, 4096), "distanceMetric": {"enum": list(METRICS)}, "quantizer": quantizer}
    flat = _object(["vectorSize", "distanceMetric"], **vector)
    graph = _object(["vectorSize", "distanceMetric", "searchSize", "degreeBound", "alpha"], **vector, searchSize=_between(25, 75), degreeBound=_between(32, 64), alpha=_between(1.1, 1.5, "number"), lists=_between(0, 65_536), probes=_between(1, 65_536))
    string = _object([], caseSensitive={"type": "boolean"})
    text = _object(["analyser"], analyser={"enum": ["standard"]})
    kinds = {"vectorFlat": flat, "vectorVamana": graph, "text": text, "string": string, "stringArray": string, "integer": None, "float": None}
    each = [_object(["type", *([k] if p else [])], type={"const": k}, **({k: p} if p else {})) for k, p in kinds.items()]
    return {"type": "object", "additionalProperties": {"oneOf": each}}


def search_request() -> dict:
    """Of ``plans.request.Request.parse``."""
    query = {"$ref": "#/$defs/query"}
    ranker = {"limit": _between(1, 75), "weight": {"type": "number"}, "filter": query}
    vector = {"operator": {"const": "near"}, "vector": {"type": "array", "items": {"type": "number"}, "minItems": 1, "maxItems": 4096}} | ranker

    def ordered(value: dict, *more: str) -> dict:
        return _object(["operator", "value"], operator={"enum": [*ORDERED, *more]}, value=value, endValue=value)

    options = {
        "vectorFlat": _object(["operator", "vector", "limit"], **vector),
        "vectorVamana": _object(["operator", "vector", "limit", "searchSize"], **vector, searchSize=_between(25, 75)),
        "text": _object(["operator", "value", "limit"], operator={"enum": list(SET)}, value={"type": "string", "minLength": 1}, **ranker),
        "string": ordered({"type": "string"}, "startsWith"),
        "integer": ordered({"type": "integer"}),
        "float": ordered({"type": "number"}),
        "stringArray": _object(["operator", "value"], operator={"enum": list(SET)}, value={"type": "array", "items": {"type": "string"}, "minItems": 1}),
    }
    tree = {"type": "array", "items": query}
    one = _object(["property"], property={"type": "string", "minLength": 1}, _and=tree, _or=tree, **options)
    sort = _object(["property"], property={"type": "string", "minLength": 1}, descending={"type": "boolean"})
    request = _object(["query", "limit"], query=query, select={"type": "array", "items": {"type": "string"}}, sort={"type": "array", "maxItems": 10, "items": sort}, offset={"type": "integer", "minimum": 0}, limit=_between(1, 100))
    return request | {"$defs": {"query": one}}


if __name__ == "__main__":
    print(json.dumps({"indexSchema": index_schema(), "searchRequest": search_request()}, indent=2))
