"""Search requests: the JSON query tree as dataclasses, with both validations, of shape and against a schema."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from .schema import UUID, VECTOR_TYPES, Schema, need, number

ORDERED = ("equals", "notEquals", "greaterThan", "greaterThanOrEquals", "lessThan", "lessThanOrEquals", "inRange")
SET = ("containsAll", "containsAny")
TREE = ("_and", "_or")
OPTIONS = (*VECTOR_TYPES, "text", "string", "integer", "float", "stringArray")


@dataclass(frozen=True)
class Options:
    """What a leaf asks for; fields that a kind lacks keep their defaults."""

    operator: str
    value: Any = None
    end: Any = None
    limit: int = 0
    weight: float = 1.0
    filter: Query | None = None
    search_size: int = 0

    @staticmethod
    def parse(kind: str, x: dict) -> Options:
        need(isinstance(x, dict), f"{kind} options must be an object")
        op, value, end = x.get("operator"), x.get("value"), x.get("endValue")
        if kind in (*VECTOR_TYPES, "text"):
            limit, weight = x.get("limit", 0), x.get("weight")
            need(number(limit) and 1 <= limit <= 75, f"{kind} limit must be from 1 to 75")
            need(weight is None or number(weight), "weight must be a number")
            sub = Query.parse(x["filter"]) if x.get("filter") is not None else None
            weight = 1.0 if weight is None else float(weight)
            if kind == "text":
                need(op in SET, f"unknown text operator {op!r}")
                need(isinstance(value, str) and value != "", "a text value must be a string, not empty")
                return Options(op, value, None, int(limit), weight, sub)
            need(op == "near", f"unknown vector operator {op!r}")
            vector = x.get("vector")
            need(isinstance(vector, list) and 1 <= len(vector) <= 4096 and all(map(number, vector)), "a query vector is an array of 1 to 4096 numbers")
            size = x.get("searchSize", 0)
            if kind == "vectorVamana":
                need(number(size) and 25 <= size <= 75, "searchSize must be from 25 to 75")
                need(limit <= size, "searchSize must not be below limit")
            return Options(op, tuple(map(float, vector)), None, int(limit), weight, sub, int(size))
        if kind == "stringArray":
            need(op in SET, f"unknown stringArray operator {op!r}")
            need(isinstance(value, list) and value and all(isinstance(v, str) for v in value), "a stringArray value is a list of strings, not empty")
            return Options(op, tuple(value))
        need(op in ORDERED or (kind == "string" and op == "startsWith"), f"unknown {kind} operator {op!r}")
        if kind == "string":
            need(isinstance(value, str) and value != "", "a string value must not be empty")
            end = "" if end is None else end
            need(isinstance(end, str), "endValue must be a string")
        else:
            kinds = int if kind == "integer" else (int, float)
            value, end = (0 if v is None else v for v in (value, end))
            need(isinstance(value, kinds) and isinstance(end, kinds) and not isinstance(value, bool) and not isinstance(end, bool), f"{kind} values must be of that type")
        need(op != "inRange" or end > value, "endValue must be above value")
        return Options(op, value, end)


@dataclass(frozen=True)
class Query:
    """A leaf on a property, or ``_and`` / ``_or`` over children."""

    property: str
    options: tuple[tuple[str, Options], ...] = ()
    children: tuple[Query, ...] = ()

    def option(self, kind: str) -> Options | None:
        return dict(self.options).get(kind)

    @staticmethod
    def parse(x: dict) -> Query:
        need(isinstance(x, dict), "a query is an object")
        prop = x.get("property")
        need(isinstance(prop, str) and prop != "", "a query needs a property")
        lists = {t: x.get(t) or [] for t in TREE}
        for t, subs in lists.items():
            need(isinstance(subs, list), f"{t} must be a list")
            need(prop != t or subs, f"{t} needs a subquery")
        children = {t: tuple(Query.parse(s) for s in subs) for t, subs in lists.items()}
        options = tuple((k, Options.parse(k, x[k])) for k in OPTIONS if x.get(k) is not None)
        q = Query(prop, options, children.get(prop, ()))
        if prop == "_id":
            s, a = q.option("string"), q.option("stringArray")
            need((s is not None and s.operator == "equals") or (a is not None and a.operator == "containsAny"), "_id takes string equals or stringArray containsAny")
            for v in ([s.value] if s is not None else a.value):
                need(UUID.fullmatch(v) is not None, f"not a UUID: {v!r}")
        return q

    def check(self, schema: Schema) -> None:
        """Against a schema: known properties, options of the index's type, vectors of its length."""
        if self.property in TREE:
            for c in self.children:
                c.check(schema)
            return
        if self.property == "_id":
            return
        need(self.property in schema, f"property {self.property} isn't in the index schema")
        index = schema[self.property]
        o = self.option(index.kind)
        need(o is not None, f"{index.kind} options are missing for {self.property}")
        if index.kind in VECTOR_TYPES:
            need(len(o.value) == index.size, f"the query vector of {self.property} must have {index.size} elements")
        if o.filter is not None:
            o.filter.check(schema)


@dataclass(frozen=True)
class Request:
    """A query with what to return of its hits, in which order, and how many."""

    query: Query
    select: tuple[str, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    offset: int = 0
    limit: int = 10

    @staticmethod
    def parse(x: dict | str) -> Request:
        x = json.loads(x) if isinstance(x, str) else x
        need(isinstance(x, dict), "a request is an object")
        query = Query.parse(x.get("query") or {})
        select, sort = x.get("select") or [], x.get("sort") or []
        need(isinstance(select, list) and all(isinstance(s, str) for s in select), "select must be a list of strings")
        need(isinstance(sort, list) and len(sort) <= 10, "at most 10 sort options")
        for s in sort:
            need(isinstance(s, dict) and isinstance(s.get("property"), str) and s["property"] != "", "a sort option needs a property")
        offset, limit = x.get("offset", 0), x.get("limit", 0)
        need(isinstance(offset, int) and offset >= 0, "offset must not be negative")
        need(isinstance(limit, int) and 1 <= limit <= 100, "limit must be from 1 to 100")
        return Request(query, tuple(select), tuple((s["property"], bool(s.get("descending", False))) for s in sort), offset, limit)
