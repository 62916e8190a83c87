"""From a request to one DataFrame.

Every node of the query tree becomes either a boolean column, which Catalyst pushes into the scan, or a relation of
hits (id, ranked, distance, score, hybrid, key). Limits inside the tree are kept as they are: nothing is pushed
through them. Ties go to the lower id everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import text as text_ops
from ..operators import vector as vector_ops
from ..operators.predicates import predicate
from .request import Query, Request
from .schema import VECTOR_TYPES, Schema

HIT = ("ranked", "distance", "score", "hybrid", "key")


@dataclass
class Source:
    """A collection to search: a frame, its id column, its schema and where its indexed properties are."""

    df: DataFrame
    id: str
    schema: Schema
    column: Callable[[str], Column] | None = None

    def of(self, path: str) -> Column:
        return self.column(path) if self.column else path_column(path)

    def kind(self, path: str) -> T.DataType | None:
        """The type at a dotted path of the frame; None where there is no such field."""
        now: T.DataType = self.df.schema
        for key in path.split("."):
            if not isinstance(now, T.StructType) or key not in now.names:
                return None
            now = now[key].dataType
        return now

    def distance(self, path: str, query) -> Column:
        """The distance of an indexed vector property to a query."""
        return vector_ops.measured(self.df, self.id, self.of(path), self.schema[path], query)

    def probed(self, path: str, query) -> Column | None:
        """The rows that an approximate index looks at; None for all."""
        return None

    def text_scores(self, path: str, query: str, every: bool, within: Column | None, restrict: DataFrame | None) -> DataFrame:
        """(id, score) of the documents that match a text query."""
        return text_ops.scored(self.df, self.id, self.of(path), query, every, within, restrict)

    def payload(self, select: tuple[str, ...]) -> tuple[list[Column], set[str] | None]:
        """Payload columns of a select list, nested paths nested again; the paths it covers, None for all."""
        names = [f for f in self.df.columns if f != self.id]
        if "*" in select:
            return [F.col(f"`{n}`") for n in names], None
        tree = nested([p for p in select if self.kind(p) is not None])

        def build(name: str, path: str, sub) -> Column:
            if sub is True:
                return path_column(path).alias(name)
            inner = F.struct(*(build(k, f"{path}.{k}", v) for k, v in sub.items()))
            return F.when(path_column(path).isNotNull(), inner).alias(name)

        return [build(k, k, v) for k, v in tree.items()], set(select)

    def sort(self, path: str, descending: bool) -> list[Column]:
        """Sort columns of a path, missing values last; none where no document has it."""
        if self.kind(path) is None:
            return []
        return [path_column(path).desc_nulls_last() if descending else path_column(path).asc_nulls_last()]


def nested(paths: list[str]) -> dict:
    """Dotted paths as a tree of keys; True at the ends. A path under another selected one adds nothing."""
    tree: dict = {}
    for path in paths:
        now = tree
        *parents, leaf = path.split(".")
        for p in parents:
            now = now.setdefault(p, {})
            if now is True:
                break
        if now is not True:
            now[leaf] = True
    return tree


def path_column(path: str) -> Column:
    return F.col(".".join(f"`{p}`" for p in path.split(".")))


@dataclass
class Hits:
    """``bound``: the most rows there can be, None where that isn't known; only bounded hits are broadcast."""

    df: DataFrame
    bound: int | None

    def small(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.bound is not None and self.bound <= 100_000 else df


Node = Column | Hits


class Compiler:
    def __init__(self, source: Source):
        self.s = source

    def node(self, q: Query) -> Node:
        if q.property in ("_and", "_or"):
            return self.tree(q)
        if q.property == "_id":
            one, many = q.option("string"), q.option("stringArray")
            values = [one.value] if one is not None and one.operator == "equals" else list(many.value)
            kind = self.s.df.schema[self.s.id].dataType
            ids = F.col(self.s.id)
            return (F.lower(ids) if isinstance(kind, T.StringType) else ids).isin([v.lower() for v in values])
        index = self.s.schema[q.property]
        o = q.option(index.kind)
        if index.kind in VECTOR_TYPES:
            return self.near(q.property, o)
        if index.kind == "text":
            return self.text(q.property, o)
        return predicate(self.s.of(q.property), index, o)

    def filtered(self, node: Node | None) -> tuple[Column | None, DataFrame | None]:
        """A pre-filter as a condition or as the ids of hits, whose scores play no part."""
        if node is None or isinstance(node, Column):
            return node, None
        return None, node.small(node.df.select(self.s.id))

    def near(self, path: str, o) -> Hits:
        df = self.s.df
        dist = self.s.distance(path, o.value)
        probed = self.s.probed(path, o.value)
        df = df if probed is None else df.where(probed)
        cond, ids = self.filtered(self.node(o.filter) if o.filter else None)
        df = df if cond is None else df.where(cond)
        df = df if ids is None else df.join(ids, self.s.id, "left_semi")
        top = vector_ops.nearest(df, self.s.id, dist, o.limit)
        none = F.lit(None).cast("double")
        return Hits(top.select(self.s.id, F.lit(True).alias("ranked"), "distance", none.alias("score"), (F.col("distance") * -o.weight).alias("hybrid"), F.col("distance").alias("key")), o.limit)

    def text(self, path: str, o) -> Hits:
        cond, ids = self.filtered(self.node(o.filter) if o.filter else None)
        got = self.s.text_scores(path, o.value, o.operator == "containsAll", cond, ids)
        top = got.orderBy(F.desc("score"), self.s.id).limit(o.limit)
        none = F.lit(None).cast("double")
        return Hits(top.select(self.s.id, F.lit(True).alias("ranked"), none.alias("distance"), "score", (F.col("score") * o.weight).alias("hybrid"), (-F.col("score")).alias("key")), o.limit)

    def tree(self, q: Query) -> Node:
        nodes = [self.node(c) for c in q.children]
        if len(nodes) == 1:
            return nodes[0]
        every = q.property == "_and"
        conds = [n for n in nodes if isinstance(n, Column)]
        cond = None
        for c in conds:
            cond = c if cond is None else (cond & c if every else cond | c)
        hits = [(i, n) for i, n in enumerate(nodes) if isinstance(n, Hits)]
        if not hits:
            return cond
        rows = None
        for i, h in hits:
            r = h.df.withColumn("ord", F.lit(i))
            rows = r if rows is None else rows.unionByName(r)

        def first(c: str) -> Column:
            return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ord"))).alias(c)

        fused = rows.groupBy(self.s.id).agg(F.countDistinct("ord").alias("n"), F.max("ranked").alias("ranked"), first("distance"), first("score"), F.coalesce(F.sum(F.when(F.col("ranked"), F.col("hybrid"))), F.lit(0.0)).alias("hybrid"))
        bounds = [h.bound for _, h in hits]
        known = [b for b in bounds if b is not None]
        if every:
            bound = min(known) if known else None
            fused = fused.where(F.col("n") == len(hits))
        else:
            bound = sum(known) if len(known) == len(bounds) else None
        fused = fused.select(self.s.id, "ranked", "distance", "score", "hybrid", (-F.col("hybrid")).alias("key"))
        out = Hits(fused, bound)
        if cond is None:
            return out
        if every:
            members = self.s.df.where(cond).select(self.s.id)
            return Hits(members.join(out.small(fused), self.s.id), bound)
        none = F.lit(None).cast("double")
        rest = self.s.df.where(cond).select(self.s.id).join(out.small(fused.select(self.s.id)), self.s.id, "left_anti")
        rest = rest.select(self.s.id, F.lit(False).alias("ranked"), none.alias("distance"), none.alias("score"), F.lit(0.0).alias("hybrid"), F.lit(0.0).alias("key"))
        return Hits(fused.unionByName(rest), None)


def search(source: Source, request: Request | dict | str, rank: bool = False) -> DataFrame:
    """The hits of a request: id, payload, ``_distance``, ``_score``, ``_hybridScore``; ``_rank`` from 1 on where asked for.

    Ranked hits come first, by distance or score for a lone leaf and by hybrid score for a composite, then the
    unranked by id; or the request's sort keys rule, missing values last either way. Keys that the selection doesn't
    cover, or that no document has, do nothing.
    """
    r = request if isinstance(request, Request) else Request.parse(request)
    r.query.check(source.schema)
    node = Compiler(source).node(r.query)
    payload, covered = source.payload(r.select)
    keys = [c for p, d in r.sort if covered is None or any(p == s or p.startswith(s + ".") for s in covered) for c in source.sort(p, d)]
    none = F.lit(None).cast("double")
    if isinstance(node, Column):
        hits = source.df.where(node).withColumns({"__ranked": F.lit(False), "__distance": none, "__score": none, "__hybrid": F.lit(0.0), "__key": F.lit(0.0)})
        small = None
    else:
        small = node.df.select(F.col(source.id), *(F.col(c).alias(f"__{c}") for c in HIT))
        hits = small
    order = [F.col("__ranked").desc(), F.col("__key"), F.col(f"`{source.id}`")]
    want = payload or keys
    if small is not None and want:
        if not keys:  # the page is known before any payload is read
            small = F.broadcast(small.orderBy(*order).limit(r.offset + r.limit)) if r.offset + r.limit <= 100_000 else small
        else:
            small = node.small(small)
        hits = source.df.join(small, source.id)
    order = [*keys, *order]
    out = [F.col(f"`{source.id}`"), *payload, F.col("__distance").alias("_distance"), F.col("__score").alias("_score"), F.col("__hybrid").alias("_hybridScore")]
    page = hits.orderBy(*order).offset(r.offset).limit(r.limit) if r.offset else hits.orderBy(*order).limit(r.limit)
    if not rank:
        return page.select(*out)
    # a window over one page
    return page.select(*out, (F.row_number().over(Window.orderBy(*order)) + r.offset).alias("_rank"))


def matching(source: Source, query: Query | dict) -> DataFrame:
    """All rows that a query matches, with ``_distance``, ``_score`` and ``_hybridScore``; no page is cut."""
    q = query if isinstance(query, Query) else Query.parse(query)
    q.check(source.schema)
    node = Compiler(source).node(q)
    none = F.lit(None).cast("double")
    if isinstance(node, Column):
        return source.df.where(node).withColumns({"_distance": none, "_score": none, "_hybridScore": F.lit(0.0)})
    hits = node.df.select(F.col(source.id), F.col("distance").alias("_distance"), F.col("score").alias("_score"), F.col("hybrid").alias("_hybridScore"))
    return source.df.join(node.small(hits), source.id)
