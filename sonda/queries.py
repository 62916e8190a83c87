"""Queries over the test tables, each with the SQL that says the same, where SQL can say it."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import distance as D
from .functions.analysis import PATTERN, STOP_WORDS, tokens
from .operators import ivf, mutate, quantize, text, vector
from .plans.compiler import Source, matching, search
from .plans.schema import Quantizer, parse_schema
from .sources import collection

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function as a query, with its SQL."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(c: str, places: int = 6) -> Column:
    """Rounded, and never a negative zero."""
    return (F.round(F.col(c), places) + F.lit(0.0)).alias(c)


def leaf(prop: str, kind: str, operator: str, value, **more) -> dict:
    key = "vector" if operator == "near" else "value"
    return {"property": prop, kind: {"operator": operator, key: value} | more}


# predicates

COMPARISONS = {"eq": ("equals", "="), "ne": ("notEquals", "<>"), "gt": ("greaterThan", ">"), "ge": ("greaterThanOrEquals", ">="), "lt": ("lessThan", "<"), "le": ("lessThanOrEquals", "<="), "range": ("inRange", "BETWEEN")}


def _predicates() -> None:
    for name, kind, tab, key, prop, value, end in (
        ("int", "integer", "part", "p_partkey", "p_size", 20, 30),
        ("float", "float", "part", "p_partkey", "p_retailprice", 901.2, 915.0),
        ("str", "string", "part", "p_partkey", "p_brand", "Brand#17", "Brand#3"),
    ):
        schema = {prop: {"type": kind, "string": {"caseSensitive": True}}}
        for short, (op, sign) in COMPARISONS.items():
            more = {"endValue": end} if op == "inRange" else {}

            def run(spark, sf_dir, tab=tab, key=key, prop=prop, kind=kind, op=op, value=value, more=more, schema=schema):
                source = Source(table(spark, sf_dir, tab).select(key, prop), key, parse_schema(schema))
                return matching(source, leaf(prop, kind, op, value, **more)).select(key, prop)

            quoted = [repr(v) for v in (value, end)]
            cond = f"{prop} BETWEEN {quoted[0]} AND {quoted[1]}" if op == "inRange" else f"{prop} {sign} {quoted[0]}"
            query(f"SELECT {key}, {prop} FROM {tab} WHERE {cond}", f"pred_{name}_{short}")(run)


_predicates()


def simple(name: str, tab: str, key: str, props: dict[str, dict], q: dict, sql: str, prepare: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query for all rows that match ``q``, with the indexed columns."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, tab)
        df = prepare(df) if prepare else df
        source = Source(df.select(key, *dict.fromkeys(p.split(".")[0] for p in props)), key, parse_schema(props))
        return matching(source, q).select(key, *(F.col(p).alias(p.replace(".", "_")) for p in props))

    query(sql, name)(run)


def s_index(case: bool = False, array: bool = False) -> dict:
    kind = "stringArray" if array else "string"
    return {"type": kind, kind: {"caseSensitive": case}}


simple("pred_str_prefix", "part", "p_partkey", {"p_type": s_index(True)}, leaf("p_type", "string", "startsWith", "S"), "SELECT p_partkey, p_type FROM part WHERE starts_with(p_type, 'S')")
simple("pred_str_ci", "customer", "c_custkey", {"c_mktsegment": s_index()}, leaf("c_mktsegment", "string", "equals", "BuildinG"), "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
# the end of a range keeps its case: 'AUTO' < 'Z' in bytes, but 'auto' is above 'MACHINERY'
simple("pred_str_ci_range", "customer", "c_custkey", {"c_mktsegment": s_index()}, leaf("c_mktsegment", "string", "inRange", "BUILDING", endValue="household"), "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) >= 'building' AND lower(c_mktsegment) <= 'household'")


def with_words(df: DataFrame) -> DataFrame:
    return df.withColumn("words", F.split("p_name", " "))


def _arrays() -> None:
    for name, op, values, case, cond in (
        ("pred_arr_all", "containsAll", ["red", "bolt"], True, "list_has_all(string_split(p_name, ' '), ['red', 'bolt'])"),
        ("pred_arr_any", "containsAny", ["red", "ring"], True, "list_has_any(string_split(p_name, ' '), ['red', 'ring'])"),
        ("pred_arr_ci", "containsAny", ["RED", "Gear"], False, "list_has_any(string_split(lower(p_name), ' '), ['red', 'gear'])"),
    ):

        def run(spark, sf_dir, op=op, values=values, case=case):
            source = Source(with_words(table(spark, sf_dir, "part")), "p_partkey", parse_schema({"words": s_index(case, True)}))
            return matching(source, leaf("words", "stringArray", op, values)).select("p_partkey", "p_name")

        query(f"SELECT p_partkey, p_name FROM part WHERE {cond}", name)(run)


_arrays()


def with_props(df: DataFrame) -> DataFrame:
    return df.withColumn("props", F.from_json("props", "k bigint"))


simple("pred_nested", "events", "event_id", {"props.k": {"type": "integer"}}, leaf("props.k", "integer", "greaterThanOrEquals", 90), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90", with_props)


# ids: the _id of a document is a UUID made of its number

UUIDS = "00000000-0000-4000-8000-"


def with_uuid(df: DataFrame) -> DataFrame:
    return df.withColumn("_id", F.concat(F.lit(UUIDS), F.lpad(F.col("doc_id").cast("string"), 12, "0")))


def _ids() -> None:
    for name, q, cond in (
        ("id_equals", leaf("_id", "string", "equals", UUIDS + "000000000042"), "doc_id = 42"),
        ("id_in", leaf("_id", "stringArray", "containsAny", [UUIDS + f"{i:012d}" for i in (3, 7, 99, 100000000000)]), "doc_id IN (3, 7, 99)"),
    ):

        def run(spark, sf_dir, q=q):
            return matching(Source(with_uuid(table(spark, sf_dir, "documents")), "_id", {}), q).select("_id", "doc_id", "lang")

        query(f"SELECT '{UUIDS}' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS _id, doc_id, lang FROM documents WHERE {cond}", name)(run)


_ids()

# composites of predicates

PART = {"p_size": {"type": "integer"}, "p_brand": s_index(True), "p_retailprice": {"type": "float"}}
simple("and_preds", "part", "p_partkey", PART, {"property": "_and", "_and": [leaf("p_size", "integer", "lessThan", 25), leaf("p_brand", "string", "startsWith", "Brand#1"), leaf("p_retailprice", "float", "greaterThan", 905.0)]}, "SELECT p_partkey, p_size, p_brand, p_retailprice FROM part WHERE p_size < 25 AND starts_with(p_brand, 'Brand#1') AND p_retailprice > 905.0")
simple("or_preds", "part", "p_partkey", PART, {"property": "_or", "_or": [leaf("p_size", "integer", "equals", 1), {"property": "_and", "_and": [leaf("p_brand", "string", "equals", "Brand#4"), leaf("p_retailprice", "float", "lessThanOrEquals", 910.0)]}]}, "SELECT p_partkey, p_size, p_brand, p_retailprice FROM part WHERE p_size = 1 OR (p_brand = 'Brand#4' AND p_retailprice <= 910.0)")
simple("and_single", "part", "p_partkey", PART, {"property": "_and", "_and": [leaf("p_size", "integer", "greaterThan", 45)]}, "SELECT p_partkey, p_size, p_brand, p_retailprice FROM part WHERE p_size > 45")

# nearest neighbours


def embedding(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


def v_index(metric: str, size: int = 64, kind: str = "vectorFlat", quantizer: dict | None = None) -> dict:
    p = {"vectorSize": size, "distanceMetric": metric}
    p |= {"searchSize": 75, "degreeBound": 64, "alpha": 1.2} if kind == "vectorVamana" else {}
    return {"type": kind, kind: p | ({"quantizer": quantizer} if quantizer else {})}


def near(prop: str, vec: list[float], limit: int, kind: str = "vectorFlat", **more) -> dict:
    more |= {"searchSize": 75} if kind == "vectorVamana" else {}
    return leaf(prop, kind, "near", vec, limit=limit, **more)


def ranked(df: DataFrame, *cols: str, distance: bool = True, score: bool = False) -> DataFrame:
    out = [*cols, *([rounded("_distance")] if distance else []), *([rounded("_score")] if score else []), rounded("_hybridScore"), F.col("_rank")]
    return df.select(*out)


VEC = "CAST({0} AS DOUBLE[])"
Q0 = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {})"


def sql_distance(metric: str, x: str, q: str) -> str:
    return {
        "l2": f"pow(list_distance({x}, {q}), 2)",
        "dot": f"-list_inner_product({x}, {q})",
        "cos": f"1 - list_inner_product({x}, {q})",
        "hamming": f"list_sum(list_transform(list_zip({x}, {q}), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1.0 ELSE 0.0 END))",
        "jaccard": f"1 - list_sum(list_transform(list_zip({x}, {q}), lambda z: CASE WHEN z[1] > 0 AND z[2] > 0 THEN 1.0 ELSE 0.0 END)) / list_sum(list_transform(list_zip({x}, {q}), lambda z: CASE WHEN z[1] > 0 OR z[2] > 0 THEN 1.0 ELSE 0.0 END))",
    }[metric]


def sql_top(metric: str, q: int, k: int, where: str = "TRUE", weight: float = 1.0, key: str = "vec_id", payload: str = "label", inner: str = "TRUE") -> str:
    d = sql_distance(metric, VEC.format("embedding"), Q0.format(q))
    return f"""WITH t AS (SELECT {key}, {payload}, {d} AS d FROM embeddings WHERE {inner}), k AS (SELECT * FROM t ORDER BY d, {key} LIMIT {k})
SELECT {key}, {payload}, round(d, 6) + 0.0 AS _distance, round(d * {-weight}, 6) + 0.0 AS "_hybridScore", row_number() OVER (ORDER BY d, {key}) AS _rank FROM k WHERE {where}"""


NAMES = {"l2": "euclidean", "dot": "dot", "cos": "cosine"}


def _flat() -> None:
    for short, metric in NAMES.items():

        def run(spark, sf_dir, metric=metric):
            source = Source(table(spark, sf_dir, "embeddings"), "vec_id", parse_schema({"embedding": v_index(metric)}))
            return ranked(search(source, {"query": near("embedding", embedding(spark, sf_dir, 0), 10), "select": ["label"], "limit": 10}, rank=True), "vec_id", "label")

        query(sql_top(short, 0, 10), f"knn_flat_{short}")(run)
    for short in ("hamming", "jaccard"):

        def run(spark, sf_dir, short=short):
            df = table(spark, sf_dir, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float")))
            q = [1.0 if x > 0 else 0.0 for x in embedding(spark, sf_dir, 0)]
            source = Source(df, "vec_id", parse_schema({"embedding": v_index(short)}))
            return ranked(search(source, {"query": near("embedding", q, 10), "select": ["label"], "limit": 10}, rank=True), "vec_id", "label")

        query(sql_top(short, 0, 10), f"knn_flat_{short}")(run)
    for name, kind, q, k, flt, weight in (
        ("knn_flat_prefilter", "vectorFlat", 0, 10, 4, 1.0),
        ("knn_flat_weight", "vectorFlat", 5, 7, None, 0.25),
        ("knn_graph_l2", "vectorVamana", 1, 10, None, 1.0),
        ("knn_graph_prefilter", "vectorVamana", 2, 10, 3, 1.0),
        ("knn_graph_weight", "vectorVamana", 3, 5, None, 2.0),
    ):

        def run(spark, sf_dir, kind=kind, q=q, k=k, flt=flt, weight=weight):
            source = Source(table(spark, sf_dir, "embeddings"), "vec_id", parse_schema({"embedding": v_index("euclidean", kind=kind), "label": {"type": "integer"}}))
            more = {"filter": leaf("label", "integer", "lessThanOrEquals", flt)} if flt is not None else {}
            return ranked(search(source, {"query": near("embedding", embedding(spark, sf_dir, q), k, kind, weight=weight, **more), "select": ["label"], "limit": k}, rank=True), "vec_id", "label")

        query(sql_top("l2", q, k, weight=weight, inner=f"label <= {flt}" if flt is not None else "TRUE"), name)(run)


_flat()


@query(sql_top("l2", 0, 20, where="label <= 4"))
def knn_flat_postfilter(spark, sf_dir):
    source = Source(table(spark, sf_dir, "embeddings"), "vec_id", parse_schema({"embedding": v_index("euclidean"), "label": {"type": "integer"}}))
    q = {"property": "_and", "_and": [near("embedding", embedding(spark, sf_dir, 0), 20), leaf("label", "integer", "lessThanOrEquals", 4)]}
    return ranked(search(source, {"query": q, "select": ["label"], "limit": 20}, rank=True), "vec_id", "label")


PLACE = "(c_custkey * 7919) % 18000 / 100.0 - 90 AS lat, (c_custkey * 104729) % 36000 / 100.0 - 180 AS lon"


@query(f"""WITH c AS (SELECT c_custkey, {PLACE} FROM customer), r AS (SELECT c_custkey, radians(lat) AS a, radians(lon) AS o FROM c),
q AS (SELECT a AS qa, o AS qo FROM r WHERE c_custkey = 1),
d AS (SELECT c_custkey, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((qa - a) / 2), 2) + cos(a) * cos(qa) * pow(sin((qo - o) / 2), 2)))) AS d FROM r, q)
SELECT c_custkey, round(d, 3) + 0.0 AS _distance, row_number() OVER (ORDER BY d, c_custkey) AS _rank FROM d ORDER BY d, c_custkey LIMIT 10""")
def knn_flat_haversine(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", F.array((F.col("c_custkey") * 7919) % 18000 / 100.0 - 90, (F.col("c_custkey") * 104729) % 36000 / 100.0 - 180).alias("place"))
    source = Source(df, "c_custkey", parse_schema({"place": v_index("haversine", 2)}))
    got = search(source, {"query": near("place", [7919 % 18000 / 100.0 - 90, 104729 % 36000 / 100.0 - 180], 10), "limit": 10}, rank=True)
    return got.select("c_custkey", rounded("_distance", 3), "_rank")


@query(f"""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id, {sql_distance("l2", "CAST(e.embedding AS DOUBLE[])", "CAST(q.embedding AS DOUBLE[])")} AS d FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d)
SELECT query_id, vec_id, round(d, 6) + 0.0 AS distance, rank FROM r WHERE rank <= 10""")
def knn_batch(spark, sf_dir):
    """A stated set of queries against all vectors."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    got = vector.nearest_batch(e, "vec_id", "embedding", queries, "query_id", "q", 10)
    return got.select("query_id", "vec_id", rounded("distance"), F.col("rank").cast("long").alias("rank"))


def lists_of(spark, sf_dir) -> tuple[ivf.Lists, DataFrame]:
    """All embeddings in 16 lists, and those of numbers divisible by 50 as queries."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ivf.build(e, "vec_id", "embedding", 16), e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


@query()
def knn_ivf(spark, sf_dir):
    """Approximate neighbours of a stated set of queries, each from 12 of 16 lists (these vectors hardly cluster)."""
    index, queries = lists_of(spark, sf_dir)
    return index.search_batch(queries, "query_id", "q", 10, 12).select("query_id", "vec_id", rounded("distance"), F.col("rank").cast("long").alias("rank"))


@query("SELECT count(*) AS queries, TRUE AS reached FROM embeddings WHERE vec_id % 50 = 0")
def knn_ivf_recall(spark, sf_dir):
    """Whether the lists give nine tenths of the true neighbours of those queries."""
    index, queries = lists_of(spark, sf_dir)
    true = vector.nearest_batch(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", queries, "query_id", "q", 10)
    found = index.search_batch(queries, "query_id", "q", 10, 12).select("query_id", "vec_id", F.lit(1).alias("hit"))
    got = true.join(found, ["query_id", "vec_id"], "left")
    return got.agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("reached"))


# full text

def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


STOP_SQL = "[" + ", ".join(map(quoted, STOP_WORDS)) + "]"
TOKENS_SQL = f"list_filter(regexp_extract_all(lower(text), {quoted(PATTERN)}), lambda w: NOT list_contains({STOP_SQL}, w))"
SCORES = f"""tok AS (SELECT doc_id, lang, {TOKENS_SQL} AS ts FROM documents),
n AS (SELECT count(*) AS n FROM tok WHERE len(ts) > 0),
"""


def sql_scores(name: str, words: list[str], every: bool, extra: str = "TRUE") -> str:
    """CTEs that end in ``name`` (doc_id, s)."""
    tf = ", ".join(f"len(list_filter(ts, lambda w: w = '{w}')) AS f{i}" for i, w in enumerate(words))
    df = ", ".join(f"(SELECT count(*) FROM tok WHERE list_contains(ts, '{w}')) AS d{i}" for i, w in enumerate(words))
    s = " + ".join(f"CASE WHEN f{i} > 0 THEN f{i} / len(ts) * log10(n / (d{i} + 1)) ELSE 0 END" for i in range(len(words)))
    has = (" AND " if every else " OR ").join(f"f{i} > 0" for i in range(len(words)))
    return f"{name}_f AS (SELECT doc_id, ts, {tf} FROM tok WHERE {extra}), {name}_d AS (SELECT n, {df} FROM n), {name} AS (SELECT doc_id, {s} AS s FROM {name}_f, {name}_d WHERE {has})"


def documents(spark, sf_dir) -> Source:
    df = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    return Source(df, "doc_id", parse_schema({"text": {"type": "text", "text": {"analyser": "standard"}}, "lang": s_index(), "n_chars": {"type": "integer"}}))


@query(f"SELECT doc_id, array_to_string({TOKENS_SQL}, ' ') AS tokens FROM documents")
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY doc_id, term")
def text_tf(spark, sf_dir):
    return text.postings(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


@query(f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS term FROM documents) GROUP BY term")
def text_df(spark, sf_dir):
    return text.frequencies(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


def _text() -> None:
    for name, words, every, limit, weight, lang in (
        ("text_all", ["ering", "onth"], True, 20, 1.0, None),
        ("text_any", ["ersh", "thanedble"], False, 20, 1.0, None),
        ("text_tfidf", ["retion", "onwh", "onble"], False, 75, 1.0, None),
        ("text_prefilter", ["le", "der"], False, 15, 1.0, "fr"),
        ("text_limit", ["antion"], True, 5, 1.0, None),
        ("text_weight", ["rely", "und"], False, 10, 3.5, None),
    ):

        def run(spark, sf_dir, words=words, every=every, limit=limit, weight=weight, lang=lang):
            more = {"filter": leaf("lang", "string", "equals", lang)} if lang else {}
            q = leaf("text", "text", "containsAll" if every else "containsAny", " ".join(words), limit=limit, weight=weight, **more)
            got = search(documents(spark, sf_dir), {"query": q, "select": ["lang"], "limit": limit}, rank=True)
            return ranked(got, "doc_id", "lang", distance=False, score=True)

        where = f"lang = '{lang}'" if lang else "TRUE"
        query(f"""WITH {SCORES} {sql_scores("h", words, every, where)}
SELECT doc_id, lang, round(s, 6) + 0.0 AS _score, round(s * {weight}, 6) + 0.0 AS "_hybridScore", row_number() OVER (ORDER BY s DESC, doc_id) AS _rank
FROM h JOIN tok USING (doc_id) ORDER BY s DESC, doc_id LIMIT {limit}""", name)(run)


_text()


@query("SELECT doc_id, lang FROM documents WHERE FALSE")
def text_stopwords_only(spark, sf_dir):
    q = leaf("text", "text", "containsAny", "the and of", limit=10)
    return search(documents(spark, sf_dir), {"query": q, "select": ["lang"], "limit": 10}).select("doc_id", "lang")


CHANGED = "CASE WHEN doc_id % 10 = 3 THEN 'thanedble onwh' ELSE text END"


@query(f"""WITH documents AS (SELECT doc_id, lang, {CHANGED} AS text FROM documents WHERE doc_id % 10 <> 7), {SCORES} {sql_scores("h", ["thanedble", "onwh"], True)}
SELECT doc_id, round(s, 6) + 0.0 AS _score, row_number() OVER (ORDER BY s DESC, doc_id) AS _rank FROM h ORDER BY s DESC, doc_id LIMIT 30""")
def text_after_update(spark, sf_dir):
    """The ranking after one tenth of the documents was updated and another deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    updates = docs.where("doc_id % 10 = 3").select("doc_id", F.lit("thanedble onwh").alias("text"))
    now = mutate.merged(mutate.deleted(docs, docs.where("doc_id % 10 = 7"), "doc_id"), updates, "doc_id", ["text"])
    source = Source(now, "doc_id", documents(spark, sf_dir).schema)
    got = search(source, {"query": leaf("text", "text", "containsAll", "thanedble onwh", limit=30), "limit": 30}, rank=True)
    return got.select("doc_id", rounded("_score"), "_rank")


def sql_hits(h: str, k: int) -> str:
    return f"{h}_k AS (SELECT * FROM {h} ORDER BY s DESC, doc_id LIMIT {k})"


def two_texts(tree: str) -> dict:
    return {"property": tree, tree: [leaf("text", "text", "containsAny", "ersh ernt", limit=60), leaf("text", "text", "containsAny", "onth erea", limit=60, weight=0.5)]}


def _two_texts() -> None:
    for name, tree, having in (("and_text_text", "_and", "count(*) = 2"), ("or_text_text", "_or", "TRUE")):

        def run(spark, sf_dir, tree=tree):
            got = search(documents(spark, sf_dir), {"query": two_texts(tree), "limit": 100}, rank=True)
            return ranked(got, "doc_id", distance=False, score=True)

        query(f"""WITH {SCORES} {sql_scores("a", ["ersh", "ernt"], False)}, {sql_scores("b", ["onth", "erea"], False)}, {sql_hits("a", 60)}, {sql_hits("b", 60)},
u AS (SELECT doc_id, s, s AS h, 0 AS o FROM a_k UNION ALL SELECT doc_id, s, s * 0.5, 1 FROM b_k),
g AS (SELECT doc_id, min_by(s, o) AS s, sum(h) AS h FROM u GROUP BY doc_id HAVING {having})
SELECT doc_id, round(s, 6) + 0.0 AS _score, round(h, 6) + 0.0 AS "_hybridScore", row_number() OVER (ORDER BY h DESC, doc_id) AS _rank FROM g ORDER BY h DESC, doc_id LIMIT 100""", name)(run)


_two_texts()


@query(f"""WITH {SCORES} {sql_scores("a", ["ersh"], False)}, {sql_hits("a", 10)},
r AS (SELECT doc_id, s, s AS h, TRUE AS ranked FROM a_k UNION ALL SELECT doc_id, NULL, 0, FALSE FROM documents WHERE n_chars < 120 AND doc_id NOT IN (SELECT doc_id FROM a_k))
SELECT doc_id, round(s, 6) + 0.0 AS _score, round(h, 6) + 0.0 AS "_hybridScore", row_number() OVER (ORDER BY ranked DESC, h DESC, doc_id) AS _rank FROM r ORDER BY ranked DESC, h DESC, doc_id LIMIT 40""")
def or_text_pred_tail(spark, sf_dir):
    q = {"property": "_or", "_or": [leaf("text", "text", "containsAny", "ersh", limit=10), leaf("n_chars", "integer", "lessThan", 120)]}
    return ranked(search(documents(spark, sf_dir), {"query": q, "limit": 40}, rank=True), "doc_id", distance=False, score=True)


# hybrid: documents with the embedding of the same number


def both(spark, sf_dir) -> Source:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    vecs = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    vecs = vecs.withColumn("turned", F.reverse("embedding"))
    schema = {"text": {"type": "text", "text": {"analyser": "standard"}}, "lang": s_index(), "n_chars": {"type": "integer"}, "label": {"type": "integer"}, "embedding": v_index("euclidean"), "turned": v_index("dot", kind="vectorVamana")}
    return Source(docs.join(vecs, "doc_id"), "doc_id", parse_schema(schema))


BOTH = f"docs AS (SELECT d.doc_id, d.text, d.lang, d.n_chars, e.label, CAST(e.embedding AS DOUBLE[]) AS v, list_reverse(CAST(e.embedding AS DOUBLE[])) AS t FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id), {SCORES.replace('FROM documents', 'FROM docs')}"


def sql_near(name: str, metric: str, column: str, q: str, k: int, weight: float, where: str = "TRUE") -> str:
    return f"{name} AS (SELECT doc_id, {sql_distance(metric, column, q)} AS d FROM docs WHERE {where} ORDER BY 2, 1 LIMIT {k}), {name}_h AS (SELECT doc_id, d, d * {-weight} AS h FROM {name})"


FUSED = """SELECT doc_id, round(d, 6) + 0.0 AS _distance, round(s, 6) + 0.0 AS _score, round(h, 6) + 0.0 AS "_hybridScore", row_number() OVER (ORDER BY h DESC, doc_id) AS _rank FROM g ORDER BY h DESC, doc_id LIMIT {}"""


def _hybrid() -> None:
    for name, tree, having in (("hybrid_vec_text_or", "_or", "TRUE"), ("hybrid_vec_text_and", "_and", "count(*) = 2")):

        def run(spark, sf_dir, tree=tree):
            q = {"property": tree, tree: [near("embedding", embedding(spark, sf_dir, 0), 60, weight=0.5), leaf("text", "text", "containsAny", "ersh ernt onth", limit=75, weight=20)]}
            return ranked(search(both(spark, sf_dir), {"query": q, "limit": 100}, rank=True), "doc_id", score=True)

        query(f"""WITH {BOTH} {sql_scores("a", ["ersh", "ernt", "onth"], False)}, {sql_hits("a", 75)}, {sql_near("n1", "l2", "v", Q0.format(0), 60, 0.5)},
u AS (SELECT doc_id, d, NULL AS s, h FROM n1_h UNION ALL SELECT doc_id, NULL, s, s * 20 FROM a_k),
g AS (SELECT doc_id, max(d) AS d, max(s) AS s, sum(h) AS h FROM u GROUP BY doc_id HAVING {having}) {FUSED.format(100)}""", name)(run)


_hybrid()


@query(f"""WITH {BOTH} {sql_near("n1", "l2", "v", Q0.format(1), 30, 1.0)}, {sql_near("n2", "dot", "t", f"list_reverse({Q0.format(2)})", 30, 0.5)},
u AS (SELECT doc_id, d, h, 0 AS o FROM n1_h UNION ALL SELECT doc_id, d, h, 1 FROM n2_h),
g AS (SELECT doc_id, min_by(d, o) AS d, CAST(NULL AS DOUBLE) AS s, sum(h) AS h FROM u GROUP BY doc_id) {FUSED.format(60)}""")
def hybrid_two_vectors(spark, sf_dir):
    """Two vector properties; a document that both rank has the distance of the first."""
    q = {"property": "_or", "_or": [near("embedding", embedding(spark, sf_dir, 1), 30), near("turned", embedding(spark, sf_dir, 2)[::-1], 30, "vectorVamana", weight=0.5)]}
    return ranked(search(both(spark, sf_dir), {"query": q, "limit": 60}, rank=True), "doc_id", score=True)


@query(f"""WITH {BOTH} {sql_scores("a", ["ersh", "ernt", "onth", "erea"], False)}, {sql_hits("a", 75)}, {sql_near("n1", "l2", "v", Q0.format(3), 50, 0.3, "label <= 6 AND n_chars > 200")},
u AS (SELECT doc_id, d, NULL AS s, h, 0 AS o FROM n1_h UNION ALL SELECT doc_id, NULL, s, s * 10, 1 FROM a_k),
f AS (SELECT doc_id, max(d) AS d, max(s) AS s, sum(h) AS h FROM u GROUP BY doc_id),
g AS (SELECT f.*, lang, n_chars FROM f JOIN docs USING (doc_id) WHERE n_chars <= 6000 AND (label <> 5 OR lang = 'en'))
SELECT doc_id, lang, n_chars, round(d, 6) + 0.0 AS _distance, round(s, 6) + 0.0 AS _score, round(h, 6) + 0.0 AS "_hybridScore", row_number() OVER (ORDER BY lang DESC, n_chars, h DESC, doc_id) AS _rank
FROM g QUALIFY _rank > 3 AND _rank <= 23""")
def kitchen_sink(spark, sf_dir):
    """Rankers with filters inside an ``_or`` inside an ``_and`` with predicates; sorted by fields and paged."""
    rankers = {"property": "_or", "_or": [
        near("embedding", embedding(spark, sf_dir, 3), 50, weight=0.3, filter={"property": "_and", "_and": [leaf("label", "integer", "lessThanOrEquals", 6), leaf("n_chars", "integer", "greaterThan", 200)]}),
        leaf("text", "text", "containsAny", "ersh ernt onth erea", limit=75, weight=10)]}
    q = {"property": "_and", "_and": [rankers, leaf("n_chars", "integer", "lessThanOrEquals", 6000), {"property": "_or", "_or": [leaf("label", "integer", "notEquals", 5), leaf("lang", "string", "equals", "EN")]}]}
    request = {"query": q, "select": ["lang", "n_chars"], "sort": [{"property": "lang", "descending": True}, {"property": "n_chars"}], "offset": 3, "limit": 20}
    return ranked(search(both(spark, sf_dir), request, rank=True), "doc_id", "lang", "n_chars", score=True)


# selection, sorting, paging

ORDERS = {"o_totalprice": {"type": "float"}, "o_orderpriority": s_index()}
URGENT = leaf("o_orderpriority", "string", "equals", "1-URGENT")


def orders(spark, sf_dir) -> Source:
    return Source(table(spark, sf_dir, "orders"), "o_orderkey", parse_schema(ORDERS))


@query("SELECT o_orderkey, CAST(NULL AS DOUBLE) AS _distance, CAST(NULL AS DOUBLE) AS _score, 0.0::DOUBLE AS \"_hybridScore\" FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 100")
def select_none(spark, sf_dir):
    return search(orders(spark, sf_dir), {"query": URGENT, "limit": 100})


@query("SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 50")
def select_star(spark, sf_dir):
    got = search(orders(spark, sf_dir), {"query": URGENT, "select": ["o_custkey", "*"], "limit": 50})
    return got.drop("_distance", "_score", "_hybridScore")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 50")
def select_fields(spark, sf_dir):
    got = search(orders(spark, sf_dir), {"query": URGENT, "select": ["o_custkey", "o_totalprice", "nosuchfield"], "limit": 50})
    return got.select("o_orderkey", "o_custkey", "o_totalprice")


def nested_events(spark, sf_dir) -> Source:
    df = table(spark, sf_dir, "events").select("event_id", "value", "event_type", F.struct(F.from_json("props", "k bigint")["k"].alias("k"), F.col("user_id").alias("u")).alias("a"))
    return Source(df, "event_id", parse_schema({"event_type": s_index(), "a.k": {"type": "integer"}}))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, row_number() OVER (ORDER BY event_id) AS _rank FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 7 ORDER BY event_id LIMIT 60")
def select_nested(spark, sf_dir):
    got = search(nested_events(spark, sf_dir), {"query": leaf("a.k", "integer", "equals", 7), "select": ["a.k"], "limit": 60}, rank=True)
    return got.select("event_id", F.col("a.k").alias("k"), "_rank")


@query("SELECT event_id, row_number() OVER (ORDER BY CAST(json_extract(props, '$.k') AS BIGINT) DESC, user_id, event_id) AS _rank FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50 QUALIFY _rank <= 80")
def sort_nested(spark, sf_dir):
    request = {"query": leaf("a.k", "integer", "greaterThan", 50), "select": ["a"], "sort": [{"property": "a.k", "descending": True}, {"property": "a.u"}], "limit": 80}
    return search(nested_events(spark, sf_dir), request, rank=True).select("event_id", "_rank")


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS _rank FROM orders WHERE o_totalprice > 200000 QUALIFY _rank <= 100")
def sort_multi(spark, sf_dir):
    request = {"query": leaf("o_totalprice", "float", "greaterThan", 200000.0), "select": ["o_orderpriority", "o_totalprice"], "sort": [{"property": "o_orderpriority", "descending": True}, {"property": "o_totalprice"}], "limit": 100}
    return search(orders(spark, sf_dir), request, rank=True).select("o_orderkey", "o_orderpriority", "_rank")


def labelled(spark, sf_dir) -> Source:
    df = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return Source(df, "doc_id", parse_schema({"n_chars": {"type": "integer"}}))


def _missing() -> None:
    for name, q, descending in (("sort_missing_last", "n_chars < 900", True), ("sort_unselected_noop", "n_chars < 900", False)):
        noop = name == "sort_unselected_noop"

        def run(spark, sf_dir, descending=descending, noop=noop):
            request = {"query": leaf("n_chars", "integer", "lessThan", 900), "select": ["lang"] if noop else ["quality"], "sort": [{"property": "quality", "descending": descending}], "limit": 100}
            return search(labelled(spark, sf_dir), request, rank=True).select("doc_id", "_rank")

        order = "doc_id" if noop else "quality DESC NULLS LAST, doc_id"
        query(f"SELECT doc_id, row_number() OVER (ORDER BY {order}) AS _rank FROM documents LEFT JOIN labels USING (doc_id) WHERE {q} QUALIFY _rank <= 100", name)(run)


_missing()


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 5 WHEN 1 THEN 2 WHEN 2 THEN 1 END AS r, n_chars, lang FROM documents)
SELECT doc_id, row_number() OVER (ORDER BY r NULLS LAST, CASE WHEN r = 2 THEN n_chars END NULLS LAST, CASE WHEN r = 5 THEN lang END NULLS LAST, doc_id) AS _rank FROM d QUALIFY _rank <= 100""")
def sort_mixed(spark, sf_dir):
    """A field that holds strings, numbers, booleans or nothing sorts by kind first."""
    d = table(spark, sf_dir, "documents")
    r = F.col("doc_id") % 4
    value = F.when(r == 0, F.to_json(F.struct(F.col("lang").alias("x")))).when(r == 1, F.to_json(F.struct(F.col("n_chars").alias("x")))).when(r == 2, F.lit('{"x":true}')).otherwise(F.lit("{}"))
    df = d.select(F.col("doc_id").alias("_id"), value.alias("_doc"), F.col("n_chars").alias("p:n"))
    source = collection.Documents(df, parse_schema({"n": {"type": "integer"}}))
    request = {"query": leaf("n", "integer", "greaterThanOrEquals", 0), "select": ["x"], "sort": [{"property": "x"}], "limit": 100}
    return search(source, request, rank=True).select(F.col("_id").alias("doc_id"), "_rank")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS _rank FROM orders WHERE o_orderpriority = '1-URGENT' QUALIFY _rank > 40 AND _rank <= 70")
def page_offset(spark, sf_dir):
    request = {"query": URGENT, "select": ["o_totalprice"], "sort": [{"property": "o_totalprice", "descending": True}], "offset": 40, "limit": 30}
    return search(orders(spark, sf_dir), request, rank=True).select("o_orderkey", "_rank")


# quantizers


@query("SELECT i - 1 AS dim, round(avg(x), 9) + 0.0 AS threshold FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i")
def bq_fit_mean(spark, sf_dir):
    return quantize.mean_thresholds(table(spark, sf_dir, "embeddings"), F.col("embedding")).select(F.col("dim").cast("long").alias("dim"), rounded("threshold", 9))


MEANS = "m AS (SELECT list(a ORDER BY i) AS m FROM (SELECT i, avg(x) AS a FROM (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i))"


@query(f"WITH {MEANS} SELECT vec_id, array_to_string(list_transform(list_zip(CAST(embedding AS DOUBLE[]), m), lambda z: CASE WHEN z[1] > z[2] THEN '1' ELSE '0' END), '') AS code FROM embeddings, m")
def bq_encode(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    t = quantize.fit_binary(e, F.col("embedding"), Quantizer("binary", None, 0, "hamming"))
    word = D.packed(F.col("embedding"), 64, t).getItem(0)
    return e.select("vec_id", F.reverse(F.lpad(F.bin(word), 64, "0")).alias("code"))


def _bq() -> None:
    for short in ("hamming", "jaccard"):
        on = "CAST({0} AS DOUBLE[])"

        def run(spark, sf_dir, short=short):
            index = v_index("euclidean", quantizer={"type": "binary", "binary": {"triggerThreshold": 100, "distanceMetric": short}})
            source = Source(table(spark, sf_dir, "embeddings"), "vec_id", parse_schema({"embedding": index}))
            got = search(source, {"query": near("embedding", embedding(spark, sf_dir, 4), 10), "limit": 10}, rank=True)
            return got.select("vec_id", rounded("_distance"), "_rank")

        a = "list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), m), lambda z: z[1] > z[2])"
        b = "list_transform(list_zip(CAST(q.embedding AS DOUBLE[]), m), lambda z: z[1] > z[2])"
        count = lambda cond: f"list_sum(list_transform(list_zip(a, b), lambda z: CASE WHEN {cond} THEN 1.0 ELSE 0.0 END))"
        d = count("z[1] <> z[2]") if short == "hamming" else f"1 - {count('z[1] AND z[2]')} / {count('z[1] OR z[2]')}"
        query(f"""WITH {MEANS}, c AS (SELECT e.vec_id, {a} AS a, {b} AS b FROM embeddings e, embeddings q, m WHERE q.vec_id = 4), d AS (SELECT vec_id, {d} AS d FROM c)
SELECT vec_id, round(d, 6) + 0.0 AS _distance, row_number() OVER (ORDER BY d, vec_id) AS _rank FROM d ORDER BY d, vec_id LIMIT 10""", f"knn_bq_{short}")(run)


_bq()


def codebook(spark, sf_dir, metric: str = "euclidean") -> quantize.Product:
    """Fixed centroids: the sub-vectors of the first 16 embeddings, in 8 parts."""
    first = table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(16).toPandas()
    x = np.stack(first["embedding"].to_numpy()).astype(np.float64)
    return quantize.Product([x[:, i * 8 : i * 8 + 8] for i in range(8)], metric)


PARTS = "list_transform(range(0, 8), lambda p: CAST({0} AS DOUBLE[])[p * 8 + 1 : p * 8 + 8])"
PQ = f"""f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS j, embedding FROM embeddings ORDER BY vec_id LIMIT 16),
b AS (SELECT j, unnest(range(0, 8)) AS p, unnest({PARTS.format("embedding")}) AS c FROM f),
x AS (SELECT vec_id, unnest(range(0, 8)) AS p, unnest({PARTS.format("embedding")}) AS s FROM embeddings),
n AS (SELECT vec_id, p, arg_min(j, (list_distance(s, c), j)) AS code FROM x JOIN b USING (p) GROUP BY vec_id, p)"""


@query(f"WITH {PQ} SELECT vec_id, string_agg(CAST(code AS VARCHAR), '-' ORDER BY p) AS code FROM n GROUP BY vec_id")
def pq_encode(spark, sf_dir):
    book = codebook(spark, sf_dir)
    codes = book.encode(F.col("embedding"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(codes, lambda c: c.cast("string")), "-").alias("code"))


def sql_kmeans(parts: int, k: int, rounds: int, rows: int = quantize.FIT_ROWS) -> str:
    """CTEs that end in ``m`` (p, j, c): centroids of each sub-vector, begun at the farthest rows, after Lloyd's rounds."""
    width = 64 // parts
    part = f"list_transform(range(0, {parts}), lambda p: v[p * {width} + 1 : p * {width} + {width}])"
    out = [f"t AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT {rows})", f"x AS MATERIALIZED (SELECT vec_id, unnest(range(0, {parts})) AS p, unnest({part}) AS s FROM t)", "c0 AS MATERIALIZED (SELECT p, arg_min(s, vec_id) AS c FROM x GROUP BY p)", "f0 AS MATERIALIZED (SELECT vec_id, x.p, s, pow(list_distance(s, c), 2) AS d FROM x JOIN c0 USING (p))"]
    for i in range(1, k):
        out += [f"c{i} AS MATERIALIZED (SELECT p, arg_max(s, (d, -vec_id)) AS c FROM f{i - 1} GROUP BY p)", f"f{i} AS MATERIALIZED (SELECT vec_id, f.p, s, least(d, pow(list_distance(s, c), 2)) AS d FROM f{i - 1} f JOIN c{i} USING (p))"]
    out.append("m0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT p, {i} AS j, c FROM c{i}" for i in range(k)) + ")")
    for r in range(rounds):
        out += [f"l{r} AS MATERIALIZED (SELECT vec_id, p, any_value(s) AS s, arg_min(j, (pow(list_distance(s, c), 2), j)) AS j FROM x JOIN m{r} USING (p) GROUP BY vec_id, p)", f"a{r} AS (SELECT p, j, list(a ORDER BY i) AS c FROM (SELECT p, j, i, avg(e) AS a FROM (SELECT p, j, unnest(s) AS e, generate_subscripts(s, 1) AS i FROM l{r}) GROUP BY p, j, i) GROUP BY p, j)", f"m{r + 1} AS MATERIALIZED (SELECT m{r}.p, m{r}.j, coalesce(a{r}.c, m{r}.c) AS c FROM m{r} LEFT JOIN a{r} USING (p, j))"]
    return ", ".join([*out, f"m AS (SELECT * FROM m{rounds})"])


@query(f"WITH {sql_kmeans(8, 16, 3)} SELECT CAST(p AS INTEGER) AS part, CAST(j AS INTEGER) AS centroid, CAST(i - 1 AS INTEGER) AS dim, round(e, 6) + 0.0 AS value FROM (SELECT p, j, unnest(c) AS e, generate_subscripts(c, 1) AS i FROM m)")
def pq_fit(spark, sf_dir):
    """Codebooks by three rounds of k-means over the first vectors."""
    book = quantize.fit_product(table(spark, sf_dir, "embeddings"), "vec_id", F.col("embedding"), Quantizer("product", None, 100, None, 16, 8), "euclidean", 3)
    rows = [(i, j, d, float(v)) for i, b in enumerate(book.books) for j, c in enumerate(b) for d, v in enumerate(c)]
    return spark.createDataFrame(rows, "part int, centroid int, dim int, value double").select("part", "centroid", "dim", rounded("value"))


@query(f"""WITH {PQ}, q AS (SELECT p, code FROM n WHERE vec_id = 7), d AS (SELECT n.vec_id, sum(pow(list_distance(a.c, b.c), 2)) AS d FROM n JOIN b a ON a.p = n.p AND a.j = n.code JOIN q ON q.p = n.p JOIN b ON b.p = q.p AND b.j = q.code GROUP BY n.vec_id)
SELECT vec_id, round(d, 6) + 0.0 AS distance FROM d ORDER BY d, vec_id LIMIT 10""")
def knn_pq_symmetric(spark, sf_dir):
    """Distances between codes, of a stored point to all others."""
    book = codebook(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings").select("vec_id", book.encode(F.col("embedding")).alias("code"))
    q = e.where("vec_id = 7").first()["code"]
    return vector.nearest(e, "vec_id", book.symmetric(F.col("code"), F.array(*map(F.lit, q))), 10).select("vec_id", rounded("distance"))


def _pq() -> None:
    for name, metric in (("knn_pq_adc", "dot"), ("knn_pq_cosine", "cosine")):

        def run(spark, sf_dir, metric=metric):
            book = codebook(spark, sf_dir, metric)
            e = table(spark, sf_dir, "embeddings")
            d = book.asymmetric(book.encode(F.col("embedding")), embedding(spark, sf_dir, 0))
            return vector.nearest(e, "vec_id", d, 10).select("vec_id", rounded("distance"))

        d = "sum(pow(list_distance(q.s, b.c), 2))" if metric == "cosine" else "-sum(list_inner_product(q.s, b.c))"
        query(f"""WITH {PQ}, q AS (SELECT p, s FROM x WHERE vec_id = 0), d AS (SELECT n.vec_id, {d} AS d FROM n JOIN b ON b.p = n.p AND b.j = n.code JOIN q ON q.p = n.p GROUP BY n.vec_id)
SELECT vec_id, round(d, 6) + 0.0 AS distance FROM d ORDER BY d, vec_id LIMIT 10""", name)(run)


_pq()


@query(f"WITH {sql_kmeans(1, 10, 4)} SELECT vec_id, CAST(arg_min(j, (pow(list_distance(CAST(embedding AS DOUBLE[]), c), 2), j)) AS INTEGER) AS cluster FROM embeddings, m GROUP BY vec_id")
def kmeans_labels(spark, sf_dir):
    """The cluster of every vector, by centroids of four rounds on the first vectors and a scan of all."""
    e = table(spark, sf_dir, "embeddings")
    book = quantize.fit_product(e, "vec_id", F.col("embedding"), Quantizer("product", None, 1, None, 10, 1), "euclidean", 4)
    return e.select("vec_id", book.encode(F.col("embedding")).getItem(0).alias("cluster"))


# mutations


@query("SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS price, p_size FROM part WHERE p_size >= 10 AND p_size <= 40")
def ingest_validated(spark, sf_dir):
    """Points as JSON through the validator: integers lose their fractions, ill-typed points are refused."""
    part = table(spark, sf_dir, "part")
    raw = part.select("p_partkey", F.when(F.col("p_size") < 10, F.lit('{"price": "free", "size": 1}')).when(F.col("p_size") > 40, F.lit('{"price": null}')).otherwise(F.to_json(F.struct(F.col("p_retailprice").alias("price"), F.col("p_size").alias("size")))).alias("doc"))
    schema = parse_schema({"price": {"type": "integer"}, "size": {"type": "integer"}})

    def run(batches):
        import pandas as pd

        from .errors import ValidationError
        from .plans.schema import checked_point

        for pdf in batches:
            out = []
            for key, doc in zip(pdf["p_partkey"], pdf["doc"]):
                try:
                    _, _, indexed = checked_point(schema, json.loads(doc), False)
                except ValidationError:
                    continue
                out.append((key, indexed.get("price"), indexed.get("size")))
            yield pd.DataFrame(out, columns=["p_partkey", "price", "p_size"])

    return raw.mapInPandas(run, "p_partkey bigint, price bigint, p_size int")


@query("WITH c AS (SELECT count(*) AS n FROM part) SELECT CAST(n AS BIGINT) AS points, n + 1000 <= 2500 AS admitted FROM c")
def ingest_quota(spark, sf_dir):
    """Whether 1000 more points fit into a plan of 2500."""
    return table(spark, sf_dir, "part").agg(F.count("*").alias("points")).select("points", (F.col("points") + 1000 <= 2500).alias("admitted"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 3 THEN 'already exists' ELSE 'duplicate in batch' END AS reason FROM documents WHERE doc_id % 7 IN (3, 4)")
def insert_reject_existing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    target = docs.where("doc_id % 7 <> 4")
    fresh = docs.where("doc_id % 7 = 4")
    new = docs.where("doc_id % 7 = 3").unionByName(fresh).unionByName(fresh)
    return mutate.rejected(target, new, "doc_id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#new' ELSE p_brand END AS p_brand, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE p_size END AS p_size FROM part")
def update_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    gone = F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit("p_size"))).otherwise(F.array().cast("array<string>"))
    updates = part.where("p_partkey % 3 = 0").select("p_partkey", F.lit("Brand#new").alias("p_brand"), F.lit(None).cast("int").alias("p_size"), gone.alias("gone"))
    return mutate.merged(part, updates, "p_partkey", ["p_brand", "p_size"], "gone")


@query("SELECT p_partkey + 1 AS p_partkey FROM part WHERE p_partkey + 1 NOT IN (SELECT p_partkey FROM part)")
def update_missing(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey")
    return mutate.missing(part.select((F.col("p_partkey") + 1).alias("p_partkey")), part, "p_partkey")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 5 <> 0")
def delete_by_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return mutate.deleted(docs, docs.where("doc_id % 5 = 0"), "doc_id")


@query("SELECT doc_id * 2 AS doc_id FROM documents WHERE doc_id * 2 NOT IN (SELECT doc_id FROM documents)")
def delete_missing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return mutate.missing(docs.select((F.col("doc_id") * 2).alias("doc_id")), docs, "doc_id")


@query("""WITH a AS (SELECT p_partkey, string_split(p_name, ' ') AS o, CASE WHEN p_partkey % 2 = 0 THEN ['new', string_split(p_name, ' ')[1]] END AS n FROM part)
SELECT p_partkey, CASE WHEN n IS NULL THEN 'delete' ELSE 'update' END AS op, CASE WHEN n IS NULL THEN 0 ELSE len(list_distinct(list_filter(n, lambda x: NOT list_contains(o, x)))) END AS added, len(list_distinct(CASE WHEN n IS NULL THEN o ELSE list_filter(o, lambda x: NOT list_contains(n, x)) END)) AS removed FROM a""")
def array_diff(spark, sf_dir):
    """What an array index does about changed values."""
    part = with_words(table(spark, sf_dir, "part"))
    new = F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("new"), F.col("words")[0]))
    d = mutate.array_changes(F.col("words"), new)
    return part.select("p_partkey", mutate.classified(F.col("words"), new).alias("op"), F.size(d["added"]).alias("added"), F.size(d["removed"]).cast("long").alias("removed"))


# the vector-only facade


@query(sql_top("cos", 6, 10).replace('round(d * -1.0, 6) + 0.0 AS "_hybridScore", ', ""))
def v1_search(spark, sf_dir):
    source = Source(table(spark, sf_dir, "embeddings"), "vec_id", parse_schema({"embedding": v_index("cosine", kind="vectorVamana")}))
    got = search(source, {"query": near("embedding", embedding(spark, sf_dir, 6), 10, "vectorVamana"), "select": ["label"], "limit": 10}, rank=True)
    return got.select("vec_id", "label", rounded("_distance"), "_rank")


@query("SELECT vec_id, round(list_sum(list_transform(v, lambda x: x / n)), 6) + 0.0 AS total, round(list_sum(list_transform(v, lambda x: x / n * (x / n))), 6) AS norm FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: 3 * x + 1) AS v, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: (3 * x + 1) * (3 * x + 1)))) AS n FROM embeddings)")
def vec_normalise(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("v", vector.normalised(F.transform("embedding", lambda x: x.cast("double") * 3 + 1)))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    return e.select("vec_id", total.alias("total"), norm.alias("norm")).select("vec_id", rounded("total"), rounded("norm"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten embeddings nearest to number 0 among labels up to 4."""
    return QUERIES["knn_flat_prefilter"](spark, sf_dir)
