"""Distances, predicates, analysis and quantizers, on drawn values and against plain Python or NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonda.functions import distance as D
from sonda.functions.analysis import STOP_WORDS, terms, tokens
from sonda.operators import quantize, text, vector
from sonda.operators.predicates import predicate
from sonda.plans.request import Options
from sonda.plans.schema import Index, Quantizer

RNG = np.random.default_rng(2024)


def measured(spark, rows, column):
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "i int, v array<double>").coalesce(1)
    return [r["d"] for r in df.select("i", column.alias("d")).orderBy("i").collect()]


@pytest.mark.parametrize("size", [1, 6, 65])
def test_float_distances(spark, size):
    x, q = np.round(RNG.normal(size=(9, size)), 3), np.round(RNG.normal(size=size), 3)
    want = {"euclidean": [sum((a - b) ** 2 for a, b in zip(r, q)) for r in x], "dot": [-math.fsum(a * b for a, b in zip(r, q)) for r in x]}
    want["cosine"] = [1 + w for w in want["dot"]]
    for metric, w in want.items():
        assert measured(spark, x, D.distance(metric, F.col("v"), q.tolist())) == pytest.approx(w)
        assert D.distances(metric, x, q[None])[:, 0] == pytest.approx(w)
    assert measured(spark, x[:1], D.distance("euclidean", F.lit(None).cast("array<float>"), q.tolist())) == [None]


@pytest.mark.parametrize("size", [5, 64, 70])
def test_bit_distances(spark, size):
    x, q = RNG.random((12, size)), RNG.random(size)
    x[0] = q * 0  # no bit is on
    on, off = [set(np.flatnonzero(r > 0.5)) for r in x], set(np.flatnonzero(q > 0.5))
    want = {"hamming": [len(a ^ off) for a in on], "jaccard": [1 - len(a & off) / len(a | off) if a | off else 0 for a in on]}
    for metric, w in want.items():
        assert measured(spark, x, D.distance(metric, F.col("v"), q.tolist())) == pytest.approx(w)
        assert D.distances(metric, x, q[None])[:, 0] == pytest.approx(w)
        words = quantize.packed_query(q, [0.5] * size)
        assert measured(spark, x, quantize.words_distance(metric, D.packed(F.col("v"), size, [0.5] * size), words)) == pytest.approx(w)
    assert measured(spark, [[0.0] * size], D.distance("jaccard", F.col("v"), [0.0] * size)) == [0]
    assert measured(spark, [q], D.packed(F.col("v"), size, [0.5] * size)) == [quantize.packed_query(q, [0.5] * size)]


def test_haversine(spark):
    quarter = math.pi * D.EARTH / 2
    places = [[0, 0], [0, 90], [90, 12], [-90, 5], [0, 180]]
    want = [0, quarter, quarter, quarter, 2 * quarter]
    assert measured(spark, places, D.distance("haversine", F.col("v"), [0.0, 0.0])) == pytest.approx(want)
    x = np.stack([RNG.uniform(-80, 80, 20), RNG.uniform(-180, 180, 20)], 1)
    a, b = np.radians(x[1:]), np.radians(x[0])
    angle = np.arccos(np.clip(np.sin(a[:, 0]) * np.sin(b[0]) + np.cos(a[:, 0]) * np.cos(b[0]) * np.cos(a[:, 1] - b[1]), -1, 1))
    assert measured(spark, x[1:], D.distance("haversine", F.col("v"), x[0].tolist())) == pytest.approx(D.EARTH * angle)


def test_number_predicates(spark):
    values = [*RNG.integers(-6, 7, 40).tolist(), None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, c int").cache()
    tests = {"equals": lambda v: v == -1, "notEquals": lambda v: v != -1, "greaterThan": lambda v: v > -1, "greaterThanOrEquals": lambda v: v >= -1, "lessThan": lambda v: v < -1, "lessThanOrEquals": lambda v: v <= -1, "inRange": lambda v: -1 <= v <= 4}
    for op, test in tests.items():
        got = df.where(predicate(F.col("c"), Index("integer"), Options(op, -1, 4 if op == "inRange" else None)))
        assert sorted(r["id"] for r in got.collect()) == [i for i, v in enumerate(values) if v is not None and test(v)]


def test_string_predicates(spark):
    words = ["Apple", "apple", "APRICOT", "banana", "Band", "zebra", "Zoo", "", None, "äpfel"]
    df = spark.createDataFrame(list(enumerate(words)), "id int, c string").cache()

    def ids(case, op, value, end=None):
        return [r["id"] for r in df.where(predicate(F.col("c"), Index("string", case_sensitive=case), Options(op, value, end))).orderBy("id").collect()]

    for case in (True, False):
        fold = (lambda x: x) if case else str.lower
        known = [(i, fold(w)) for i, w in enumerate(words) if w is not None]
        assert ids(case, "equals", "APPLE") == [i for i, w in known if w == fold("APPLE")]
        assert ids(case, "startsWith", "Ban") == [i for i, w in known if w.startswith(fold("Ban"))]
        assert ids(case, "lessThan", "Band") == [i for i, w in known if w.encode() < fold("Band").encode()]
        # the end of a range is taken as it is: below every lower-case word if it is in upper case
        assert ids(case, "inRange", "apple", "zebra") == [i for i, w in known if fold("apple").encode() <= w.encode() <= b"zebra"]
    assert ids(False, "inRange", "apple", "ZEBRA") == []


def test_string_arrays(spark):
    rows = [["Red", "blue"], ["red"], ["BLUE", "green", "red"], ["green", "green"], [], None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, c array<string>").cache()
    for case in (True, False):
        fold = (lambda x: x) if case else str.lower
        for values in (["red"], ["Red", "BLUE"], ["green", "GREEN"], ["yellow", "blue"]):
            want = {fold(v) for v in values}
            for op, test in (("containsAll", lambda have, w: w <= have), ("containsAny", lambda have, w: bool(w & have))):
                got = df.where(predicate(F.col("c"), Index("stringArray", case_sensitive=case), Options(op, values)))
                assert sorted(r["id"] for r in got.collect()) == [i for i, r in enumerate(rows) if r is not None and test({fold(x) for x in r}, want)]


def brute_scores(texts, query, every):
    """{id: score} by the formula, over texts that are already lists of terms."""
    n = sum(bool(t) for t in texts.values())
    df = {w: sum(w in t for t in texts.values()) for w in query}
    keep = {i: t for i, t in texts.items() if t and (all if every else any)(w in t for w in query)}
    return {i: sum(t.count(w) / len(t) * math.log10(n / (df[w] + 1)) for w in query if w in t) for i, t in keep.items()}


def test_text_scores_by_brute_force(spark):
    words = ["river", "stone", "riverstone", "moss", "fern", "o'clock"]
    texts = {i: RNG.choice(words, RNG.integers(1, 12)).tolist() for i in range(80)} | {90: [], 91: []}
    rows = [(i, ("The " * (i % 3) + ", ".join(t)) if t else None if i == 90 else "the of") for i, t in texts.items()]
    rows += [(95, "x" * 300 + " " + "moss " * 3)]  # its first term is longer than the head
    texts[95] = ["x" * 300, "moss", "moss", "moss"]
    df = spark.createDataFrame(rows, "id int, t string").cache()
    stored = text.postings(df, "id", F.col("t")).join(text.lengths(df, "id", F.col("t")), "id")
    n = text.lengths(df, "id", F.col("t")).agg(F.count("*"))
    for query in (["river"], ["stone", "moss"], ["river", "fern", "o'clock"], ["nowhere", "fern"]):
        for every in (True, False):
            want = brute_scores(texts, query, every)
            for got in (text.scored(df, "id", F.col("t"), " ".join(query), every), text.from_postings(stored, "id", n, " ".join(query), every)):
                assert {r["id"]: r["score"] for r in got.collect()} == pytest.approx(want)
            some = [i for i in want if i % 2]
            got = text.scored(df, "id", F.col("t"), " ".join(query), every, F.col("id") % 2 == 1)
            assert sorted(r["id"] for r in got.collect()) == sorted(some)
    assert text.scored(df, "id", F.col("t"), "the and", False).count() == 0 == text.from_postings(stored, "id", n, "the and", False).count()


def test_analysis(spark):
    cases = {
        "The Garden's 7th tree": ["garden's", "7th", "tree"], "Don't WAIT for 2.50 or 1,000,000": ["wait", "2.50", "1,000,000"], "snake_case a.1 x.y. 'quoted'": ["snake_case", "1", "x.y", "quoted"],
        "Ünder-Öffnung naïve": ["ünder", "öffnung", "naïve"], "": [], "l’été": ["l’été"], "éte": ["éte"],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", tokens(F.col("t")).alias("w")).orderBy("i").collect()
    assert [r["w"] for r in rows] == list(cases.values())
    for t, want in cases.items():
        assert terms(t) == list(dict.fromkeys(want))
    long = "a1" * 30_000
    assert spark.createDataFrame([(long,)], "t string").select(tokens(F.col("t")).alias("w")).first()["w"] == [long]
    assert len(STOP_WORDS) == len(set(STOP_WORDS))


def test_binary_quantizer(spark):
    x = np.round(RNG.normal(size=(25, 6)), 2).astype(np.float32)
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "v array<float>")
    assert quantize.fit_binary(df, F.col("v"), Quantizer("binary", None, 25, "hamming")) == pytest.approx(x.astype(float).mean(0).tolist())
    assert quantize.fit_binary(df, F.col("v"), Quantizer("binary", None, 26, "hamming")) is None
    assert quantize.fit_binary(df, F.col("v"), Quantizer("binary", 0.25, 26, "hamming")) == 0.25


def test_kmeans_and_product(spark):
    centres = np.array([[-20, -20], [0, 30], [25, -5]], float)
    which = RNG.integers(0, 3, (90, 2))
    x = np.concatenate([centres[which[:, 0]], centres[which[:, 1]]], 1) + RNG.normal(size=(90, 4)) * 0.5
    for part in (0, 1):
        found, labels = quantize.kmeans(x[:, 2 * part : 2 * part + 2], 3)
        assert len({(a, b) for a, b in zip(labels.tolist(), which[:, part].tolist())}) == 3
        assert sorted(map(tuple, np.round(found / 5).tolist())) == sorted(map(tuple, (centres / 5).tolist()))
    assert (quantize.kmeans(np.full((5, 3), 2.0), 4)[1] == 0).all()
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(999, None)], "id int, v array<double>")
    book = quantize.fit_product(df, "id", F.col("v"), Quantizer("product", None, 90, None, 3, 2), "euclidean")
    assert quantize.fit_product(df, "id", F.col("v"), Quantizer("product", None, 91, None, 3, 2), "dot") is None
    again = quantize.Product.of(book.plain(), "euclidean")
    code = again.encode(F.col("v"))
    rows = df.select("id", code.alias("c"), again.asymmetric(code, x[4].tolist()).alias("a")).orderBy("id").collect()
    decode = lambda c: np.concatenate([b[k] for b, k in zip(book.books, c)])
    assert rows[-1]["c"] is None and rows[-1]["a"] is None
    assert [r["a"] for r in rows[:-1]] == pytest.approx([((decode(r["c"]) - x[4]) ** 2).sum() for r in rows[:-1]])
    pair = spark.createDataFrame([(rows[i]["c"], rows[i + 1]["c"]) for i in range(20)] + [(None, [0, 0])], "a array<int>, b array<int>")
    got = [r["s"] for r in pair.select(book.symmetric(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[-1] is None and got[:-1] == pytest.approx([((decode(rows[i]["c"]) - decode(rows[i + 1]["c"])) ** 2).sum() for i in range(20)])


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine", "hamming", "jaccard"])
def test_batches_equal_brute_force(spark, metric, monkeypatch):
    x = RNG.normal(size=(250, 7))
    x[100:130] = x[:30]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id int, v array<double>").repartition(3)
    queries = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 250, 25)], "q int, qv array<double>")
    d = D.distances(metric, x, x[::25])
    want = {25 * k: [i for _, i in sorted((round(d[i, k], 9), i) for i in range(250))[:6]] for k in range(10)}
    for ids, block, most in (("id", 64, 1 << 20), (F.concat(F.lit("n"), F.lpad("id", 4, "0")).alias("id"), 1024, 1 << 20), ("id", 32, 300)):
        got = vector.nearest_batch(df.select(ids, "v"), "id", "v", queries, "q", "qv", 6, metric, block=block, most_bytes=most).collect()
        for k, ids_k in want.items():
            mine = [int(str(r["id"]).lstrip("n")) for r in sorted((r for r in got if r["q"] == k), key=lambda r: r["rank"])]
            assert [round(d[i, k // 25], 9) for i in mine] == [round(d[i, k // 25], 9) for i in ids_k]
            if metric in ("hamming", "jaccard"):
                assert mine == ids_k
    assert vector.nearest_batch(df.limit(0), "id", "v", queries, "q", "qv", 5, metric).count() == 0
