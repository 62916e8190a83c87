"""Searches over a made-up shop, each compared with plain Python over the same rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sonda.errors import ValidationError
from sonda.plans.compiler import Source, matching, search
from sonda.plans.request import Query, Request
from sonda.plans.schema import parse_schema

SCHEMA = parse_schema({
    "shape": {"type": "vectorVamana", "vectorVamana": {"vectorSize": 3, "distanceMetric": "euclidean", "searchSize": 60, "degreeBound": 40, "alpha": 1.3}},
    "colour": {"type": "vectorFlat", "vectorFlat": {"vectorSize": 3, "distanceMetric": "dot"}},
    "about": {"type": "text", "text": {"analyser": "standard"}},
    "maker": {"type": "string", "string": {"caseSensitive": False}},
    "tags": {"type": "stringArray", "stringArray": {"caseSensitive": True}},
    "stock": {"type": "integer"},
    "cost": {"type": "float"},
    "box.weight": {"type": "integer"},
})
RND = random.Random(77)
WORDS = ["lamp", "oak", "brass", "shade", "tall", "round", "reading", "garden"]
ROWS = [
    {"id": 10 + 3 * n, "shape": [RND.randint(-9, 9) / 2 for _ in range(3)], "colour": [RND.randint(0, 8) / 4 for _ in range(3)], "about": "a " + " ".join(RND.choices(WORDS, k=RND.randint(2, 9))),
     "maker": RND.choice(["Ada", "ADA", "Brix", "coil"]), "tags": RND.sample(["new", "New", "sale", "gift"], RND.randint(0, 3)), "stock": RND.randint(0, 20), "cost": RND.randint(1, 400) / 8, "box": {"weight": RND.randint(1, 5)}, "note": RND.choice([None, "x", "y"])}
    for n in range(70)
]
BY = {r["id"]: r for r in ROWS}
AT, TINT = [0.5, -1.0, 2.0], [1.0, 0.25, 0.5]


@pytest.fixture(scope="module")
def shop(spark):
    shape = "id int, shape array<float>, colour array<float>, about string, maker string, tags array<string>, stock int, cost double, box struct<weight:int>, note string"
    rows = [(*(r[k] for k in ("id", "shape", "colour", "about", "maker", "tags", "stock", "cost")), (r["box"]["weight"],), r["note"]) for r in ROWS]
    return Source(spark.createDataFrame(rows, shape).cache(), "id", SCHEMA)


def shaped(limit, **more):
    return {"property": "shape", "vectorVamana": {"operator": "near", "vector": AT, "limit": limit, "searchSize": 60, **more}}


def coloured(limit, **more):
    return {"property": "colour", "vectorFlat": {"operator": "near", "vector": TINT, "limit": limit, **more}}


def about(value, limit, op="containsAny", **more):
    return {"property": "about", "text": {"operator": op, "value": value, "limit": limit, **more}}


def stock(op, value, **more):
    return {"property": "stock", "integer": {"operator": op, "value": value, **more}}


def by_shape(rows, k):
    d = {r["id"]: sum((a - b) ** 2 for a, b in zip(r["shape"], AT)) for r in rows}
    return {i: d[i] for i in sorted(d, key=lambda i: (d[i], i))[:k]}


def by_colour(rows, k):
    d = {r["id"]: -sum(a * b for a, b in zip(r["colour"], TINT)) for r in rows}
    return {i: d[i] for i in sorted(d, key=lambda i: (d[i], i))[:k]}


def by_text(rows, words, k, every=False):
    terms = {r["id"]: r["about"].split()[1:] for r in ROWS}
    n, df = len(ROWS), {w: sum(w in t for t in terms.values()) for w in words}
    keep = [r["id"] for r in rows if (all if every else any)(w in terms[r["id"]] for w in words)]
    s = {i: sum(terms[i].count(w) / len(terms[i]) * math.log10(n / (df[w] + 1)) for w in words) for i in keep}
    return {i: s[i] for i in sorted(s, key=lambda i: (-round(s[i], 12), i))[:k]}


def hits(shop, query, **more):
    rows = search(shop, {"query": query, "limit": 100, **more}, rank=True).orderBy("_rank").collect()
    return [r["id"] for r in rows], rows


def fused(lists, every=False):
    """Ids by their summed scores, of (signed scores, weight) lists."""
    ids = set.intersection(*(set(s) for s, _ in lists)) if every else set.union(*(set(s) for s, _ in lists))
    total = {i: sum(s[i] * w for s, w in lists if i in s) for i in ids}
    return sorted(ids, key=lambda i: (-round(total[i], 9), i)), total


def minus(d):
    return {i: -x for i, x in d.items()}


def test_rankers(shop):
    ids, rows = hits(shop, shaped(9))
    assert ids == list(by_shape(ROWS, 9)) and [r["_distance"] for r in rows] == pytest.approx(list(by_shape(ROWS, 9).values()))
    assert hits(shop, coloured(7))[0] == list(by_colour(ROWS, 7))
    for every, op in ((False, "containsAny"), (True, "containsAll")):
        want = by_text(ROWS, ["brass", "oak"], 12, every)
        ids, rows = hits(shop, about("Brass the OAK", 12, op))
        assert ids == list(want) and [r["_score"] for r in rows] == pytest.approx(list(want.values()))


@pytest.mark.parametrize("query, test", [
    ({"property": "maker", "string": {"operator": "equals", "value": "aDa"}}, lambda r: r["maker"].lower() == "ada"),
    ({"property": "tags", "stringArray": {"operator": "containsAll", "value": ["New", "sale"]}}, lambda r: {"New", "sale"} <= set(r["tags"])),
    ({"property": "tags", "stringArray": {"operator": "containsAny", "value": ["gift", "none"]}}, lambda r: "gift" in r["tags"]),
    (stock("inRange", 4, endValue=9), lambda r: 4 <= r["stock"] <= 9),
    ({"property": "cost", "float": {"operator": "lessThan", "value": 12.5}}, lambda r: r["cost"] < 12.5),
    ({"property": "box.weight", "integer": {"operator": "notEquals", "value": 3}}, lambda r: r["box"]["weight"] != 3),
    ({"property": "_or", "_or": [stock("equals", 2), {"property": "_and", "_and": [stock("greaterThan", 15), {"property": "maker", "string": {"operator": "startsWith", "value": "B"}}]}]}, lambda r: r["stock"] == 2 or (r["stock"] > 15 and r["maker"] == "Brix")),
])
def test_predicates_keep_id_order(shop, query, test):
    assert hits(shop, query)[0] == [r["id"] for r in ROWS if test(r)]
    assert sorted(r["id"] for r in matching(shop, query).collect()) == [r["id"] for r in ROWS if test(r)]


def test_a_filter_comes_before_the_ranker(shop):
    some = [r for r in ROWS if 5 <= r["stock"] <= 11]
    flt = stock("inRange", 5, endValue=11)
    assert hits(shop, shaped(6, filter=flt))[0] == list(by_shape(some, 6))
    assert hits(shop, coloured(6, filter=flt))[0] == list(by_colour(some, 6))
    assert hits(shop, about("lamp tall", 6, filter=flt))[0] == list(by_text(some, ["lamp", "tall"], 6))
    # the filter may be a ranker itself: its hits are the candidates
    inner = [BY[i] for i in by_text(ROWS, ["round"], 8)]
    assert hits(shop, shaped(5, filter=about("round", 8)))[0] == list(by_shape(inner, 5))


def test_id_predicates(shop):
    name = lambda i: f"1b4e28ba-2fa1-11d2-883f-{i:012x}"
    named = Source(shop.df.withColumn("_id", F.concat(F.lit("1b4e28ba-2fa1-11d2-883f-"), F.lpad(F.lower(F.hex("id")), 12, "0"))), "_id", SCHEMA)
    one = {"property": "_id", "string": {"operator": "equals", "value": name(31).upper()}}
    got = search(named, {"query": shaped(5, filter=one), "limit": 5}).collect()
    assert [r["_id"] for r in got] == [name(31)] and got[0]["_hybridScore"] == -got[0]["_distance"] == pytest.approx(-by_shape([BY[31]], 1)[31])
    assert matching(named, {"property": "_id", "stringArray": {"operator": "containsAny", "value": [name(13), name(14), name(16)]}}).count() == 2


@pytest.mark.parametrize("tree", ["_and", "_or"])
def test_trees_of_rankers_fuse_scores(shop, tree):
    lists = [(minus(by_shape(ROWS, 40)), 0.75), (by_text(ROWS, ["shade", "garden"], 30), 4.0), (minus(by_colour(ROWS, 45)), 1.0)]
    ids, total = fused(lists, tree == "_and")
    got, rows = hits(shop, {"property": tree, tree: [shaped(40, weight=0.75), about("shade garden", 30, weight=4), coloured(45)]})
    assert got == ids and [r["_hybridScore"] for r in rows] == pytest.approx([total[i] for i in ids])
    # of two distances the first child's is shown
    first, second = by_shape(ROWS, 40), by_colour(ROWS, 45)
    assert all(r["_distance"] == pytest.approx(first.get(r["id"], second.get(r["id"]))) for r in rows if r["id"] in first or r["id"] in second)


def test_a_predicate_beside_a_ranker(shop):
    near = by_shape(ROWS, 12)
    ids, _ = hits(shop, {"property": "_and", "_and": [shaped(12), stock("lessThan", 10)]})
    assert ids == [i for i in near if BY[i]["stock"] < 10]  # fewer than 12: filtered afterwards
    tail = [r["id"] for r in ROWS if r["stock"] == 0 and r["id"] not in near]
    ids, rows = hits(shop, {"property": "_or", "_or": [shaped(12), stock("equals", 0)]})
    assert ids == [*near, *tail] and all(r["_hybridScore"] == 0 and r["_distance"] is None for r in rows[12:])


def test_a_lone_child_keeps_the_order_of_distance(shop):
    near = by_shape(ROWS, 5)
    ids, rows = hits(shop, {"property": "_or", "_or": [shaped(5, weight=-3)]})
    assert ids == list(near) and [r["_hybridScore"] for r in rows] == pytest.approx([3 * d for d in near.values()])


def test_scores_of_common_terms_are_negative(spark):
    df = spark.createDataFrame([(1, "green kettle"), (2, "green spoon")], "id int, about string")
    ids, rows = hits(Source(df, "id", SCHEMA), about("spoon", 5))
    assert ids == [2] and rows[0]["_score"] == 0
    ids, rows = hits(Source(df, "id", SCHEMA), about("green", 5))
    assert ids == [1, 2] and all(r["_score"] < 0 for r in rows)


def test_select_sort_and_page(shop):
    keys = [{"property": "box.weight", "descending": True}, {"property": "note"}, {"property": "absent"}, {"property": "cost", "descending": True}]
    ids, rows = hits(shop, stock("greaterThanOrEquals", 0), select=["box.weight", "note", "absent"], sort=keys, offset=4, limit=9)
    # cost isn't selected, so it sorts nothing
    want = sorted(BY, key=lambda i: (-BY[i]["box"]["weight"], BY[i]["note"] or "~", i))
    assert ids == want[4:13] and rows[0]["box"]["weight"] == BY[ids[0]]["box"]["weight"] and rows[0]["_rank"] == 5 and "absent" not in rows[0]
    assert set(search(shop, {"query": stock("equals", 3), "limit": 1}).columns) == {"id", "_distance", "_score", "_hybridScore"}
    star = search(shop, {"query": stock("greaterThan", -1), "select": ["*"], "limit": 1}).first()
    assert star["maker"] == ROWS[0]["maker"] and star["about"] == ROWS[0]["about"]


@pytest.mark.parametrize("descending", [True, False])
def test_missing_sorts_last_both_ways(shop, descending):
    ids, rows = hits(shop, stock("lessThan", 9), select=["note"], sort=[{"property": "note", "descending": descending}])
    notes = [r["note"] for r in rows]
    known = [n for n in notes if n is not None]
    assert notes == [*sorted(known, reverse=descending), *[None] * (len(notes) - len(known))] and known and len(known) < len(notes)


@pytest.mark.parametrize("bad", [
    {"query": {"property": ""}, "limit": 3},
    {"query": stock("equals", 1), "limit": 0}, {"query": stock("equals", 1), "limit": 101}, {"query": stock("equals", 1), "limit": 3, "offset": -2},
    {"query": stock("inRange", 8, endValue=8), "limit": 3}, {"query": stock("startsWith", 8), "limit": 3}, {"query": stock("equals", "eight"), "limit": 3},
    {"query": coloured(76), "limit": 3}, {"query": {"property": "shape", "vectorVamana": {"operator": "near", "vector": AT, "limit": 40, "searchSize": 30}}, "limit": 3},
    {"query": about("", 3), "limit": 3}, {"query": about("lamp", 3, "near"), "limit": 3},
    {"query": {"property": "_or"}, "limit": 3}, {"query": {"property": "_and", "_and": []}, "limit": 3},
    {"query": {"property": "_id", "string": {"operator": "equals", "value": "seven"}}, "limit": 3},
    {"query": {"property": "_id", "string": {"operator": "notEquals", "value": "1b4e28ba-2fa1-11d2-883f-000000000001"}}, "limit": 3},
    {"query": {"property": "tags", "stringArray": {"operator": "containsAll", "value": []}}, "limit": 3},
    {"query": stock("equals", 1), "limit": 3, "sort": [{"property": "cost"}] * 11}, {"query": stock("equals", 1), "limit": 3, "sort": [{"property": ""}]},
])
def test_bad_requests(bad):
    with pytest.raises(ValidationError):
        Request.parse(bad)


@pytest.mark.parametrize("query", [stock("equals", 1) | {"property": "colours"}, stock("equals", 1) | {"property": "maker"}, {"property": "colour", "vectorFlat": {"operator": "near", "vector": [0.5, 0.5], "limit": 3}}])
def test_requests_against_the_schema(query):
    with pytest.raises(ValidationError):
        Query.parse(query).check(SCHEMA)


def test_filters_reach_the_scan(spark, tmp_path, shop):
    shop.df.select("id", "stock", "maker", "cost").write.parquet(str(tmp_path / "p"))
    df = matching(Source(spark.read.parquet(str(tmp_path / "p")), "id", SCHEMA), stock("inRange", 6, endValue=13)).select("id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(stock,6)" in plan and "maker" not in plan
