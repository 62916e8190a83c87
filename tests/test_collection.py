"""Schemas, points, collections, quotas, stored indexes and the mutation stream."""

import json
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonda.errors import AlreadyExists, NotFound, QuotaReached, ValidationError
from sonda.functions import distance as D
from sonda.operators import text as text_ops
from sonda.plans.schema import checked_point, parse_schema
from sonda.sources.collection import Catalog, Documents, Plan, migrate_vectors, vector_search
from sonda.streaming.mutations import apply_batch, apply_stream, rejected

SCHEMA = {
    "where": {"type": "vectorFlat", "vectorFlat": {"vectorSize": 2, "distanceMetric": "euclidean"}},
    "review": {"type": "text", "text": {"analyser": "standard"}},
    "city": {"type": "string", "string": {"caseSensitive": False}},
    "dishes": {"type": "stringArray", "stringArray": {"caseSensitive": False}},
    "rating": {"type": "float"},
    "info.seats": {"type": "integer"},
}
ANY = {"property": "rating", "float": {"operator": "greaterThanOrEquals", "value": -1000}}


def pid(i):
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"place {i}"))


def place(i, **more):
    return {"_id": pid(i), "where": [i * 2, -i], "review": f"soup and bread at table {i}", "city": f"Town{i % 4}", "rating": i / 4, "info": {"seats": 10 + i, "floor": 1}, "open": [i], **more}


def read(c):
    return {r["_id"]: json.loads(r["_doc"]) for r in c.df().collect()}


@pytest.mark.parametrize("doc, ok", [
    ({"where": [0.5, -2]}, True), ({"where": [1, 2, 3]}, False), ({"where": {}}, False), ({"where": [None, 1]}, False), ({"where": None}, False),
    ({"review": ""}, True), ({"review": ["a"]}, False), ({"city": "Rome"}, True), ({"city": 5}, False), ({"city": None}, False),
    ({"dishes": []}, True), ({"dishes": "soup"}, False), ({"dishes": ["soup", 2]}, False), ({"rating": -3}, True), ({"rating": "good"}, False), ({"rating": False}, False),
    ({"info": {"seats": 12.75}}, True), ({"info": {"seats": [12]}}, False), ({"info": {}}, True), ({"info": "none"}, True), ({"else": None}, True), ({}, True), ({"_id": "12"}, False),
])
def test_points(doc, ok):
    schema = parse_schema(SCHEMA)
    if ok:
        _, _, indexed = checked_point(schema, doc, False)
        assert indexed.get("info.seats", 12) == 12  # fractions are cut off
    else:
        with pytest.raises(ValidationError):
            checked_point(schema, doc, False)


GRAPH = {"vectorSize": 8, "distanceMetric": "cosine", "searchSize": 40, "degreeBound": 48, "alpha": 1.15}


@pytest.mark.parametrize("bad", [
    {"type": "map"}, {"type": "text", "text": {"analyser": "french"}}, {"type": "stringArray"}, {"type": "vectorFlat", "vectorFlat": {"vectorSize": -1, "distanceMetric": "cosine"}},
    {"type": "vectorFlat", "vectorFlat": {"vectorSize": 5000, "distanceMetric": "cosine"}}, {"type": "vectorFlat", "vectorFlat": {"vectorSize": 4, "distanceMetric": "haversine"}},
    {"type": "vectorFlat", "vectorFlat": {"vectorSize": 4, "distanceMetric": "manhattan"}}, *({"type": "vectorVamana", "vectorVamana": GRAPH | x} for x in ({"searchSize": 80}, {"degreeBound": 31}, {"alpha": 1.0}, {"lists": 1}, {"lists": 8, "probes": 9}, {"lists": 8, "distanceMetric": "hamming"})),
    *({"type": "vectorFlat", "vectorFlat": {"vectorSize": 6, "distanceMetric": "euclidean", "quantizer": q}} for q in (
        {"type": "scalar"}, {"type": "binary", "binary": {"triggerThreshold": 7, "distanceMetric": "euclidean"}}, {"type": "binary", "binary": {"triggerThreshold": 60_000, "distanceMetric": "hamming"}},
        {"type": "product", "product": {"numCentroids": 1, "numSubVectors": 3, "triggerThreshold": 2000}}, {"type": "product", "product": {"numCentroids": 8, "numSubVectors": 4, "triggerThreshold": 2000}}, {"type": "product", "product": {"numCentroids": 8, "numSubVectors": 3, "triggerThreshold": 10}})),
])
def test_bad_schemas(bad):
    with pytest.raises(ValidationError):
        parse_schema({"p": bad})
    assert parse_schema({"p": {"type": "vectorVamana", "vectorVamana": GRAPH | {"lists": 9}}})["p"].probes == 7


def test_life_of_a_collection(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    c = cat.create("ann", "places", SCHEMA, Plan(max_collections=1, max_points=18, max_parts=3))
    with pytest.raises(AlreadyExists):
        cat.create("ann", "places", SCHEMA)
    with pytest.raises(QuotaReached):
        cat.create("ann", "others", SCHEMA, Plan(max_collections=1))
    for name in ("No", "with-dash", "x" * 25):
        with pytest.raises(ValidationError):
            cat.create("ann", name, SCHEMA)
    with pytest.raises(NotFound):
        cat.get("ann", "missing")
    assert c.search({"query": ANY, "limit": 5}).count() == 0
    assert c.insert([place(i) for i in range(12)]) == [pid(i) for i in range(12)]
    assert c.count() == 12 == c.df().count() and cat.list("ann") == ["places"]
    for bad, error in (([place(3)], AlreadyExists), ([place(50), place(50)], AlreadyExists), ([place(60 + i) for i in range(7)], QuotaReached), ([], ValidationError), ([{"city": 1}], ValidationError)):
        with pytest.raises(error):
            c.insert(bad)
    assert uuid.UUID(c.insert([{"rating": 9.5}])[0]) and c.count() == 13
    # a shallow merge; a removed key; an id that isn't there
    assert c.update([{"_id": pid(6), "info": {"seats": 99}, "city": "Elsewhere", "rating": "_delete"}, {"_id": pid(400), "city": "x"}]) == [{"id": pid(400), "error": "not found"}]
    at = {"property": "city", "string": {"operator": "equals", "value": "ELSEWHERE"}}
    want = {k: v for k, v in place(6).items() if k != "rating"} | {"info": {"seats": 99}, "city": "Elsewhere", "_hybridScore": 0.0}
    assert c.results({"query": at, "select": ["*"], "limit": 5}) == [want]
    assert c.results({"query": {"property": "info.seats", "integer": {"operator": "equals", "value": 99}}, "select": ["info.seats", "city", "absent"], "limit": 5})[0]["info"] == {"seats": 99}
    assert c.delete([pid(2), pid(401)]) == [{"id": pid(401), "error": "not found"}] and c.count() == 12 == c.df().count()
    c.insert([place(2)])
    near = {"property": "where", "vectorFlat": {"operator": "near", "vector": [4, -2], "limit": 3}}
    top = c.results({"query": near, "select": ["city", "_distance"], "limit": 3})
    assert [x["_id"] for x in top][0] == pid(2) and {x["_id"] for x in top[1:]} == {pid(1), pid(3)} and top[1]["_distance"] == 5
    for i in range(4):  # parts are merged by themselves, tombstones of the others stay
        c.delete([pid(i)])
        c.insert([place(i)])
    m = c.manifest
    assert len(m["parts"]) <= 3 and len(m["tombstones"]) <= 4 and sum(m["sizes"].values()) >= 13 and c.count() == 13 == c.df().count() and set(m["sizes"]) == set(m["parts"])
    assert c.postings().where("term = 'soup'").count() == 12
    c.compact()
    assert c.df().count() == 13 and c.manifest["tombstones"] == [] and c.vacuum() > 0 and c.df().count() == 13
    assert sum(p["pointCount"] for p in c.describe()["parts"]) == 13
    kept = [c.backup(f"{tmp_path}/backups", keep=2) for _ in range(3)]
    assert spark.read.parquet(kept[-1]).count() == 13 and c.backup(f"{tmp_path}/backups", 2, 3600) is None
    before = read(c)
    c.dump(str(tmp_path / "dump"))
    cat.drop("ann", "places")
    assert cat.list("ann") == []
    again = cat.create("ann", "again", SCHEMA)
    assert again.load_dump(str(tmp_path / "dump")) == 13 and read(again) == before


def test_frames(spark, tmp_path):
    c = Catalog(spark, str(tmp_path)).create("u", "frames", SCHEMA)
    frame = lambda rows: spark.createDataFrame(rows, "_id string, _doc string")
    # equal documents without ids are two points
    assert c.insert_frame(frame([(None, '{"rating": 1}'), (None, '{"rating": 1}'), (pid(1), '{"rating": 2}')])) == 3 == len(read(c))
    for bad in ((None, None), (None, "no json"), (None, "[1]"), (None, '{"rating": "x"}'), ("7", "{}"), (None, json.dumps({"review": "x" * (1 << 20)}))):
        with pytest.raises(ValidationError):
            c.insert_frame(frame([(pid(5), "{}"), bad]))
    for rows in ([(pid(1), "{}")], [(pid(8), "{}"), (pid(8).upper(), "{}")]):
        with pytest.raises(AlreadyExists):
            c.insert_frame(frame(rows))
    assert c.count() == 3 == c.df().count() and c.vacuum() == 0
    # integers beyond doubles stay what they are, beside rows without one
    big = 2**60 + 1
    assert c.insert_frame(frame([(pid(20), json.dumps({"info": {"seats": big}})), (pid(21), "{}")])) == 2
    assert c.results({"query": {"property": "info.seats", "integer": {"operator": "equals", "value": big}}, "limit": 5})[0]["_id"] == pid(20)


def test_mixed_sorts(spark, tmp_path):
    c = Catalog(spark, str(tmp_path)).create("u", "mixed", SCHEMA)
    values = [[3], "pear", 7.5, None, False, -2, {"k": 0}, "fig", True]
    rows = [(f"00000000-0000-0000-0000-00000000000{i}", json.dumps({"rating": 1} | ({"any": v} if v is not None else {}))) for i, v in enumerate(values)]
    c.insert_frame(spark.createDataFrame(rows, "_id string, _doc string"))
    order = {bool: 1, int: 2, float: 2, dict: 3, list: 4, str: 5}
    key = lambda i: (order[type(values[i])], values[i] if isinstance(values[i], (str, int, float)) and not isinstance(values[i], bool) else 0)
    known = [i for i in range(9) if values[i] is not None]
    up = c.results({"query": ANY, "select": ["any"], "sort": [{"property": "any"}], "limit": 20})
    assert [int(x["_id"][-1]) for x in up] == [*sorted(known, key=lambda i: (*key(i), i)), 3]
    down = c.results({"query": ANY, "select": ["*"], "sort": [{"property": "any", "descending": True}], "limit": 20})
    assert [values[int(x["_id"][-1])] for x in down][:2] == ["pear", "fig"] and down[-1]["_id"][-1] == "3"


def test_vector_collections_and_migration(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    c = cat.create_vectors("u", "vectors", 3, "dot")
    old = spark.createDataFrame([(pid(i), [float(i), 1.0, -1.0], json.dumps({"n": i}) if i % 3 == 0 else "[1]" if i % 3 == 1 else None) for i in range(14)], "id string, vector array<double>, metadata string")
    assert migrate_vectors(old, c) == 14
    rows = vector_search(c, [2, 0, 0], 5).collect()
    assert [r["_id"] for r in rows] == [pid(i) for i in (13, 12, 11, 10, 9)] and rows[0]["_distance"] == -26
    docs = read(c)
    assert docs[pid(6)] == {"n": 6, "vector": [6, 1, -1]} and docs[pid(7)]["metadata"] == [1] and set(docs[pid(8)]) == {"vector"}


def test_postings_are_stored(spark, tmp_path):
    """Scores by stored postings are those of a scan, after updates, deletes and compaction; texts aren't cut again."""
    c = Catalog(spark, str(tmp_path)).create("u", "texts", SCHEMA)
    rnd = random.Random(3)
    words = ["soup", "bread", "wine", "quiet", "loud"]
    c.insert([place(i, review=" ".join(rnd.choices(words, k=rnd.randint(1, 8)))) for i in range(40)])
    c.insert([{"_id": pid(100), "rating": 1.0}, {"_id": pid(101), "review": "the", "rating": 1.0}])

    def check():
        for value, op in (("soup wine", "containsAny"), ("quiet loud", "containsAll")):
            q = {"property": "review", "text": {"operator": op, "value": value, "limit": 20}}
            stored = c.search({"query": q, "limit": 20}, rank=True)
            plain = text_ops.scored(c.df(), "_id", F.col("`p:review`"), value, op == "containsAll").orderBy(F.desc("score"), "_id").limit(20).collect()
            assert [(r["_id"], round(r["_score"], 9)) for r in stored.orderBy("_rank").collect()] == [(r["_id"], round(r["score"], 9)) for r in plain]
            plan = stored._jdf.queryExecution().executedPlan().toString()
            assert "regexp_extract_all" not in plan and "In(term" in plan
        flt = {"property": "rating", "float": {"operator": "lessThan", "value": 5}}
        got = c.results({"query": {"property": "review", "text": {"operator": "containsAny", "value": "soup", "limit": 50, "filter": flt}}, "select": ["rating", "review"], "limit": 50})
        assert got and {x["_id"] for x in got} == {i for i, d in read(c).items() if d.get("rating", 9) < 5 and "soup" in d.get("review", "").split()}

    check()
    c.update([{"_id": pid(i), "review": "soup soup wine"} for i in range(0, 40, 7)])
    c.delete([pid(i) for i in range(1, 40, 9)])
    check()
    c.compact()
    check()


def quantized(kind, trigger, **more):
    p = {"binary": {"triggerThreshold": trigger, "distanceMetric": "hamming"}, "product": {"triggerThreshold": trigger, "numCentroids": 8, "numSubVectors": 4}}[kind]
    return {"v": {"type": "vectorFlat", "vectorFlat": {"vectorSize": 16, "distanceMetric": "euclidean", "quantizer": {"type": kind, kind: p | more}}}}


def test_binary_quantizers_are_fitted_once(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(60, 16)).round(3)
    c = Catalog(spark, str(tmp_path)).create("u", "binary", quantized("binary", 40))
    near = lambda q: {"query": {"property": "v", "vectorFlat": {"operator": "near", "vector": q.tolist(), "limit": 10}}, "limit": 10}
    c.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(30)])
    assert c.fits() == {}
    got = c.results(near(x[3]) | {"select": ["v"]})
    assert [g["_id"] for g in got][0] == pid(3) and got[1]["_distance"] == pytest.approx(sorted(((x[:30] - x[3]) ** 2).sum(1))[1], abs=1e-4)
    c.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(30, 45)])
    first = c.fits()["v"]["thresholds"]
    assert first == pytest.approx(x[:45].mean(0).tolist(), abs=1e-6)
    c.insert([{"_id": pid(i), "v": (x[i] + 5).tolist()} for i in range(45, 60)])
    c.update([{"_id": pid(2), "v": (x[2] * -1).tolist()}])
    assert c.fits()["v"]["thresholds"] == first and c.df().where("`c:v` is null").count() == 0
    now = np.where(np.arange(60)[:, None] >= 45, x + 5, x)
    now[2] *= -1
    bits = now.astype(np.float32).astype(float) > np.array(first)
    d = {pid(i): int((bits[i] ^ (x[7] > np.array(first))).sum()) for i in range(60)}
    got = c.search(near(x[7]), rank=True).orderBy("_rank")
    assert [(r["_distance"], r["_id"]) for r in got.collect()] == sorted((n, i) for i, n in d.items())[:10]
    assert "ReadSchema: struct<_id:string,_seq:bigint,c:v" in got._jdf.queryExecution().executedPlan().toString().replace("`", "")


def test_given_thresholds_and_product_codes(spark, tmp_path):
    cat = Catalog(spark, str(tmp_path))
    x = np.random.default_rng(7).normal(size=(1200, 16)).round(3)
    c = cat.create("u", "given", quantized("binary", 0, threshold=0.1))
    c.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(5)])
    assert c.fits()["v"]["thresholds"] == [0.1] * 16 and c.df().where("`c:v` is null").count() == 0
    p = cat.create("u", "product", quantized("product", 1000))
    p.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(999)])
    assert p.fits() == {}
    p.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(999, 1100)])
    books = p.fits()["v"]["books"]
    p.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(1100, 1200)])
    assert p.fits()["v"]["books"] == books and p.df().where("size(`c:v`) = 4").count() == 1200
    q = x[77]
    code = np.stack([D.distances("euclidean", x.astype(np.float32).astype(float)[:, 4 * i : 4 * i + 4], np.array(b)).argmin(1) for i, b in enumerate(books)], 1)
    d = sum(((np.array(b)[code[:, i]] - q[4 * i : 4 * i + 4]) ** 2).sum(1) for i, b in enumerate(books))
    got = p.search({"query": {"property": "v", "vectorFlat": {"operator": "near", "vector": q.tolist(), "limit": 20}}, "limit": 20}).collect()
    assert sorted(r["_distance"] for r in got) == pytest.approx(sorted(d)[:20])


def test_lists_behind_graph_properties(spark, tmp_path):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 8)) * 3
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))).round(3)
    schema = {"v": {"type": "vectorVamana", "vectorVamana": {"vectorSize": 8, "distanceMetric": "euclidean", "searchSize": 50, "degreeBound": 40, "alpha": 1.2, "lists": 12, "probes": 4}}}
    c = Catalog(spark, str(tmp_path)).create("u", "lists", schema)
    c.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(100)])
    assert c.fits() == {}  # exact until there are enough points
    c.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(100, 600)])
    centroids = c.fits()["v"]["centroids"]
    c.insert([{"_id": pid(i), "v": x[i].tolist()} for i in range(600, 900)])
    c.delete([pid(i) for i in range(0, 50)])
    assert c.fits()["v"]["centroids"] == centroids and len(centroids) == 12 and c.df().where("`l:v` is null").count() == 0
    hit = 0
    for i in range(60, 900, 84):
        true = {pid(j) for j in sorted(range(50, 900), key=lambda j: ((x[j] - x[i]) ** 2).sum())[:10]}
        got = c.search({"query": {"property": "v", "vectorVamana": {"operator": "near", "vector": x[i].tolist(), "limit": 10, "searchSize": 50}}, "limit": 10})
        hit += len(true & {r["_id"] for r in got.collect()})
    assert hit >= 0.9 * 100
    assert "In(l:v" in got._jdf.queryExecution().executedPlan().toString().replace("`", "")


SHAPE = "op string, _id string, _doc string, `order` int"


def mutations(n, seed):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        op = rnd.choice(["insert", "insert", "update", "update", "delete", "upsert"] if k % 9 == 0 else ["insert", "update", "update", "delete"])
        doc = rnd.choice(['{"rating": %d}' % k, '{"city": "c%d", "rating": "_delete"}' % k, '{"open": [%d]}' % k, '{"rating": "bad"}', None if op == "delete" else "{}"])
        out.append((op, pid(rnd.randrange(9)), doc, k))
    return out


def replayed(docs, ops):
    """Documents after all mutations, and the number of those rejected."""
    docs, bad = dict(docs), 0
    for op, i, doc, _ in ops:
        change = json.loads(doc) if doc else None
        if op == "delete" and i in docs:
            del docs[i]
        elif op in ("insert", "update") and (op == "insert") == (i not in docs) and change is not None and change.get("rating") != "bad" and (op == "update" or change.get("rating") != "_delete"):
            docs[i] = {k: v for k, v in (docs.get(i, {}) | change).items() if v != "_delete"}
        else:
            bad += 1
    return docs, bad


@pytest.mark.parametrize("cuts", [[60], [1, 2, 3, 30, 60], list(range(6, 61, 6))])
def test_any_cutting_of_a_stream_gives_the_same(spark, tmp_path, cuts):
    ops = mutations(60, 5)
    c = Catalog(spark, str(tmp_path)).create("u", "cuts", SCHEMA)
    c.insert([place(i) for i in range(4)])
    want, bad = replayed({pid(i): {k: v for k, v in place(i).items() if k != "_id"} for i in range(4)}, ops)
    last = 0
    for epoch, cut in enumerate(cuts):
        apply_batch(c, spark.createDataFrame(ops[last:cut], SHAPE).repartition(3), epoch, "s")
        last = cut
    assert read(c) == want and c.count() == len(want) and rejected(c).count() == bad
    assert {r["_id"]: r["p:rating"] for r in c.df().collect()} == {i: d.get("rating") for i, d in want.items()}


def test_stream_rules(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c")).create("u", "stream", SCHEMA, Plan(max_points=6, max_point_size=300))
    c.insert([place(i) for i in range(4)])
    ops = [("insert", pid(9), '{"rating": 1}', 1), ("update", pid(9), '{"city": "Oslo"}', 2), ("insert", pid(1), "{}", 3), ("merge", pid(2), "{}", 4), ("insert", None, "{}", 5), ("update", pid(3), json.dumps({"review": "y" * 300}), 6), ("live", pid(2), "{}", 7), (None, pid(2), "{}", 8)]
    spark.createDataFrame(ops, SHAPE).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = apply_stream(c, spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in")), str(tmp_path / "check"))
    q.processAllAvailable()
    q.stop()
    assert c.count() == 5 == c.df().count() and read(c)[pid(9)] == {"rating": 1, "city": "Oslo"}
    reasons = [r["reason"] for r in rejected(c).collect()]
    assert len(reasons) == 6 and sum("already exists" in r for r in reasons) == 1 and sum("unknown op" in r for r in reasons) == 3
    with pytest.raises(QuotaReached):
        apply_batch(c, spark.createDataFrame([("insert", pid(20 + k), "{}", k) for k in range(2)], SHAPE), 7, "mutations")
    assert c.count() == 5 == c.df().count() and c.manifest["epochs"]["mutations"] == 0
    apply_batch(c, spark.createDataFrame([("delete", pid(1), None, 1)], SHAPE), 0, "mutations")  # a replay
    assert c.count() == 5
    # a source without fits or postings searches by scan
    assert Documents(c.df(), c.schema).text_scores("review", "soup", False, None, None).count() == 4
