"""URL filters, secrets, shards and decontamination."""

import datetime as dt
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from samples import SF, prose
from sonda.llm import decontaminate, secrets, shards, url_filters, words

# URL filters

DAY = dt.date(2024, 1, 1)


def on(n):
    return DAY + dt.timedelta(days=n)


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_as_of_join_by_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(url_filters, "BROADCAST_ROWS", broadcast)
    rnd = random.Random(1)
    domains = ["a.com", "x.a.com", "b.org", "deep.x.a.com", "com"]
    entries = [(rnd.choice(domains), rnd.choice(["add", "remove"]), on(rnd.randrange(60))) for _ in range(40)] + [(None, "add", on(1)), ("b.org", None, on(1)), ("b.org", "add", None), ("b.org", "other", on(3))]
    hosts = ["a.com", "www.a.com", "x.a.com", "deep.x.a.com", "b.org", "nota.com", "b.organ"]
    captures = [(i, f"http://{rnd.choice(hosts)}/p?q", on(rnd.randrange(70)), "clash") for i in range(300)] + [(900, None, on(5), "c"), (901, "no url", on(5), "c"), (902, "http://a.com", None, "c"), (1, "HTTPS://u:p@A.com.:80/x", on(9), "c")]
    df = spark.createDataFrame(captures, "page_id int, url string, fetched_on date, entry string")
    got = url_filters.judged(df, spark.createDataFrame(entries, "domain string, action string, day date")).collect()

    def active(d, day):
        last = {}
        for e, a, n in entries:
            if e == d and a in ("add", "remove") and n is not None and n <= day:
                last.setdefault(n, []).append(a)
        return bool(last) and max(last[max(last)]) == "add"

    assert len(got) == len(captures)
    for r in got:
        h, day = r["host"], r["fetched_on"]
        want = [d for d in domains if h and day and (h == d or h.endswith("." + d)) and active(d, day)]
        assert r["n_active"] == len(want) and r["blocked"] == bool(want) and r["entry"] == (max(want, key=len) if want else None)
    assert {r["host"] for r in got if r["page_id"] in (900, 901)} == {None} and "a.com" in {r["host"] for r in got if r["page_id"] == 1}


def test_hosts(spark):
    urls = {"http://[::1]:80/x": "[::1]", "http://u@[2001:DB8::2]/": "[2001:db8::2]", "ftp://A.b.:21": "a.b", "http:///x": None, "http://[x": None, "//a.b": None}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", url_filters.host(F.col("u")).alias("h"))
    assert {r["u"]: r["h"] for r in df.collect()} == urls


def test_empty_lists_and_captures(spark):
    df = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id int, url string, fetched_on date")
    none = spark.createDataFrame([], "domain string, action string, day date")
    assert not url_filters.judged(df, none).first()["blocked"] and url_filters.judged(df.limit(0), none).count() == 0


def test_intervals(spark):
    e = spark.createDataFrame([("A.com", "add", on(1)), ("a.com", "add", on(2)), ("a.com", "remove", on(5)), ("a.com", "add", on(5)), ("a.com", "add", on(9)), ("b", "remove", on(1))], "domain string, action string, day date")
    assert set(map(tuple, url_filters.intervals(e).collect())) == {("a.com", on(1), on(5)), ("a.com", on(9), None)}


# secrets

ASSIGN = re.compile("(?:password|passwd|secret|token|api_key|apikey)[\"']?[ ]*[:=][ ]*[\"']?[A-Za-z0-9+/_.=-]+", re.I | re.A)


def labels_of(texts):
    return list(dict.fromkeys(x for t in (secrets.PLAIN, *texts) for x in secrets.labelled(t)))


@pytest.fixture(scope="module")
def model():
    texts = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 100").df()["text"].tolist()
    return secrets.train([*secrets.random_samples(1500), *labels_of(texts)])


@pytest.mark.parametrize("text, want", [
    ("password=abcd1234", "assign:0:17"), ("PassWd : 'short'", ""), ("é token=\"12345678\"", "assign:2:17"), ("api_key=abcdefgh apikey=abcdefgh", "assign:0:16,assign:17:32"),
    ("AKIA1234567890AB", "access:0:16"), ("AKIA12345678", ""), ("0123456789abcdef0123456789abcdef", "hex:0:32"), ("0123456789abcdef0123456789abcde", ""),
    ("token=0123456789abcdef0123456789abcdef", "assign:0:38,hex:6:38"), ("ſecret=abcdefgh KIA", ""), ("secret\n=abcdefgh", ""), ("", ""),
])
def test_patterns(text, want):
    assert secrets.joined(secrets.base_spans(text)) == want


def test_random_strings_and_identifiers(model):
    fresh = [s for s, _ in secrets.random_samples(400, seed=99)]
    assert sum(map(model.is_random, fresh)) > 0.93 * len(fresh)
    plain = [w for w, y in labels_of(duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id OFFSET 100").df()["text"].tolist()) if not y and len(w) >= secrets.LEAST]
    assert plain and not any(map(model.is_random, plain)) and not model.is_random("4041894974608795")


def test_a_random_sample_without_digits_hides_no_secrets():
    texts = duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT 100").df()["text"].tolist()
    token = "qXvWzKjTbRnLcGhPmYsD"
    tainted = secrets.train([*secrets.random_samples(1500), *labels_of([*texts, f"see {token} there"])])
    fresh = [s for s, _ in secrets.random_samples(400, seed=99)]
    assert (token, 0) in secrets.labelled(f"see {token} there") and tainted.is_random(token)
    assert sum(map(tainted.is_random, fresh)) > 0.93 * len(fresh)


def test_spans_and_redaction(edge, edge_rows, nothing, model, spark):
    got = {str(r["doc_id"]): r["spans"] for r in secrets.spans(edge, model).collect()}
    assert len(got["2"]) == 0 and set(got) == {str(i) for i, _ in edge_rows}
    text = "ok é password=abcd1234 then qX7zP0vK3mW9sT2bR8nL5cJ1 and thousandtimesnothing"
    df = spark.createDataFrame([(1, text, "x"), (2, None, "y"), (3, "clean", None)], "doc_id int, text string, spans string")
    rows = {r["doc_id"]: r for r in secrets.redacted(df, model).collect()}
    assert rows[1]["text"] == "ok é [SECRET] then [SECRET] and thousandtimesnothing" and rows[2]["text"] is None and rows[3]["text"] == "clean"
    assert secrets.redacted(df, model).columns == df.columns and secrets.redacted(edge, model).count() == len(edge_rows)
    assert secrets.spans(nothing, secrets.fitted(nothing)).count() == 0


def test_long_texts_are_sampled_whole_and_scanned_in_linear_time(spark, model):
    """A text of many tokens beside many matches; and the sample's labels come from it too, whatever its length."""
    long = " ".join(f"password=abcd{i:04d}efgh someOrdinaryIdentifierName{i}" for i in range(20_000))
    began = time.time()
    got = secrets.all_spans(long, model)
    assert sum(k == 0 for _, k, _ in got) == 20_000 and time.time() - began < 6
    seen = []
    df = spark.createDataFrame([(1, long), (1, long), (2, None), (None, "veryordinaryword")], "doc_id bigint, text string")
    real = secrets.train
    try:
        secrets.train = lambda samples: seen.extend(samples) or real(samples)
        secrets.fitted(df)
    finally:
        secrets.train = real
    assert ("abcd0007efgh", 1) in seen and ("veryordinaryword", 0) in seen


def test_overlaps_by_brute_force(model):
    rnd = random.Random(2)
    parts = ["password=abcd1234", "0123456789abcdef" * 2, "AKIA1234567890ABCD", "qX7zP0vK3mW9sT2bR8nL5cJ1", "plain", "/", "=", " ", " ", "token: 'Zq81jd92kLmn'"]
    for _ in range(300):
        t = "".join(rnd.choice(parts) for _ in range(12))
        base = secrets.base_spans(t)
        want = [(m.start(), 3, m.end()) for m in secrets.TOKEN.finditer(t) if not any(a < m.end() and m.start() < b for a, _, b in base) and model.is_random(m[0])]
        assert secrets.all_spans(t, model) == sorted([*base, *want])


# shards


def test_tree_and_best_fit_by_brute_force():
    rnd = random.Random(4)
    for _ in range(50):
        sizes = sorted((rnd.randint(1, 60) for _ in range(rnd.randint(1, 80))), reverse=True)
        rooms, want = [], []
        for s in sizes:
            fit = [k for k, r in enumerate(rooms) if r >= s]
            k = min(fit, key=lambda k: rooms[k]) if fit else len(rooms)
            if k == len(rooms):
                rooms.append(100)
            rooms[k] -= s
            want.append(rooms[k])
        mine, got = {}, []
        pairs = sorted(Counter(sizes).items(), reverse=True)
        for s, times, b in shards.best_fit(pairs, 100):
            for _ in range(times):
                mine[b] = mine.get(b, 100) - s
                got.append(mine[b])
        assert got == want and len(mine) == len(rooms)
        assert shards.best_fit(pairs, 100, len(rooms)) is not None and shards.best_fit(pairs, 100, len(rooms) - 1) is None
        least, plan = shards.smallest_capacity(pairs, 4)
        assert len({b for _, _, b in plan}) <= 4 and sum(t for _, t, _ in plan) == len(sizes)
        assert least == -(-sum(sizes) // 4) or shards.best_fit(pairs, least - 1, 4) is None


def test_shards(spark, edge, edge_rows, nothing):
    rows = shards.assign(edge, 3, with_text=True).collect()
    assert sorted((str(r["id"]), r["size"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 8) for i, t in edge_rows)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= {0, 1, 2}
    texts = {}
    for r in rows:
        texts.setdefault(r["text"] or "", set()).add(r["shard"])
    assert all(len(s) == 1 for s in texts.values())
    assert shards.assign(nothing, 3).count() == 0
    # equal rows, of which nothing tells one from another, still have slots of their own
    same = shards.assign(spark.createDataFrame([(None, "same")] * 50 + [(1, "other")], "doc_id bigint, text string").repartition(4), 2).collect()
    assert sorted(r["slot"] for r in same if r["id"] is None) == list(range(50)) and len({r["shard"] for r in same}) == 2


def test_near_equal_sizes_and_files(spark, tmp_path):
    df = spark.createDataFrame([(i, prose(i, 5 + i % 90)) for i in range(600)], "doc_id bigint, text string")
    sizes = [r["s"] for r in shards.assign(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.01 * min(sizes)
    shards.write_shards(df, str(tmp_path / "out"), 8)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 600


# decontamination


def norm(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block", [32 << 20, 200])
def test_scan_by_brute_force(spark, edge_rows, block):
    item = prose(70, 40)
    short = "ñandú only three"
    items = [(1, item), (2, prose(71, 30)), (3, short), (4, ""), (5, None), (6, item), (7, "zz")]
    docs = [*edge_rows, (20, prose(72, 30) + " " + " ".join(item.split()[5:20]).upper() + "! " + prose(73, 9)), (21, f"x {short} y {short}"), (22, item), (23, " ".join(item.split()[:7])), (24, item + " zz " + item)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    windows = {}
    for i, t in items:
        w = norm(t)
        for a in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[a : a + 8]), set()).add(str(i))
    want = []
    for i, t in docs:
        w, hit, found = norm(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[a : a + k]))) is not None:
                    hit |= set(range(a, a + k))
                    found |= names
        want.append((str(i), len(w), len(hit), sorted(found)))
    got = decontaminate.scan(df, b, block_bytes=block).withColumn("h", decontaminate.n_hit("hits")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["h"], r["items"]) for r in got) == sorted(want)
    kept = decontaminate.decontaminated(df, b, least_items=1, block_bytes=block)
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(i for i, _, _, f in want if not f)
    # short items alone condemn no document, two items or a full window do
    kept = decontaminate.decontaminated(df, b, block_bytes=block)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(i for i, _, h, f in want if len(f) < 2 and h < 8)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminated(df, b, action="span", least_items=1, block_bytes=block).collect()}
    assert cut[21] == "x  y " and norm(cut[20]) == norm(docs[-5][1])[:30] + norm(prose(73, 9)) and cut[2] is None


def test_windows_of_one_hash_stand_apart(monkeypatch):
    """Verified on words: windows of equal hashes but other words are told apart, on either side."""
    monkeypatch.setattr(decontaminate, "runs", lambda h, k: real(h, k) & np.uint64(1))
    real = words.runs
    items = [prose(80, 20), prose(81, 12), prose(80, 20)]
    index = decontaminate.Index([1, 2, 3], pa.array(items), 8)
    for text, want in ((prose(82, 50), set()), ("q " + items[1] + " q", {"2"}), (items[0] + " " + items[1], {"1", "2", "3"})):
        data = np.frombuffer(text.encode(), np.uint8)
        _, ranges, found = index.scan(data, np.array([0, len(data)]))
        assert found.get(0, set()) == want and bool(ranges) == bool(want)


def test_index_is_bounded_by_the_bytes_of_its_items():
    one = "a b " * 500  # the most words a byte
    for texts in ([one + str(i) for i in range(200)], [prose(i, 400) for i in range(50)]):
        size = sum(len(t.encode()) for t in texts)
        index = decontaminate.Index(list(range(len(texts))), pa.array(texts), 8)
        arrays = [*(a for x in index.by_length.values() for a in x), *(a for a in vars(index.words).values() if isinstance(a, np.ndarray))]
        assert sum(a.nbytes for a in arrays) < 40 * size


def test_empty_sides(spark, edge, edge_rows, nothing):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.scan(edge, none).where("size(items) > 0").count() == 0
    assert decontaminate.scan(nothing, none).count() == 0
    assert decontaminate.decontaminated(edge, none).count() == len(edge_rows)
    with pytest.raises(ValueError):
        decontaminate.decontaminated(edge, none, action="other")
