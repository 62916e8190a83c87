"""The queries over the smallest tables: against SQL, or against brute force."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from samples import SF
from sonda.llm import jaccard, queries, secrets

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    key = [c for c in got.columns if c.endswith("_id")][0]
    plain = lambda d: [tuple("null" if v is None or v != v else str(v) for v in r) for r in d.sort_values(key)[sorted(d.columns)].astype(object).itertuples(index=False)]
    assert plain(got) == plain(want)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


def test_token_queries(spark, texts):
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(queries.tokenizer(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    start = 0
    for r in sorted(queries.op2_token_files(spark, SF).collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*word.encode(texts[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    for r in queries.op3_token_counts(spark, SF).collect():
        n = len(byte.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["over_limit"]) == (n, n > 512)
    rows = queries.op6_packing(spark, SF).collect()
    total = sum(r["length"] for r in rows)
    assert total == sum(len(byte.encode(t, add_special_tokens=False).ids) + 1 for t in texts.values())
    assert len({r["sequence_id"] for r in rows}) == -(-total // 2048)


def spans_by_hand(text):
    """(start, kind, end) of the pattern matches, found character by character without regular expressions."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    value = letters | set("+/_.=-")
    out = []

    def run(at, chars):
        end = at
        while end < len(text) and text[end] in chars:
            end += 1
        return end

    def assigned(at):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if not low.startswith(word, at):
                continue
            end = at + len(word)
            end += text[end : end + 1] in ("'", '"')
            end = run(end, " ")
            if text[end : end + 1] not in (":", "="):
                continue
            end = run(end + 1, " ")
            end += text[end : end + 1] in ("'", '"')
            last = run(end, value)
            if last > end:
                return end, last
        return None

    at = 0
    while at < len(text):
        if low[at] in "pst" + "a" and (got := assigned(at)):
            if got[1] - got[0] >= 8:
                out.append((at, 0, got[1]))
            at = got[1]
        else:
            at += 1
    at = text.find("AKIA")
    while at >= 0:
        end = run(at + 4, set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))
        if end - at >= 16:
            out.append((at, 1, end))
        at = text.find("AKIA", end if end > at + 4 else at + 1)
    at = 0
    while at < len(text):
        end = run(at, set("0123456789abcdef"))
        if end - at >= 32:
            out.append((at, 2, end))
        at = max(end, at + 1)
    return sorted(out)


def test_patterns_by_hand():
    rnd = random.Random(12)
    parts = ["password", "ToKen", "api_key", "apikey", "secret", "=", ":", " ", "'", '"', "abcdefgh", "0123456789abcdef", "AKIA", "AKIA0123456789AB", "Zq", ".", "\n", "é", "f" * 20, "A" * 13]
    for _ in range(20_000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9)))
        assert secrets.base_spans(t) == spans_by_hand(t), t


def test_secret_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in queries.op8_secrets(spark, sf).collect()}
    found = 0
    for i, t in texts.items():
        base = spans_by_hand(t)
        found += len(base)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
    assert found > 10


def test_shard_query(spark, texts):
    rows = queries.op9_sharding(spark, SF).collect()
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) and r["size"] == len(texts[r["doc_id"]].encode()) + 8 for r in rows)
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    shard, load, slots = {}, [0] * 24, [[] for _ in range(24)]
    for r in rows:
        assert shard.setdefault(texts[r["doc_id"]], r["shard"]) == r["shard"]
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots) and max(load) <= max(sum(load) / 24 * 1.02, max(r["size"] for r in rows))


def test_pipeline(spark, con, texts):
    """Each stage against what its operator says of the stage's own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    state = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out = corpus_pipeline.staged(out, name)
        state.append((docs, out))
        docs = out
    ids = [{r["doc_id"] for r in out.select("doc_id").collect()} for _, out in state]
    assert all(b <= a for a, b in zip(ids, ids[1:]))
    assert all(out.columns == before.columns for before, out in state[:-1])
    before, after = state[1]
    classes = {r["doc_id"]: r["class_id"] for r in jaccard.similar(before).collect()}
    assert ids[1] == {i for i, c in classes.items() if i == c}
    hit = {r[0] for r in con.execute(queries.ORACLE_SQL["op10_decontamination"]).fetchall() if r[3] > 0}
    assert ids[2] == ids[1] - hit and ids[3] == ids[2] == ids[4]
    for r in state[3][1].collect():
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))
