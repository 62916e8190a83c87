import os
import zlib

import numpy as np
import pyarrow as pa
import pytest

from samples import SF, prose
from sonda.llm import quality, queries

LARGER = "/root/testdata/sf0.01"


def test_features_are_of_single_documents():
    texts = ["", "aa bb bb", "x", "bb aa"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    got = [(d, b) for doc, bucket in quality.features(data, off) for d, b in zip(doc.tolist(), bucket.tolist())]
    alone = [(i, b) for i, t in enumerate(texts) for doc, bucket in quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)])) for b in bucket.tolist()]
    assert sorted(got) == sorted(alone)


def test_held_out_accuracy():
    good = [prose(i, 40) for i in range(600)]
    bad = [" ".join(w + "$$$" for w in prose(i, 40).split()) if i % 3 else prose(i, 40).upper().replace(" ", "!! ") for i in range(600, 900)]
    texts, y = good + bad, np.array([1] * 600 + [0] * 300)
    train = np.arange(900) % 4 != 2
    m = quality.train(pa.array([t for t, k in zip(texts, train) if k]), y[train])
    p = m.score(pa.array([t for t, k in zip(texts, train) if not k])) >= 0.7
    assert (p == (y[~train] == 1)).mean() > 0.95
    again = quality.train(pa.array([t for t, k in zip(texts, train) if k]), y[train])
    assert (again.folded == m.folded).all() and again.bias == m.bias


def test_degenerate_labels_and_texts():
    assert quality.train(pa.array([], pa.string()), np.zeros(0)).score(pa.array(["a", ""])).tolist() == [0.5, 0.5]
    assert (quality.train(pa.array(["a", "b"]), np.array([1, 1])).score(pa.array(["z", None, ""])) > 0.99).all()


def test_on_spark(spark, edge, edge_rows, nothing):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, 1), (5, 0), (6, None), (None, 1), (77, 1), (9, 0)], "doc_id bigint, quality int")
    model = quality.fitted(edge, labels)
    got = quality.scored(edge, model).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in edge_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.kept(edge, model, 0.0).count() == len(edge_rows) and quality.kept(edge, model, 0.0).columns == edge.columns
    assert quality.scored(nothing, quality.fitted(nothing, labels.limit(0))).count() == 0
    texts, y = quality.sample(edge, labels, rows=2)
    assert len(texts) == len(y) <= 3


def test_query_learns_nothing_of_held_out_rows(spark):
    got = queries.op4_quality(spark, SF).toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in got.itertuples())
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.fitted(docs, labels), quality.fitted(docs, turned)
    assert (a.folded == b.folded).all()


def test_no_text_is_too_long_for_the_sample(spark):
    docs = spark.createDataFrame([(d, "x" * (3_000_000 if d == 1 else 10 + d)) for d in range(8)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(d, d % 2) for d in range(8)] * 2, "doc_id bigint, quality int")
    held = {r["doc_id"] for r in docs.where(quality.held_out(docs["doc_id"])).collect()}
    texts, y = quality.sample(docs, labels)
    assert sorted(map(len, texts.to_pylist())) == sorted(3_000_000 if d == 1 else 10 + d for d in range(8) if d not in held)
    assert sorted(y.tolist()) == sorted(d % 2 for d in range(8) if d not in held)


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no test tables")
def test_held_out_quality_of_the_query(spark):
    """On the labelled rows of the tables that were not learned from."""
    got = queries.op4_quality(spark, LARGER).where("held_out").join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").where("quality is not null").toPandas()
    good, bad = (got[got["quality"] == k]["score"].to_numpy() for k in (1, 0))
    assert len(good) > 20 and len(bad) > 5
    auc = (good[:, None] > bad[None]).mean() + (good[:, None] == bad[None]).mean() / 2
    assert auc > 0.97 and (got["predicted"] == got["quality"]).mean() > 0.93


def test_characters_not_bytes():
    """An n-gram of a script of three bytes a character holds whole characters, and words are hashed as wholes."""
    data = np.frombuffer("日本語".encode(), np.uint8)
    sizes = [len(doc) for doc, _ in quality.features(data, np.array([0, len(data)]))]
    assert sizes == [1, 3, 2, 1]
