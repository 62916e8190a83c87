"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its hashed words and of the hashed 3- to 5-character n-grams inside
its words (marked at both ends). A softmax layer reads the average. Vectors and layer are trained together by numpy
stochastic gradient descent on at most ``TRAIN_ROWS`` labelled rows, those with the least hashes of their ids, so
the sample is the same however the table is laid out. The layer is linear in the average, so for scoring each
bucket's vector is folded into one number and a score is a softmax over the average of those.

Features are of whole texts, whatever their length, in training too. Null and empty texts have no features and score
by the bias alone. Labels that are null, or of ids that are null or not in the table, are not learned; an id labelled
twice alike counts once, and once with each label if they differ. With rows of one label only, or none, scores are the
share of label 1 (0.5 without any). Columns other than id, text and label are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, id_text, slices, unloaded
from .words import U, mix, powers

TRAIN_ROWS = 4000
BUCKETS, DIM, EPOCHS, RATE, SEED, BATCH = 1 << 17, 8, 6, 0.3, 7, 16
GRAMS = (3, 4, 5)
#: Few samples are gone through more often, up to 60 times, until so many documents were visited.
VISITS = 12_000


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS):
    """Arrays of (document, bucket), one after another: of the words, and of each length of n-gram.

    Words are runs of characters between ASCII blanks here, with their case and marks, for these tell prose from junk.
    """
    cp = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(cp) < len(data):  # from bytes to characters
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    n = len(cp)
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    inside = cp > 32
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    if not len(starts):
        return
    lens = ends - starts
    at = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum())) - np.repeat(at, lens)
    marks = cp[inside]
    h = mix(np.add.reduceat((marks.astype(U) + U(1)) * powers(int(lens.max()))[place], at) + lens.astype(U))
    yield doc, (h % U(buckets)).astype(np.int64)
    # each word between a 0x02 and a 0x03, all in a row
    total = int(lens.sum()) + 2 * len(lens)
    flat = np.empty(total, np.uint32)
    first = at + 2 * np.arange(len(lens))
    flat[first] = 2
    flat[first + lens + 1] = 3
    flat[np.repeat(first + 1, lens) + place] = marks
    owner = np.repeat(doc, lens + 2)
    word = np.repeat(np.arange(len(lens), dtype=np.int32), lens + 2)
    for k in GRAMS:
        m = total - k + 1
        if m <= 0:
            continue
        g = np.full(m, k, np.uint32)
        for j in range(k):
            g = g * np.uint32(0x01000193) ^ flat[j : j + m]
        g ^= g >> np.uint32(15)
        g *= np.uint32(0x85EBCA6B)
        g ^= g >> np.uint32(13)
        ok = word[:m] == word[k - 1 :]
        yield owner[:m][ok], (g[ok] % np.uint32(buckets)).astype(np.int64)


@dataclass
class Model:
    """``folded``: of each bucket its vector times the difference of the layer's two rows; ``bias``: of the two biases."""

    folded: np.ndarray
    bias: float

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offsets = buffers(texts)
        out = np.empty(len(texts))
        for a, b in slices(offsets, 1 << 18):
            s, c = np.zeros(b - a), np.zeros(b - a)
            for doc, bucket in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], len(self.folded)):
                s += np.bincount(doc, self.folded[bucket], b - a)
                c += np.bincount(doc, minlength=b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(s / np.maximum(c, 1) + self.bias, -30, 30)))
        return out


def train(texts: pa.Array, labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE, buckets: int = BUCKETS, seed: int = SEED) -> Model:
    """Fit on labelled texts by stochastic gradient descent over small batches of documents."""
    y = np.asarray(labels, np.int64)
    if not len(y) or y.min() == y.max():
        share = min(0.999, max(0.001, float(y.mean()))) if len(y) else 0.5
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))))
    data, offsets = buffers(texts)
    bags: list[tuple[np.ndarray, np.ndarray]] = []
    for a, b in slices(offsets, 1 << 18):
        parts = list(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], buckets))
        doc, bucket = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        # of each document its distinct buckets and their shares
        key, n = np.unique(doc * buckets + bucket, return_counts=True)
        doc, bucket = key // buckets, key % buckets
        first = np.searchsorted(doc, np.arange(b - a + 1))
        for i in range(b - a):
            c = n[first[i] : first[i + 1]]
            bags.append((bucket[first[i] : first[i + 1]].astype(np.int32), (c / max(1, c.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = (rng.random((buckets, dim), np.float32) - np.float32(0.5)) / dim
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    # steps shrink with what a vector has been moved by before, so frequent and rare n-grams learn alike
    moved, moved_layer = np.full(buckets, 1e-8, np.float32), np.full(layer.shape, 1e-8, np.float32)
    weight = np.where(y == 1, 1.0, np.sqrt((y == 1).sum() / max(1, (y == 0).sum()))).astype(np.float32)
    epochs = max(epochs, min(60, VISITS // len(y)))
    for epoch in range(epochs):
        now = np.float32(rate * (1 - epoch / epochs))
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            mean = np.stack([bags[i][1] @ vectors[bags[i][0]] if len(bags[i][0]) else np.zeros(dim, np.float32) for i in pick])
            z = mean @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None] / len(pick)
            back = p @ layer.T
            grad = mean.T @ p
            moved_layer += grad * grad
            layer -= now * grad / np.sqrt(moved_layer)
            bias -= now * p.sum(0)
            # a document's buckets are distinct, so they move together; one step for the batch would have to sort them all
            for row, i in zip(back, pick):
                b, share = bags[i]
                moved[b] += share * share * np.float32(row @ row)
                vectors[b] -= (now * share / np.sqrt(moved[b]))[:, None] * row
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(id_col) -> F.Column:
    """Rows whose crc32 of the id as text leaves 2 by 4: never learned from."""
    return F.coalesce(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> tuple[pa.Array, np.ndarray]:
    """At most ``rows`` labels, those of the least hashes of their ids, with their whole texts; none of held-out rows.

    Ids and labels are picked first, so only the picked texts are read and sent.
    """
    lab = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y"))
    lab = lab.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id"))).distinct()
    known = id_text(docs, id_col, text_col)
    at = F.xxhash64(F.col("id").cast("string"))
    picked = lab.join(known.select("id").distinct(), "id", "left_semi").orderBy(at, "id", "y").limit(rows).collect()
    want = docs.sparkSession.createDataFrame(picked, lab.schema)
    # an id that has several texts is learned from by the least of them
    t = known.join(F.broadcast(want), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select(at.alias("at"), "id", "y", "text").toArrow()
    t = t.sort_by([("at", "ascending"), ("id", "ascending"), ("y", "ascending")])
    return t.column("text").combine_chunks() if t.num_rows else pa.array([], pa.string()), t.column("y").to_numpy()


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    return train(*sample(docs, labels, id_col, text_col, label_col, rows))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1, higher: label 1 is likelier) of every row."""
    rows = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats

    def run(batches):
        unloaded()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(shared.value.score(batch.column("text")))], ["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, in its own columns, whose text scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        unloaded()
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(text_col)) >= least))

    return docs.mapInArrow(run, docs.schema)
