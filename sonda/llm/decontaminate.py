"""Benchmark decontamination by a broadcast hash set of normalised item n-grams.

Windows of 8 consecutive item words (a shorter item is one window) are hashed; documents are scanned
with rolling word hashes and every hit is verified on the words themselves. The index is broadcast in
blocks of items whose size is checked against ``block_bytes``; more blocks mean more narrow passes over
the same rows, never a larger broadcast.

Null and empty texts have no words and no hits. Items without words match nothing. Repeated rows and ids
are judged row by row; item ids that occur twice count once. Columns other than id and text are ignored
by ``scan`` and passed through untouched by ``decontaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, id_text, slices
from .words import runs, words

WINDOW = 8
#: Bytes of item text in an index; every executor process holds one at a time, of up to 40 times these bytes (words of one letter).
BLOCK_BYTES = 8 << 20
_OUT = [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]


class Index:
    """Windows of many items by length: sorted hashes, where a window stands in one buffer of words, and its item ids.

    Arrays only: about 70 bytes a word, and the words themselves.
    """

    def __init__(self, ids: list, texts: pa.Array, size: int):
        data, offsets = buffers(texts)
        w = words(data, offsets)
        self.words = w
        self.names = [str(i) for i in ids]
        counts = np.diff(w.first)
        #: Of each length: hashes of distinct windows (ascending), their first words, and their items as slices of a list.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k in np.unique(np.minimum(counts[counts > 0], size)).tolist():
            owner = np.flatnonzero(counts >= k if k == size else counts == k)
            n = counts[owner] - k + 1
            item = np.repeat(owner, n)
            at = np.repeat(w.first[owner] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            h = runs(w.hashes, k)[at]
            order = np.lexsort((item, h))
            h, at, item = h[order], at[order], item[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            group = np.cumsum(new) - 1
            # windows of one hash and other words stand apart, as groups of their own with the same hash
            lead = at[np.flatnonzero(new)][group]
            apart = [i for i in np.flatnonzero(~new & (at != lead)).tolist() if w.text(int(at[i]), k) != w.text(int(lead[i]), k)]
            if apart:
                texts_of = [w.text(int(a), k) for a in at]
                order = sorted(range(len(h)), key=lambda i: (int(h[i]), texts_of[i], int(item[i])))
                h, at, item = h[order], at[order], item[order]
                new = np.array([i == 0 or texts_of[order[i]] != texts_of[order[i - 1]] or h[i] != h[i - 1] for i in range(len(h))])
            first = np.flatnonzero(new)
            once = new.copy()
            once[1:] |= item[1:] != item[:-1]
            place = np.cumsum(once) - once
            self.by_length[k] = h[first], at[first], np.append(place[first], once.sum()), item[once].astype(np.int32)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[int]], dict[int, set[str]]]:
        """Word counts; flat (first word, end word) ranges and item ids of documents with hits."""
        w = words(data, offsets)
        ranges: dict[int, list[int]] = {}
        items: dict[int, set[int]] = {}
        for k, (hashes, window, place, item) in self.by_length.items():
            h = runs(w.hashes, k)
            if not len(h):
                continue
            at = np.searchsorted(hashes, h)
            at[at == len(hashes)] = 0
            hit = np.flatnonzero(hashes[at] == h)
            doc = np.searchsorted(w.first, hit, "right") - 1
            inside = hit + k <= w.first[doc + 1]
            for i, d in zip(hit[inside].tolist(), doc[inside].tolist()):
                g, text = int(at[i]), w.text(i, k)
                while g < len(hashes) and hashes[g] == h[i]:
                    if self.words.text(int(window[g]), k) == text:
                        r, first = ranges.setdefault(d, []), i - int(w.first[d])
                        if r and r[-2] <= first <= r[-1]:
                            r[-1] = max(r[-1], first + k)
                        else:
                            r += [first, first + k]
                        items.setdefault(d, set()).update(item[place[g] : place[g + 1]].tolist())
                        break
                    g += 1
        return np.diff(w.first), ranges, {d: {self.names[i] for i in found} for d, found in items.items()}


def indexes(items: DataFrame, item_col: str, text_col: str, size: int, block_bytes: int) -> Iterator[Index]:
    """One index after another, each of about ``block_bytes`` of item text, so that driver and broadcast stay bounded."""
    rows = id_text(items, item_col, text_col)
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        got = part.toArrow()
        yield Index(got.column("id").to_pylist(), got.column("text").combine_chunks() if got.num_rows else pa.array([], pa.string()), size)


def _merged(ranges: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scanned(docs: DataFrame, items: DataFrame, text: str, item_col: str, item_text: str, size: int, block_bytes: int, fields: list) -> DataFrame:
    """``docs`` with the columns ``fields`` of counts, hits and items, one narrow pass for each block of items."""
    spark = docs.sparkSession
    n, hits, names = (f.name for f in fields)
    out = docs.select("*", F.lit(0).cast("long").alias(n), F.array().cast("array<bigint>").alias(hits), F.array().cast("array<string>").alias(names))
    schema = out.schema
    for index in indexes(items, item_col, item_text, size, block_bytes):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for batch in batches:
                data, offsets = buffers(batch.column(text))
                counts, r_all, i_all = [], batch.column(hits).to_pylist(), batch.column(names).to_pylist()
                for a, b in slices(offsets):
                    c, ranges, got = shared.value.scan(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    counts.append(c)
                    for d, r in ranges.items():
                        r_all[a + d] = _merged([*r_all[a + d], *r])
                        i_all[a + d] = sorted({*i_all[a + d], *got[d]})
                new = {n: pa.array(np.concatenate(counts) if counts else [], pa.int64()), hits: pa.array(r_all, pa.list_(pa.int64())), names: pa.array(i_all, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([new.get(k, batch.column(k)) for k in batch.schema.names], batch.schema.names)

        out = out.mapInArrow(run, schema)
    return out


def scan(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: id, n_words, hits (flat word ranges ``[first, end, ...]``), items (ids as strings, sorted)."""
    got = _scanned(id_text(docs, id_col, text_col), items, "text", item_col, item_text, size, block_bytes, _OUT)
    return got.select(F.col("id").alias(id_col), "n_words", "hits", "items")


def n_hit(hits):
    """Words inside the flat ranges of ``scan``."""
    return F.aggregate(F.transform(hits, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def longest(hits):
    """Words of the longest of the flat ranges of ``scan``; 0 without any."""
    ends = F.transform(hits, lambda x, i: F.when(i % 2 == 1, x - F.get(hits, i - 1)).otherwise(0))
    return F.coalesce(F.array_max(ends), F.lit(0))


def _cut(data: np.ndarray, hits: list[int]) -> str:
    """The text without the words of ``hits`` and what stands between them."""
    w = words(data, np.array([0, len(data)]))
    out, at = [], 0
    for a, b in zip(hits[::2], hits[1::2]):
        out.append(data[at : w.starts[a]].tobytes())
        at = int(w.ends[b - 1])
    out.append(data[at:].tobytes())
    return b"".join(out).decode("utf-8")


def decontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", action: str = "document", least_items: int = 2, least_share: float = 0.0, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contamination, in its own columns.

    A document is contaminated by occurring windows of ``least_items`` items or more, or by ``size`` words in a row
    from one or more windows (so a short item alone, such as one word, condemns nothing); in either case they must cover
    more than ``least_share`` of its words. ``document`` drops such documents; ``span`` cuts the hit words out of them.
    """
    if action not in ("document", "span"):
        raise ValueError(f"unknown action {action!r}")
    fields = [T.StructField("__sonda_" + f.name, f.dataType) for f in _OUT]
    n, hits, names = (F.col(f.name) for f in fields)
    got = _scanned(docs, items, text_col, item_col, item_text, size, block_bytes, fields)
    bad = ((F.size(names) >= least_items) | (longest(hits) >= size)) & (n_hit(hits) > n * least_share)
    if action == "document":
        return got.where(~bad).select(*(F.col(f"`{c}`") for c in docs.columns))
    got = got.withColumn("__sonda_hits", F.when(bad, hits).otherwise(F.array().cast("array<bigint>")))
    keep = docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col)
            found = batch.column("__sonda_hits").to_pylist()
            if any(found):
                data, offsets = buffers(texts)
                new = [_cut(data[offsets[i] : offsets[i + 1]], r) if r else x for i, (r, x) in enumerate(zip(found, texts.to_pylist()))]
                texts = pa.array(new, texts.type)
            yield pa.RecordBatch.from_arrays([texts if k == text_col else batch.column(k) for k in keep.names], keep.names)

    return got.mapInArrow(run, keep)
