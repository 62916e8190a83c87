"""Token counts on Spark by the transducer of a byte-level BPE tokenizer.

Special strings inside a text are one token each, as the tokenizer's library has it by default: the text is cut
at them, and its pieces are counted alone. Null and empty texts have no tokens. Null ids, equal ids and repeated
rows are rows like any other. Columns other than id and text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import buffers, id_text, per_worker, slices
from .transducer import Transducer



def count_texts(t: Transducer, texts: pa.Array) -> np.ndarray:
    """Tokens of each text, special strings and all."""
    data, offsets = buffers(texts)
    out = np.zeros(len(texts), np.int64)
    for a, b in slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        raw = part.tobytes()
        if not any(s.encode() in raw for s in t.special):
            out[a:b] = t.counts(part, off)
            continue
        cut = regex.compile("|".join(map(regex.escape, sorted(t.special, key=len, reverse=True))).encode())
        pieces, owner = [], []
        for d in range(b - a):
            text = raw[off[d] : off[d + 1]]
            found = cut.split(text)
            out[a + d] = len(found) - 1
            pieces += found
            owner += [a + d] * len(found)
        ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        np.add.at(out, owner, t.counts(np.frombuffer(b"".join(pieces), np.uint8), ends))
    return out


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes (UTF-8) and n_tokens of every row; ``path``: a tokenizer JSON that every executor can open."""
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        t = per_worker(lambda: Transducer(path), path)
        for batch in batches:
            texts = batch.column("text")
            _, offsets = buffers(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(count_texts(t, texts), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint").withColumnRenamed("id", id_col)
