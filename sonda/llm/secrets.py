"""Secret scans: fixed patterns, and strings that a character Markov model calls random.

Two first-order Markov models over the characters of a token, one of random strings and one of ordinary words and
identifiers, are trained from labelled samples. A token of at least ``LEAST`` characters is a secret of kind
``markov`` if the log-likelihood ratio of the two, in bits, is above ``bits`` in all and ``rate`` a character, and
it overlaps no pattern match. Tokens of digits alone are numbers, not secrets.

Places are code points, ends exclusive. Null and empty texts have no spans. Null ids, equal ids and repeated rows
are rows like any other. Whole texts are scanned. Columns other than id and text are ignored by ``spans`` and
passed through by ``redacted``.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, strings, unloaded

#: Fixed patterns; letters of the first in either case (ASCII only).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "markov")
LEAST, SAMPLE_DOCS, SAMPLE_TOKENS, RANDOM, SEED = 16, 500, 200_000, 4000, 11
#: The share of ordinary samples that the threshold rises above; some are random strings without a digit, so not all.
ORDINARY = 0.999
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
ALPHABETS = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
_SYMBOL = np.zeros(256, np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"):
    _SYMBOL[_c] = _i + 1
_N = int(_SYMBOL.max()) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order of place and then kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


@dataclass
class Markov:
    """``ratio``: log2 of the chance of a character after another among random strings over that among ordinary ones."""

    ratio: np.ndarray
    bits: float
    rate: float

    def llr(self, token: str) -> float:
        s = _SYMBOL[np.frombuffer(token.encode("ascii"), np.uint8)]
        return float(self.ratio[np.concatenate([[0], s[:-1]]), s].sum())

    def is_random(self, token: str) -> bool:
        if token.isdigit():
            return False
        x = self.llr(token)
        return x > self.bits and x > self.rate * len(token)


def train(samples: list[tuple[str, int]], smoothing: float = 0.5, bits: float = 24.0, rate: float = 1.0) -> Markov:
    """From (token, 1: random or 0: ordinary). The rate rises above ``ORDINARY`` of the ordinary samples where it must."""
    logs = []
    for label in (1, 0):
        tokens = [t.encode("ascii", "ignore") for t, y in samples if y == label]
        after = _SYMBOL[np.frombuffer(b"".join(tokens), np.uint8)]
        before = np.zeros_like(after)
        before[1:] = after[:-1]
        first = np.cumsum([0, *map(len, tokens)])[:-1]
        before[first[first < len(before)]] = 0
        n = np.bincount(before * _N + after, minlength=_N * _N).reshape(_N, _N) + smoothing
        logs.append(np.log2(n / n.sum(1, keepdims=True)))
    model = Markov(logs[0] - logs[1], bits, rate)
    plain = [model.llr(t) / len(t) for t, y in samples if not y and len(t) >= LEAST and not t.isdigit()]
    return Markov(model.ratio, bits, max(rate, float(np.quantile(plain, ORDINARY)) + 0.1) if plain else rate)


def random_samples(n: int = RANDOM, seed: int = SEED) -> list[tuple[str, int]]:
    """Labelled random strings of 16 to 64 characters, evenly of each alphabet."""
    rng = np.random.default_rng(seed)
    return [("".join(a[i] for i in rng.integers(0, len(a), rng.integers(16, 65))), 1) for k in range(n) for a in (ALPHABETS[k % len(ALPHABETS)],)]


#: Ordinary prose and names beside those of the corpus, so that plain words of other languages and code aren't taken for random.
PLAIN = """
the quick answer to most questions about storage is that whoever reads the documentation first spends less time waiting later
internationalization responsibilities configuration understanding notwithstanding characteristically environmental thousandtimes
getUserName setConnectionTimeout background_color maximum_retry_count Content-Type application/json README Makefile requirements
Geschwindigkeitsbegrenzung Zusammenarbeit Wissenschaftler verantwortlich nichtsdestoweniger selbstverständlich Krankenversicherung
malheureusement immédiatement développement gouvernement anticonstitutionnellement reconnaissance bibliothèque aujourdhui
desafortunadamente responsabilidad administración comunicaciones electroencefalograma conocimiento inmediatamente trabajadores
"""

_WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")


def labelled(text: str) -> list[tuple[str, int]]:
    """Samples of a text: values of pattern matches are random, tokens that start in no match are ordinary.

    Neighbouring words joined as identifiers (snake_case, camelCase, paths) are ordinary too.
    """
    out = []
    spans = base_spans(text)
    for a, kind, b in spans:
        value = ASSIGN.match(text, a)[2] if kind == 0 else text[a:b]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            out.append((value, 1))
    taken = np.zeros(len(text) + 1, bool)
    for a, _, b in spans:
        taken[a:b] = True
    words = [m[0] for m in _WORD.finditer(text) if not taken[m.start() : m.end()].any()]
    words = [w for w in words if not (any(c.isdigit() for c in w) and any(c.isalpha() for c in w)) or len(w) < LEAST]
    out += [(w, 0) for w in words]
    for a, b in zip(words[::8], words[1::8]):
        out += [(f"{a}_{b}".lower(), 0), (a.lower() + b.capitalize(), 0), (f"/{a}/{b}", 0), (f"{a}-{b}", 0), (f"{a}_{b}".upper(), 0), (f"{a}={len(b)}", 0)]
    return list(dict.fromkeys(out))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE_DOCS, tokens: int = SAMPLE_TOKENS) -> Markov:
    """Trained on random strings and on the labelled tokens of ``rows`` documents, those of the least hashes of id and text.

    The hashes are picked first, so texts stay where they are; a sampled text is read whole, whatever its length, and
    its tokens are labelled by the executors. The driver gets at most ``tokens`` distinct ones, those of the least hashes.
    """
    some = id_text(docs, id_col, text_col).withColumn("at", F.xxhash64("id", "text"))
    least = [r["at"] for r in some.select("at").distinct().orderBy("at").limit(rows).collect()]
    picked = some.where(F.col("at").isin(least)) if least else some.where("false")

    def run(batches):
        for batch in batches:
            got = list(dict.fromkeys(x for t in strings(batch.column("text")) for x in labelled(t)))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([y for _, y in got], pa.int32())], ["token", "y"])

    found = picked.select("text").mapInArrow(run, "token string, y int").distinct()
    got = found.orderBy(F.xxhash64("token", "y"), "token", "y").limit(tokens).toArrow()
    return train([*random_samples(), *labelled(PLAIN), *zip(got.column("token").to_pylist(), got.column("y").to_pylist())])


def all_spans(text: str, model: Markov) -> list[tuple[int, int, int]]:
    """Pattern matches and the random tokens that overlap none of them, in one pass over both in order of place."""
    out = base_spans(text)
    more, at, end = [], 0, 0  # the matches that start before a token's end, and how far they reach
    for m in TOKEN.finditer(text):
        a, b = m.span()
        while at < len(out) and out[at][0] < b:
            end = max(end, out[at][2])
            at += 1
        if end <= a and model.is_random(m[0]):
            more.append((a, 3, b))
    return sorted([*out, *more]) if more else out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def spans(docs: DataFrame, model: Markov, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, spans (array of kind, start, end)."""
    rows = id_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 70 x 70 numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        unloaded()
        for batch in batches:
            found = [[(KINDS[k], a, b) for a, k, b in all_spans(t, shared.value)] for t in strings(batch.column("text"))]
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, kind)], ["id", "spans"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def digest(kind_start_end: str) -> str:
    return hashlib.sha256(kind_start_end.encode()).hexdigest()


def redacted(docs: DataFrame, model: Markov, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` in its own columns, with every span of its texts, overlapping ones together, replaced by ``mark``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: str | None) -> str | None:
        if not text or not (found := all_spans(text, shared.value)):
            return text
        out, at = [], 0
        for a, _, b in found:
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches):
        unloaded()
        for batch in batches:
            texts = batch.column(text_col)
            new = pa.array([clean(t) for t in strings(texts)], texts.type)
            yield pa.RecordBatch.from_arrays([new if k == text_col else batch.column(k) for k in batch.schema.names], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
