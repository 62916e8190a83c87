"""Words and word shingles of many texts at once, as 64-bit hashes over their UTF-8 bytes.

A word is a run of ASCII letters or digits or of any characters from U+0080 on; A-Z count as a-z.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = IS_WORD[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE, _STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_POWERS = [np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of two multiply-xorshift rounds."""
    x = (x ^ (x >> U(32))) * _STEP
    x = (x ^ (x >> U(29))) * _BASE
    return x ^ (x >> U(32))


def powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        p = np.full(max(n, 64), _STEP, U)
        p[0] = 1
        _POWERS[0] = np.cumprod(p)
    return _POWERS[0][:n]


@dataclass
class Words:
    """``starts``/``ends``: byte places of all words; ``first``: of each document the index of its first word (n + 1)."""

    lower: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    def text(self, word: int, n: int) -> bytes:
        """The ``n`` words from ``word`` on, lower case, with single spaces."""
        return b" ".join(self.lower[self.starts[i] : self.ends[i]].tobytes() for i in range(word, word + n))


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    lower = LOWER[data]
    inside = IS_WORD[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    begin = inside & (~before | cut[:n])
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    lens = ends - starts
    if len(starts):
        at = np.cumsum(lens) - lens
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        v = (lower[inside].astype(U) + U(1)) * powers(int(lens.max()))[place]
        hashes = mix(np.add.reduceat(v, at) + lens.astype(U) * _BASE)
    else:
        hashes = np.zeros(0, U)
    return Words(lower, starts, ends, np.searchsorted(starts, offsets), hashes)


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each ``k`` hashes in a row (fewer results by k - 1), whatever document they are of."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, powers(k + 1)[k], U)
    for j in range(k):
        out += hashes[j : j + n] * powers(k + 1)[j + 1]
    return mix(out)


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The distinct k-word shingles of each document, ascending, and the n + 1 offsets of the documents.

    Fewer than k words make one shingle of them all; no words make none.
    """
    counts = np.diff(w.first)
    all_runs = runs(w.hashes, k)
    n = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    doc = np.repeat(np.arange(len(counts)), n)
    at = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    h = all_runs[at] if len(at) else np.zeros(0, U)
    if len(short):
        h = np.concatenate([h, *(runs(w.hashes[w.first[d] : w.first[d + 1]], int(counts[d])) for d in short)])
        doc = np.concatenate([doc, short])
    # the first sort orders all hashes, the second puts documents together and keeps that order
    order = np.argsort(h, kind="quicksort")
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        h, doc = h[keep], doc[keep]
    return h, np.searchsorted(doc, np.arange(len(counts) + 1))
