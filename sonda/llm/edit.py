"""Document fingerprints by randomised edit embedding.

All texts are walked by the same random walk: at step ``t`` a text stands at one of its characters, emits a
hash of it and moves on or stays, as a shared random function of (t, character) says. Texts that differ by few
edits soon walk in step again, so edit distance becomes Hamming distance between emissions. A second, independent
walk goes from the end of a text to its start: what lies behind an edit is met by it before the edit. A fingerprint
keeps, of each walk, the emissions of steps sampled at ``SAMPLES`` places in each octave (all of the first steps),
four bits each; an emission past a text's end is missing. Whole texts are walked, whatever their length.

``likeness`` estimates the share of the longer text on which two texts agree, each sample weighed by the steps it
stands for and corrected for chance: the walk from the start judges the text up to some place, the walk from the end
what lies behind it, and the place is where both agree most. ``bands`` hash bits sampled from both walks, so that
likely pairs share one. Null texts are empty; an empty text has the fingerprint "" and is like an empty one only.
"""

from __future__ import annotations

import numpy as np

from .words import U, mix

SAMPLES, PERIOD, SEED = 64, 4096, 20177
#: So few texts are walked faster one after another than side by side.
FEW = 64
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)
#: Likeness by chance: one in 16, and characters that are equal anyway.
CHANCE = 1 / 16 + 0.06


def sampled_steps(n: int) -> np.ndarray:
    """The sampled steps below ``n``: 0 to 63, then 64 evenly spread in each octave [64 * 2**o, 128 * 2**o)."""
    out, low = [np.arange(min(n, SAMPLES))], SAMPLES
    while low < n:
        at = low + np.arange(SAMPLES) * (low // SAMPLES) + low // (2 * SAMPLES)
        out.append(at[at < n])
        low *= 2
    return np.concatenate(out)


def weights(k: int) -> np.ndarray:
    """The steps that each of the first ``k`` samples stands for."""
    return np.left_shift(1, np.maximum(np.arange(k) // SAMPLES - 1, 0)).astype(np.float64)


def _tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Move (0 or 1) by step and symbol, and the hash of a symbol emitted."""
    cells = mix(np.arange(PERIOD * 256, dtype=U) + U(seed))
    return (cells >> U(63)).astype(np.uint8), (mix(np.arange(256, dtype=U) + U(seed << 8)) >> U(60)).astype(np.uint8)


_TABLES = _tables(SEED), _tables(SEED + (1 << 32))


def _symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One byte per character, and the n + 1 offsets; other planes than Latin-1 are folded onto it by a hash."""
    cp = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.where(cp < 256, cp, (cp * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8), offsets


def _walk(symbols: np.ndarray, offsets: np.ndarray, move: np.ndarray, emit: np.ndarray) -> list[str]:
    """The samples of one walk over many texts, side by side; the last ``FEW`` of them one after another."""
    n = len(offsets) - 1
    symbols = np.append(symbols, np.uint8(0))
    pos, end = offsets[:-1].copy(), offsets[1:]
    lanes = np.flatnonzero(pos < end)
    emitted: list[tuple[np.ndarray, np.ndarray]] = []
    t, due, low, step = 0, 0, SAMPLES, 1
    pos, end = pos[lanes], end[lanes]
    while len(lanes) > FEW:
        c = symbols[pos]
        if t == due:
            emitted.append((lanes, emit[c]))
            if t + 1 < SAMPLES:
                due = t + 1
            else:  # the next of 64 places of this octave, else the first of the next one
                due = low + step // 2 if t < low else due + step
                if due >= 2 * low:
                    low, step = 2 * low, 2 * step
                    due = low + step // 2
        row = (t % PERIOD) << 8
        pos += move[row : row + 256][c]
        t += 1
        alive = pos < end
        if not alive.all():
            lanes, pos, end = lanes[alive], pos[alive], end[alive]
    table = move.tobytes()
    for lane, at, last in zip(lanes.tolist(), pos.tolist(), end.tolist()):
        got = _alone(symbols[at:last].tobytes(), t, table)
        emitted.append((np.full(len(got), lane), emit[np.frombuffer(got, np.uint8)]))
    if not emitted:
        return [""] * n
    who = np.concatenate([e[0] for e in emitted])
    what = _HEX[np.concatenate([e[1] for e in emitted])]
    order = np.argsort(who, kind="stable")
    flat, first = what[order].tobytes().decode(), np.searchsorted(who[order], np.arange(n + 1))
    return [flat[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _alone(text: bytes, t: int, move: bytes) -> bytes:
    """The symbols at the sampled steps from ``t`` on of one text, walked on from its first character."""
    out, at, n = bytearray(), 0, len(text)
    mask = PERIOD - 1
    dues = sampled_steps(max(2 * SAMPLES, 8 * (t + n)))  # a walk is about twice as long as its text
    for due in dues[np.searchsorted(dues, t) :].tolist():
        for t in range(t, due):
            at += move[(t & mask) << 8 | text[at]]
            if at == n:
                return bytes(out)
        t = due
        out.append(text[at])
    raise AssertionError("a walk is longer than eight times its text")


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprints of many texts: the samples of the walk from the start, a dot, and those of the walk from the end."""
    symbols, offsets = _symbols(texts)
    ahead = _walk(symbols, offsets, *_TABLES[0])
    # all texts turned around as one, which puts the last text first
    back = _walk(np.ascontiguousarray(symbols[::-1]), offsets[-1] - offsets[::-1], *_TABLES[1])[::-1]
    return [f"{a}.{b}" if a else "" for a, b in zip(ahead, back)]


_SPLITS = np.linspace(0, 1, 17)


def _agreed(a: str, b: str) -> tuple[np.ndarray, float]:
    """Of two walks the agreement of samples in all, up to each of ``_SPLITS`` of the longer one, in its steps; and its steps."""
    k, m = min(len(a), len(b)), max(len(a), len(b))
    w = weights(m)
    total = np.cumsum(w)
    same = np.frombuffer(a[:k].encode(), np.uint8) == np.frombuffer(b[:k].encode(), np.uint8)
    got = np.concatenate([[0.0], np.cumsum(w[:k] * ((same - CHANCE) / (1 - CHANCE)))])
    return got[np.minimum(np.searchsorted(total, _SPLITS * total[-1] * (1 + 1e-12), "right"), k)], float(total[-1])


def likeness(a: str, b: str) -> float:
    """From 0 (as unlike as chance) to 1 (all samples agree)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (af, ab), (bf, bb) = a.split("."), b.split(".")
    (ahead, n), (back, m) = _agreed(af, bf), _agreed(ab, bb)
    return float(min(1.0, max(0.0, (ahead / n + back[::-1] / m).max())))


def _picks(count: int, bits: int) -> np.ndarray:
    """Of each length to ``SAMPLES`` the ``bits`` places of each band: of the places a text has, those of the least hashes.

    A place is drawn alike by all texts that have it, whatever their lengths.
    """
    rank = mix(np.arange(count * bits * SAMPLES, dtype=U) + U(SEED << 20)).reshape(count, bits, SAMPLES)
    return np.stack([rank[:, :, :k].argmin(2) if k else np.zeros((count, bits), np.int64) for k in range(SAMPLES + 1)])


_PICKS: dict[tuple[int, int], np.ndarray] = {}


def bands(fingerprint: str, count: int = 12, bits: int = 8) -> list[int]:
    """Hashes of ``count`` bands of each walk, each of ``bits`` samples drawn from the last two octaves that it has in full.

    The octave is part of a band, and the one below it is banded too, so texts whose lengths stand on either side
    of an octave share bands. In the first octave, which short texts don't have in full, places are drawn by
    ``_picks``, so that texts whose walks differ in length have most places in common.
    """
    if (count, bits) not in _PICKS:
        _PICKS[count, bits] = _picks(count, bits)
    out: list[np.ndarray] = []
    for way, walk in enumerate(fingerprint.split(".") if fingerprint else ()):
        top = max(0, len(walk) // SAMPLES - 1)
        for o in {top, max(0, top - 1)}:
            part = np.frombuffer(walk[: (o + 1) * SAMPLES].encode(), np.uint8).astype(U)
            low = 0 if o == 0 else max(0, o - 1) * SAMPLES
            drawn = low + (mix(np.arange(count * bits, dtype=U) + U(SEED)) % U(len(part) - low)).astype(np.int64).reshape(count, bits)
            values = part[_PICKS[count, bits][len(part)] if o == 0 else drawn]
            h = (np.arange(count, dtype=U) + U((way * 64 + o) * count)).copy()
            for k in range(bits):
                h = mix(h * U(257) + values[:, k])
            out.append(h.view(np.int64))
    return np.concatenate(out).tolist() if out else []


def padded(prints: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each of the two walks: the samples as rows of one array, zeros behind them, and their lengths."""
    out = []
    for way in (0, 1):
        walks = [f.split(".")[way] if f else "" for f in prints]
        n = np.array([len(f) for f in walks], np.int64)
        rows = np.zeros((len(walks), int(n.max(initial=0))), np.uint8)
        rows[np.arange(rows.shape[1])[None] < n[:, None]] = np.frombuffer("".join(walks).encode(), np.uint8)
        out.append((rows, n))
    return out


def likenesses(one: int, to: np.ndarray, prints: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """``likeness`` of one of the ``padded`` fingerprints, all distinct, to those numbered ``to``."""
    shares = []
    for rows, n in prints:
        k, m = np.minimum(n[to], n[one]), np.maximum(n[to], n[one])
        w = weights(rows.shape[1])
        total = np.cumsum(w)
        got = np.zeros((len(to), rows.shape[1] + 1))
        np.cumsum(w * (((rows[to] == rows[one]) - CHANCE) / (1 - CHANCE)), axis=1, out=got[:, 1:])
        whole = total[np.maximum(m, 1) - 1] if len(total) else np.ones(len(to))
        at = np.minimum(np.searchsorted(total, _SPLITS * whole[:, None] * (1 + 1e-12), "right"), k[:, None])
        shares.append(np.take_along_axis(got, at, 1) / whole[:, None])
    best = (shares[0] + shares[1][:, ::-1]).max(1)
    return np.where(np.minimum(prints[0][1][to], prints[0][1][one]) > 0, np.clip(best, 0, 1), 0.0)
