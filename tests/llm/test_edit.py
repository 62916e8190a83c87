import hashlib
import random
import time

import numpy as np
import pytest

from samples import prose
from sonda.llm import edit, fingerprint


def test_fingerprints_follow_edits():
    a = prose(5, 400)
    few, many, other = a[:500] + "XY" + a[507:], a[: len(a) // 2] + prose(6, 200), prose(7, 400)
    fa, ff, fm, fo, again = edit.fingerprints([a, few, many, other, a])
    assert fa == again and edit.likeness(fa, again) == 1
    assert edit.likeness(fa, ff) > 0.85 > 0.65 > edit.likeness(fa, fm) > 0.35 > 0.15 > edit.likeness(fa, fo)
    assert edit.fingerprints(["", "a"])[0] == "" and edit.likeness("", "") == 1 and edit.likeness("", fa) == 0
    # alone or in company, a text has one fingerprint
    assert edit.fingerprints([few]) == [ff] and edit.fingerprints(["日本" * 300])[0] != edit.fingerprints(["日曜" * 300])[0]


def test_samples_cover_every_octave():
    steps = edit.sampled_steps(1000)
    assert steps[:64].tolist() == list(range(64)) and len(set(steps.tolist())) == len(steps) and steps.max() < 1000
    assert abs(edit.weights(len(edit.sampled_steps(4096))).sum() - 4096) < 1


def test_edited_texts_by_brute_force(spark, edge, edge_rows, nothing):
    got = fingerprint.with_edits(edge).collect()
    rows = [(i, t or "") for i, t in edge_rows]
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(i), len(t)) for i, t in rows)
    plain = [(i, t) for i, t in rows if i is not None and i not in (5,)]
    by = {r["doc_id"]: r for r in got}
    order = sorted({i for i, _ in rows if i is not None}, reverse=True)
    text = dict(rows)
    for i, t in plain:
        at = order.index(i)
        if at + 1 < len(order):
            following = text[order[at + 1]]
            k = len(t) // 3
            want = t[: len(t) - k] + following[:k]
            assert by[i]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
            f, e, n = edit.fingerprints([t, want, following])
            assert (by[i]["fingerprint"], by[i]["edited_fingerprint"]) == (f, e)
            assert by[i]["near_edited"] == edit.likeness(f, e) and by[i]["near_next"] == edit.likeness(f, n)
    assert fingerprint.with_edits(nothing).count() == 0


def test_wraps_around(spark):
    df = spark.createDataFrame([(i, f"text number {i} " * 3) for i in range(50)], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.with_edits(df).collect()}
    texts = {i: f"text number {i} " * 3 for i in range(50)}
    for i in texts:
        t, n = texts[i], texts[(i - 1) % 50]
        k = len(t) // 3
        assert got[i] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()
    one = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    assert fingerprint.with_edits(one).first()["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()


def test_near_duplicates_by_brute_force(spark, edge, nothing):
    texts = []
    for g in range(12):
        base = prose(100 + g, 150)
        texts += [base, base[:200] + "Z" + base[203:], base + " tail"] if g % 2 else [base]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(df).collect()}
    prints = edit.fingerprints(texts)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if edit.likeness(prints[i], prints[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert got == dict(enumerate(root))
    classes = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(edge).collect()}
    assert classes[5] == 1 and classes[10] == 10
    assert fingerprint.near_duplicates(nothing).count() == 0


def test_short_copies_share_bands():
    """Walks of different length below 64 samples."""
    lost, near = 0, 0
    for k in range(300):
        a = prose(1000 + k, 4)[:18]
        fa, fb = edit.fingerprints([a, a + "es"])
        assert len(fa) < 129
        if len(fa) != len(fb) and edit.likeness(fa, fb) >= 0.8:
            near += 1
            lost += not set(edit.bands(fa)) & set(edit.bands(fb))
    assert near > 100 and lost <= near // 50


def test_large_bands_are_verified_whole(spark, monkeypatch):
    """Copies that differ early, with hundreds of other texts between them in one band."""
    rnd = random.Random(4)
    letters = "0123456789abcdef"
    prints = [f"{x[:64]}.{x[64:]}" for x in ("".join(rnd.choice(letters) for _ in range(128)) for _ in range(400))]
    prints += [("0" if f[0] != "0" else "f") + f[1:] for f in prints[:40]]
    monkeypatch.setattr(fingerprint, "with_fingerprints", lambda docs, *_: docs)
    monkeypatch.setattr(fingerprint, "bands", lambda *_: [1])
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id bigint, fingerprint string")
    for block in (512, 50):
        got = {r["doc_id"]: r["class_id"] for r in fingerprint.near_duplicates(df, block=block).collect()}
        assert got == {i: i - 400 if i >= 400 else i for i in range(440)}


def test_likenesses_are_likeness():
    prints = sorted({*edit.fingerprints([prose(i, 1 + i % 90)[: 3 + 7 * i] for i in range(60)]), ""})
    group = edit.padded(prints)
    for x, f in enumerate(prints):
        to = np.arange(x + 1, len(prints))
        assert edit.likenesses(x, to, group).tolist() == pytest.approx([edit.likeness(f, g) for g in prints[x + 1 :]])


@pytest.mark.parametrize("edits, letters", [(1, 3), (1, 10), (1, 30), (3, 1)])
def test_near_copies_by_edit_distance(edits, letters):
    """Characters put in anywhere into texts of 400 and more: copies at a small edit distance are like, share a band, and others don't look like them."""
    rnd = random.Random(edits * 100 + letters)
    found, n = 0, 200
    for k in range(n):
        a = prose(3000 + k, 80 + k)
        assert len(a) > 400
        b = a
        for _ in range(edits):
            at = rnd.randrange(len(b))
            b = b[:at] + "".join(rnd.choice("qxzvkw") for _ in range(letters)) + b[at:]
        fa, fb = edit.fingerprints([a, b])
        found += edit.likeness(fa, fb) >= 0.8 and bool(set(edit.bands(fa)) & set(edit.bands(fb)))
    assert found >= (0.9 if edits == 1 else 0.8) * n, found / n


def test_long_texts_take_linear_time():
    text = prose(9, 200000)[:1_000_000]
    began = time.time()
    (one,) = edit.fingerprints([text])
    assert time.time() - began < 5
    # walked alone or side by side, a text has the same fingerprint
    assert edit.fingerprints([text[:2000]] * 100 + [text[:30000]])[-1] == edit.fingerprints([text[:30000]])[0]
    assert len(one) < 4000


def test_string_ids(spark):
    texts = {f"doc{i:03d}": f"text number {i} " * 3 for i in range(60)}
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprint.with_edits(spark.createDataFrame(list(texts.items()), "doc_id string, text string").repartition(5)).collect()}
    order = sorted(texts, reverse=True)
    for i, name in enumerate(order):
        t, n = texts[name], texts[order[(i + 1) % 60]]
        k = len(t) // 3
        assert got[name] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()


def walk_by_hand(text, tables):
    """The samples of one walk, a step at a time, by the definition: stand, emit, and move if the shared function says so."""
    move, emit = tables
    symbols = [c if c < 256 else (c * 2654435761 % 2**32) >> 24 for c in map(ord, text)]
    emitted, at, t = [], 0, 0
    while at < len(symbols):
        emitted.append("0123456789abcdef"[emit[symbols[at]]])
        at += int(move[(t % edit.PERIOD) * 256 + symbols[at]])
        t += 1
    # all of the first 64 steps, then of every octave the middles of 64 equal parts
    keep = [s for s in range(min(64, t))]
    low = 64
    while low < t:
        keep += [s for k in range(64) if (s := low + k * (low // 64) + low // 128) < t]
        low *= 2
    return "".join(emitted[s] for s in keep)


def test_walks_by_hand():
    texts = ["", "a", "ab" * 40, prose(31, 300), "ñandú 日本語 😀 " * 30, "x" * 3000, prose(32, 4000)] + [prose(40 + i, 1 + i) for i in range(120)]
    for text, got in zip(texts, edit.fingerprints(texts)):
        want = f"{walk_by_hand(text, edit._TABLES[0])}.{walk_by_hand(text[::-1], edit._TABLES[1])}" if text else ""
        assert got == want


def test_likeness_by_hand():
    """The best of 17 places, each with the weighed and corrected agreement of the walks before and behind it."""

    def agreed(a, b, steps):
        w = edit.weights(max(len(a), len(b)))
        total, done = 0.0, 0.0
        for i in range(min(len(a), len(b))):
            done += w[i]
            if done > steps * w.sum() * (1 + 1e-12):
                break
            total += w[i] * ((a[i] == b[i]) - edit.CHANCE) / (1 - edit.CHANCE)
        return total / w.sum()

    for k in range(40):
        a = prose(600 + k, 10 + 9 * k)
        b = a[: len(a) // 2] + "zq" * (k % 5) + a[len(a) // 2 + k % 7 :]
        fa, fb = edit.fingerprints([a, b])
        (af, ab), (bf, bb) = fa.split("."), fb.split(".")
        want = 1.0 if fa == fb else max(agreed(af, bf, i / 16) + agreed(ab, bb, 1 - i / 16) for i in range(17))
        assert edit.likeness(fa, fb) == pytest.approx(min(1.0, max(0.0, want)))
