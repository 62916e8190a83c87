import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sonda.llm import bins, packing
from sonda.llm.queries import tokenizer

BYTE = "byte_bpe_50k.json"


def exact(sizes, capacity):
    """The fewest bins, by trying everything."""
    best = len(sizes)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= sizes[i]}.values():
            rooms[k] -= sizes[i]
            place(i + 1, rooms)
            rooms[k] += sizes[i]
        place(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_plans_hold_every_size_once():
    rnd = random.Random(2)
    for _ in range(150):
        counts = Counter(rnd.randint(1, 20) for _ in range(rnd.randint(1, 10)))
        plan, bound = bins.pack(counts, 20)
        held = Counter()
        for filling, times in plan:
            assert sum(filling) <= 20
            for s in filling:
                held[s] += times
        assert held == counts
        n = sum(t for _, t in plan)
        assert bound <= n == exact(list(counts.elements()), 20)
    assert bins.pack({}, 20) == ([], 0)
    with pytest.raises(ValueError):
        bins.pack({21: 1}, 20)


def test_large_histograms_reach_the_bound():
    rnd = random.Random(3)
    counts = Counter(min(2048, int(rnd.lognormvariate(6.3, 1)) + 1) for _ in range(100_000))
    plan, bound = bins.pack(counts, 2048)
    assert sum(t for _, t in plan) == bound


def test_dominance():
    assert bins.dominates((10,), (6, 4)) and bins.dominates((6, 5), (5, 4, 1)) and not bins.dominates((6, 4), (10,))


def test_documents(edge, edge_rows, nothing):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer(BYTE))
    want = {}
    for i, t in edge_rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(i, []).append(ids)
    rows = packing.pack_documents(edge, tokenizer(BYTE)).collect()
    at = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] <= 2048 and r["ids_crc32"] == zlib.crc32(ids)
        assert any((w[r["start"] : r["start"] + r["length"]] == ids).all() for w in want[r["id"]] if len(w) >= r["start"] + r["length"])
        assert r["piece"] == 0 or r["length"] == 2048
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 2048
    total = sum(len(w) for ws in want.values() for w in ws)
    assert sum(r["length"] for r in rows) == total and len(at) == -(-total // 2048)
    assert packing.pack_documents(nothing, tokenizer(BYTE)).count() == 0
    seqs = packing.sequences(edge, tokenizer(BYTE)).collect()
    assert sorted(t for s in seqs for t in s["ids"]) == sorted(int(t) for ws in want.values() for w in ws for t in w)


@pytest.mark.parametrize("pieces", [2, 3, 5])
def test_tight_sizes_of_known_optimum(pieces):
    """Full sequences cut into pieces at random: a packing without waste exists, and the plan is near it."""
    rnd = random.Random(pieces)
    counts = Counter()
    for _ in range(600):
        cuts = sorted(rnd.sample(range(1, 2048), pieces - 1))
        counts.update(b - a for a, b in zip([0, *cuts], [*cuts, 2048]))
    plan, bound = bins.pack(counts, 2048)
    n = sum(t for _, t in plan)
    held = Counter()
    for filling, times in plan:
        for s in filling:
            held[s] += times
    assert held == counts and bound == 600 <= n <= 606 and n <= sum(t for _, t in bins.best_fit_decreasing(dict(counts), 2048))


def test_report_of_a_plan(spark):
    df = spark.createDataFrame([(i, "word " * (50 + i)) for i in range(40)], "doc_id bigint, text string")
    seen = []
    got = packing.packed(packing.staged(packing.pieces(df, tokenizer(BYTE), with_ids=False), "pieces"), report=lambda n, bound: seen.append((n, bound)))
    assert seen[0][0] == got.select("sequence_id").distinct().count() >= seen[0][1] > 0
