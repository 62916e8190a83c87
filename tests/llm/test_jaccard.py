import random

import numpy as np
import pyarrow as pa
import pytest

from samples import prose
from sonda.llm import jaccard
from sonda.llm.common import staged
from sonda.llm.components import components

import re


def sets(text):
    w = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, least=0.8):
    """{row number: (class, links)} over rows of (id, text)."""
    s = [sets(t) if i is not None else set() for i, t in rows]
    link = [[a for a in range(len(rows)) if a != b and s[a] and s[b] and 10 * len(s[a] & s[b]) >= 10 * least * len(s[a] | s[b])] for b in range(len(rows))]
    root = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            low = min([root[a], *(root[b] for b in link[a])])
            if low < root[a]:
                root[a], changed = low, True
    return sorted((str(rows[a][0]), str(min((rows[b][0] for b in range(len(rows)) if root[b] == root[a] and rows[b][0] is not None), default=None)), len(link[a])) for a in range(len(rows)))


def mine(df):
    return sorted((str(r["doc_id"]), str(r["class_id"]), r["n_links"]) for r in df.collect())


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(8)
    rows, n = [], 0
    passage = prose(50, 40)
    for g in range(30):
        base = prose(200 + g, rnd.randint(8, 160)).split()
        for _ in range(rnd.choice([1, 1, 2, 3, 12])):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = "EDIT%d" % rnd.randrange(9)
            text = " ".join(w)
            rows.append((n, text + " " + passage if g % 3 == 0 else text))
            n += 1
    return rows


@pytest.mark.parametrize("small, block", [(512, 2048), (3, 4)])
def test_equals_brute_force(spark, corpus, small, block):
    """Small limits send buckets through leaders, splits and cells."""
    df = spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)
    assert mine(jaccard.similar(df, small=small, block=block)) == brute(corpus)


def test_edges(spark, edge, edge_rows, nothing):
    rows = [(i, t) for i, t in edge_rows]
    assert mine(jaccard.similar(edge)) == brute(rows)
    assert jaccard.similar(nothing).count() == 0
    kept = jaccard.without_near_copies(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["1", "2", "3", "4", "None", "None", "6", "7", "8", "9", "10"])


def test_one_large_group_of_near_copies(spark):
    base = prose(77, 120).split()
    rows = []
    for i in range(600):
        w = list(base)
        w[(i * 7) % 120] = f"w{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = jaccard.similar(df, small=64, block=128).collect()
    assert {r["class_id"] for r in got} == {0}
    want = {i: 0 for i, _ in rows}
    s = [sets(t) for _, t in rows]
    for a in range(0, 600, 37):
        want[a] = sum(10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]) for b in range(600) if b != a)
    assert all(r["n_links"] == want[r["doc_id"]] for r in got if r["doc_id"] % 37 == 0)


def test_runs_rise_with_recall():
    assert jaccard.runs_needed(0.8, 0.9, 2.0) < jaccard.runs_needed(0.8, 0.999999, 2.0) < 30


def pairs_of_sets(rng, n, common=0):
    """Hashes and offsets of ``n`` pairs of a set of 200 shingles and its part of 160 (similarity 0.8); the first ``common`` are in all."""
    h, first = [], [0]
    shared = rng.integers(0, 2**64, common, np.uint64)
    for _ in range(n):
        whole = np.concatenate([shared, rng.integers(0, 2**64, 200 - common, np.uint64)])
        for x in (whole, whole[:160]):
            h.append(np.sort(x))
            first.append(first[-1] + len(x))
    return shared, np.concatenate(h), np.array(first)


def never_met(pairs, levels, common=0, seed=3):
    """How many of ``pairs`` share no path of ``levels`` levels in any run, all buckets being large."""
    rng = np.random.default_rng(seed)
    runs, lost = jaccard.runs_needed(0.8, jaccard.RECALL, jaccard.BRANCHING), 0
    for lo in range(0, pairs, 500):
        n = min(500, pairs - lo)
        _, h, first = pairs_of_sets(rng, n, common)
        sketch = [x.tobytes() for x in jaccard._sketches(h, first)]
        leaders = [sketch[2 * i] for i in range(jaccard.LEADERS)]
        doc, path = jaccard._paths(h, first, runs, jaccard.BRANCHING)
        run = np.cumsum(np.diff(doc, prepend=0) < 0)  # documents ascend within a run
        assert run[-1] == runs - 1
        met: set = set()
        for r in range(runs):
            rows = {(d, p) for d, p in zip(doc[run == r].tolist(), path[run == r].view(np.int64).tolist()) if d // 2 not in met}
            for level in range(1, levels + 1):
                rows = sorted((d, p) for d, p in rows if (d ^ 1, p) in rows)
                if level == levels or not rows:
                    break
                paths = sorted({p for _, p in rows})
                each = sorted([(p, False, -1 - i, x) for p in paths for i, x in enumerate(leaders)] + [(p, True, d, sketch[d]) for d, p in rows], key=lambda r: r[:3])
                zero = pa.array([0] * len(each))
                batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in each]), zero, *(pa.array([r[k] for r in each]) for k in (1, 2, 3)), zero, zero], ["path", "slice", "member", "key", "sketch", "sampled", "small"])
                rows = set()
                for new in jaccard._follow(level, 0.8, jaccard.SPLIT)(batch.slice(a, 1000) for a in range(0, batch.num_rows, 1000)):
                    rows |= {(d, p) for d, x in zip(new.column("key").to_pylist(), new.column("next").to_pylist()) for p in x}
            met |= {d // 2 for d, _ in rows}
        lost += n - len(met)
    return lost


@pytest.mark.parametrize("pairs, levels, common", [(200, jaccard.DEPTH, 0), (2000, 2, 80), (2000, 2, 120), (2000, 2, 150)])
def test_pairs_meet_at_deep_levels(pairs, levels, common):
    """Also where two fifths or more of the larger set are in every set of the bucket."""
    assert never_met(pairs, levels, common) == 0


@pytest.mark.parametrize("common", [40, 60, 80, 100])
def test_covered_sets_meet_in_small_buckets(common):
    """Shingles in all sets have large buckets; sets with enough other samples stop there and still find their partners."""
    rng = np.random.default_rng(9)
    runs = jaccard.runs_needed(0.8, jaccard.RECALL, jaccard.BRANCHING)
    stopped = 0
    for _ in range(8):
        shared, h, first = pairs_of_sets(rng, 1000, common)
        doc, path = jaccard._paths(h, first, runs, jaccard.BRANCHING)
        wide = {p for r in range(runs) for p in jaccard.mix(shared + jaccard._spread(r)).tolist()}
        small, sampled = [set() for _ in range(2000)], np.bincount(doc, minlength=2000)
        for d, p in zip(doc.tolist(), path.tolist()):
            if p not in wide:
                small[d].add(p)
        for d, (a, b) in enumerate(zip(small[::2], small[1::2])):
            if len(a) >= jaccard.covering(int(sampled[2 * d])) or len(b) >= jaccard.covering(int(sampled[2 * d + 1])):
                stopped += 1
                assert a & b
    assert stopped or common == 100


def test_fewer_tokens_are_enough_where_small_buckets_help():
    """The target holds by simulation of what a partner lacks, at a recall that can be seen in so many trials."""
    rng = np.random.default_rng(4)
    assert jaccard.mean_needed(30, jaccard.covering(30)) < 0.01 < jaccard.mean_needed(30, jaccard.covering(30) - 1) < jaccard.mean_needed(30, 2) <= 1.6
    kept = 0.6  # of a path that both follow, at the deepest level
    for sampled, small in ((30, 4), (30, 12), (24, 7), (40, 15)):
        mean = jaccard.mean_needed(sampled, small, recall=0.999)
        lacks = rng.binomial(sampled, 0.2, 400_000)
        found = rng.poisson(mean * kept * np.maximum(sampled - np.maximum(lacks, small), 0))
        assert ((lacks >= small) & (found == 0)).mean() < 0.0015


def templated(n, unlike=50):
    """Texts of one template of 100 words with words of their own behind it: pairs at a similarity of about 0.5, no links."""
    base = prose(5, 100)
    return [(i, base + " " + " ".join(f"w{i}x{j}" for j in range(unlike))) for i in range(n)]


def test_templates_without_links_take_linear_work(spark, monkeypatch):
    def rows_made(n):
        made = []
        monkeypatch.setattr(jaccard, "staged", lambda df, name: made.append((name, out := staged(df, name))) or out)
        monkeypatch.setattr(jaccard, "release", lambda *tables: None)
        got = jaccard.similar(spark.createDataFrame(templated(n), "doc_id bigint, text string").repartition(4), small=64)
        assert got.where("class_id <> doc_id or n_links > 0").isEmpty()
        counts = {}
        for name, t in made:
            counts[name] = counts.get(name, 0) + t.count()
        return counts

    one, four = rows_made(500), rows_made(2000)
    assert four["paths"] < 4.8 * one["paths"] and four["led"] < 4.8 * one["led"]
    assert four.get("candidates", 0) <= 2000 and four["links"] == 0


def test_components(spark):
    rnd = random.Random(5)
    edges = [(a, a + 1) for a in range(0, 60)] + [(100 + rnd.randrange(40), 100 + rnd.randrange(40)) for _ in range(30)] + [(7, 7), (None, 3)]
    root = {}
    for a, b in edges:
        if a is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
