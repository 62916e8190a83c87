"""N-gram Jaccard join by chosen paths.

Sets are the distinct 5-word shingles of a document (fewer words: one shingle). Equal sets are one node. In each
run every set samples about ``branching`` of its shingles by a shared hash; sets that sampled the same shingle
share a bucket. Small buckets are compared by brute force on minhash sketches of ``BINS`` tokens of 16 bits. A set is covered,
and goes no deeper, once so many of its samples lie in small buckets that a partner at the threshold can't have
missed them all (``covering``). The others are split again inside their large buckets, on sampled shared tokens of
their sketches, as many as the recall still needs (``mean_needed``). A few leaders of each bucket tell which tokens most of it has; those part nothing and are not
sampled where a set has enough others. Where the leaders show that a bucket has a dense group, members much like
its leaders are done there. Splits go down to ``DEPTH`` levels; what is then still together counts as candidates.
Runs repeat until a pair at the threshold is found with probability ``recall`` even at the deepest level. Candidate
pairs are held as connected components, and inside each component all pairs are verified on the shingles
themselves, in cells of about 2 x ``BLOCK`` sets, or fewer long ones, so link counts are exact and no pair leaves a task.

Documents without words are in no class but their own and have no links. Each row counts as a document: a row
repeated under its id is linked to its repetition. Rows with a null id have no name: they are compared with
nothing, have a null class and no links. Null texts are empty. Columns other than id and text are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, id_text, partitions, release, slices, sorted_groups, staged, unloaded
from .components import components
from .words import U, mix, shingles, words

SHINGLE, SIMILARITY, RECALL, BRANCHING = 5, 0.8, 0.999999, 2.0
SMALL, DEPTH, BLOCK, BINS = 512, 8, 2048, 128
#: Tokens that a set samples in a large bucket at each further level; runs are counted with it (``runs_needed``).
SPLIT = 2.0
#: Deviation of a sketch's agreement from the similarity; the splits of all runs see the same sketch.
SPREAD = 0.04
#: Shingles for each of the BLOCK sets of a block; components of longer texts have smaller blocks.
SHINGLES = 1024
BROADCAST_IDS = 2_000_000
#: Sketches estimate similarity with a deviation of at most ``SPREAD`` at the threshold; pairs above threshold - SLACK stay candidates.
#: Against leaders: a set is done where its sketch agrees on SURE or more. What is similar to it, by 0.8 or more, is
#: then similar to the leader by 0.52 or more, by the triangle inequality, and NEAR leaves that three deviations.
SLACK, SURE, NEAR, LEADERS = 0.18, 0.72, 0.40, 32
#: A leader stands for a dense group, and members may be done by it, if so many other leaders are as much like it.
DENSE = 3
#: Of the leaders: a token that more than this share of them have is common in the bucket.
COMMON = 0.25
#: A set samples common tokens only if its others aren't so much more of its sketch than partners may differ by.
LEAST_RARE, MARGIN = 5 * SPREAD, 2 * SPREAD
#: Sets with more samples are held to what so many of them must have in small buckets.
MOST_SAMPLED = 200
#: Members of a large bucket that one task compares with its leaders.
SLICE = 4096


def runs_needed(similarity: float, recall: float, branching: float, levels: int = DEPTH, split: float = SPLIT) -> int:
    """Runs until a pair at the threshold has met in a bucket with probability ``recall``, at the deepest of ``levels``.

    Sets of sizes n and s * n that share s * n shingles sample branching * s shared ones on average; at each further
    level sketches that agree on a share x sample split * x shared tokens. That share is one for all runs, so the
    chance of a miss is averaged over it (normal, deviation ``SPREAD``).
    """
    at = np.linspace(-4, 4, 161)
    weight = np.exp(-at * at / 2)
    p = np.ones(len(at))
    for _ in range(levels - 1):
        p = 1 - np.exp(-split * np.clip(similarity + SPREAD * at, 0, 1) * p)
    missed = np.exp(-branching * similarity * p)
    runs = 1
    while (weight @ missed**runs) / weight.sum() > 1 - recall:
        runs += 1
    return runs


def _unshared(sampled: int, similarity: float) -> np.ndarray:
    """The chance that a partner at the threshold lacks 0, 1 and so on of ``sampled`` samples of a set: binomial, as it
    lacks each with 1 - similarity at most."""
    d = np.arange(sampled + 1)
    choose = np.array([math.lgamma(sampled + 1) - math.lgamma(k + 1) - math.lgamma(sampled - k + 1) for k in d.tolist()])
    return np.exp(choose + d * np.log(1 - similarity) + (sampled - d) * np.log(similarity))


def covering(sampled: int, similarity: float = SIMILARITY, recall: float = RECALL) -> int:
    """How many of ``sampled`` samples in small buckets cover a set, whatever its partners: one is missed only if it lacks them all."""
    tail = np.cumsum(_unshared(sampled, similarity)[::-1])[::-1]
    return int(np.count_nonzero(tail > 1 - recall))


@functools.lru_cache(10_000)
def mean_needed(sampled: int, small: int, similarity: float = SIMILARITY, recall: float = RECALL, branching: float = BRANCHING) -> float:
    """How many shared tokens a set must sample on average in each of its large buckets, if ``small`` of its ``sampled``
    samples lie in small ones.

    A partner is missed only if it lacks all small ones and is lost in each of the large buckets that it shares: there
    no token is sampled that is followed by both to the deepest level.
    """
    kept = 1.0
    for _ in range(DEPTH - 2):
        kept = 1 - math.exp(-SPLIT * (similarity - SPREAD) * kept)
    d = np.arange(small, sampled + 1)
    lacks = _unshared(sampled, similarity)[small:]

    def missed(mean: float) -> float:
        return float(lacks @ np.exp(-mean * kept * (sampled - d)))

    most = branching * similarity
    if missed(most) > 1 - recall:
        return most
    low, high = 0.0, most
    while high - low > 0.005:
        mid = (low + high) / 2
        low, high = (mid, high) if missed(mid) > 1 - recall else (low, mid)
    return high


def _spread(seed: int) -> np.uint64:
    return mix(np.array([seed + 1], U) * U(0x9E3779B97F4A7C15))[0] | U(1)


def _set_keys(h: np.ndarray, first: np.ndarray) -> list[bytes | None]:
    """128 bits of each set: two independent sums over its members and its size; None for the empty set."""
    n = np.diff(first)
    out: list[bytes | None] = [None] * len(n)
    full = np.flatnonzero(n)
    if len(full):
        a = mix(np.add.reduceat(h * U(0xC2B2AE3D27D4EB4F), first[full]) + n[full].astype(U))
        b = mix(np.add.reduceat(mix(h ^ U(0x165667B19E3779F9)), first[full]) ^ n[full].astype(U))
        both = np.stack([a, b], 1).tobytes()
        for i, d in enumerate(full.tolist()):
            out[d] = both[16 * i : 16 * i + 16]
    return out


def _sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One-permutation minhash: the top 7 bits of a shingle are its bin, 16 bits of each bin's least member are kept; 0: empty."""
    n = len(first) - 1
    out = np.zeros((n, BINS), np.uint16)
    if len(h):
        doc = np.repeat(np.arange(n), np.diff(first))
        cell = doc * BINS + (h >> U(57)).astype(np.int64)
        lead = np.ones(len(h), bool)
        lead[1:] = cell[1:] != cell[:-1]
        out.reshape(-1)[cell[lead]] = 1 + (mix(h[lead]) % U(65535)).astype(np.uint16)
    return out


def _paths(h: np.ndarray, first: np.ndarray, runs: int, branching: float) -> tuple[np.ndarray, np.ndarray]:
    """Documents and paths of the shingles that each set samples in each run."""
    n = np.diff(first)
    share = np.minimum(branching / np.maximum(n, 1), 1.0)
    limit = np.where(share >= 1, U(2**64 - 1), (share * 2.0**64 * (1 - 2.0**-52)).astype(U))
    limit = np.repeat(limit, n)
    docs, paths = [], []
    for r in range(runs):
        c = _spread(r)
        got = np.flatnonzero(h * c <= limit)
        docs.append(np.searchsorted(first, got, "right") - 1)
        paths.append(mix(h[got] + c))
    return np.concatenate(docs), np.concatenate(paths)


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def signatures(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, branching: float = BRANCHING, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: id, set key (null without words), sketch, first-level paths and number of shingles."""
    runs = runs_needed(similarity, recall, branching)

    def run(batches):
        unloaded()
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                h, first = shingles(words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), SHINGLE)
                at, path = _paths(h, first, runs, branching)
                order = np.argsort(at, kind="stable")
                off = np.searchsorted(at[order], np.arange(b - a + 1))
                paths = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(path[order].view(np.int64)))
                sketch = [x.tobytes() for x in _sketches(h, first)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), pa.array(_set_keys(h, first), pa.binary()), pa.array(sketch, pa.binary()), paths, pa.array(np.diff(first), pa.int32())], ["id", "key", "sketch", "paths", "shingles"])

    rows = id_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, key binary, sketch binary, paths array<bigint>, shingles int")


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of sketches, row by row."""
    full = (a | b) > 0
    return ((a == b) & full).sum(-1) / np.maximum(full.sum(-1), 1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of ``n`` nodes the least node of its component under the edges a, b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _bucket_edges(least: float):
    """Sketch edges inside buckets, as one edge from a node to the least of its component."""

    def run(batches):
        for t in sorted_groups(batches, ["path"]):
            path = t.column("path").to_numpy()
            keys = t.column("key").combine_chunks()
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(len(path), BINS)
            starts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
            ends = np.append(starts[1:], len(path))
            # in most buckets each set is like the one before it, and that chain says all
            near = np.zeros(len(path), bool)
            near[1:] = (path[1:] == path[:-1]) & (_alike(sketch[1:], sketch[:-1]) >= least)
            ea, eb = [np.flatnonzero(near)], [np.flatnonzero(near) - 1]
            linked = np.add.reduceat(near, starts) if len(path) else np.zeros(0)
            for a, b in zip(starts[linked < ends - starts - 1].tolist(), ends[linked < ends - starts - 1].tolist()):
                for i in range(a, b - 1):
                    got = np.flatnonzero(_alike(sketch[i + 1 : b], sketch[i][None]) >= least) + i + 1
                    ea.append(got)
                    eb.append(np.full(len(got), i))
            ea, eb = np.concatenate(ea), np.concatenate(eb)
            root = _roots(len(path), ea, eb)
            out = np.flatnonzero(root != np.arange(len(path)))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(out)), keys.take(pa.array(root[out]))], ["a", "b"])

    return run


def _bucket(lead: list[tuple[bytes, bytes]], least: float, sure: float):
    """The leaders of a bucket: their sketches, and of those that stand for dense groups the names of their groups."""
    lead.sort()
    ls = np.frombuffer(b"".join(x[1] for x in lead), np.uint16).reshape(len(lead), BINS)
    like = np.stack([_alike(ls, x) for x in ls])
    dense = np.flatnonzero((like >= sure).sum(1) > DENSE)
    near = like[np.ix_(dense, dense)] >= least
    root = _roots(len(dense), *np.nonzero(near))
    return ls, dense, np.array([lead[dense[r]][0] for r in root.tolist()], object)


def _follow(depth: int, similarity: float, branching: float, recall: float = RECALL):
    """Members of large buckets against the ``LEADERS`` of their bucket: edges, and the next paths of those not done.

    Rows are sorted by path and slice, the leaders of a bucket first. Every member is compared with every leader. One that
    is sure to be like the leader of a dense group is done with this bucket: by the triangle inequality of Jaccard
    distance its own partners are near enough to that leader to get an edge too. The others sample tokens (bin, value) of
    their sketches: rare ones of this bucket, at such a rate that of those a partner must share ``branching * similarity``
    are sampled on average, or as few as ``mean_needed`` says, and common ones only where rare ones are few.
    """
    least, sure = similarity - 0.8 + NEAR, similarity - 0.8 + SURE
    bins = np.arange(BINS, dtype=U)[None] * U(65536)

    def members(path: int, keys: pa.Array, sketch: np.ndarray, sampled: list[int], small: list[int], bucket) -> pa.RecordBatch:
        ls, dense, names = bucket
        n = len(sketch)
        full = sketch > 0
        had = np.zeros(sketch.shape, np.uint8)
        for x in ls:
            had += sketch == x
        rare = full & (had <= COMMON * len(ls))
        size = np.maximum(full.sum(1), 1)
        left = rare.sum(1) / size - (1 - similarity)  # what a partner must have of them
        # of each token the chance that it is sampled
        mean = np.array([mean_needed(a, b, similarity, recall, branching) if a else branching * similarity for a, b in zip(sampled, small)])
        often = mean / (np.maximum(left, LEAST_RARE) - MARGIN) / size
        pick = np.where(rare, often[:, None], full * ((left < LEAST_RARE) * mean / similarity / size)[:, None])
        edges: list[list[bytes]] = [[] for _ in range(n)]
        if len(dense):
            like = np.stack([_alike(sketch, ls[x]) for x in dense.tolist()], 1)
            pick[(like >= sure).any(1)] = 0
            for r in np.flatnonzero((like >= least).any(1)).tolist():
                edges[r] = sorted(set(names[like[r] >= least].tolist()))
        at = np.array([path]).view(U)
        token = mix((bins + sketch.astype(U)) ^ mix(at + U(depth)))
        row, cell = np.nonzero(token.astype(np.float64) < pick * 2.0**64)
        new = mix(token[row, cell] + at).view(np.int64)
        off = np.searchsorted(row, np.arange(n + 1))
        cols = [keys, pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(edges, pa.list_(pa.binary())), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(new))]
        return pa.RecordBatch.from_arrays(cols, ["key", "sketch", "near", "next"])

    def run(batches):
        now, lead, bucket = None, [], None
        for batch in batches:
            path, part, member = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "slice", "member"))
            keys, sampled, small = batch.column("key"), batch.column("sampled").to_pylist(), batch.column("small").to_pylist()
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(batch.num_rows, BINS)
            cut = np.flatnonzero((path[1:] != path[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
                if a == b:
                    continue
                if now != (path[a], part[a]):
                    now, lead, bucket = (path[a], part[a]), [], None
                m = a + int(np.searchsorted(member[a:b], True))
                lead += [(keys[k].as_py(), sketch[k].tobytes()) for k in range(a, m)]
                if m < b:
                    bucket = bucket or _bucket(lead, least, sure)
                    yield members(int(path[a]), keys.slice(m, b - m), sketch[m:b], sampled[m:b], small[m:b], bucket)

    return run


def _sized(level: DataFrame) -> DataFrame:
    """(path, key) with the number of sets in each bucket, without buckets of one."""
    return level.join(level.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"), "path")


def _uncovered(wide: DataFrame, nodes: DataFrame, similarity: float, recall: float) -> DataFrame:
    """The rows of ``wide`` of sets that aren't covered, with how many samples each has, and in small buckets."""
    held = wide.groupBy("key").agg(F.count("*").alias("held")).join(nodes.select("key", F.size("paths").alias("sampled")), "key")
    held = held.select("key", "sampled", (F.col("sampled") - F.col("held")).cast("int").alias("small"))
    least = F.lit([covering(k, similarity, recall) for k in range(MOST_SAMPLED + 1)])
    return wide.join(held.where(F.col("small") < F.element_at(least, F.least("sampled", F.lit(MOST_SAMPLED)) + 1)), "key")


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, branching: float = BRANCHING, small: int = SMALL) -> DataFrame:
    """(key, component) of every node (key, sketch, paths) that may be similar to another one."""
    parts = partitions(nodes.sparkSession)
    paths = _sized(nodes.select(F.explode("paths").alias("path"), "key"))
    level = staged(paths.join(nodes.select("key", "sketch"), "key").select("path", "n", "key", "sketch"), "paths")
    edges, used = [], [level]
    for depth in range(1, DEPTH + 1):
        tight = level.where(F.col("n") <= small).select("path", "key", "sketch").repartition(parts, "path").sortWithinPartitions("path", "key")
        edges.append(staged(tight.mapInArrow(_bucket_edges(similarity - SLACK), "a binary, b binary").distinct(), "near"))
        wide = level.where(F.col("n") > small)
        if wide.isEmpty():
            break
        if depth == DEPTH:  # sets that stayed together through all splits: candidates as they are
            least = wide.groupBy("path").agg(F.min("key").alias("b"))
            edges.append(wide.join(least, "path").select(F.col("key").alias("a"), "b").where("a <> b").distinct())
            break
        if depth == 1:
            wide = _uncovered(wide, nodes, similarity, recall)
        else:
            wide = wide.select("*", F.lit(0).alias("sampled"), F.lit(0).alias("small"))
        # leaders: of each of LEADERS hash slots the least member; they are sent to every slice of their bucket
        slices_of = F.ceil(F.col("n") / SLICE).cast("int")
        slot = wide.groupBy("path", F.pmod(F.xxhash64("key"), F.lit(LEADERS)).alias("slot")).agg(F.min(F.struct("key", "sketch")).alias("leader"), F.max("n").alias("n"))
        lead = slot.select("path", F.explode(F.sequence(F.lit(0), slices_of - 1)).alias("slice"), F.lit(False).alias("member"), "leader.key", "leader.sketch", F.lit(0).alias("sampled"), F.lit(0).alias("small"))
        rows = wide.select("path", F.pmod(F.xxhash64("key"), slices_of).cast("int").alias("slice"), F.lit(True).alias("member"), "key", "sketch", "sampled", "small").unionByName(lead)
        rows = rows.repartition(parts, "path", "slice").sortWithinPartitions("path", "slice", "member", "key")
        led = staged(rows.mapInArrow(_follow(depth, similarity, SPLIT, recall), "key binary, sketch binary, near array<binary>, next array<bigint>"), "led")
        edges.append(led.select(F.col("key").alias("a"), F.explode("near").alias("b")).where("a <> b").distinct())
        new = led.select(F.explode("next").alias("path"), "key", "sketch")
        level = staged(_sized(new).select("path", "n", "key", "sketch"), "paths")
        used += [led, level]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    whole = components(out)
    found = whole.select(F.col("node").alias("key"), F.col("root").alias("component"))
    found.staged_at = whole.staged_at
    release(*used, *edges)
    return found


def _verify(num: int, den: int):
    """Exact links inside cells; a row of each set in a cell: documents linked to it and the least set of its class there."""

    def run(batches):
        for t in sorted_groups(batches, ["component", "i", "j"]):
            comp = t.column("component").to_pylist()
            ij = np.stack([t.column("i").to_numpy(), t.column("j").to_numpy()], 1)
            same = np.ones(len(comp), bool)
            same[1:] = [x == y for x, y in zip(comp[1:], comp)]
            same[1:] &= (ij[1:] == ij[:-1]).all(1)
            same[:1] = False
            starts = np.flatnonzero(~same)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(comp)]):
                yield from _cell(t.slice(a, b - a), int(ij[a, 0]), int(ij[a, 1]), num, den)

    return run


def _cell(t: pa.Table, i: int, j: int, num: int, den: int):
    data, offsets = buffers(t.column("text"))
    h, first = [], [0]
    keys: list = []
    for a, b in slices(offsets):
        hh, ff = shingles(words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), SHINGLE)
        keys += _set_keys(hh, ff)
        h.append(hh)
        first += (ff[1:] + first[-1]).tolist()
    h, first = np.concatenate(h), np.array(first)
    want = t.column("key").to_pylist()
    seen: set = set()
    good = []  # rows of another text under the same id, and repeated rows, go
    for r, (k, w) in enumerate(zip(keys, want)):
        if k == w and k not in seen:
            seen.add(k)
            good.append(r)
    n = len(good)
    if n < 2:
        return
    size = np.diff(first)[good]
    weight = t.column("copies").to_numpy()[good]
    block = t.column("block").to_numpy()[good]
    member = np.concatenate([np.arange(first[r], first[r + 1]) for r in good])
    doc = np.repeat(np.arange(n), size)
    _, inverse, df = np.unique(h[member], return_inverse=True, return_counts=True)
    useful = df[inverse] > 1
    doc = doc[useful]
    _, column = np.unique(inverse[useful], return_inverse=True)
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return
    width = int(column.max()) + 1 if len(column) else 0
    both = np.zeros((len(left), len(right)), np.float32)
    step = max(64, (32 << 20) // (4 * n))
    order = np.argsort(column, kind="stable")
    column, doc = column[order], doc[order]
    for c in range(0, width, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        m = np.zeros((n, min(step, width - c)), np.float32)
        m[doc[lo:hi], column[lo:hi] - c] = 1
        both += m[left] @ m[right].T
    union = (size[left][:, None] + size[right][None]) - both
    link = both * den >= union * num
    if i == j:
        np.fill_diagonal(link, False)
        ea, eb = np.nonzero(np.triu(link))
        linked = np.zeros(n, np.int64)
        linked[left] = link @ weight[left]
    else:
        ea, eb = np.nonzero(link)
        linked = np.zeros(n, np.int64)
        linked[left] = link @ weight[right]
        linked[right] = weight[left] @ link
    root = _roots(n, left[ea], right[eb])
    out = np.flatnonzero(linked)
    name = [want[r] for r in good]
    yield pa.RecordBatch.from_arrays([pa.array([name[x] for x in out], pa.binary()), pa.array(linked[out], pa.int64()), pa.array([name[root[x]] for x in out], pa.binary())], ["key", "linked", "root"])


def similar(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, branching: float = BRANCHING, small: int = SMALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, class_id (least id of the connected component), n_links (rows of similarity or more)."""
    parts = partitions(docs.sparkSession)
    num, den = round(similarity * 1000), 1000
    sig = staged(signatures(docs, similarity, recall, branching, id_col, text_col), "signatures")
    full = sig.where("key is not null and id is not null")
    sets = full.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.max("shingles").alias("shingles"))
    one = full.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("paths").alias("paths"))
    found = candidates(one, similarity, recall, branching, small)
    members_of = staged(found.join(sets, "key"), "candidates")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("shingles") / (block * SHINGLES)))
    # a table of its own, so that the rows of one large component are joined with it in several tasks
    sizes = staged(members_of.groupBy("component").agg(F.count("*").alias("sets"), blocks.cast("int").alias("blocks")), "components")
    members = members_of.join(sizes.where("sets > 1"), "component")
    members = members.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    texts = id_text(docs, id_col, text_col)
    placed = members.join(texts, texts["id"] == members["id"]).select("component", "key", "copies", "block", "blocks", "text")
    cells = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "copies", "block", "text")
    cells = cells.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "key")
    links = staged(cells.mapInArrow(_verify(num, den), "key binary, linked bigint, root binary"), "links")
    counts = links.groupBy("key").agg(F.sum("linked").alias("linked"))
    classes = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    known = sets.join(classes, sets["key"] == classes["node"], "left").select("key", "id", "copies", F.coalesce("root", "key").alias("root"))
    known = staged(known.join(counts, "key", "left").select("key", "id", "root", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")), "classes")
    release(found, members_of, sizes, links, classes)
    names_of = staged(known.groupBy("root").agg(F.min("id").alias("class_id")), "names")
    named = known.join(names_of, "root").select("key", "class_id", "n_links")
    out = sig.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(named, "key", "left")
    out = out.select(F.col("id").alias(id_col), F.when(F.col("key").isNull() | F.col("id").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out.reads = (sig, known, names_of)
    return out


def without_near_copies(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` in its own columns with one document, that of the least id, of each class.

    A document repeated under its id is kept once. Rows with a null id all stay.
    """
    found = similar(docs, similarity, id_col=id_col, text_col=text_col)
    got = staged(found, "similar")
    release(found)
    known = got.where(F.col(id_col).isNotNull())
    gone = known.where(F.col(id_col) != F.col("class_id")).select(F.col(id_col).alias("__sonda_id")).distinct()
    repeated = known.where(F.col(id_col) == F.col("class_id")).groupBy(id_col).count().where("count > 1")
    # the ids that go are counted; only so many are sent to all tasks, more are joined by shuffle
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    out = docs.join(gone, docs[f"`{id_col}`"] == gone["__sonda_id"], "left_anti")
    if repeated.isEmpty():
        return out
    named = F.col(f"`{id_col}`").isNotNull()
    return out.where(named).dropDuplicates([id_col]).unionByName(out.where(~named))
