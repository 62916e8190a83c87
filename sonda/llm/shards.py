"""Best-fit-decreasing sharding of indivisible groups.

Groups (documents of equal text) are sorted by size and enter the shard with the tightest remaining capacity,
found in a balanced tree. The driver packs the histogram of group sizes: groups of one size that enter the same
shard one after another are one step, so its work is of distinct sizes, of which a corpus of B bytes has fewer
than sqrt(2 B). The plan says how many groups of each size go to which shard; groups are numbered within their
size, by prefix sums over hash buckets, and each number has its place in the plan. Texts are not shuffled: a row
goes by its id, size and hash.

Null texts count no bytes. Null ids, empty texts and repeated rows are rows like any other; equal rows stand
next to each other. An empty table gives no rows. A group larger than a shard's capacity fills a shard alone.
Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, release, staged


class Tree:
    """A balanced (AA) tree of distinct integer keys, each with a list of values."""

    class Node:
        __slots__ = ("key", "values", "level", "left", "right")

        def __init__(self, key, value):
            self.key, self.values, self.level, self.left, self.right = key, [value], 1, None, None

    def __init__(self):
        self.root = None

    @staticmethod
    def _skew(n):
        if n and n.left and n.left.level == n.level:
            x = n.left
            n.left, x.right = x.right, n
            return x
        return n

    @staticmethod
    def _split(n):
        if n and n.right and n.right.right and n.right.right.level == n.level:
            x = n.right
            n.right, x.left = x.left, n
            x.level += 1
            return x
        return n

    def add(self, key, value):
        def put(n):
            if n is None:
                return Tree.Node(key, value)
            if key == n.key:
                n.values.append(value)
                return n
            if key < n.key:
                n.left = put(n.left)
            else:
                n.right = put(n.right)
            return self._split(self._skew(n))

        self.root = put(self.root)

    def _remove(self, n, key):
        if n is None:
            return None
        if key < n.key:
            n.left = self._remove(n.left, key)
        elif key > n.key:
            n.right = self._remove(n.right, key)
        elif n.left is None:
            return n.right
        elif n.right is None:
            return n.left
        else:
            x = n.right
            while x.left:
                x = x.left
            n.key, n.values = x.key, x.values
            n.right = self._remove(n.right, x.key)
        least = 1 + min(n.left.level if n.left else 0, n.right.level if n.right else 0)
        if least < n.level:
            n.level = least
            if n.right and n.right.level > least:
                n.right.level = least
        n = self._skew(n)
        if n.right:
            n.right = self._skew(n.right)
            if n.right.right:
                n.right.right = self._skew(n.right.right)
        n = self._split(n)
        if n.right:
            n.right = self._split(n.right)
        return n

    def take_at_least(self, key):
        """Remove and return (key, value) with the least key of ``key`` or more; None if there is none."""
        n, best = self.root, None
        while n:
            if n.key >= key:
                best, n = n, n.left
            else:
                n = n.right
        if best is None:
            return None
        found, value = best.key, best.values.pop()
        if not best.values:
            self.root = self._remove(self.root, found)
        return found, value


def best_fit(sizes: Iterable[tuple[int, int]], capacity: int, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """(size, times, bin) steps of packing (size, count) pairs, whose sizes descend; None if more than ``most`` bins are needed.

    Each item enters the bin with the tightest room; a new bin opens when no open one has room. As a bin that an item
    has entered is still the tightest for the next item of that size while it has room, such items enter together.
    """
    tree, bins, out = Tree(), 0, []
    for size, count in sizes:
        while count:
            got = tree.take_at_least(size)
            if got is None:
                if bins == most:
                    return None
                got, bins = (max(capacity, size), bins), bins + 1
            times = min(count, got[0] // size)
            out.append((size, times, got[1]))
            count -= times
            tree.add(got[0] - size * times, got[1])
    return out


def smallest_capacity(sizes: list[tuple[int, int]], shards: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The least capacity found at which best-fit-decreasing of (size, count) pairs needs at most ``shards`` bins: the
    capacity grows in doubling steps from the mean, then the last step is bisected."""
    if not sizes:
        return 1, []
    low = max(-(-sum(s * n for s, n in sizes) // shards), 1)
    step, best = 0, best_fit(sizes, low, shards)
    while best is None:
        low, step = low + max(step, 1), 2 * step or 1
        best = best_fit(sizes, low, shards)
    high, low = low, low - step + 1 if step else low
    while low < high:
        mid = (low + high) // 2
        got = best_fit(sizes, mid, shards)
        if got is None:
            low = mid + 1
        else:
            high, best = mid, got
    return high, best


def places(plan: list[tuple[int, int, int]]) -> dict[str, np.ndarray]:
    """The plan by numbers within a size: from ``first`` on they are in ``bin``."""
    done: dict[int, int] = {}
    rows = []
    for size, times, where in plan:
        rows.append((size, done.get(size, 0), where))
        done[size] = done.get(size, 0) + times
    # plans descend by size and ascend by number
    rows.sort()
    return dict(zip(("size", "first", "bin"), np.array(rows, np.int64).reshape(-1, 3).T))


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Each row's id, size (UTF-8 bytes plus 8), text_crc32, shard (0 to shards - 1) and slot (gapless from 0 in its shard).

    ``with_text`` carries the text along too, for writing shards out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    facts = [(F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.md5(text.cast("binary"))).alias("group")]
    rows = rows.select("id", *["text"] * with_text, *facts)
    groups = staged(rows.groupBy("group").agg(F.sum("size").alias("size")), "groups")
    counts = [(r["size"], r["count"]) for r in groups.groupBy("size").count().collect()]  # one row for each size
    counts.sort(reverse=True)
    _, plan = smallest_capacity(counts, shards)
    table = spark.sparkContext.broadcast(places(plan))

    def run(batches):
        t = table.value
        for batch in batches:
            size, n = batch.column("size").to_numpy(), batch.column("number").to_numpy()
            # of each row the last step of its size that begins at or before its number
            low, high = np.searchsorted(t["size"], size, "left"), np.searchsorted(t["size"], size, "right")
            while (high - low > 1).any():
                mid = (low + high) // 2
                right = (high - low > 1) & (t["first"][mid] <= n)
                low, high = np.where(right, mid, low), np.where(right | (high - low <= 1), high, mid)
            yield pa.RecordBatch.from_arrays([batch.column("group"), pa.array(t["bin"][low].astype(np.int32))], ["group", "shard"])

    # a table of its own, so that the join can part the rows of one large group over several tasks
    where = staged(numbered(groups, "size", ["group"], F.xxhash64("group")).mapInArrow(run, "group binary, shard int"), "shards")
    # rows may be equal in all they have, so each gets a number before they are spread over buckets
    dealt = staged(rows.join(where, "group").withColumn("row", F.monotonically_increasing_id()), "dealt")
    release(groups, where)
    dealt = numbered(dealt, "shard", ["id", "group", "row"], F.xxhash64("id", "row"))
    return dealt.select("id", *["text"] * with_text, "size", "text_crc32", "shard", F.col("number").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The shards as Parquet folders ``shard=0`` and so on, each row with its slot."""
    assign(docs, shards, id_col, text_col, with_text=True).drop("text_crc32").withColumnRenamed("id", id_col).withColumnRenamed("text", text_col).write.partitionBy("shard").parquet(path)
