"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a written table in the shared folder; nothing is collected but one checksum a step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, staged


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Loops, repeated edges and either direction are fine; null ends are left out. The result reads one staged table.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _checksum(edges)
    while True:
        # large star: of each node, its larger neighbours go to the least of it and its neighbours; these least ones are a
        # table of their own, so that the join can part the star of one node over several tasks
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        table = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
        large = both.join(table, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = staged(large, "edges")
        # small star: of each node, its smaller neighbours and itself go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        old, edges = edges, staged(small.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        release(old, large, table)
        now = _checksum(edges)
        if now == before:
            break
        before = now
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    out.staged_at = edges.staged_at
    return out
