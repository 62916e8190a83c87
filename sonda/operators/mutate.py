"""Inserts, updates and deletes as joins of a target with a batch of changes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rejected(target: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """(id, reason) of new rows that can't go in: ids twice in the batch, or in the target already."""
    twice = new.groupBy(id_col).count().where("count > 1").select(id_col, F.lit("duplicate in batch").alias("reason"))
    there = new.select(id_col).distinct().join(target.select(id_col), id_col, "left_semi").select(id_col, F.lit("already exists").alias("reason"))
    return twice.unionByName(there)


def merged(target: DataFrame, updates: DataFrame, id_col: str, columns: Sequence[str], removed: str | None = None) -> DataFrame:
    """The target with the given columns of ``updates`` laid over it, shallowly: a nested value is replaced as a whole.

    Null in an update is no value. ``removed``, an array column of ``updates``, names columns to take away. Rows
    without an update stay; updates without a row are skipped.
    """
    u = updates.select(F.col(id_col), *(F.col(c).alias(f"__u_{c}") for c in columns), *([F.col(removed).alias("__removed")] if removed else []))
    out = target.join(u, id_col, "left")
    for c in columns:
        new = F.coalesce(f"__u_{c}", c)
        out = out.withColumn(c, F.when(F.array_contains("__removed", c), F.lit(None)).otherwise(new) if removed else new)
    return out.select(*target.columns)


def missing(requested: DataFrame, target: DataFrame, id_col: str) -> DataFrame:
    """Requested ids that the target doesn't have."""
    return requested.select(id_col).distinct().join(target.select(id_col), id_col, "left_anti")


def deleted(target: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The target without the rows of ``ids``; ids it doesn't have are skipped."""
    return target.join(ids.select(id_col).distinct(), id_col, "left_anti")


def array_changes(before, after) -> dict:
    """What an array gained and lost, each value once; null counts as empty."""
    empty = F.array().cast("array<string>")
    b, a = F.coalesce(before, empty), F.coalesce(after, empty)
    return {"added": F.array_except(a, b), "removed": F.array_except(b, a)}


def classified(before, after):
    """What an index does about a property: insert, update, delete, or skip."""
    return F.when(before.isNull() & after.isNull(), "skip").when(before.isNull(), "insert").when(after.isNull(), "delete").otherwise("update")
