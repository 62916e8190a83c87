"""Vectors to try things on: random ones, and stored ones brought to length 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import normalised


def random_vectors(spark: SparkSession, n: int, size: int, seed: int = 0) -> DataFrame:
    """``n`` rows of ``id`` and a ``vector`` of ``size`` numbers from 0 to 1, made on the executors and repeatable."""
    rows = spark.range(n)
    # a hash of row, place and seed, so that a lost partition comes back the same
    value = lambda i: (F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(1 << 24)) / float(1 << 24)).cast("float")
    return rows.select("id", F.transform(F.sequence(F.lit(1), F.lit(size)), value).alias("vector"))


def load_vectors(spark: SparkSession, path: str, vec_col: str = "vector", unit: bool = False) -> DataFrame:
    """A Parquet table of vectors, normalised for angular distances where ``unit`` is set."""
    df = spark.read.parquet(path)
    return df.withColumn(vec_col, normalised(F.col(vec_col))) if unit else df
