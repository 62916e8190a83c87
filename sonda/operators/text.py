"""Full-text ranking by TF-IDF.

Counts of documents are of the whole collection, whatever filter a query has. A collection stores its postings, and
``from_postings`` reads those of a query's terms. Over a plain frame (``scored``) a text is cut into terms only where it
shows one of the query's terms as a string of its own, which few do; one small aggregate gives the document frequencies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import cut, terms, tokens


def postings(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, term, tf): how often each term occurs in each document."""
    return df.select(F.col(id_col), F.explode(tokens(text)).alias("term")).groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def frequencies(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(term, df): in how many documents each term occurs."""
    return df.select(F.explode(F.array_distinct(tokens(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def lengths(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(id, length) of documents with terms."""
    return df.select(F.col(id_col), F.size(tokens(text)).alias("length")).where("length > 0")


#: Whether a text has terms is mostly seen from so many characters of it; the whole is looked at where it isn't.
HEAD = 256


def _count(ts: Column, word: str) -> Column:
    return F.size(F.filter(ts, lambda t: t == word))


def _may_have(lower: Column, word: str) -> Column:
    """What a text with the term must show, without cutting it into terms: the string, and somewhere no letter on either side."""
    inside = r"[\p{L}\p{M}\p{N}_]"
    alone = rf"\Q{word}\E(?!{inside})(?<!{inside}\Q{word}\E)"
    return F.contains(lower, F.lit(word)) & F.rlike(lower, F.lit(alone))


def _total(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def _fits(conditions: list[Column], every: bool) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c if every else out | c
    return out


def _score(n: int, length: str, documents: Column, frequency) -> Column:
    """The sum over terms ``tf0`` and so on: tf / length * log10(N / (df + 1))."""
    return _total([F.when(F.col(f"tf{i}") > 0, F.col(f"tf{i}") / F.col(length) * F.log10(documents / (frequency(i) + 1))).otherwise(0.0) for i in range(n)])


def scored(df: DataFrame, id_col: str, text: Column, query: str, every: bool, within: Column | None = None, restrict: DataFrame | None = None) -> DataFrame:
    """(id, score) of documents with all or any of the query's terms.

    score = sum over terms of tf / length * log10(N / (df + 1)), which may be 0 or below. ``within`` or the ids of
    ``restrict`` narrow the result, not the counts.
    """
    wanted = terms(query)
    base = df.withColumn("__text", text).where("__text is not null")
    if not wanted:
        return base.where("false").select(id_col, F.lit(0.0).alias("score"))
    lower = F.array(F.lower("__text"))  # of one element, so that lambdas read it and it is made once a row
    # the first of two terms of the head is whole
    counted = F.when(F.size(tokens(F.substring("__text", 1, HEAD))) > 1, True).otherwise(F.size(tokens(F.col("__text"))) > 0)
    found = F.get(F.transform(lower, lambda t: F.array(*(F.when(_may_have(t, w), F.array_contains(cut(t), w)).otherwise(False) for w in wanted))), 0)
    stats = base.select(counted.cast("long").alias("n"), found.alias("found"))
    stats = stats.agg(F.sum("n").alias("n"), *(F.sum(F.get("found", i).cast("long")).alias(f"df{i}") for i in range(len(wanted))))
    kept = base if within is None else base.where(within)
    if restrict is not None:
        kept = kept.join(restrict, id_col, "left_semi")
    kept = kept.where(F.exists(lower, lambda t: _fits([_may_have(t, w) for w in wanted], every)))

    def counts(ts: Column) -> Column:
        return F.struct(*(_count(ts, w).alias(f"tf{i}") for i, w in enumerate(wanted)), F.size(ts).alias("length"))

    # generated rows, so that the terms of a text are cut once and not again for every count and condition
    each = F.filter(F.transform(F.array(tokens(F.col("__text"))), counts), lambda m: _fits([m[f"tf{i}"] > 0 for i in range(len(wanted))], every))
    kept = kept.select(id_col, F.inline(each))
    kept = kept.withColumn("c", stats.select(F.struct("*").alias("s")).scalar())  # one row, as a scalar subquery
    return kept.select(id_col, _score(len(wanted), "length", F.col("c.n"), lambda i: F.col(f"c.df{i}")).alias("score"))


def from_postings(stored: DataFrame, id_col: str, documents: DataFrame, query: str, every: bool, restrict: DataFrame | None = None) -> DataFrame:
    """``scored`` by stored postings (id, term, tf, length); ``documents`` has one row and column, N."""
    wanted = terms(query)
    rows = stored.where(F.col("term").isin(wanted))
    if not wanted:
        return rows.select(id_col, F.lit(0.0).alias("score"))
    counts = rows.agg(*(F.count(F.when(F.col("term") == w, 1)).alias(f"df{i}") for i, w in enumerate(wanted)))
    kept = rows if restrict is None else rows.join(restrict, id_col, "left_semi")
    kept = kept.groupBy(id_col).agg(*(F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, w in enumerate(wanted)), F.max("length").alias("length"))
    kept = kept.where(_fits([F.col(f"tf{i}") > 0 for i in range(len(wanted))], every))
    kept = kept.withColumn("n", documents.scalar()).withColumn("c", counts.select(F.struct("*").alias("s")).scalar())
    return kept.select(id_col, _score(len(wanted), "length", F.col("n"), lambda i: F.col(f"c.df{i}")).alias("score"))
