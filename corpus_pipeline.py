"""A corpus pipeline: quality, near copies, benchmark passages, secrets, packing. Each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonda.llm import decontaminate, jaccard, packing, quality, secrets
from sonda.llm.common import release, staged
from sonda.llm.queries import table, tokenizer

#: Documents that score below this are rejected; the classifier was fitted with the same rule as the query of the operator.
LEAST_SCORE = 0.7


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of this stage's input, rejects go."""
    return quality.kept(docs, quality.fitted(docs, table(spark, sf_dir, "labels")), LEAST_SCORE)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with a shingle similarity of 0.8 or more, the one of the least id stays."""
    return jaccard.without_near_copies(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which windows of two items occur (the rule of op10), or a full window of one."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"), action="document")


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows."""
    clean = secrets.redacted(docs, secrets.fitted(docs))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else clean


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, packed into sequences of 2048."""
    got = packing.pack_documents(docs, tokenizer("byte_bpe_50k.json"), with_ids=False)
    return got.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_copies", near_copies),
    ("benchmark_passages", benchmark_passages),
    ("secret_spans", secret_spans),
    ("packed_sequences", packed_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, name)
            release(before)
    return docs
