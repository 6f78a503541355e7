"""Documents to packed training sequences: five stages, each written as Parquet and read again by the next one.

Quality rules drop documents; of each class of near copies one stays; passages that an earlier document has are cut out of the later
ones; sources are sampled to target weights; what is left is packed into sequences. Every stage sees all that the one before kept, and all
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from volpanel.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from volpanel.llm.common import DOCUMENT_COLUMNS, table, vocabulary
from volpanel.session import scratch_path, staging


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules; thresholds come from these documents alone."""
    return quality_rules.keep_documents(docs.select(*DOCUMENT_COLUMNS))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class linked at a Jaccard similarity of 0.8 of five-word shingles."""
    return ngram_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes covered by 100-byte strings that also start earlier."""
    return suffix_dedup.cleaned(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens are raked to source, language and topic targets."""
    return mixing.sample(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 2,048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality),
    ("ngram_join", near_copies),
    ("suffix_dedup", repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

#: Near copies, repeated byte strings and tokens are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with staging(spark):  # what a stage wrote for itself goes with it
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
