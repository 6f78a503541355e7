"""Small helpers that several corpus operators share."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from volpanel.session import small_batches as small_batches

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores behind it until no column of ``df`` has that name (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the caller sets to fit the size of the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(doc_id: Column | str, folds: int) -> Column:
    """crc32 of the decimal text of an id, modulo ``folds``; a NULL id counts as the empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text's UTF-8 bytes as 32 bytes; NULL counts as the empty text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def row_key(columns: Sequence[Column]) -> Column:
    """Uniform number in [0, 1) that depends on the given values alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("\u0001", *columns)), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps a public vocabulary file; tasks find it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def spread_numbers(n: int) -> np.ndarray:
    """n fixed well-spread 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files as soon as they end; for tables that are staged once and never computed again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs now and not when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
