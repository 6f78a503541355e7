"""Landed files as streams: keep-latest upsert, daily share with late data, dedup on arrival.

Each job reads what has landed, once (``availableNow``), and leaves its progress in a checkpoint folder, so
it can be scheduled daily or left running with another trigger. Sinks are written per micro-batch. A table keeps the number of the
last batch merged into it, per stream, so a batch that is delivered again changes nothing, be it the last one or an older one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from volpanel.operators.keep import PART, hash_part, last_applied, mark_applied, upsert_table


def landed_files(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int = 1000, **options
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**options).load(path)


def _start(stream: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(each).trigger(availableNow=True).start()


def merged_once(table: str, checkpoint: str, merge: Callable[[DataFrame], object]) -> Callable[[DataFrame, int], None]:
    """``merge`` for batches with a higher number than the last one that this checkpoint's stream merged into the table."""
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, number: int) -> None:
        if number > last_applied(batch.sparkSession, table, source):
            merge(batch)
            mark_applied(batch.sparkSession, table, source, number)

    return each


def _into_days(table: str, checkpoint: str) -> Callable[[DataFrame, int], None]:
    def merge(batch: DataFrame) -> None:
        upsert_table(batch.withColumn("month", F.year("date") * 100 + F.month("date")), table, ["date"], "date", partition_by=["month"])

    return merged_once(table, checkpoint, merge)


def upsert_stream(
    stream: DataFrame, table: str, checkpoint: str, keys: Sequence[str], time: str = "date", keep: str = "last",
    partition_by: Sequence[str] = (), parse: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Merge every micro-batch into the parquet table; ``parse`` turns landed documents into rows first.

    A batch reads and replaces the partitions it touches; without ``partition_by`` these are hash partitions of the key in
    the column ``_part``.
    """

    def merge(batch: DataFrame) -> None:
        rows = parse(batch) if parse else batch
        if not partition_by:
            rows = rows.withColumn(PART, hash_part(keys))
        upsert_table(rows, table, keys, time, keep, partition_by or [PART])

    return _start(stream, checkpoint, "append", merged_once(table, checkpoint, merge))


def daily_share_stream(
    stream: DataFrame, table: str, checkpoint: str, ts: str, hit: Column, late: str = "2 days"
) -> StreamingQuery:
    """(date, hits, total, share_pct) per day; a late row corrects its day for as long as the watermark allows.

    Changed days come out of every micro-batch and replace their row in the table.
    """
    daily = (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("_w"))
        .agg(F.count_if(hit).alias("hits"), F.count(F.lit(1)).alias("total"))
        .select(F.to_date("_w.start").alias("date"), "hits", "total", (F.try_divide("hits", "total") * 100).alias("share_pct"))
    )
    return _start(daily, checkpoint, "update", _into_days(table, checkpoint))


def daily_index_stream(stream: DataFrame, table: str, checkpoint: str, ts: str, late: str = "2 days") -> StreamingQuery:
    """Daily text index of scored rows (label, signed_score), corrected by late rows."""
    negative = (F.coalesce("label", F.lit("")) == "NEGATIVE").cast("double")
    daily = (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, "1 day").alias("_w"))
        .agg(F.avg("signed_score").alias("sentiment_mean"), F.avg(negative).alias("share_negative"), F.count("label").alias("n_texts"))
        .select(F.to_date("_w.start").alias("date"), "sentiment_mean", "share_negative", "n_texts")
    )
    return _start(daily, checkpoint, "update", _into_days(table, checkpoint))


def first_arrivals(stream: DataFrame, keys: Sequence[str], ts: str, within: str = "7 days") -> DataFrame:
    """Drop repeats of a key that arrive within the watermark delay; state is dropped with it."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark(list(keys))


def append_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once parquet sink."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.option("path", table).trigger(availableNow=True).start()


def finish(query: StreamingQuery) -> None:
    """Wait for a run over what has landed; a failed batch raises here."""
    query.awaitTermination()
