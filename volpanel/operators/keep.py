"""Keyed tables: keep-first / keep-latest, upsert into history, union of corpora."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.session import stage

BATCH = "_batch"
#: A batch that touches more partitions than this is matched by a join; up to it, their values become a filter of the scan.
LISTED_PARTITIONS = 2000
#: Column and number of the hash partitions of tables whose key has no natural partition.
PART, PARTS = "_part", 64


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by column name; frames may lack columns."""
    if not frames:
        raise ValueError("no frame to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_one(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "last") -> DataFrame:
    """One row per key: the first or last in ``order`` (NULLs at the end), remaining columns break ties.

    A min/max over a struct is combined before the shuffle, so a key holding a third of the rows sends one
    row per input partition, and unlike ``dropDuplicates`` the pick does not depend on row arrival.
    """
    keys, order = list(keys), [c for c in order if c not in keys]
    rest = sorted(c for c in df.columns if c not in {*keys, *order})
    if not (order or rest):
        return df.distinct()
    ranked = F.struct(
        *[f for c in order for f in (F.col(c).isNull().alias(f"_null_{c}"), F.col(c))], *[F.col(c) for c in rest]
    )
    pick = (F.max if keep == "last" else F.min)(ranked).alias("_r")
    return df.groupBy(*keys).agg(pick).select(*[c if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def upsert(
    history: DataFrame, new: DataFrame, keys: Sequence[str], time: str = "date", keep: str = "last"
) -> DataFrame:
    """History and new rows by key: greatest time wins, between equal times the newer batch (or the older one
    with ``keep="first"``)."""
    both = union_all([history.withColumn(BATCH, F.lit(0)), new.withColumn(BATCH, F.lit(1))])
    return keep_one(both, keys, [time, BATCH], keep).drop(BATCH)


def hash_part(keys: Sequence[str], parts: int = PARTS) -> Column:
    """Partition number as a function of the key."""
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


def _touched(history: DataFrame, new: DataFrame, parts: list[str]) -> DataFrame:
    """Rows of ``history`` in the partitions of ``new``; the scan lists only those folders."""
    listed = new.select(*parts).distinct().limit(LISTED_PARTITIONS + 1).collect()
    if len(listed) > LISTED_PARTITIONS:
        return history.join(new.select(*parts).distinct(), parts, "left_semi")
    for p in parts:
        values = {r[p] for r in listed}
        known = F.col(p).isin([v for v in values if v is not None])
        history = history.filter(known | F.col(p).isNull() if None in values else known)
    return history if len(parts) == 1 else history.join(new.select(*parts).distinct(), parts, "left_semi")


def _matches(spark: SparkSession, pattern: str) -> list:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath() for f in found or []]


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Completely written versions of an unpartitioned table, oldest first."""
    done = _matches(spark, f"{path}/version=*/_SUCCESS")
    return sorted(int(p.getParent().getName().split("=")[1]) for p in done)


def _location(spark: SparkSession, path: str) -> str | None:
    versions = _versions(spark, path)
    if versions:
        return f"{path}/version={versions[-1]}"
    # Replacing single partitions leaves no success mark; their folders appear only when a write is complete.
    return path if _matches(spark, f"{path}/_SUCCESS") or _matches(spark, f"{path}/*=*") else None


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table written by ``upsert_table``: its newest complete version, or the partitioned folder itself."""
    return spark.read.parquet(_location(spark, path) or path)


def _marks(spark: SparkSession, path: str, source: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_applied/{source}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def last_applied(spark: SparkSession, path: str, source: str) -> int:
    """Number of the last batch of ``source`` that was merged into the table; -1 before the first."""
    system, folder = _marks(spark, path, source)
    return max((int(f.getPath().getName()) for f in system.listStatus(folder)), default=-1) if system.exists(folder) else -1


def mark_applied(spark: SparkSession, path: str, source: str, batch: int) -> None:
    """Notes with the table that ``batch`` of ``source`` is in it; earlier notes go."""
    system, folder = _marks(spark, path, source)
    system.create(spark._jvm.org.apache.hadoop.fs.Path(folder, str(batch))).close()
    for old in system.listStatus(folder):
        if int(old.getPath().getName()) < batch:
            system.delete(old.getPath(), False)


def upsert_table(
    new: DataFrame, path: str, keys: Sequence[str], time: str = "date", keep: str = "last",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Upsert ``new`` into the parquet table at ``path``; returns the table. The same batch again changes nothing.

    Without partitions every merge writes a new version next to the one it read, which readers go on using until
    the new one is complete; a failed merge leaves the table as it was, and the version before the last is removed.
    ``partition_by`` columns must be part of the key (or a function of it, such as ``hash_part``): then only the partitions that
    ``new`` touches are read and replaced, staged first because a path cannot be overwritten while it is read. A batch names its
    partitions in a filter of the scan, at most ``LISTED_PARTITIONS`` values.
    """
    spark, parts, where = new.sparkSession, list(partition_by), _location(new.sparkSession, path)
    if where is None:
        merged = keep_one(new, keys, [time], keep)
    else:
        new = stage(new, "batch")
        history = spark.read.schema(new.schema).parquet(where)
        if parts:
            history = _touched(history, new, parts)
        merged = upsert(history.select(*new.columns), new, keys, time, keep)
    if parts:
        merged = stage(merged, "merged") if where else merged
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
    else:
        latest = (_versions(spark, path) or [0])[-1]
        merged.write.mode("overwrite").parquet(f"{path}/version={latest + 1}")
        for old in _matches(spark, f"{path}/version={latest - 1}"):
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return read_table(spark, path)
