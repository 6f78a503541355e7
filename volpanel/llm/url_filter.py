"""URL rules and listed URLs behind one blocked Bloom filter.

Rules and listed pages become keys: ``host/path/`` for a rule, the canonical URL for a listed page. A blocked Bloom filter over all
keys, at most ``MAX_BLOCKS`` blocks of 32 bytes whatever the number of keys, goes to every executor. A URL asks it for
the few keys that could concern it: each host suffix with the path prefix of each depth that rules have, and its own canonical form.
Only possible hits take part in the exact hash join with the keys, which removes the false positives; among the rules
that fit, the longest wins, and a URL that no rule fits is blocked if it is listed, else allowed.

The work is done once per distinct URL, so a URL that a third of all rows share costs one row; the verdicts join back by URL.

Defined cases: NULL and a URL without ``://`` have an empty host and path, fit no rule, are never listed and are allowed. Repeated rows each get
their verdict. Without rules and listed URLs everything is allowed; an empty table gives an empty table. Two rules with one
key and different actions are an error, as are rule paths that don't begin and end with ``/``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from volpanel.llm.common import spread_numbers
from volpanel.session import stage

WORDS_PER_BLOCK = 8
MAX_BLOCKS = 1 << 18  # 8 MB
BITS_PER_KEY = 16
#: One odd multiplier for each 32-bit word of a block.
SALTS = (spread_numbers(WORDS_PER_BLOCK) >> np.uint64(32)) | np.uint64(1)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` to a frame with a column ``url`` and no others of these names."""
    rest = F.expr("CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END")
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    return (
        urls.withColumn("_rest", rest)
        .withColumn("host", F.translate(host, UPPER, LOWER))
        .withColumn("path", F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1))
        .drop("_rest")
    )


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and the path without ``/`` or ``.html`` at its end, no query; empty for an empty host."""
    return F.when(host == "", "").otherwise(
        F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/|\.html)$", ""))
    )


def _bits(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block number and the eight one-bit words of each 64-bit hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    low = (h & np.uint64(0xFFFFFFFF))[:, None]
    words = np.uint64(1) << (((low * SALTS) & np.uint64(0xFFFFFFFF)) >> np.uint64(27))
    return ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64), words.astype(np.uint32)


def build_filter(keys: DataFrame) -> np.ndarray:
    """Blocked Bloom filter of the column ``key``.

    Each task fills its own filter and emits the blocks that it touched; equal blocks are joined by ``bit_or``. The result has
    at most ``MAX_BLOCKS`` rows, which is what comes to the driver.
    """
    count = keys.count()
    blocks = 1
    while blocks < MAX_BLOCKS and blocks * WORDS_PER_BLOCK * 32 < count * BITS_PER_KEY:
        blocks *= 2

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros((blocks, WORDS_PER_BLOCK), np.uint32)
        for part in parts:
            at, words = _bits(part["h"].to_numpy(), blocks)
            np.bitwise_or.at(own, at, words)
        used = np.flatnonzero(own.any(axis=1))
        yield pd.DataFrame({"block": used} | {f"w{i}": own[used, i].astype(np.int64) for i in range(WORDS_PER_BLOCK)})

    columns = [f"w{i}" for i in range(WORDS_PER_BLOCK)]
    rows = (
        keys.select(F.xxhash64("key").alias("h"))
        .mapInPandas(fill, "block long, " + ", ".join(f"{c} long" for c in columns))
        .groupBy("block").agg(*(F.bit_or(c).alias(c) for c in columns))
        .collect()
    )
    out = np.zeros((blocks, WORDS_PER_BLOCK), np.uint32)
    for row in rows:
        out[row["block"]] = row[1:]
    return out


def may_hold(spark: SparkSession, bloom: np.ndarray):
    """A function Column -> Column: may the filter hold the key with this hash?"""
    shared = spark.sparkContext.broadcast(bloom)

    @F.pandas_udf("boolean")
    def probe(hashes: pd.Series) -> pd.Series:
        table = shared.value
        at, words = _bits(hashes.to_numpy(), len(table))
        return pd.Series(((table[at] & words) == words).all(axis=1))

    return probe


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    for r in rules:
        if not (r.path.startswith("/") and r.path.endswith("/")):
            raise ValueError(f"the path of rule {r.key} must begin and end with /")
    if len({r.key for r in rules}) < len(set(rules)):
        raise ValueError("two rules have the same key and different actions")
    return spark.createDataFrame(sorted({(r.key, r.action) for r in rules}), "key string, action string")


def keys_of(host: Column, path: Column, depths: Sequence[int]) -> Column:
    """Host suffixes, each with the path prefixes that end behind ``/`` number 1 + depth."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = [F.regexp_extract(path, "^(/[^/]*){%d}/" % d, 0) for d in depths]
    found = F.filter(F.array_distinct(F.array(*prefixes)), lambda p: p != "") if prefixes else F.array().cast("array<string>")
    return F.flatten(F.transform(suffixes, lambda s: F.transform(found, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: Sequence[Rule], listed: DataFrame) -> DataFrame:
    """Columns of ``pages`` named ``page_id`` and ``url``, with ``host``, ``path``, ``rule``, ``verdict`` and ``listed``.

    ``listed`` has the canonical URLs to block in its column ``key``.
    """
    spark = pages.sparkSession
    rule_rows = rule_table(spark, rules)
    pages_listed = listed.select("key").where("key <> ''").distinct()
    keys = stage(
        rule_rows.select("key", "action", F.lit(True).alias("is_rule"))
        .unionByName(pages_listed.select("key", F.lit("block").alias("action"), F.lit(False).alias("is_rule"))),
        "url-keys",
    )
    probe = may_hold(spark, build_filter(keys.select("key")))
    urls = with_parts(pages.select("url").where(F.col("url").isNotNull()).distinct())
    depths = sorted({r.path.count("/") - 1 for r in rules})
    asked = F.concat(
        F.transform(keys_of(F.col("host"), F.col("path"), depths), lambda k: F.struct(F.lit(True).alias("is_rule"), k.alias("key"))),
        F.array(F.struct(F.lit(False).alias("is_rule"), canonical(F.col("host"), F.col("path")).alias("key"))),
    )
    possible = (
        urls.where("host <> ''").select("url", F.explode(asked).alias("a")).select("url", "a.*")
        .where(probe(F.xxhash64("key")))
    )
    # Longest rule first; a listed page counts only where no rule fits.
    rank = F.when(F.col("is_rule"), F.length("key")).otherwise(0)
    hits = (
        possible.join(keys, ["key", "is_rule"])
        .groupBy("url")
        .agg(
            F.max_by(F.when(F.col("is_rule"), F.col("key")), rank).alias("rule"),
            F.max_by("action", rank).alias("verdict"), F.bool_or(~F.col("is_rule")).alias("listed"),
        )
    )
    given = pages.select("page_id", "url")
    judged = given.join(hits, "url", "left")
    return with_parts(judged).select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )


def listed_by_host(pages: DataFrame, words: Sequence[str]) -> DataFrame:
    """Canonical URLs of the pages whose host has one of the words."""
    urls = with_parts(pages.select("url").where(F.col("url").isNotNull()).distinct())
    return urls.where(F.col("host").rlike("|".join(words))).select(canonical(F.col("host"), F.col("path")).alias("key")).distinct()
