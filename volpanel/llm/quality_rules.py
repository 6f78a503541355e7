"""Quality rules whose cut-offs come from the corpus itself.

Every text is measured once. Ratios of the measures of texts that pass the base rule go into one logarithmic histogram per language,
source and ratio: bucket ``floor(ln(x) / ln(GROWTH))`` with a count, and one bucket for zero. Such a sketch merges by adding counts, so Spark
builds it with a plain partial aggregation, and every quantile read from it lies within a relative error of ``(GROWTH - 1) / 2``
of the true one, whatever the order of merging.

A source is not judged by itself alone: its sketch is mixed with that of its language, and the language's with that of the corpus. A group of n
documents has the weight n / (n + PRIOR) in its mixture, at most a half, so small groups follow the coarser ones. Junk in up to a quarter of any group, or in up
to half of one that is small beside its language, leaves the upper quartile of its mixture where the others put it. A ratio's cut-off in a language and source is

    q75 + reach * (q75 - q50)

of that mixture; no fixed ratio takes part. A text of ``whole`` words, letters or lines may then hold ``e = cut * whole`` of the counted things, and
by chance ``SPREAD * sqrt(e + 1)`` more, which is what lets a short text have one or two of what most texts have none of. Mixing is done in whole
numbers (millionths of a group, thousandths of a weight), so the cut-offs are the same on every run. They join back to the measures by language and source.

Defined cases: a NULL or empty text has no words and fails the base rule; NULL languages or sources form groups of
their own; repeated rows are measured and judged row by row; an empty table gives an empty table; columns beside ``text``, ``lang``
and ``source`` pass through untouched, and measures that clash with one get an underscore.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from volpanel.llm.common import fresh_name, small_batches
from volpanel.session import stage

GROWTH = 1.02
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_lines")
MEASURED = StructType([StructField(name, LongType()) for name in MEASURES])
SYMBOLS = "#*$%&|<>"
CAPITAL = re.compile("[A-Z]")
MIN_WORDS, REPEAT_PERCENT = 10, 20
PRIOR, MOST, WHOLE = 200, 500, 1000  # documents that outweigh a group's own; the most weight of its own, of WHOLE
MASS = 1_000_000
SPREAD = 4.0


@dataclass(frozen=True)
class Ratio:
    """A ratio of two measures and how far above the upper quartile a clean text may lie, in distances from the median to that quartile."""

    name: str
    part: str
    whole: str
    reach: float = 8.0


RATIOS = (
    Ratio("symbols", "n_symbols", "n_words"),
    Ratio("capitals", "n_capitals", "word_chars"),
    Ratio("dup_lines", "n_dup_lines", "n_lines"),
)


def repeat_words(words: list[bytes]) -> int:
    """How many words lie in a five-word window that the text holds at least twice."""
    n = len(words)
    if n < 6:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0

    def join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.unique(left * (right.max() + 1) + right, return_inverse=True)[1]

    two = join(ids[:-1], ids[1:])
    four = join(two[:-2], two[2:])
    five = four[:-1] * len(number) + ids[4:]
    order = np.argsort(five, kind="stable")
    same = np.flatnonzero(five[order][1:] == five[order][:-1])
    if not len(same):
        return 0
    edge = np.zeros(n + 1, np.int64)
    starts = np.unique(np.concatenate([order[same], order[same + 1]]))
    edge[starts] += 1
    np.subtract.at(edge, starts + 5, 1)
    return int(np.count_nonzero(np.cumsum(edge)[:n]))


def measure_text(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "surrogatepass").split()
    white = sum(text.count(c) for c in " \t\n\v\f\r")
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return (
        len(words), len(text) - white, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(words),
        len(CAPITAL.findall(text)), len(lines),
    )


@F.pandas_udf(MEASURED)
def measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure_text(t) for t in text], columns=list(MEASURES), dtype="int64")


#: The same values; Spark leaves the number of calls as it is written.
measures_once = F.pandas_udf(measures.func, MEASURED).asNondeterministic()


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > REPEAT_PERCENT * n_words)


def _ratio(ratio: Ratio, m: Column) -> Column:
    return F.try_divide(m[ratio.part].cast("double"), m[ratio.whole].cast("double"))


def sketches(measured: DataFrame, m: Column, ratios: tuple[Ratio, ...] = RATIOS) -> DataFrame:
    """Histogram rows (lang, source, ratio, bucket, n) of the documents that pass the base rule; those without the ratio's whole are left out."""
    entries = F.explode(F.array(*(F.struct(F.lit(r.name).alias("ratio"), _ratio(r, m).alias("x")) for r in ratios)))
    bucket = F.when(F.col("e.x") > 0, F.floor(F.log(F.col("e.x")) / F.log(F.lit(GROWTH))).cast("int"))
    return (
        measured.where(~base_failed(m["n_words"], m["n_repeat_words"])).select("lang", "source", entries.alias("e"))
        .where(F.col("e.x").isNotNull())
        .groupBy("lang", "source", F.col("e.ratio").alias("ratio"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def merge_sketches(left: DataFrame, right: DataFrame) -> DataFrame:
    """The sketch of both inputs together, for corpora that grow by parts."""
    return left.unionByName(right).groupBy("lang", "source", "ratio", "bucket").agg(F.sum("n").alias("n"))


def _masses(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, ratio, bucket, mass, share): a group's buckets in millionths, and the weight of its own in its mixture."""
    total = F.sum("n").over(Window.partitionBy(*keys, "ratio"))
    counted = sketch.groupBy(*keys, "ratio", "bucket").agg(F.sum("n").alias("n")).withColumn("total", total)
    return counted.select(
        *keys, "ratio", "bucket", F.expr(f"n * {MASS} div total").alias("mass"),
        F.expr(f"least({MOST}, {WHOLE} * total div (total + {PRIOR}))").alias("share"),
    )


def _mixed(own: DataFrame, coarser: DataFrame, by: list[str], scale: int) -> DataFrame:
    """Each group of ``own`` mixed with the group of ``coarser`` that agrees in ``by``."""
    keys = [c for c in own.columns if c not in ("bucket", "mass", "share")]
    groups, prior = own.select(*keys, "share").distinct().alias("g"), coarser.alias("p")
    same = F.col("g.ratio") == F.col("p.ratio")
    for c in by:
        same = same & F.col(f"g.{c}").eqNullSafe(F.col(f"p.{c}"))
    from_prior = groups.join(prior, same).select(*(F.col(f"g.{c}") for c in keys), "bucket", (F.col("p.mass") * (WHOLE - F.col("share"))).alias("mass"))
    from_own = own.select(*keys, "bucket", (F.col("mass") * F.col("share") * scale).alias("mass"))
    return from_own.unionByName(from_prior).groupBy(*keys, "bucket").agg(F.sum("mass").alias("mass"))


def thresholds(sketch: DataFrame, ratios: tuple[Ratio, ...] = RATIOS) -> DataFrame:
    """One row per language and source with a column ``cut_<ratio>``; a group holds some thousand buckets at most."""
    sketch = stage(sketch, "quality-sketch")
    # The corpus has at most as many rows as a double has buckets, times the ratios.
    corpus = F.broadcast(_masses(sketch).drop("share"))
    language = _mixed(_masses(sketch, "lang"), corpus, [], 1)
    mixture = _mixed(_masses(sketch, "lang", "source"), language, ["lang"], WHOLE)
    group = Window.partitionBy("lang", "source", "ratio")
    running = group.orderBy(F.col("bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(GROWTH), F.col("bucket") + 1) / (F.lit(GROWTH) + 1))
    ranked = mixture.select(
        "lang", "source", "ratio", value.alias("value"), F.sum("mass").over(running).alias("upto"), F.sum("mass").over(group).alias("total"),
    )
    # The first bucket that reaches the wanted rank is the least value among those that do.
    quantile = {k: F.min(F.when(F.col("upto") * 4 >= F.col("total") * k, F.col("value"))) for k in (2, 3)}
    cut = F.coalesce(*(F.when(F.col("ratio") == r.name, F.col("q75") + r.reach * (F.col("q75") - F.col("q50"))) for r in ratios))
    return (
        ranked.groupBy("lang", "source", "ratio").agg(quantile[2].alias("q50"), quantile[3].alias("q75")).withColumn("cut", cut)
        .groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == r.name, F.col("cut"))).alias(f"cut_{r.name}") for r in ratios))
    )


def _passes(m: Column, cuts: DataFrame, ratios: tuple[Ratio, ...]) -> Column:
    keep = ~base_failed(m["n_words"], m["n_repeat_words"])
    for r in ratios:
        expected = cuts[f"cut_{r.name}"] * m[r.whole].cast("double")
        keep = keep & ~F.coalesce(m[r.part].cast("double") > expected + SPREAD * F.sqrt(expected + 1), F.lit(False))
    return keep


def judge(docs: DataFrame, ratios: tuple[Ratio, ...] = RATIOS) -> DataFrame:
    """doc_id, measures, ``base_failed`` and ``kept`` of every row, with one pass over the texts.

    The measures, some bytes a row, are written once; the sketch and the verdict both read that table.
    """
    measured = stage(docs.select("doc_id", "lang", "source", measures("text").alias("m")), "quality-measures")
    cuts = stage(thresholds(sketches(measured, F.col("m"), ratios), ratios), "quality-cuts")
    m = measured["m"]
    same = measured["lang"].eqNullSafe(cuts["lang"]) & measured["source"].eqNullSafe(cuts["source"])
    return measured.join(cuts, same, "left").select(
        measured["doc_id"], *(m[name].alias(name) for name in MEASURES[:5]),
        base_failed(m["n_words"], m["n_repeat_words"]).alias("base_failed"), _passes(m, cuts, ratios).alias("kept"),
    )


def keep_documents(docs: DataFrame, ratios: tuple[Ratio, ...] = RATIOS) -> DataFrame:
    """The rows of ``docs`` that pass, columns unchanged.

    The texts are measured a second time beside the small staged cut-offs, which costs less than a shuffle of all texts. Called non-deterministic,
    the measures are not computed again for the filters that Spark moves down to the scan, which takes a second Python worker for each task.
    """
    name = fresh_name(docs, "m")
    measured = docs.withColumn(name, measures_once("text"))
    with small_batches(docs.sparkSession):
        cuts = stage(thresholds(sketches(measured.select("lang", "source", F.col(name).alias("m")), F.col("m"), ratios), ratios), "quality-cuts")
    same = measured["lang"].eqNullSafe(cuts["lang"]) & measured["source"].eqNullSafe(cuts["source"])
    return measured.join(cuts, same, "left").where(_passes(measured[name], cuts, ratios)).select(*(measured[c] for c in docs.columns))
