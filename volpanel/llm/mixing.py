"""Sources mixed to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); a topic is the first of a list of patterns that the text has. A margin's target is the
share ``tokens ** exponent`` of each of its values, so an exponent under 1 lifts the small ones, times the tokens to keep. Each cell
starts with the same keep probability; a sweep rakes the cells to the source, the language and the topic margin in turn, multiplying
by target / current and never above 1, as no document is kept twice. Where a target is above what a margin has, all of it is kept.

Only the table of cells takes part in the sweeps: sums by margin with partial aggregation, joined back to the cells, and written once a margin so
that plans stay small (a margin reads its cells twice, a sweep in one plan eight times) and a lost executor costs one margin. A document is kept if a uniform number made from its id and text lies
under its cell's probability, so the sample is the same on every run and copies of a row share their fate.

Defined cases: NULL and empty texts have no tokens and the last topic; NULL sources and languages are values of their own; cells without
tokens keep the starting probability; repeated rows count as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from volpanel.llm.common import fresh_name, row_key
from volpanel.session import stage

WORD = r"[^\x20\x09-\x0D]+"
MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Mix:
    """How much to keep and how far each margin is evened out."""

    keep: float = 0.75
    exponents: tuple[float, float, float] = (0.7, 0.8, 0.9)
    topics: tuple[tuple[str, str], ...] = (("table", r" \| "), ("outcry", "!!"), ("figures", "[0-9]{3}"))
    other: str = "prose"
    sweeps: int = 8


def topic(text: Column, mix: Mix) -> Column:
    out = F.lit(mix.other)
    for name, pattern in reversed(mix.topics):
        out = F.when(F.coalesce(text.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cells(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per cell: its tokens, and its documents' count."""
    return (
        docs.select("source", "lang", topic(F.col("text"), mix).alias("topic"), tokens(F.col("text")).alias("n"))
        .groupBy(*MARGINS).agg(F.sum("n").cast("double").alias("tokens"), F.count("*").alias("documents"))
    )


def targets(table: DataFrame, margin: str, exponent: float, keep: float) -> DataFrame:
    """Tokens to keep for each value of a margin."""
    sums = table.groupBy(margin).agg(F.sum("tokens").alias("has"))
    whole = sums.agg(F.sum("has").alias("total"), F.sum(F.pow("has", F.lit(exponent))).alias("scale"))
    return sums.join(F.broadcast(whole)).select(  # one row
        margin, (F.lit(keep) * F.col("total") * F.try_divide(F.pow("has", F.lit(exponent)), F.col("scale"))).alias("target"),
    )


def rake(table: DataFrame, wanted: Sequence[tuple[str, DataFrame]], mix: Mix) -> DataFrame:
    """The cells with their column ``probability``."""
    out = table.withColumn("probability", F.lit(mix.keep))
    for _ in range(mix.sweeps):
        for margin, target in wanted:
            now = out.groupBy(margin).agg(F.sum(F.col("tokens") * F.col("probability")).alias("now"))
            factor = now.join(target, now[margin].eqNullSafe(target[margin])).select(
                now[margin].alias("value"), F.try_divide("target", "now").alias("factor")
            )
            out = out.join(factor, out[margin].eqNullSafe(factor["value"]), "left").select(
                *MARGINS, "tokens", "documents",
                F.least(F.lit(1.0), F.col("probability") * F.coalesce("factor", F.lit(1.0))).alias("probability"),
            )
            out = stage(out, "mix-cells")
    return out


def _fit(table: DataFrame, mix: Mix) -> DataFrame:
    table = stage(table, "mix-cells")
    wanted = [
        (margin, stage(targets(table, margin, exponent, mix.keep), "mix-targets")) for margin, exponent in zip(MARGINS, mix.exponents)
    ]
    return rake(table, wanted, mix)


def _same_cell(left: DataFrame, topic_name: str, right: DataFrame) -> Column:
    return left["source"].eqNullSafe(right["source"]) & left["lang"].eqNullSafe(right["lang"]) & (left[topic_name] == right["topic"])


def draw(doc_id: Column, text: Column) -> Column:
    return row_key([F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))])


def weigh(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every row; texts are read once."""
    told = stage(
        docs.select(
            "doc_id", "source", "lang", topic(F.col("text"), mix).alias("topic"), tokens(F.col("text")).alias("n_tokens"),
            draw(F.col("doc_id"), F.col("text")).alias("draw"),
        ),
        "mix-documents",
    )
    raked = _fit(told.groupBy(*MARGINS).agg(F.sum("n_tokens").cast("double").alias("tokens"), F.count("*").alias("documents")), mix)
    return told.join(raked, _same_cell(told, "topic", raked), "left").select(
        told["doc_id"], told["source"], told["lang"], told["topic"], "n_tokens", "probability",
        (F.col("draw") < F.col("probability")).alias("kept"),
    )


def sample(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, columns unchanged."""
    raked = _fit(cells(docs, mix), mix)
    name = fresh_name(docs, "topic")
    told = docs.withColumn(name, topic(F.col("text"), mix))
    joined = told.join(raked, _same_cell(told, name, raked), "left")
    return joined.where(draw(told["doc_id"], told["text"]) < raked["probability"]).select(*(told[c] for c in docs.columns))
