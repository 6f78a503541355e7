"""Scoring texts and daily text indices."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.keep import union_all
from volpanel.session import small_batches, stage

POSITIVE, NEGATIVE, NEUTRAL = "POSITIVE", "NEGATIVE", "NEUTRAL"
Scorer = Callable[[list[str]], list[dict]]
_scorers: dict[str, Scorer] = {}


def _scorer(name: str, make_scorer: Callable[[], Scorer]) -> Scorer:
    """The one scorer of this kind in a Python worker; a worker runs many tasks."""
    if name not in _scorers:
        _scorers[name] = make_scorer()
    return _scorers[name]


def signed(label: Column, score: Column) -> Column:
    return F.when(label == POSITIVE, score).when(label == NEGATIVE, -score).when(label == NEUTRAL, F.lit(0.0))


def lexicon_scores(df: DataFrame, text: str, positive: Sequence[str], negative: Sequence[str]) -> DataFrame:
    """Add label, score and signed_score by counting lexicon words over the whole text, as Columns.

    The label is the side with more words; the score is the margin over all lexicon words found. One pattern
    pass finds the words of both sides; a word is a maximal run of letters.
    """
    lexicon = [w.lower() for w in (*positive, *negative)]
    if not all(w.isalpha() for w in lexicon):
        raise ValueError("lexicon words may hold letters only")
    pattern = rf"(?<!\p{{L}})(?:{'|'.join(lexicon)})(?!\p{{L}})"
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(pattern), F.lit(0))
    hits = F.size(F.filter("_words", lambda w: w.isin(lexicon[: len(positive)])))
    counted = df.withColumn("_words", words).withColumns({"_pos": hits, "_all": F.size("_words")})
    p, n = F.col("_pos"), F.col("_all") - F.col("_pos")
    label = F.when(p > n, POSITIVE).when(n > p, NEGATIVE).otherwise(NEUTRAL)
    score = F.coalesce(F.try_divide(F.abs(p - n), p + n), F.lit(0.0))
    scored = counted.withColumns({"label": label, "score": score}).drop("_words", "_pos", "_all")
    return scored.withColumn("signed_score", signed(F.col("label"), F.col("score")))


def cut_batches(lengths: Sequence[int], budget: int, most: int) -> list[list[int]]:
    """Places of texts in batches: short ones together, and each batch, padded to its longest text, within ``budget`` tokens (or one text)."""
    batches: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if not batches or len(batches[-1]) >= most or (len(batches[-1]) + 1) * lengths[i] > budget:
            batches.append([])
        batches[-1].append(i)
    return batches


def score_once(
    df: DataFrame, text: str, make_scorer: Callable[[], Scorer], batch: int = 256, window: int = 512, budget: int = 16_384,
) -> DataFrame:
    """(digest, label, score): one row for each different text of ``df``, which the model sees once however often it occurs.

    ``make_scorer`` is called once per Python worker, which runs many tasks, and returns a function from a list of texts to a list of
    ``{"label", "score"}``. It receives whole texts and reads the first ``window`` tokens of each, as its own tokenizer cuts them. Texts of like length
    go together, at most ``batch`` of them and ``budget`` tokens after padding, words standing for tokens. A NULL text isn't scored.
    The scores are staged; a worker holds 1,000 texts at most, whatever a partition has.
    """
    name = hashlib.sha256(cloudpickle.dumps(make_scorer)).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(name, make_scorer)
        for pdf in frames:
            texts = pdf["text"].tolist()
            results: list[dict] = [{}] * len(texts)
            for places in cut_batches([min(len(t.split()), window) for t in texts], budget, batch):
                for place, found in zip(places, scorer([texts[i] for i in places])):
                    results[place] = found
            yield pd.DataFrame({"digest": pdf["digest"], "label": [r["label"] for r in results], "score": [float(r["score"]) for r in results]})

    known = df.select(text_key(text).alias("digest"), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    scored = known.groupBy("digest").agg(F.first("text").alias("text")).mapInPandas(run, "digest string, label string, score double")
    with small_batches(df.sparkSession):
        return stage(scored, "scores")


def text_key(text: str) -> Column:
    return F.sha2(F.col(text).cast("binary"), 256)


def model_scores(
    df: DataFrame, text: str, make_scorer: Callable[[], Scorer], batch: int = 256, window: int = 512, budget: int = 16_384,
) -> DataFrame:
    """Add label, score and signed_score from an injected model to every row; see ``score_once``."""
    scored = score_once(df, text, make_scorer, batch, window, budget).withColumnRenamed("digest", "_digest")
    joined = df.withColumn("_key", text_key(text)).join(scored, F.col("_key") == F.col("_digest"), "left").drop("_key", "_digest")
    return joined.withColumn("signed_score", signed(F.col("label"), F.col("score")))


def daily_index(scored: DataFrame, day: Column | str = "date", keys: Sequence[str] = ()) -> DataFrame:
    """(keys…, date, sentiment_mean, share_negative, n_texts) from scored rows; rows without a day are left out."""
    when = F.to_date(F.col(day) if isinstance(day, str) else day)
    return scored.filter(when.isNotNull()).groupBy(*keys, when.alias("date")).agg(
        F.avg("signed_score").alias("sentiment_mean"),
        F.avg((F.coalesce("label", F.lit("")) == NEGATIVE).cast("double")).alias("share_negative"),
        F.count("label").alias("n_texts"),
    )


def combined_corpus(documents: DataFrame | None = None, feed: DataFrame | None = None) -> DataFrame:
    """(date, text) of meeting documents (full text) and feed items (title)."""
    frames = []
    if documents is not None:
        frames.append(documents.select(F.col("data_referencia").cast("date").alias("date"), F.col("texto").alias("text")))
    if feed is not None:
        frames.append(feed.select(F.col("date").cast("date").alias("date"), F.col("title").alias("text")))
    if not frames:
        raise FileNotFoundError("neither corpus is available")
    return union_all(frames)


def select_headlines(headlines: DataFrame, query: str, language: str = "Portuguese", require: bool = False) -> DataFrame:
    """Headlines of one query in the one language a scorer understands.

    With ``require`` an empty selection is an error: one job that stops at the first matching row.
    """
    hit = headlines.filter((F.col("query") == query) & (F.col("language") == language))
    if require and hit.isEmpty():
        raise ValueError(f"no headline in {language!r} for this query")
    return hit
