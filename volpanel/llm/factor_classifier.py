"""Quality scores by a factorisation machine.

A text becomes a sparse vector: one entry per hashed lower-cased word with weight log(1 + times), scaled to length 1, and a block of structure
statistics (shares of symbols, capitals, digits, repeated and distinct words, line and word lengths) and of metadata (length). Its score is

    sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2))

where the last sum has all pairs of entries in time linear in their number. Language, source, ids and labels are no inputs of a score.

The machine is fitted by AdaGrad in one task on at most ``Fit.rows`` labelled rows, those with the smallest hash of their id, which is the documented bound;
every document is then scored where it lies, with no shuffle of texts. The model (some megabytes, a fixed size) is written to the shared
folder and broadcast.

Defined cases: NULL and empty texts have the structure block of zeros alone; a NULL label or id is no training row; several labels for one id count as
several rows; without training rows every score is the share 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from volpanel.llm.common import remainder
from volpanel.session import stage

BUCKETS = 1 << 16
SYMBOLS = "#*$%&|<>!@^~_=+{}[]\\/"
LETTER_CASE = re.compile("[A-Z]")
DIGIT = re.compile("[0-9]")
STRUCTURE = (
    "symbols", "capitals", "digits", "distinct", "same_as_before", "repeated_pairs", "repeated_lines", "word_length", "line_words", "length",
    "ends", "shortness", "commonest",
)
KEPT_WORDS = 300_000
_bucket_of: dict[bytes, int] = {}


@dataclass(frozen=True)
class Fit:
    rows: int = 6000
    factors: int = 4
    epochs: int = 12
    batch: int = 64
    rate: float = 0.08
    shrink: float = 1e-4
    seed: int = 7


def buckets(words: list[bytes]) -> np.ndarray:
    """Hash bucket of each word; a Python worker keeps the buckets of some words."""
    new = [w for w in words if w not in _bucket_of]
    if new:
        if len(_bucket_of) > KEPT_WORDS:
            _bucket_of.clear()
            new = words
        for w in new:
            _bucket_of[w] = zlib.crc32(w) % BUCKETS
    return np.fromiter(map(_bucket_of.__getitem__, words), np.int64, len(words))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values; the structure block lies behind the word buckets."""
    if not text:
        return np.empty(0, np.int64), np.empty(0)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    stats = np.zeros(len(STRUCTURE))
    at, weight = np.empty(0, np.int64), np.empty(0)
    lines = [x for x in text.split("\n") if x.strip()]
    if n:
        hashed = buckets(words)
        at, times = np.unique(hashed, return_counts=True)
        weight = np.log1p(times)
        weight /= np.sqrt(weight.dot(weight))
        chars = max(1, len(text) - text.count(" ") - text.count("\n"))
        pairs = hashed[:-1] * BUCKETS + hashed[1:]
        symbols = sum(text.count(c) for c in SYMBOLS)
        stats[:] = (
            min(1.0, symbols / n), min(1.0, 3 * len(LETTER_CASE.findall(text)) / chars), min(1.0, 5 * len(DIGIT.findall(text)) / chars), len(at) / n,
            np.count_nonzero(hashed[1:] == hashed[:-1]) / n, 1 - len(np.unique(pairs)) / max(1, len(pairs)),
            1 - len(set(lines)) / max(1, len(lines)), min(1.0, chars / n / 12), min(1.0, n / max(1, len(lines)) / 60), min(1.0, np.log10(n) / 5),
            min(1.0, 4 * sum(text.count(c) for c in ".,;:?") / n), 1 / n, times.max() / n,
        )
    return np.concatenate([at, np.arange(BUCKETS, BUCKETS + len(STRUCTURE))]), np.concatenate([weight, stats])


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    @classmethod
    def empty(cls, factors: int) -> Machine:
        size = BUCKETS + len(STRUCTURE)
        return cls(0.0, np.zeros(size, np.float32), np.zeros((size, factors), np.float32))

    def margin(self, at: np.ndarray, value: np.ndarray) -> float:
        own = self.factors[at] * value[:, None]
        total = own.sum(axis=0)
        return float(self.bias + self.linear[at].dot(value) + 0.5 * (total.dot(total) - np.square(own).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.margin(*features(text)), -30, 30))))

    def to_bytes(self) -> bytes:
        return np.float32(self.bias).tobytes() + self.linear.tobytes() + self.factors.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, factors: int) -> Machine:
        size = BUCKETS + len(STRUCTURE)
        numbers = np.frombuffer(raw, np.float32)
        return cls(float(numbers[0]), numbers[1 : 1 + size], numbers[1 + size :].reshape(size, factors))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], fit: Fit) -> Machine:
    """AdaGrad on the logistic loss, in an order that the seed fixes."""
    machine = Machine.empty(fit.factors)
    rng = np.random.default_rng(fit.seed)
    linear, factors = machine.linear.astype(float), rng.normal(0, 0.02, machine.factors.shape)
    share = np.clip(np.mean([y for *_, y in rows]), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    seen_linear, seen_factors, seen_bias = np.full(linear.shape, 1e-3), np.full(factors.shape, 1e-3), 1e-3
    for _ in range(fit.epochs):
        order = rng.permutation(len(rows))
        for begin in range(0, len(order), fit.batch):
            chosen = [rows[i] for i in order[begin : begin + fit.batch]]
            at = np.concatenate([r[0] for r in chosen])
            value = np.concatenate([r[1] for r in chosen])
            owner = np.repeat(np.arange(len(chosen)), [len(r[0]) for r in chosen])
            own = factors[at] * value[:, None]
            total = np.stack([np.bincount(owner, own[:, f], len(chosen)) for f in range(fit.factors)], axis=1)
            margin = bias + np.bincount(owner, linear[at] * value, len(chosen)) + 0.5 * (
                np.square(total).sum(axis=1) - np.bincount(owner, np.square(own).sum(axis=1), len(chosen))
            )
            error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.array([r[2] for r in chosen])
            used, place = np.unique(at, return_inverse=True)
            pull = error[owner] * value / len(chosen)
            step = np.bincount(place, pull, len(used)) + fit.shrink * linear[used]
            seen_linear[used] += step**2
            linear[used] -= fit.rate * step / np.sqrt(seen_linear[used])
            for f in range(fit.factors):
                step = np.bincount(place, pull * (total[owner, f] - own[:, f]), len(used)) + fit.shrink * factors[used, f]
                seen_factors[used, f] += step**2
                factors[used, f] -= fit.rate * step / np.sqrt(seen_factors[used, f])
            step = float(error.mean())
            seen_bias += step**2
            bias -= fit.rate * step / np.sqrt(seen_bias)
    return Machine(bias, linear.astype(np.float32), factors.astype(np.float32))


def training_rows(docs: DataFrame, labels: DataFrame, folds: int, held: int, fit: Fit) -> DataFrame:
    """text and label of at most ``fit.rows`` rows outside the held-out fold, by the smallest hash of their id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).where(remainder("doc_id", folds) != held)
    chosen = usable.select("doc_id", F.col("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(fit.rows)
    picked = stage(chosen, "labels").withColumnRenamed("doc_id", "labelled")
    return docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("labelled")).select("doc_id", "label", "text")


def fitted(docs: DataFrame, labels: DataFrame, folds: int, held: int, fit: Fit) -> Machine:
    def featurize(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = [features(t) for t in part["text"]]
            yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"], "at": [a for a, _ in made], "value": [v for _, v in made]})

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(np.asarray(a), np.asarray(v), y) for p in parts for a, v, y in zip(p["at"], p["value"], p["label"])]
        if rows:
            yield pd.DataFrame({"model": [train(rows, fit).to_bytes()]})

    made = training_rows(docs, labels, folds, held, fit).mapInPandas(featurize, "doc_id long, label int, at array<long>, value array<double>")
    # Bounded by fit.rows; sorted, so that the fit doesn't depend on how the rows arrive.
    model = stage(made.repartition(1).sortWithinPartitions("doc_id", "label").mapInPandas(learn, "model binary"), "machine").first()
    return Machine.from_bytes(bytes(model["model"]), fit.factors) if model else Machine.empty(fit.factors)


def score(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, cut: float = 0.3, fit: Fit = Fit()
) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, folds, held, fit))

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        machine = shared.value
        return pd.Series([machine.score(t) for t in text], dtype="float64")

    out = docs.select("doc_id", (remainder("doc_id", folds) == held).alias("held_out"), scored("text").alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))
