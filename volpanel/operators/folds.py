"""Walk-forward folds as arithmetic on row numbers: nothing is copied and nothing is range-joined.

A numbered dataset carries ``rn`` (0-based) and ``n`` per series. A scheme says, per row, which fold tests
it and which is the first fold that trains on it; train sets are nested, so later folds train on it too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.panel import SERIES


def _div(a: Column, b: Column | int) -> Column:
    return F.floor(a / b).cast("long")


def _purge(horizon: int | str, embargo: int) -> Column:
    """Rows between train and test; a horizon given by name is a key column of the dataset."""
    h = F.col(horizon) if isinstance(horizon, str) else F.lit(horizon)
    return h.cast("long") + embargo


@dataclass(frozen=True)
class CountedFolds:
    """``n_splits`` equal test blocks after an expanding train set that stops ``purge`` rows earlier.

    The remainder rows behind the last block are never tested. Folds with an empty train set are skipped.
    """

    n_splits: int = 5
    horizon: int | str = 0
    embargo: int = 0

    @property
    def purge(self) -> Column:
        return _purge(self.horizon, self.embargo)

    def size(self, n: Column) -> Column:
        fs = _div(n, self.n_splits + 1)
        message = F.lit(f"dataset too small for {self.n_splits} folds")
        return F.when(fs < 1, F.raise_error(message).cast("long")).otherwise(fs)

    def test_fold(self, rn: Column, n: Column) -> Column:
        fs = self.size(n)
        i = _div(rn, fs)
        return F.when((i >= 1) & (i <= self.n_splits) & (fs * i > self.purge), i)

    def first_train_fold(self, rn: Column, n: Column) -> Column:
        i = F.greatest(_div(rn + self.purge, self.size(n)) + 1, F.lit(1).cast("long"))
        return F.when(i <= self.n_splits, i)

    def bounds(self, n: Column) -> Column:
        fs = self.size(n)
        every = F.transform(
            F.sequence(F.lit(1).cast("long"), F.lit(self.n_splits).cast("long")),
            lambda i: F.struct(
                i.alias("fold"),
                F.greatest(fs * i - self.purge, F.lit(0).cast("long")).alias("train_end"),
                (fs * i).alias("test_start"),
                F.least(n, fs * (i + 1)).alias("test_end"),
            ),
        )
        return F.filter(every, lambda f: f["train_end"] > 0)


def expanding_folds(n_splits: int = 5) -> CountedFolds:
    """Expanding folds without purge or embargo."""
    return CountedFolds(n_splits=n_splits)


@dataclass(frozen=True)
class StepFolds:
    """A test block of ``step`` rows after another, the first one at row ``min_train``."""

    min_train: int = 252
    step: int = 21
    horizon: int | str = 0
    embargo: int = 0

    @property
    def purge(self) -> Column:
        return _purge(self.horizon, self.embargo)

    def test_fold(self, rn: Column, n: Column) -> Column:
        i = _div(rn - self.min_train, self.step)
        return F.when((rn >= self.min_train) & (i * self.step + self.min_train > self.purge), i)

    def first_train_fold(self, rn: Column, n: Column) -> Column:
        i = F.greatest(_div(rn + self.purge - self.min_train, self.step) + 1, F.lit(0).cast("long"))
        return F.when(i * self.step + self.min_train < n, i)

    def bounds(self, n: Column) -> Column:
        last = _div(n - 1 - self.min_train, self.step)
        every = F.transform(
            F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>")),
            lambda i: F.struct(
                i.alias("fold"),
                F.greatest(i * self.step + self.min_train - self.purge, F.lit(0).cast("long")).alias("train_end"),
                (i * self.step + self.min_train).alias("test_start"),
                F.least(n, (i + 1) * self.step + self.min_train).alias("test_end"),
            ),
        )
        return F.filter(every, lambda f: f["train_end"] > 0)


@dataclass(frozen=True)
class LastShare:
    """One split: the last ``test_size`` of the rows is tested, at least one row."""

    test_size: float = 0.2

    def start(self, n: Column) -> Column:
        return n - F.greatest(F.lit(1).cast("long"), F.floor(n * F.lit(self.test_size)).cast("long"))

    def test_fold(self, rn: Column, n: Column) -> Column:
        return F.when(rn >= self.start(n), F.lit(1).cast("long"))

    def first_train_fold(self, rn: Column, n: Column) -> Column:
        return F.when(rn < self.start(n), F.lit(1).cast("long"))

    def bounds(self, n: Column) -> Column:
        return F.array(
            F.struct(
                F.lit(1).cast("long").alias("fold"), self.start(n).alias("train_end"),
                self.start(n).alias("test_start"), n.alias("test_end"),
            )
        )


Scheme = CountedFolds | StepFolds | LastShare


def fold_table(numbered: DataFrame, scheme: Scheme, keys: Sequence[str] = SERIES) -> DataFrame:
    """(keys…, n, fold, train_end, test_start, test_end): one row per fold, row-number bounds half open."""
    sizes = numbered.groupBy(*keys).agg(F.max("n").alias("n"))
    return sizes.select(*keys, "n", F.explode(scheme.bounds(F.col("n"))).alias("_f")).select(*keys, "n", "_f.*")


def assign_folds(numbered: DataFrame, scheme: Scheme) -> DataFrame:
    """Add ``test_fold`` and ``first_train_fold``; NULL where a row plays no such part."""
    rn, n = F.col("rn"), F.col("n")
    return numbered.withColumns(
        {"test_fold": scheme.test_fold(rn, n), "first_train_fold": scheme.first_train_fold(rn, n)}
    )
