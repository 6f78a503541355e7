"""Out-of-sample forecasts over walk-forward folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions import market as M
from volpanel.operators.folds import Scheme, assign_folds
from volpanel.operators.panel import SERIES
from volpanel.operators.regression import fit_folds, predict_folds
from volpanel.session import stage


def persistence(rv_m: str = "rv_m") -> Column:
    """Forecast that volatility stays at its 22-row mean."""
    return M.annual_pct(F.col(rv_m))


def walk_forward(
    dataset: DataFrame, feature_sets: Mapping[str, Sequence[str]], scheme: Scheme, log_target: bool = True,
    keys: Sequence[str] = SERIES, staged: bool = False,
) -> DataFrame:
    """Tested rows of every feature set with ``rv_forecast`` and ``persistence``.

    The dataset feeds the fit and the prediction, so it is written once and both read the table.
    """
    data = dataset if staged else stage(dataset, "dataset")
    coefs = fit_folds(data, feature_sets, scheme, log_target=log_target, keys=keys)
    return predict_folds(data, coefs, feature_sets, scheme, log_target, keys).withColumn("persistence", persistence())


def persistence_rows(dataset: DataFrame, scheme: Scheme) -> DataFrame:
    """The tested rows with the persistence forecast in ``rv_forecast``; nothing is fitted."""
    tested = assign_folds(dataset, scheme).filter(F.col("test_fold").isNotNull())
    return tested.withColumn("rv_forecast", persistence()).withColumnRenamed("test_fold", "fold").drop("first_train_fold")


def ensemble(predictions: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean forecast over feature sets per date, NULLs skipped."""
    return predictions.groupBy(*keys, "date").agg(
        F.avg("rv_forecast").alias("rv_forecast"), F.max("target").alias("target"), F.max("fold").alias("fold")
    )


def residual_corrected(
    dataset: DataFrame, features: Sequence[str], scheme: Scheme, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Persistence plus a regression of its error, in levels, floored at zero."""
    data = stage(dataset, "dataset")
    sets = {"residual": features}
    coefs = fit_folds(data, sets, scheme, y=F.col("target") - persistence(), keys=keys)
    out = predict_folds(data, coefs, sets, scheme, keys=keys, to="_correction")
    return out.withColumn(
        "rv_forecast", F.greatest(persistence() + F.col("_correction"), F.lit(0.0))
    ).drop("_correction")
