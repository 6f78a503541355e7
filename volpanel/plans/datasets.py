"""Supervised datasets: features known at t, label over t+1…t+h, no NULL, numbered per series.

Shared series (an index, a survey, a text index) are smoothed or differenced on their own calendar first and
only then aligned by last known label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.operators import features as W
from volpanel.operators.asof import asof_join, asof_shared_all
from volpanel.operators.panel import SERIES, number_rows
from volpanel.session import stage

BASE = W.HAR
NEWS = (*BASE, "news")
OVERNIGHT = (*BASE, "overnight")
SIGNED = ("rv_d_pos", "rv_d_neg", "rv_w", "rv_m")
GLOBAL_RISK = (*BASE, "vix_level", "vix_change", "dxy_return")
CREDIBILITY = (*BASE, "theta_baseline", "dispersion")
FISCAL = (*BASE, "fiscal_surprise", "fiscal_sentiment")


def supervised(df: DataFrame, features: Sequence[str], keys: Sequence[str] = SERIES, carry: Sequence[str] = ()) -> DataFrame:
    """Rows with every feature and the target present, numbered (``rn``, ``n``) in date order."""
    used = [*dict.fromkeys([*features, "target"])]
    return number_rows(df.select(*keys, "date", *used, *carry).dropna("any", subset=used), keys)


def _labelled(bars: DataFrame, horizon: int, keys: Sequence[str]) -> DataFrame:
    return W.har_features(bars, horizons=[horizon], keys=keys).withColumnRenamed(f"target_{horizon}", "target")


def _aligned(left: DataFrame, rights: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """As-of join of several right series; the left side is staged once if any of them is shared."""
    shared = [not all(k in r.columns for k in keys) for r in rights]
    left = stage(left, "labelled") if all(shared) and shared else left
    for right in (r for r, alone in zip(rights, shared) if not alone):
        left = asof_join(left, right, keys)
    together = [r for r, alone in zip(rights, shared) if alone]
    return asof_shared_all(left, together, staged=len(together) == len(rights)) if together else left


def _smoothed(series: DataFrame, value: str, window: int | None, keys: Sequence[str], to: str) -> DataFrame:
    own = [k for k in keys if k in series.columns]
    named = series.select(*own, "date", F.col(value).alias(to))
    return W.smooth(named, to, window, own) if window else named


def base_dataset(
    bars: DataFrame, horizon: int = 21, news: DataFrame | None = None, news_value: str = "news",
    smooth_window: int | None = None, keys: Sequence[str] = SERIES,
) -> DataFrame:
    """rv_d, rv_w, rv_m (and ``news``) with the label; ``bars`` carries ``variance``."""
    out = _labelled(bars, horizon, keys)
    if news is None:
        return supervised(out, BASE, keys)
    return supervised(_aligned(out, [_smoothed(news, news_value, smooth_window, keys, "news")], keys), NEWS, keys)


def extended_dataset(bars: DataFrame, horizon: int = 21, keys: Sequence[str] = SERIES) -> DataFrame:
    """Base plus overnight gap variance and variance by sign of the return."""
    out = W.gap_and_sign(_labelled(bars, horizon, keys), keys=keys)
    return supervised(out, [*OVERNIGHT, "rv_d_pos", "rv_d_neg"], keys)


def global_risk_dataset(
    bars: DataFrame, risk: DataFrame, horizon: int = 21, level: str = "vix_close", index: str = "dxy_close",
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Base plus level, change and log return of an exogenous pair, computed on the pair's calendar."""
    changes = W.exogenous_changes(risk.select("date", level, index), level, index)
    changes = changes.select("date", "vix_level", "vix_change", "dxy_return")
    return supervised(_aligned(_labelled(bars, horizon, keys), [changes], keys), GLOBAL_RISK, keys)


def credibility_dataset(bars: DataFrame, anchored: DataFrame, horizon: int = 21, keys: Sequence[str] = SERIES) -> DataFrame:
    """Base plus anchoring score and survey dispersion."""
    right = anchored.select("date", "theta_baseline", "dispersion")
    return supervised(_aligned(_labelled(bars, horizon, keys), [right], keys), CREDIBILITY, keys)


def fiscal_dataset(
    bars: DataFrame, attention: DataFrame, sentiment: DataFrame, horizon: int = 21, smooth_window: int | None = 5,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Base plus attention surprise and smoothed text sentiment, each aligned on its own."""
    surprise = attention.select("date", F.col("surprise").alias("fiscal_surprise"))
    mood = _smoothed(sentiment, "sentiment_mean", smooth_window, keys, "fiscal_sentiment")
    return supervised(_aligned(_labelled(bars, horizon, keys), [surprise, mood], keys), FISCAL, keys)
