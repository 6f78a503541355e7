"""Grids of datasets, folds and feature sets as single jobs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions import market as M
from volpanel.functions.small_stats import pearson_p
from volpanel.operators import features as W
from volpanel.operators import metrics as E
from volpanel.operators import trades as B
from volpanel.operators.asof import asof_point, asof_shared
from volpanel.operators.folds import CountedFolds, Scheme, StepFolds
from volpanel.operators.panel import SERIES, number_rows
from volpanel.operators.regression import coefficient_column, fit_folds, predict_folds
from volpanel.plans import datasets as D
from volpanel.plans.forecasts import walk_forward
from volpanel.session import stage

SWEEP = (1, 3, 5, 10, 15, 21)
BANDS = (0.5, 1.0, 1.5, 2.0)


@dataclass(frozen=True)
class Ablation:
    """Forecast quality with and without a layer: per fold, mean over folds, pooled, and the verdict."""

    predictions: DataFrame
    per_fold: DataFrame
    mean: DataFrame
    pooled: DataFrame
    verdict: DataFrame


def ablation(
    dataset: DataFrame, layer: Sequence[str], scheme: Scheme, log_target: bool = True,
    base: Sequence[str] = D.BASE, name: str = "layer", keys: Sequence[str] = SERIES,
) -> Ablation:
    """Both feature sets on the same folds and rows; one fit serves both, and its forecasts all the metrics."""
    sets: Mapping[str, Sequence[str]] = {"base": base, name: layer}
    rows = stage(walk_forward(dataset, sets, scheme, log_target, keys), "predictions")
    if rows.isEmpty():
        raise ValueError("no valid fold: the dataset is too small for this scheme")
    per_fold = E.error_metrics(rows, [*keys, "config", "fold"])
    pooled = E.error_metrics(rows, [*keys, "config"])
    return Ablation(
        rows, per_fold, E.mean_over_folds(per_fold, [*keys, "config"]), pooled,
        E.verdict(pooled, per_fold, "base", name, keys),
    )


def horizon_sweep(
    bars: DataFrame, horizons: Sequence[int] = SWEEP, n_splits: int = 5, embargo: int = 5, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Pooled metrics of the fitted model and of persistence per series and horizon, on the same tested rows.

    Labels of all horizons come from one window pass; the horizon then is a key column.
    """
    wide = W.har_features(bars, horizons=horizons, keys=keys)
    labels = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("target")) for h in horizons])
    long = wide.select(*keys, "date", *D.BASE, F.explode(labels).alias("_l")).select("*", "_l.*").drop("_l")
    by = [*keys, "horizon"]
    data = D.supervised(long, D.BASE, by)
    scheme = CountedFolds(n_splits, horizon="horizon", embargo=embargo)
    rows = walk_forward(data, {"har": D.BASE}, scheme, True, by)
    kinds = F.array(
        F.struct(F.lit("har").alias("model"), F.col("rv_forecast").alias("predicted")),
        F.struct(F.lit("persistence").alias("model"), F.col("persistence").alias("predicted")),
    )
    both = rows.select(*by, "target", F.explode(kinds).alias("_k")).select(*by, "target", "_k.*")
    return E.error_metrics(both, [*by, "model"], predicted="predicted")


def skew_against_theta(
    returns: DataFrame, theta: DataFrame, horizons: Sequence[int] = (10, 21, 42), keys: Sequence[str] = SERIES
) -> DataFrame:
    """Correlation of forward skewness with the anchoring score per horizon: all windows, and only windows that
    share no return."""
    skewed = W.forward_skew(returns.select(*keys, "date", "ret"), "ret", horizons, keys)
    aligned = asof_shared(skewed, theta.select("date", F.col("theta_baseline").alias("theta")))
    labels = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"skew_{h}").alias("skew")) for h in horizons])
    long = aligned.select(*keys, "date", "theta", F.explode(labels).alias("_l")).select(*keys, "date", "theta", "_l.*")
    by = [*keys, "horizon"]
    rows = number_rows(long.dropna("any", subset=["theta", "skew"]), by)
    alone = F.col("rn") % F.col("horizon") == 0
    t, s = F.col("theta"), F.col("skew")
    out = rows.groupBy(*by).agg(
        F.avg("skew").alias("skew_mean"), F.count(F.lit(1)).alias("n_overlapping"), E.pair_correlation(t, s).alias("r_overlapping"),
        F.count_if(alone).alias("n_independent"),
        E.pair_correlation(F.when(alone, t), F.when(alone, s)).alias("r_independent"),
    )
    return out.withColumns(
        {
            "p_overlapping": pearson_p(F.col("r_overlapping"), F.col("n_overlapping")),
            "p_independent": pearson_p(F.col("r_independent"), F.col("n_independent")),
        }
    )


def proxy_implied(
    trailing: DataFrame, surface_atm: DataFrame, keys: Sequence[str] = SERIES, rv: str = "range_vol_21"
) -> DataFrame:
    """(keys, date, iv_proxy): trailing volatility times the IV/RV ratio on the latest quoted date."""
    newest = E.newest_row(surface_atm, ["iv_atm_pct"], keys, "refdate")
    trailing = stage(trailing.select(*keys, "date", rv).dropna("any", subset=[rv]), "trailing")
    known = asof_point(trailing, rv, newest, "refdate", keys)
    ratio = known.join(newest.select(*keys, "iv_atm_pct"), list(keys)).select(
        *keys, M.risk_premium(F.col("iv_atm_pct"), F.col(rv)).alias("_premium")
    )
    return trailing.join(ratio, list(keys)).select(*keys, "date", (F.col(rv) * F.col("_premium")).alias("iv_proxy"))


def band_grid(
    prices: DataFrame, forecast: DataFrame, implied: DataFrame, bands: Sequence[float] = BANDS, chosen: float = 1.0,
    horizon: int = 21, keys: Sequence[str] = SERIES,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trades, summary per band, deflated Sharpe of the chosen band)."""
    trades = stage(B.run_backtest(prices, forecast, implied, horizon, bands, keys=keys), "trades")
    grid = prices.select(*keys).distinct().withColumn("band_pct", F.explode(F.array(*[F.lit(float(b)) for b in bands])))
    summary = B.summarize(trades, grid, horizon, [*keys, "band_pct"])
    return trades, summary, B.deflated_sharpe(summary, chosen, keys)


def signal_today(
    realized: DataFrame, surface_atm: DataFrame, spot: DataFrame, rv: str = "range_vol_21", price: str = "close",
    band: float = 1.0, target_vega: float = 1000.0, days: int = 21, keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Latest realized and implied volatility, the signal between them and the straddle count.

    ``spot`` without the keys is one rate for all series, such as an official one.
    """
    known = realized.filter(F.col(rv).isNotNull())
    out = E.newest_row(known, [rv], keys).join(E.newest_row(surface_atm, ["iv_atm_pct"], keys, "refdate"), list(keys))
    if all(k in spot.columns for k in keys):
        out = out.join(E.newest_row(spot, [price], keys).withColumnRenamed("date", "spot_date"), list(keys))
    else:
        one = E.newest_row(spot.withColumn("_all", F.lit(0)), [price], ["_all"]).withColumnRenamed("date", "spot_date")
        out = out.withColumn("_all", F.lit(0)).join(one, "_all").drop("_all")
    return out.withColumns(
        {
            "signal": M.dead_band_signal(F.col(rv), F.col("iv_atm_pct"), band),
            "n_straddles": M.straddle_contracts(target_vega, F.col(price), days, F.col("iv_atm_pct")),
        }
    )


def layer_trades(
    dataset: DataFrame, layer: Sequence[str], prices: DataFrame, implied: DataFrame, watched: Sequence[str],
    scheme: Scheme = StepFolds(252, 21, 21, 5), horizon: int = 21, band: float = 1.0, keys: Sequence[str] = SERIES, weights: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """(trade summary with and without the layer on the same folds, coefficient weights of the layer).

    The fit is written for its second reader only if the weights are asked for.
    """
    sets = {"base": D.BASE, "layer": layer}
    names = sorted({f for fs in sets.values() for f in fs})
    data = stage(dataset, "dataset")
    coefs = fit_folds(data, sets, scheme, log_target=True, keys=keys)
    coefs = stage(coefs, "coefs") if weights else coefs
    rows = predict_folds(data, coefs, sets, scheme, True, keys)
    trades = B.run_backtest(prices, rows, implied, horizon, [band], keys=keys, extra=["config"])
    by = [*keys, "config", "band_pct"]
    grid = data.select(*keys).distinct().withColumns(
        {"config": F.explode(F.array(*[F.lit(c) for c in sets])), "band_pct": F.lit(float(band))}
    )
    summary = B.summarize(trades, grid, horizon, by)
    if not weights:
        return summary, None
    layer_only = coefs.filter(F.col("config") == "layer")
    watched_pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), coefficient_column(coefs, names, f).alias("coef")) for f in watched]
    )
    long = layer_only.select(*keys, F.explode(watched_pairs).alias("_w")).select(*keys, "_w.*")
    return summary, E.coefficient_spread(long, [*keys, "feature"])
