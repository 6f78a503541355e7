"""Evaluation: errors, hit rates, correlations, Sharpe family."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions.small_stats import EULER_MASCHERONI, binomial_p_half, normal_quantile, pearson_p
from volpanel.operators.panel import SERIES, framed


def error_metrics(
    df: DataFrame, by: Sequence[str], actual: str = "target", predicted: str = "rv_forecast"
) -> DataFrame:
    """RMSE, MAE, out-of-sample R² and count per group; R² is NULL where the actuals do not vary.

    Grouped with the fold this is the per-fold view, without it the pooled one.
    """
    e = F.col(actual) - F.col(predicted)
    pairs = df.filter(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    total = F.var_pop(actual) * F.count(F.lit(1))
    return pairs.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(
            F.min(actual) < F.max(actual), 1 - F.try_divide(F.sum(e * e), total)
        ).alias("r2_oos"),
        F.count(F.lit(1)).alias("n_obs"),
    )


def mean_over_folds(per_fold: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("rmse", "mae", "r2_oos")) -> DataFrame:
    """Plain mean over folds; a fold without a value makes the mean NULL instead of being skipped."""
    whole = lambda m: F.when(F.count(m) == F.count(F.lit(1)), F.avg(m)).alias(m)
    return per_fold.groupBy(*by).agg(*[whole(m) for m in metrics], F.count(F.lit(1)).alias("n_folds"))


def directional_hits(
    df: DataFrame, by: Sequence[str], forecast: str = "rv_forecast", actual: str = "target", reference: str = "reference",
) -> DataFrame:
    """Share of rows where forecast and actual lie on the same side of ``reference`` (equal counts as a side)."""
    f, a, r = F.col(forecast), F.col(actual), F.col(reference)
    pairs = df.filter(f.isNotNull() & a.isNotNull() & r.isNotNull())
    same = F.signum(f - r) == F.signum(a - r)
    out = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(same).alias("hits"))
    return out.withColumn("accuracy", F.try_divide(F.col("hits"), F.col("n"))).withColumn(
        "p_value", binomial_p_half(F.col("hits"), F.col("n"))
    )


def pair_correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; NULL for a constant side.

    Spark's ``corr`` raises on a constant column under ANSI rules, so the division is guarded.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    moves = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when(
        moves, F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b)))
    )


def correlations(df: DataFrame, by: Sequence[str], x: str, y: str, p_value: bool = False) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.groupBy(*by).agg(pair_correlation(F.col(x), F.col(y)).alias("r"), F.count_if(both).alias("n"))
    return out.withColumn("p_value", pearson_p(F.col("r"), F.col("n"))) if p_value else out


def autocorrelation(
    df: DataFrame, value: str, lags: Sequence[int] = (1, 2, 3, 5, 10, 15, 21), keys: Sequence[str] = SERIES,
    time: str = "date",
) -> DataFrame:
    """(keys…, lag, acf): all lags from one window and one aggregation, then unpivoted."""
    present = df.filter(F.col(value).isNotNull())
    panel = framed(present, keys, time, back=max(lags))
    lagged = panel.close(panel.df.withColumns({f"_l{k}": F.lag(value, k).over(panel.window) for k in lags}))
    wide = lagged.groupBy(*keys).agg(*[pair_correlation(F.col(value), F.col(f"_l{k}")).alias(str(k)) for k in lags])
    return wide.unpivot(list(keys), [str(k) for k in lags], "lag", "acf").withColumn("lag", F.col("lag").cast("int"))


def sharpe(returns: Column | str, periods: float) -> Column:
    """Annualised mean over sample deviation; 0.0 for identical returns, NULL below two."""
    sd = F.stddev_samp(returns)
    flat = F.min(returns) == F.max(returns)
    ratio = F.try_divide(F.avg(returns), sd) * F.lit(math.sqrt(periods))
    return F.when(F.count(returns) > 1, F.when(flat | (sd == 0), F.lit(0.0)).otherwise(ratio))


def probabilistic_sharpe_score(sr: Column, benchmark: Column, n_obs: Column, skew: Column, kurtosis: Column) -> Column:
    """z of P(true Sharpe > benchmark) = Φ(z); kurtosis of a Normal is 3. NULL where the variance term is not
    positive."""
    spread = 1 - skew * sr + (kurtosis - 1) / 4 * sr * sr
    return F.when(spread > 0, (sr - benchmark) * F.sqrt(n_obs - 1) / F.sqrt(F.greatest(spread, F.lit(0.0))))


def expected_best_sharpe(trial_sd: Column, trials: Column) -> Column:
    """Greatest Sharpe expected by chance among ``trials`` independent tries; fewer than two is an error."""
    few = F.raise_error(F.lit("at least two trials are needed")).cast("double")
    n = F.when(trials < 2, few).otherwise(trials.cast("double"))
    return trial_sd * (
        (1 - EULER_MASCHERONI) * normal_quantile(1 - 1 / n)
        + EULER_MASCHERONI * normal_quantile(1 - 1 / (n * F.lit(math.e)))
    )


def fold_wins(per_fold: DataFrame, keys: Sequence[str], base: str, other: str, metric: str = "r2_oos") -> DataFrame:
    """Folds in which ``other`` beats or trails ``base`` on ``metric``."""
    side = lambda c: F.max(F.when(F.col("config") == c, F.col(metric)))
    wide = per_fold.groupBy(*keys, "fold").agg(side(base).alias("_b"), side(other).alias("_o"))
    return wide.groupBy(*keys).agg(
        F.count_if(F.col("_o") > F.col("_b")).alias("better"),
        F.count_if(F.col("_o") < F.col("_b")).alias("worse"),
        F.count(F.lit(1)).alias("n_folds"),
    )


def verdict(pooled: DataFrame, per_fold: DataFrame, base: str, other: str, keys: Sequence[str] = SERIES) -> DataFrame:
    """Verdict codes per series: is the base forecast any good, and does the added layer help?"""
    side = lambda c: F.max(F.when(F.col("config") == c, F.col("r2_oos")))
    r2 = pooled.groupBy(*keys).agg(side(base).alias("base_r2"), side(other).alias("other_r2"))
    b, d = F.col("base_r2"), F.col("other_r2") - F.col("base_r2")
    return r2.join(fold_wins(per_fold, keys, base, other), list(keys)).select(
        *keys, "base_r2", "other_r2", d.alias("delta_r2"), "better", "worse", "n_folds",
        F.when(b < 0, "none").when(b < 0.10, "weak").otherwise("fair").alias("forecast_verdict"),
        F.when((d > 0.02) & (F.col("better") > F.col("worse")), "helps")
        .when(d > 0, "inconsistent").otherwise("no help").alias("layer_verdict"),
    )


def coefficient_spread(coefs: DataFrame, by: Sequence[str], value: str = "coef") -> DataFrame:
    """Mean and population deviation of a coefficient over folds, NULLs skipped."""
    return coefs.groupBy(*by).agg(
        F.avg(value).alias("coef_mean"), F.stddev_pop(value).alias("coef_sd"), F.count(value).alias("n_folds")
    )


def newest_row(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = SERIES, time: str = "date") -> DataFrame:
    """Latest row per series by partial aggregation, no sort."""
    newest = F.max_by(F.struct(time, *columns), time).alias("_r")
    return df.groupBy(*keys).agg(newest).select(*keys, "_r.*")
