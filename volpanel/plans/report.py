"""The whole study over clean tables: read what is there, run every experiment it allows, write the results.

``tables`` maps a name to a parquet path; an experiment whose tables are missing from the map is left out.

========== =========================================================================================
bars       [series_id], date, open, high, low, close
futures    [series_id], date, ticker, settlement, open, last, low, high, contract_changed
official   date, value, tipo
tone       date (an instant), tone, query
volume     date (an instant), share_pct, query
sentiment  date, sentiment_mean
credibility date, theta_baseline, dispersion
surface    [series_id], refdate, maturity_date, delta_pct, iv_pct
========== =========================================================================================

Tables with a query column hold several series; ``queries`` names the one to use for each such table. Instants are kept and
aligned to the market's midnight.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volpanel.operators import features as W
from volpanel.operators import metrics as E
from volpanel.operators.folds import CountedFolds, StepFolds, expanding_folds
from volpanel.operators.panel import nan_to_null
from volpanel.operators.surface import atm_tenors
from volpanel.plans import datasets as D
from volpanel.plans import diagnostics as G
from volpanel.plans import experiments as P
from volpanel.plans import forecasts as C
from volpanel.session import stage
from volpanel.sources.exchange import write_csv, write_json

ONE = "one"


def _read(spark: SparkSession, path: str, time: str = "date") -> DataFrame:
    df = nan_to_null(spark.read.parquet(path))
    df = df if "series_id" in df.columns else df.withColumn("series_id", F.lit(ONE))
    return df.withColumn(time, F.to_date(time))


def _shared(spark: SparkSession, tables: Mapping[str, str], name: str, value: str, queries: Mapping[str, str]) -> DataFrame:
    """(date, value) of the one series that all bars share; several rows of a date are an error."""
    df = nan_to_null(spark.read.parquet(tables[name]))
    if "query" in df.columns:
        if name not in queries:
            raise ValueError(f"table {name!r} holds a series per query: name the one to use in queries[{name!r}]")
        df = df.filter(F.col("query") == queries[name])
    out = df.select("date", value).filter(F.col("date").isNotNull())
    twice = out.groupBy("date").count().filter("count > 1")
    if not twice.isEmpty():
        raise ValueError(f"table {name!r} has several rows for one date")
    return out


def load_bars(spark: SparkSession, tables: Mapping[str, str], source: str = "bars") -> DataFrame:
    """Bars with the range variance; futures are quoted per 1000 and close at the settlement."""
    df = _read(spark, tables[source])
    if source == "futures":
        df = df.withColumn("close", F.col("settlement") / 1000)
    return W.range_variance(df)


def ablations(
    spark: SparkSession, tables: Mapping[str, str], queries: Mapping[str, str], horizon: int = 21, source: str = "bars",
    smooth_window: int | None = 21,
) -> dict[str, P.Ablation]:
    """With and without each information layer whose table is there, over purged folds."""
    bars, folds = stage(load_bars(spark, tables, source), "bars"), CountedFolds(5, horizon, 5)
    out: dict[str, P.Ablation] = {}
    if "tone" in tables:
        tone = _shared(spark, tables, "tone", "tone", queries)
        out["news"] = P.ablation(D.base_dataset(bars, horizon, tone, "tone", smooth_window), D.NEWS, folds, name="news")
    if "volume" in tables:
        share = _shared(spark, tables, "volume", "share_pct", queries)
        level = D.base_dataset(bars, horizon, share, "share_pct", smooth_window)
        out["attention"] = P.ablation(level, D.NEWS, folds, name="attention")
        surprise = W.surprise(share.withColumn("series_id", F.lit(ONE)), "share_pct").drop("series_id")
        out["surprise"] = P.ablation(D.base_dataset(bars, horizon, surprise, "surprise"), D.NEWS, folds, name="surprise")
        if "sentiment" in tables:
            mood = _shared(spark, tables, "sentiment", "sentiment_mean", queries)
            out["fiscal"] = P.ablation(D.fiscal_dataset(bars, surprise, mood, horizon), D.FISCAL, folds, name="fiscal")
    if "credibility" in tables:
        anchored = _read(spark, tables["credibility"])
        out["credibility"] = P.ablation(D.credibility_dataset(bars, anchored, horizon), D.CREDIBILITY, folds, name="credibility")
    return out


def persistence(spark: SparkSession, tables: Mapping[str, str], horizon: int = 21, source: str = "bars") -> dict[str, DataFrame]:
    """Errors of the persistence forecast on the tested rows of the same purged folds."""
    data = D.base_dataset(load_bars(spark, tables, source), horizon)
    rows = stage(C.walk_forward(data, {"base": D.BASE}, CountedFolds(5, horizon, 5)), "persistence")
    return {
        "persistence_per_fold": E.error_metrics(rows, ["series_id", "fold"], predicted="persistence"),
        "persistence_pooled": E.error_metrics(rows, ["series_id"], predicted="persistence"),
    }


def preliminary(
    spark: SparkSession, tables: Mapping[str, str], queries: Mapping[str, str], horizon: int = 21, n_splits: int = 5, log_target: bool = False,
    smooth_window: int | None = None,
) -> P.Ablation:
    """The news layer over expanding folds without purge."""
    tone = _shared(spark, tables, "tone", "tone", queries)
    data = D.base_dataset(load_bars(spark, tables), horizon, tone, "tone", smooth_window)
    return P.ablation(data, D.NEWS, expanding_folds(n_splits), log_target, name="news")


def trading(
    spark: SparkSession, tables: Mapping[str, str], queries: Mapping[str, str], horizon: int = 21, rate: str = "venda",
    smooth_window: int | None = 21,
) -> dict[str, DataFrame]:
    """Today's signal, the backtest of the persistence forecast over the band grid, and trades with and without the attention layers.

    The signal's spot is the official rate where that table is there.
    """
    bars = stage(load_bars(spark, tables), "bars")
    vol = W.range_vol(bars, [21])
    atm = stage(atm_tenors(_read(spark, tables["surface"], "refdate"), [21]), "atm")
    data = D.base_dataset(bars, horizon)
    forecast = data.select("series_id", "date", C.persistence().alias("rv_forecast"))
    implied = P.proxy_implied(vol, atm)
    trades, summary, deflated = P.band_grid(bars.select("series_id", "date", "close"), forecast, implied, horizon=horizon)
    spot = _official(spark, tables, rate).withColumnRenamed("value", "close") if "official" in tables else bars
    out = {
        "signal": P.signal_today(vol, atm, spot), "trades": trades, "trade_summary": summary, "deflated_sharpe": deflated,
        "forecast_implied": G.paired_correlation(forecast, implied, "rv_forecast", "iv_proxy", ["series_id"]),
    }
    if "volume" in tables:
        steps = StepFolds(252, 21, horizon, 5)
        share = _shared(spark, tables, "volume", "share_pct", queries)
        level = D.base_dataset(bars, horizon, share, "share_pct", smooth_window)
        out["attention_trades"], out["attention_weights"] = P.layer_trades(level, D.NEWS, bars, implied, ["news"], steps, horizon)
        if "sentiment" in tables:
            mood = _shared(spark, tables, "sentiment", "sentiment_mean", queries)
            surprise = W.surprise(share.withColumn("series_id", F.lit(ONE)), "share_pct").drop("series_id")
            watched = [f for f in D.FISCAL if f not in D.BASE]
            out["layer_trades"], out["layer_weights"] = P.layer_trades(
                D.fiscal_dataset(bars, surprise, mood, horizon), D.FISCAL, bars, implied, watched, steps, horizon
            )
    return out


def _official(spark: SparkSession, tables: Mapping[str, str], rate: str) -> DataFrame:
    return _read(spark, tables["official"]).filter(F.col("tipo") == rate).select("date", "value")


def diagnostics(spark: SparkSession, tables: Mapping[str, str], rate: str = "venda") -> dict[str, DataFrame]:
    """Sample, bar quality, memory, alignment of both sources against the official rate, skewness against anchoring."""
    out: dict[str, DataFrame] = {}
    official = _official(spark, tables, rate) if "official" in tables else None
    if "bars" in tables:
        bars = stage(load_bars(spark, tables), "bars")
        if official is not None:
            out["lead_lag_bars"] = G.lead_lag(W.roll_free_returns(bars.withColumn("contract_changed", F.lit(False)), "close"), official)
        out["bar_quality"] = G.bar_quality(bars)
        out["bars_acf"] = E.autocorrelation(bars, "variance")
        out["bars_sweep"] = P.horizon_sweep(bars)
        out["bars_volatility"] = G.volatility_profile(W.range_vol(bars, [21]), "range_vol_21")
    if "futures" in tables:
        futures = stage(load_bars(spark, tables, "futures"), "futures")
        returns = W.roll_free_returns(futures)
        out["sample"] = G.sample_profile(futures)
        out["futures_quality"] = G.bar_quality(futures)
        out["futures_acf"] = E.autocorrelation(futures, "variance")
        out["futures_sweep"] = P.horizon_sweep(futures)
        out["futures_volatility"] = G.volatility_profile(W.range_vol(futures, [21]), "range_vol_21")
        if official is not None:
            out["lead_lag"] = G.lead_lag(returns, official)
        if "credibility" in tables:
            out["skew_theta"] = P.skew_against_theta(returns, _read(spark, tables["credibility"]))
        if "bars" in tables:
            both = [W.range_vol(x, [21]) for x in (futures, bars)]
            out["volatility_correlation"] = G.paired_correlation(
                both[0], both[1].withColumnRenamed("range_vol_21", "other"), "range_vol_21", "other"
            )
    return out


def write_study(
    spark: SparkSession, tables: Mapping[str, str], folder: str, queries: Mapping[str, str], horizon: int = 21
) -> list[str]:
    """Run all parts; metrics go to ``<folder>/<block>`` as JSON lines, trades as CSV. Returns the block names."""
    blocks: dict[str, DataFrame] = {}
    for name, a in ablations(spark, tables, queries, horizon).items():
        blocks |= {f"{name}_per_fold": a.per_fold, f"{name}_mean": a.mean, f"{name}_pooled": a.pooled, f"{name}_verdict": a.verdict}
    if "bars" in tables:
        blocks |= persistence(spark, tables, horizon)
    if "surface" in tables:
        blocks |= trading(spark, tables, queries, horizon)
    blocks |= diagnostics(spark, tables)
    for name, df in blocks.items():
        (write_csv if name == "trades" else write_json)(df, f"{folder}/{name}")
    return list(blocks)
