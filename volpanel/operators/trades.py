"""Straddle backtest: candidates by joins and windows, non-overlapping choice, P&L, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions import market as M
from volpanel.functions.normal import norm_cdf
from volpanel.operators.chains import entry_states
from volpanel.operators.metrics import expected_best_sharpe, probabilistic_sharpe_score, sharpe
from volpanel.operators.options import with_option_prices
from volpanel.operators.panel import SERIES, framed
from volpanel.session import stage

TRADE_COLUMNS = (
    "entry_date", "exit_date", "signal", "rv_forecast", "iv_proxy", "n_contracts", "premium", "payoff", "cost",
    "pnl_gross", "pnl_net",
)


def candidate_trades(
    prices: DataFrame, forecast: DataFrame, implied: DataFrame, horizon: int = 21, bands: Sequence[float] = (1.0,),
    keys: Sequence[str] = SERIES, price: str = "close", extra: Sequence[str] = (),
) -> DataFrame:
    """Every day with a signal and an exit: the exit is ``horizon`` rows ahead in the price calendar.

    ``forecast`` has (keys, date, rv_forecast), ``implied`` (keys, date, iv_proxy). All bands in one pass; ``extra``
    names further key columns of the forecast (a feature set). TIMESTAMP-keyed prices are split into blocks wherever a series is long.
    """
    keys = list(keys)
    frame = framed(prices, keys, "date", ahead=horizon)
    w = frame.window
    number = F.col("rn") if frame.blocked else F.row_number().over(w).cast("long") - 1
    path = frame.close(frame.df.withColumns({
        "spot_entry": F.col(price), "entry_rn": number, "exit_date": F.lead("date", horizon).over(w), "spot_exit": F.lead(price, horizon).over(w),
    })).select(*keys, "date", "spot_entry", "entry_rn", "exit_date", "spot_exit")
    common = path.join(forecast.select(*keys, *extra, "date", "rv_forecast"), [*keys, "date"]).join(
        implied.select(*keys, "date", "iv_proxy"), [*keys, "date"]
    )
    usable = common.filter(
        F.col("rv_forecast").isNotNull() & (F.col("iv_proxy") > 0) & F.col("exit_date").isNotNull()
    )
    grid = usable.withColumn("band_pct", F.explode(F.array(*[F.lit(float(b)) for b in bands])))
    signal = M.dead_band_signal(F.col("rv_forecast"), F.col("iv_proxy"), F.col("band_pct"))
    return grid.withColumn("signal", signal).filter(F.col("signal") != M.NO_TRADE)


def pick_without_overlap(
    candidates: DataFrame, horizon: int, by: Sequence[str], block_rows: int = 2048
) -> DataFrame:
    """Go through the candidates in entry order and keep those entering on or after the last kept exit.

    A kept trade blocks the next ``horizon − 1`` rows, so whatever happened before a block of rows is summed
    up by how many of the block's first rows are still blocked, a number below ``horizon``. Pass one follows
    the greedy rule through every block for each of those possible starts (array of one block's row numbers,
    all blocks in parallel). The starts that really occur then follow from composing these maps level by level (``chains``),
    and pass two repeats the rule once per block. The result is that of the sequential rule.
    """
    by, block_rows = list(by), max(block_rows, horizon)
    candidates = stage(candidates, "candidates").withColumn("_block", F.floor(F.col("entry_rn") / block_rows))
    blocks = candidates.groupBy(*by, "_block").agg(F.sort_array(F.collect_list("entry_rn")).alias("_rns"))

    follow = lambda rns, free: F.aggregate(
        rns, free, lambda f, r: F.when(r >= f, r + horizon).otherwise(f)
    )
    base = F.col("_block") * block_rows
    starts = F.sequence(F.lit(0).cast("long"), F.lit(max(horizon - 1, 0)).cast("long"))
    maps = blocks.withColumn(
        "_after",
        F.transform(
            starts, lambda s: F.greatest(follow(F.col("_rns"), base + s) - (base + block_rows), F.lit(0).cast("long"))
        ),
    )
    # A missing block frees the ones behind it, since no trade reaches over a whole block.
    numbered = F.struct(F.col("_block").alias("first"), F.col("_block").alias("last"), F.col("_after").alias("after"))
    freed = F.struct(F.lit(-1).cast("long").alias("last"), F.lit(0).cast("long").alias("free"))
    start = lambda m, s: F.when(s["last"] == m["first"] - 1, s["free"]).otherwise(F.lit(0).cast("long"))
    after = lambda m, free: F.get(m["after"], free.cast("int"))

    def apply(m, s):
        return F.struct(m["last"].alias("last"), after(m, start(m, s)).alias("free"))

    def compose(m, following):
        met = following["first"] == m["last"] + 1
        through = F.transform(m["after"], lambda free: after(following, F.when(met, free).otherwise(F.lit(0).cast("long"))))
        return F.struct(m["first"].alias("first"), following["last"].alias("last"), through.alias("after"))

    states = entry_states(
        maps.withColumn("_map", numbered), by, freed, apply, compose, "struct<last:bigint,free:bigint>", "struct<first:bigint,last:bigint,after:array<bigint>>"
    )
    entry = F.when(F.col("_entry.last") == F.col("_block") - 1, F.col("_entry.free")).otherwise(F.lit(0).cast("long"))
    entered = states.select(*by, "_block", entry.alias("_start"))
    kept_type = "struct<free:bigint,kept:array<bigint>>"
    kept = F.aggregate(
        "_rns",
        F.struct((base + F.col("_start")).alias("free"), F.array().cast("array<bigint>").alias("kept")).cast(kept_type),
        lambda s, r: F.when(
            r >= s["free"],
            F.struct((r + horizon).alias("free"), F.concat(s["kept"], F.array(r)).alias("kept")),
        ).otherwise(s),
    )["kept"]
    chosen = blocks.join(entered, [*by, "_block"]).select(*by, "_block", F.explode(kept).alias("entry_rn"))
    return candidates.join(chosen, [*by, "_block", "entry_rn"], "left_semi").drop("_block")


def price_trades(
    chosen: DataFrame, horizon: int = 21, target_vega: float = 1000.0, spread: float = 0.05, rate: float = 0.0,
    by: Sequence[str] = SERIES,
) -> DataFrame:
    """Premium, size, payoff, cost and P&L of each kept trade; strike at spot, one cost per trade."""
    spot, iv = F.col("spot_entry"), F.col("iv_proxy")
    t, sigma = F.lit(horizon / M.CALENDAR_DAYS), iv / 100
    legs = with_option_prices(chosen, spot, spot, t, sigma, rate, "_call", "_put")
    staged = legs.withColumns(
        {
            "premium": F.col("_call") + F.col("_put"),
            "n_contracts": M.straddle_contracts(target_vega, spot, horizon, iv, rate),
            "payoff": F.abs(F.col("spot_exit") - spot),
        }
    )
    gross = F.col("signal") * F.col("n_contracts") * (F.col("payoff") - F.col("premium"))
    costed = staged.withColumns({"cost": M.trade_cost(F.col("premium"), F.col("n_contracts"), spread), "pnl_gross": gross})
    net = costed.withColumn("pnl_net", F.col("pnl_gross") - F.col("cost")).withColumnRenamed("date", "entry_date")
    return net.select(*by, *TRADE_COLUMNS)


def run_backtest(
    prices: DataFrame, forecast: DataFrame, implied: DataFrame, horizon: int = 21, bands: Sequence[float] = (1.0,),
    target_vega: float = 1000.0, spread: float = 0.05, rate: float = 0.0, keys: Sequence[str] = SERIES,
    price: str = "close", extra: Sequence[str] = (),
) -> DataFrame:
    """Trades of every series and band: (keys…, extra…, band_pct) and the eleven trade columns."""
    by = [*keys, *extra, "band_pct"]
    candidates = candidate_trades(prices, forecast, implied, horizon, bands, keys, price, extra)
    return price_trades(pick_without_overlap(candidates, horizon, by), horizon, target_vega, spread, rate, by)


def summarize(
    trades: DataFrame, grid: DataFrame | None = None, horizon: int = 21, by: Sequence[str] = (*SERIES, "band_pct")
) -> DataFrame:
    """One row per group: counts, win rate, P&L, Sharpe; groups of ``grid`` without trades show n_trades = 0."""
    by = list(by)
    capital = F.abs(F.col("n_contracts") * F.col("premium"))
    r = trades.withColumn("_ret", F.try_divide(F.col("pnl_net"), capital))
    out = r.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.avg((F.col("pnl_net") > 0).cast("double")).alias("win_rate"),
        F.sum("pnl_net").alias("total_pnl"),
        F.avg("pnl_net").alias("avg_pnl"),
        F.stddev_samp("pnl_net").alias("pnl_std"),
        sharpe("_ret", M.TRADING_DAYS / horizon).alias("sharpe"),
        F.count_if(F.col("signal") == M.LONG_VOL).alias("n_long_vol"),
        F.count_if(F.col("signal") != M.LONG_VOL).alias("n_short_vol"),
        F.when(F.min("_ret") < F.max("_ret"), F.skewness("_ret")).alias("ret_skew"),
        F.when(F.min("_ret") < F.max("_ret"), F.kurtosis("_ret") + 3).alias("ret_kurtosis"),
    )
    if grid is None:
        return out
    return grid.join(out, by, "left").withColumn("n_trades", F.coalesce("n_trades", F.lit(0).cast("long")))


def deflated_sharpe(
    summary: DataFrame, chosen_band: float = 1.0, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Deflated Sharpe of the chosen band, every band with more than one trade counting as a trial.

    NULL where fewer than two trials remain or the chosen band has fewer than two trades.
    """
    is_chosen = F.col("band_pct") == F.lit(float(chosen_band))
    trial = F.when(F.col("n_trades") > 1, F.col("sharpe"))
    own = lambda c: F.max(F.when(is_chosen, F.col(c)))
    per = summary.groupBy(*keys).agg(
        own("sharpe").alias("sharpe"), own("n_trades").alias("n_trades"),
        own("ret_skew").alias("ret_skew"), own("ret_kurtosis").alias("ret_kurtosis"),
        F.stddev_samp(trial).alias("trials_sd"), F.count(trial).alias("n_trials"),
    )
    enough = (F.col("n_trials") >= 2) & (F.col("n_trades") > 1)
    bar = expected_best_sharpe(F.col("trials_sd"), F.greatest(F.col("n_trials"), F.lit(2).cast("long")))
    staged = per.withColumn("benchmark", F.when(enough, bar))
    z = probabilistic_sharpe_score(
        F.col("sharpe"), F.col("benchmark"), F.col("n_trades"), F.col("ret_skew"), F.col("ret_kurtosis")
    )
    return staged.withColumn("_z", z).select(
        *keys, "sharpe", "n_trades", "n_trials", "trials_sd", "benchmark", norm_cdf(F.col("_z")).alias("dsr")
    )
