"""Realized-variance features, forward labels and other row-window columns of a panel."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions import market as M
from volpanel.operators.panel import SERIES, forward, framed, is_daily, rolling, series_window

HAR = ("rv_d", "rv_w", "rv_m")
HAR_ROWS = {"rv_d": 1, "rv_w": 5, "rv_m": 22}


def close_variance(df: DataFrame, price: str = "close", keys: Sequence[str] = SERIES, time: str = "date") -> DataFrame:
    """Add ``variance``: the squared log return of ``price``."""
    fr = framed(df, keys, time, back=1)
    return fr.close(fr.df.withColumn("variance", F.pow(M.log_return(F.col(price), fr.window), 2)))


def range_variance(df: DataFrame) -> DataFrame:
    """Add ``variance`` from the day's high and low; needs no window, so a contract roll cannot disturb it."""
    return df.withColumn("variance", M.range_variance(F.col("high"), F.col("low")))


def har_features(
    df: DataFrame, variance: str = "variance", keys: Sequence[str] = SERIES, time: str = "date",
    horizons: Sequence[int] = (), block_rows: int | None = None,
) -> DataFrame:
    """Mean variance over 1, 5 and 22 rows, and one label ``target_<h>`` per forecast horizon.

    All frames share one window specification, so the panel is sorted once.
    """
    fr = framed(df, keys, time, back=21, ahead=max(horizons, default=0), block_rows=block_rows)
    v = F.col(variance)
    cols: dict[str, Column] = {name: rolling(F.avg, v, fr.window, n) for name, n in HAR_ROWS.items()}
    cols |= {f"target_{h}": M.annual_pct(forward(F.avg, v, fr.window, h)) for h in horizons}
    return fr.close(fr.df.withColumns(cols))


def realized_vol(
    df: DataFrame, price: str = "close", windows: Sequence[int] = (21,), keys: Sequence[str] = SERIES,
    time: str = "date", periods: int = M.TRADING_DAYS,
) -> DataFrame:
    """Rolling close-to-close volatility in points per year, one ``rv_<window>`` column per window."""
    fr = framed(df, keys, time, back=max(windows))
    r = fr.df.withColumn("_r", M.log_return(F.col(price), fr.window))
    scale = F.sqrt(F.lit(float(periods))) * 100
    cols = {f"rv_{n}": rolling(F.stddev_samp, F.col("_r"), fr.window, n) * scale for n in windows}
    return fr.close(r.withColumns(cols).drop("_r"))


def range_vol(
    df: DataFrame, windows: Sequence[int] = (21,), keys: Sequence[str] = SERIES, time: str = "date",
    periods: int = M.TRADING_DAYS,
) -> DataFrame:
    """Rolling high/low volatility in points per year, one ``range_vol_<window>`` column per window."""
    fr = framed(range_variance(df), keys, time, back=max(windows) - 1)
    cols = {
        f"range_vol_{n}": M.annual_pct(rolling(F.avg, F.col("variance"), fr.window, n), periods) for n in windows
    }
    return fr.close(fr.df.withColumns(cols).drop("variance"))


def gap_and_sign(
    df: DataFrame, variance: str = "variance", keys: Sequence[str] = SERIES, time: str = "date"
) -> DataFrame:
    """Add ``overnight`` (gap variance) and ``rv_d_pos`` / ``rv_d_neg`` (variance by sign of the return)."""
    fr = framed(df, keys, time, back=1)
    pos, neg = M.signed_variance(F.col(variance), F.col("_r"))
    staged = fr.df.withColumns(
        {
            "_r": M.log_return(F.col("close"), fr.window),
            "overnight": M.gap_variance(F.col("open"), F.lag("close").over(fr.window)),
        }
    )
    return fr.close(staged.withColumns({"rv_d_pos": pos, "rv_d_neg": neg}).drop("_r"))


def forward_skew(
    df: DataFrame, returns: str, horizons: Sequence[int], keys: Sequence[str] = SERIES, time: str = "date",
    min_periods: Mapping[int, int] | None = None,
) -> DataFrame:
    """Bias-adjusted skewness of the next ``h`` returns; by default up to three of them may be missing."""
    fr = framed(df, keys, time, ahead=max(horizons))
    cols = {}
    for h in horizons:
        frame = fr.window.rowsBetween(1, h)
        need = (min_periods or {}).get(h, max(3, h - 3))
        whole = (F.count(returns).over(frame) >= need) & (F.count(F.lit(1)).over(frame) == h)
        cols[f"skew_{h}"] = F.when(whole, M.adjusted_skew(F.col(returns), frame))
    return fr.close(fr.df.withColumns(cols))


def exogenous_changes(
    df: DataFrame, level: str, index: str, prefix: tuple[str, str] = ("vix", "dxy"),
    keys: Sequence[str] = (), time: str = "date",
) -> DataFrame:
    """Level, first difference and log difference on the pair's own calendar (before any alignment).

    Without ``keys`` the pair is one shared series: a row per calendar day.
    """
    keyed = df if keys else df.withColumn("_all", F.lit(0))
    fr = framed(keyed, list(keys) or ["_all"], time, back=1)
    out = fr.df.withColumns(
        {
            f"{prefix[0]}_level": F.col(level),
            f"{prefix[0]}_change": F.col(level) - F.lag(level).over(fr.window),
            f"{prefix[1]}_return": M.log_return(F.col(index), fr.window),
        }
    )
    return fr.close(out).drop("_all")


def surprise(
    df: DataFrame, value: str, window: int = 63, min_periods: int = 21, keys: Sequence[str] = SERIES,
    time: str = "date", block_rows: int | None = None,
) -> DataFrame:
    """Add ``surprise``: the z-score of ``value`` against its last ``window`` rows, the current one included."""
    fr = framed(df, keys, time, back=window - 1, block_rows=block_rows)
    x = F.col(value)
    mean = rolling(F.avg, x, fr.window, window, min_periods)
    sd = rolling(F.stddev_samp, x, fr.window, window, min_periods)
    flat = x.eqNullSafe(rolling(F.min, x, fr.window, window, min_periods)) & x.eqNullSafe(
        rolling(F.max, x, fr.window, window, min_periods)
    )
    return fr.close(fr.df.withColumn("surprise", F.when(~flat, F.try_divide(x - mean, F.nullif(sd, F.lit(0.0))))))


def smooth(
    df: DataFrame, value: str, window: int, keys: Sequence[str] = SERIES, time: str = "date", to: str | None = None
) -> DataFrame:
    """Trailing mean over up to ``window`` rows of the series' own calendar.

    Without ``keys`` the input is one shared series: a row per calendar day.
    """
    keyed = df if keys else df.withColumn("_all", F.lit(0))
    fr = framed(keyed, list(keys) or ["_all"], time, back=window - 1)
    return fr.close(fr.df.withColumn(to or value, rolling(F.avg, F.col(value), fr.window, window, 1))).drop("_all")


def roll_free_returns(
    df: DataFrame, price: str = "settlement", changed: str = "contract_changed", keys: Sequence[str] = SERIES,
    time: str = "date",
) -> DataFrame:
    """Add ``ret``: log returns with the days on which the contract changed set to NULL."""
    fr = framed(df, keys, time, back=1)
    r = M.log_return(F.col(price), fr.window)
    return fr.close(fr.df.withColumn("ret", F.when(~F.col(changed), r)))


def shifted(
    df: DataFrame, value: str, shifts: Sequence[int], keys: Sequence[str] = SERIES, time: str = "date"
) -> DataFrame:
    """One ``<value>_s<k>`` column per shift: positive k looks back k rows, negative looks ahead."""
    name = lambda k: f"{value}_s{'m' if k < 0 else ''}{abs(k)}"
    fr = framed(df, keys, time, back=max(max(shifts), 0), ahead=max(-min(shifts), 0))
    return fr.close(fr.df.withColumns({name(k): F.lag(value, k).over(fr.window) for k in shifts}))


def every_nth(df: DataFrame, step: int, rn: str = "rn") -> DataFrame:
    """Rows 0, step, 2·step… of a numbered panel: windows that share no observation."""
    return df.filter(F.col(rn) % step == 0)


def running_total(
    df: DataFrame, value: str, keys: Sequence[str] = SERIES, time: str = "date", to: str = "running"
) -> DataFrame:
    """Cumulative sum along DATE-keyed rows (a trade list by exit date)."""
    if not is_daily(df, time):
        raise TypeError("running_total needs a DATE key")
    upto = series_window(keys, time).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(to, F.sum(value).over(upto))


def gap_breaks(
    df: DataFrame, value: str, max_gap_days: int = 5, keys: Sequence[str] = SERIES, time: str = "date"
) -> DataFrame:
    """Rows of the panel plus one NULL row inside every hole longer than ``max_gap_days``.

    ``ts`` is the row's instant; the NULL row stands half a gap limit before the row after the hole.
    """
    fr = framed(df, keys, time, back=1)
    marked = fr.close(
        fr.df.withColumn(
            "_hole", F.coalesce(F.datediff(time, F.lag(time).over(fr.window)) > max_gap_days, F.lit(False))
        )
    )
    ts = F.col(time).cast("timestamp")
    half = F.lit(int(max_gap_days * 86_400 / 2))
    point = F.struct(ts.alias("ts"), F.col(value).alias(value), F.lit(False).alias("is_break"))
    filler = F.struct(
        F.timestamp_seconds(F.unix_seconds(ts) - half).alias("ts"),
        F.lit(None).cast(df.schema[value].dataType).alias(value),
        F.lit(True).alias("is_break"),
    )
    emitted = F.when(F.col("_hole"), F.array(filler, point)).otherwise(F.array(point))
    rows = marked.select(*keys, F.explode(emitted).alias("_p"))
    return rows.select(*keys, "_p.*")
