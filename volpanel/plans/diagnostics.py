"""Checks of the input series themselves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions import market as M
from volpanel.operators import features as W
from volpanel.operators.metrics import pair_correlation
from volpanel.operators.panel import SERIES, framed


def bar_quality(bars: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Mean move inside a bar, mean jump between bars, their ratio, and the open/close correlation."""
    frame = framed(bars, keys, "date", back=1)
    d = frame.close(frame.df.withColumn("_gap", F.abs(F.col("open") - F.lag("close").over(frame.window))))
    out = d.groupBy(*keys).agg(
        F.avg(F.abs(F.col("close") - F.col("open"))).alias("mean_intra"), F.avg("_gap").alias("mean_gap"),
        pair_correlation(F.col("open"), F.col("close")).alias("corr_open_close"),
    )
    return out.withColumn("gap_ratio", F.try_divide(F.col("mean_gap"), F.col("mean_intra")))


def sample_profile(front: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Sessions, first and last date, distinct contracts, rolls."""
    return front.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_sessions"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.countDistinct("ticker").alias("n_contracts"), F.count_if("contract_changed").alias("n_rolls"),
    )


def lead_lag(
    returns: DataFrame, official: DataFrame, shifts: Sequence[int] = (-1, 0, 1), keys: Sequence[str] = SERIES,
    rates: Sequence[str] = (),
) -> DataFrame:
    """Correlation of ``ret`` with the official rate's log return shifted by k rows of its own calendar.

    ``official`` (rates…, date, value) is shared by all series: one row per calendar day or instant and rate. Both sides have the
    same kind of key; a long calendar of instants is split into blocks.
    """
    one = framed(official.withColumn("_all", F.lit(0)), ["_all", *rates], "date", back=1)
    fr = one.close(one.df.withColumn("official_ret", M.log_return(F.col("value"), one.window)))
    moved = W.shifted(fr, "official_ret", shifts, ["_all", *rates])
    name = lambda k: f"official_ret_s{'m' if k < 0 else ''}{abs(k)}"
    joined = returns.select(*keys, "date", "ret").join(moved.select(*rates, "date", *[name(k) for k in shifts]), "date")
    wide = joined.groupBy(*keys, *rates).agg(*[pair_correlation(F.col("ret"), F.col(name(k))).alias(str(k)) for k in shifts])
    return wide.unpivot([*keys, *rates], [str(k) for k in shifts], "shift", "r").withColumn("shift", F.col("shift").cast("int"))


def volatility_profile(vol: DataFrame, value: str, keys: Sequence[str] = SERIES) -> DataFrame:
    return vol.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.count(value).alias("n")
    )


def paired_correlation(a: DataFrame, b: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of two series on their common dates."""
    on = [*keys, "date"]
    both = a.select(*on, F.col(x).alias("_x")).join(b.select(*on, F.col(y).alias("_y")), on).dropna("any")
    agg = [pair_correlation(F.col("_x"), F.col("_y")).alias("r"), F.count(F.lit(1)).alias("n")]
    return both.groupBy(*keys).agg(*agg)
