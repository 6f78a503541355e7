"""Front contract of a futures chain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.operators.panel import SERIES, framed

PRICE_COLUMNS = ("settlement", "open", "last", "low", "high")


def front_contract(
    contracts: DataFrame, keys: Sequence[str] = SERIES, time: str = "date", fill_from_next: bool = True,
    columns: Sequence[str] = PRICE_COLUMNS,
) -> DataFrame:
    """The most traded contract per day or instant (then open interest, then ticker) and whether it changed.

    ``fill_from_next`` takes a missing price from the next most traded contract that has one; without it the
    row is that of a single contract.
    """
    rank = F.struct(
        F.coalesce("trades", F.lit(-1)).alias("trades"), F.coalesce("open_interest", F.lit(-1)).alias("oi"), "ticker"
    )
    pick = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), rank) if fill_from_next else rank).alias(c)
    front = contracts.groupBy(*keys, time).agg(F.max_by("ticker", rank).alias("ticker"), *[pick(c) for c in columns])
    frame = framed(front, keys, time, back=1)
    previous = F.lag("ticker").over(frame.window)
    return frame.close(frame.df.withColumn("contract_changed", F.coalesce(F.col("ticker") != previous, F.lit(False))))
