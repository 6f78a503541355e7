"""Greatest spikes of a series that keep a minimum distance in days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.operators.panel import SERIES


def spike_windows(
    df: DataFrame, value: str, top_n: int = 15, window_days: int = 3, min_gap_days: int = 10,
    keys: Sequence[str] = SERIES, time: str = "date",
) -> DataFrame:
    """Take spikes from the greatest down, skipping days closer than ``min_gap_days`` to one already taken.

    Returns (keys…, spike_date, spike_value, window_start, window_end). Equal values go by date.

    One accepted day rules out at most ``2·gap − 1`` days, itself included. So while fewer than ``top_n``
    days are accepted, at most ``(top_n − 1)·(2·gap − 1)`` days are decided, and the first
    ``(top_n − 1)·(2·gap − 1) + 1`` ranked days always contain the whole answer. Only that many reach the
    greedy pass; Spark applies the rank limit before the shuffle as well, so a hot series is cut per
    input partition.
    """
    keys = list(keys)
    need = (top_n - 1) * (2 * min_gap_days - 1) + 1
    present = df.filter(F.col(value).isNotNull())
    days = present.groupBy(*keys, F.to_date(time).alias("_d")).agg(F.max(value).alias("_v"))
    best = Window.partitionBy(*keys).orderBy(F.desc("_v"), "_d")
    short = days.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= need)
    ranked = short.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_k", "_d", "_v"))).alias("_ranked"))

    empty = F.array().cast(f"array<struct<_k:int,_d:date,_v:{days.schema['_v'].dataType.simpleString()}>>")
    take = lambda taken, c: F.when(
        (F.size(taken) < top_n)
        & F.forall(taken, lambda s: F.abs(F.datediff(c["_d"], s["_d"])) >= min_gap_days),
        F.concat(taken, F.array(c)),
    ).otherwise(taken)
    chosen = ranked.select(*keys, F.explode(F.aggregate("_ranked", empty, take)).alias("_s"))
    d = F.col("_s._d")
    return chosen.select(
        *keys, d.alias("spike_date"), F.col("_s._v").alias("spike_value"),
        F.date_sub(d, window_days).alias("window_start"), F.date_add(d, window_days).alias("window_end"),
    )
