"""States along blocks of a long series, without passing a series through one row or task.

A recursion over the rows of a block of bounded size acts on the state before the block as one map, and maps compose. Every ``fan`` neighbouring
blocks' maps are composed into that of a greater block, and those again, until a series is one block; then the states go down the
same levels. A level is a job over 1/``fan`` of the rows of the one below, and no row holds more than ``fan`` maps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.session import stage

FAN = 256


def entry_states(
    maps: DataFrame, by: Sequence[str], first: Column, apply: Callable[[Column, Column], Column], compose: Callable[[Column, Column], Column],
    state_type: str, map_type: str, fan: int = FAN,
) -> DataFrame:
    """(by…, _block, _entry): the state before each block.

    ``maps`` has (by…, _block, _map), blocks numbered from 0, some may be missing. ``apply(map, state)`` is the state after a block,
    ``compose(map, next map)`` the map of two blocks, ``first`` the state before a series.
    """
    by = list(by)
    maps = stage(maps.select(*by, "_block", F.col("_map").cast(map_type).alias("_map")), "maps")
    gathered = F.sort_array(F.collect_list(F.struct("_block", "_map")))
    grouped = maps.groupBy(*by, F.floor(F.col("_block") / fan).alias("_above")).agg(gathered.alias("_maps"))
    top = maps.agg(F.max("_block")).first()[0]
    if top is None or top < fan:
        entered = grouped.withColumn("_first", first.cast(state_type))
    else:
        whole = F.aggregate(F.slice("_maps", 2, fan), F.col("_maps")[0]["_map"], lambda m, x: compose(m, x["_map"]).cast(map_type))
        above = grouped.select(*by, F.col("_above").alias("_block"), whole.alias("_map"))
        states = entry_states(above, by, first, apply, compose, state_type, map_type, fan)
        entered = grouped.join(states.select(*by, F.col("_block").alias("_above"), F.col("_entry").alias("_first")), [*by, "_above"])
    running = f"struct<state:{state_type},out:array<struct<_block:bigint,_entry:{state_type}>>>"
    zero = F.struct(F.col("_first").alias("state"), F.array().alias("out")).cast(running)

    def step(s: Column, m: Column) -> Column:
        here = F.array(F.struct(m["_block"].alias("_block"), s["state"].alias("_entry")))
        return F.struct(apply(m["_map"], s["state"]).alias("state"), F.concat(s["out"], here).alias("out")).cast(running)

    return entered.select(*by, F.explode(F.aggregate("_maps", zero, step)["out"]).alias("_e")).select(*by, "_e.*")
