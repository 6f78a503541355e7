"""One-sided Hodrick–Prescott gap.

The last trend point of the filter on [0…t] is the filtered state of a second-difference random walk with
observation noise 1 and shock variance 1/λ, started flat on the first two values. Its gains depend on the
row number only and settle to constants, so they are computed once from λ and shipped as a short literal;
every series is then one linear recursion in the JVM instead of one filter solve per prefix.

A DATE-keyed series is short and is followed in one row. Of others, the recursion runs in blocks of rows. A block acts on the state before it as one affine map; the maps are composed level by level (``chains``), which
gives the state before each block, and every block is then followed once. No row holds more than a block, whatever the series' length.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.chains import entry_states
from volpanel.operators.panel import SERIES, is_daily, number_rows
from volpanel.session import stage

MONTHLY_LAMBDA = 14400.0
MIN_WINDOW = 24
BLOCK_ROWS = 256
#: (level, level before) after a block is ((a, b), (c, d)) times that before it plus (e, f).
MAP = "struct<a:double,c:double,b:double,d:double,e:double,f:double>"


def trend_gains(lam: float = MONTHLY_LAMBDA, limit: int = 20_000) -> list[tuple[float, float]]:
    """Gains of (level, previous level) for rows 2, 3, …; the last entry holds for all later rows.

    Their number grows like the fourth root of ``lam``. A ``lam`` whose gains have not settled after ``limit`` rows is an error.
    """
    p11, p12, p22 = 1.0, 0.0, 1.0
    gains: list[tuple[float, float]] = []
    for _ in range(limit):
        a11 = 4 * p11 - 4 * p12 + p22 + 1 / lam
        a12 = 2 * p11 - p12
        a22 = p11
        k1, k2 = a11 / (a11 + 1), a12 / (a11 + 1)
        p11, p12, p22 = a11 - k1 * a11, a12 - k1 * a12, a22 - k2 * a12
        if gains and abs(k1 - gains[-1][0]) < 1e-17 and abs(k2 - gains[-1][1]) < 1e-17:
            return gains
        gains.append((k1, k2))
    raise ArithmeticError(f"gains for lambda {lam:g} have not settled after {limit} rows")


def one_sided_gap(
    df: DataFrame, value: str, lam: float = MONTHLY_LAMBDA, min_window: int = MIN_WINDOW,
    keys: Sequence[str] = SERIES, time: str = "reference_date", to: str = "gap", block_rows: int | None = None,
) -> DataFrame:
    """Add the cycle at t of the filter on all rows up to t; NULL for the first ``min_window`` rows.

    From a NULL value on a series has no cycle.
    """
    keys = list(keys)
    gains = trend_gains(lam)
    # Two literals in the plan, whatever the number of gains.
    k1, k2 = (F.from_json(F.lit(json.dumps([g[i] for g in gains])), "array<double>") for i in (0, 1))
    rest = [c for c in df.columns if c not in {*keys, time}]
    start = F.struct(F.lit(0.0).alias("level"), F.lit(0.0).alias("before"))
    if is_daily(df, time) and block_rows is None:
        series = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(time, *rest))).alias("_rows"))
        numbered = F.transform("_rows", lambda x, i: F.struct(i.cast("long").alias("rn"), *(x[c].alias(c) for c in (time, *rest))))
        with_gains = series.withColumns({"_rows": numbered, "_k1": k1, "_k2": k2, "_entry": start})
    else:
        cut = number_rows(df, keys, time).withColumn("_block", F.floor(F.col("rn") / (block_rows or BLOCK_ROWS)))
        blocks = stage(cut.groupBy(*keys, "_block").agg(F.sort_array(F.collect_list(F.struct("rn", time, *rest))).alias("_rows")), "trend-blocks")
        with_gains = blocks.withColumns({"_k1": k1, "_k2": k2})

    def gain(name: str, i: Column) -> Column:
        return F.get(name, (F.least(i - 1, F.lit(len(gains)).cast("long")) - 1).cast("int"))

    def after(level: Column, before: Column, row: Column, y: Column) -> tuple[Column, Column]:
        """Level and level before of the next row; of linear parts where ``y`` is 0."""
        i = row["rn"]
        ahead = 2 * level - before
        return (
            F.when(i < 2, y).otherwise(ahead + gain("_k1", i) * (y - ahead)),
            F.when(i < 2, level).otherwise(level + gain("_k2", i) * (y - ahead)),
        )

    def follow(m: Column, row: Column) -> Column:
        zero, y = F.lit(0.0), row[value].cast("double")
        parts = [*after(m["a"], m["c"], row, zero), *after(m["b"], m["d"], row, zero), *after(m["e"], m["f"], row, y)]
        return F.struct(*(p.alias(n) for p, n in zip(parts, "acbdef"))).cast(MAP)

    one = F.struct(*(F.lit(v).alias(n) for n, v in zip("acbdef", (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)))).cast(MAP)

    def apply(m: Column, s: Column) -> Column:
        level = m["a"] * s["level"] + m["b"] * s["before"] + m["e"]
        return F.struct(level.alias("level"), (m["c"] * s["level"] + m["d"] * s["before"] + m["f"]).alias("before"))

    def compose(m: Column, n: Column) -> Column:
        parts = {
            "a": n["a"] * m["a"] + n["b"] * m["c"], "c": n["c"] * m["a"] + n["d"] * m["c"], "b": n["a"] * m["b"] + n["b"] * m["d"],
            "d": n["c"] * m["b"] + n["d"] * m["d"], "e": n["a"] * m["e"] + n["b"] * m["f"] + n["e"], "f": n["c"] * m["e"] + n["d"] * m["f"] + n["f"],
        }
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    if "_entry" not in with_gains.columns:
        maps = with_gains.select(*keys, "_block", F.aggregate("_rows", one, follow).alias("_map"))
        states = entry_states(maps, keys, start, apply, compose, "struct<level:double,before:double>", MAP)
        with_gains = with_gains.join(states, [*keys, "_block"])

    running = "struct<level:double,before:double,out:array<double>>"
    zero = F.struct(F.col("_entry.level").alias("level"), F.col("_entry.before").alias("before"), F.array().alias("out")).cast(running)

    def step(s: Column, row: Column) -> Column:
        y = row[value].cast("double")
        level, before = after(s["level"], s["before"], row, y)
        cycle = F.when(row["rn"] >= min_window, y - level)
        return F.struct(level.alias("level"), before.alias("before"), F.concat(s["out"], F.array(cycle)).alias("out")).cast(running)

    folded = with_gains.withColumn("_gap", F.aggregate("_rows", zero, step)["out"])
    pairs = folded.select(*keys, F.explode(F.arrays_zip("_rows", "_gap")).alias("_p"))
    return pairs.select(*keys, *(F.col("_p._rows")[c].alias(c) for c in (time, *rest)), F.col("_p._gap").alias(to))
