"""At-the-money implied volatility at chosen tenors from a long surface."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.operators.panel import SERIES

ATM_DELTA = 50.0


def wide_to_long(df: DataFrame, ids: Sequence[str], deltas: Sequence[str], maturity: str = "maturity_date") -> DataFrame:
    """Wide sheet (one column per delta) to (ids…, maturity_date, delta_pct, iv_pct).

    Rows whose maturity is not a date and cells that are not numbers are dropped.
    """
    day = F.expr(f"try_cast(`{maturity}` as date)")
    text = df.select(*ids, day.alias("maturity_date"), *[F.col(f"`{d}`").cast("string").alias(d) for d in deltas])
    long = text.filter(F.col("maturity_date").isNotNull()).unpivot(
        [*ids, "maturity_date"], list(deltas), "delta_pct", "iv_pct"
    )
    return (
        long.withColumns({"delta_pct": F.col("delta_pct").cast("double"), "iv_pct": F.expr("try_cast(iv_pct as double)")})
        .filter(F.col("iv_pct").isNotNull() & ~F.isnan("iv_pct"))
    )


def atm_tenors(
    surface: DataFrame, tenors: Sequence[int] = (21,), keys: Sequence[str] = SERIES, refdate: str = "refdate"
) -> DataFrame:
    """(keys…, refdate, tenor, target_date, iv_atm_pct): linear in total variance between the neighbouring
    maturities, flat outside them. Hash aggregation only; all tenors in one pass."""
    atm = surface.filter(F.col("delta_pct") == ATM_DELTA)
    grid = atm.withColumn("tenor", F.explode(F.array(*[F.lit(t) for t in tenors])))
    t, goal, iv = F.datediff("maturity_date", refdate).cast("double"), F.col("tenor"), F.col("iv_pct")
    left, right = F.when(t < goal, t), F.when(t >= goal, t)
    sides = grid.groupBy(*keys, refdate, "tenor").agg(
        F.max(left).alias("t1"), F.max_by(iv, left).alias("iv1"),
        F.min(right).alias("t2"), F.min_by(iv, right).alias("iv2"),
    )
    total = lambda v, d: F.pow(F.col(v) / 100, 2) * F.col(d)
    share = (goal - F.col("t1")) / (F.col("t2") - F.col("t1"))
    between: Column = total("iv1", "t1") + share * (total("iv2", "t2") - total("iv1", "t1"))
    value = (
        F.when(F.col("t1").isNull(), F.col("iv2")).when(F.col("t2").isNull(), F.col("iv1"))
        .otherwise(F.sqrt(between / goal) * 100)
    )
    return sides.select(
        *keys, refdate, "tenor", F.date_add(refdate, goal).alias("target_date"), value.alias("iv_atm_pct")
    )
