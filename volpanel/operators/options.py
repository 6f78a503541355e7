"""Black-76 prices on a table of options.

Spark repeats an expression wherever its Column is reused, so the intermediate values are columns of their own
steps: every option evaluates two Normal tails, and all of it stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.functions import market as M
from volpanel.functions.normal import cdf_from_tail, normal_tail


def with_option_prices(
    df: DataFrame, f: Column, k: Column, t: Column, sigma: Column, r: Column | float = 0.0,
    call: str = "call", put: str = "put",
) -> DataFrame:
    """Add call and put prices of options on a future; ``sigma`` and ``r`` in decimals, ``t`` in years."""
    rate = r if isinstance(r, Column) else F.lit(float(r))
    inputs = df.withColumns({"_f": f, "_k": k, "_t": t, "_sigma": sigma, "_discount": F.exp(-rate * t)})
    d1 = M.futures_d1(F.col("_f"), F.col("_k"), F.col("_t"), F.col("_sigma"))
    steps = inputs.withColumn("_d1", d1).withColumn("_d2", F.col("_d1") - F.col("_sigma") * F.sqrt("_t"))
    steps = steps.withColumns({"_a1": F.abs("_d1"), "_a2": F.abs("_d2")})
    steps = steps.withColumns({"_q1": normal_tail(F.col("_a1")), "_q2": normal_tail(F.col("_a2"))})
    up = lambda i: cdf_from_tail(F.col(f"_d{i}"), F.col(f"_q{i}"))
    down = lambda i: cdf_from_tail(-F.col(f"_d{i}"), F.col(f"_q{i}"))
    priced = steps.withColumns(
        {
            call: F.col("_discount") * (F.col("_f") * up(1) - F.col("_k") * up(2)),
            put: F.col("_discount") * (F.col("_k") * down(2) - F.col("_f") * down(1)),
        }
    )
    return priced.drop("_f", "_k", "_t", "_sigma", "_discount", "_d1", "_d2", "_a1", "_a2", "_q1", "_q2")
