"""Per-fold least squares from aggregated cross-products.

Every dataset row is aggregated once, into the first fold that trains on it: counts, means and co-moments about the means, which partial
aggregates merge pairwise without losing digits to a feature's level. Nested train sets make the moments of fold i the merged ones of folds ≤ i;
about one value per series, the first fold's mean, that is a running sum over one row per fold. Only those k×k sums reach the solver, so
the fit costs one pass whatever the number of folds and feature sets is, and no series is sorted or gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.small_stats import solve_normal_equations
from volpanel.operators.folds import Scheme, assign_folds, fold_table
from volpanel.operators.panel import SERIES

def fit_folds(
    numbered: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    scheme: Scheme,
    y: Column | str = "target",
    log_target: bool = False,
    keys: Sequence[str] = SERIES,
) -> DataFrame:
    """Coefficients per (keys, config, fold): ``beta`` = intercept and one entry per feature, 0 where unused."""
    keys = list(keys)
    names = sorted({f for fs in feature_sets.values() for f in fs})
    target = F.col(y) if isinstance(y, str) else y
    target = F.ln(target) if log_target else target

    # A log target that does not exist (volatility 0) leaves the row out of every sum, not just of some.
    rows = assign_folds(numbered, scheme).withColumn("_y", target)
    rows = rows.filter("first_train_fold IS NOT NULL AND _y IS NOT NULL")
    k = len(names) + 1
    column = {i: f"`{f}`" for i, f in enumerate(names, start=1)} | {"y": "_y"}
    moments = {"_n": "count(1)"} | {f"m_{i}": f"avg({c})" for i, c in column.items()}
    pairs = [(i, j) for i in range(1, k) for j in [*range(i, k), "y"]]
    moments |= {f"c_{i}_{j}": f"var_pop({column[i]})" if i == j else f"covar_pop({column[i]}, {column[j]})" for i, j in pairs}
    pieces = rows.groupBy(*keys, F.col("first_train_fold").alias("fold")).agg(*[F.expr(f"{c} AS {a}") for a, c in moments.items()])

    # One row per fold from here on. Sums of products of distances from one value per series keep their digits.
    along = Window.partitionBy(*keys).orderBy("fold")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shifts = {f"s_{i}": F.coalesce(F.first(f"m_{i}", ignorenulls=True).over(whole), F.lit(0.0)) for i in range(1, k)}
    shifted = fold_table(numbered, scheme, keys).join(pieces, [*keys, "fold"], "left").withColumns(shifts)
    d = {i: f"(m_{i} - s_{i})" for i in range(1, k)} | {"y": "m_y"}
    sums = {"g_0_0": "CAST(_n AS DOUBLE)", "v_0": "_n * m_y"}
    sums |= {f"g_0_{i}": f"_n * {d[i]}" for i in range(1, k)}
    sums |= {f"v_{i}" if j == "y" else f"g_{i}_{j}": f"_n * (c_{i}_{j} + {d[i]} * {d[j]})" for i, j in pairs}
    upto = along.rowsBetween(Window.unboundedPreceding, 0)
    nested = shifted.select(*keys, "fold", "train_end", "test_start", "test_end", *shifts, *[F.sum(F.expr(c)).over(upto).alias(a) for a, c in sums.items()])
    entry = lambda i, j: f"g_{min(i, j)}_{max(i, j)}"
    gram = ", ".join(entry(i, j) for i in range(k) for j in range(k))
    packed = nested.select(
        *keys, "fold", "train_end", "test_start", "test_end", F.expr(f"array({gram})").alias("_gram"),
        F.expr(f"array({', '.join(f'v_{i}' for i in range(k))})").alias("_xty"),
        F.array(*[F.col(a) for a in shifts]).alias("_shift"),
    )
    configs = F.array(
        *[
            F.struct(
                F.lit(name).alias("config"),
                F.array(*[F.lit(i) for i in [0, *sorted(names.index(f) + 1 for f in fs)]]).alias("picked"),
            )
            for name, fs in feature_sets.items()
        ]
    )
    grid = packed.withColumn("_c", F.explode(configs))
    beta = solve_normal_equations(F.col("_gram"), F.col("_xty"), F.col("_c.picked"), F.col("_shift"))
    return grid.select(
        *keys, F.col("_c.config").alias("config"), "fold", "train_end", "test_start", "test_end",
        F.col("_gram")[0].cast("long").alias("n_train"), beta.alias("beta"), F.array(*[F.lit(f) for f in names]).alias("features"),
    )


def coefficient_column(coefs: DataFrame, names: Sequence[str], feature: str) -> Column:
    """Coefficient of one feature out of ``beta``."""
    return F.col("beta")[sorted(names).index(feature) + 1]


def predict_folds(
    numbered: DataFrame,
    coefs: DataFrame,
    feature_sets: Mapping[str, Sequence[str]],
    scheme: Scheme,
    log_target: bool = False,
    keys: Sequence[str] = SERIES,
    to: str = "rv_forecast",
) -> DataFrame:
    """Out-of-sample rows of every fold and feature set with their forecast in the target's own scale."""
    keys = list(keys)
    names = sorted({f for fs in feature_sets.values() for f in fs})
    tested = assign_folds(numbered, scheme).filter(F.col("test_fold").isNotNull())
    tested = tested.drop("first_train_fold").withColumnRenamed("test_fold", "fold")
    hit = tested.join(coefs.select(*keys, "config", "fold", "beta"), [*keys, "fold"])
    value = F.expr(" + ".join(["beta[0]", *[f"beta[{i}] * `{f}`" for i, f in enumerate(names, start=1)]]))
    return hit.withColumn(to, F.exp(value) if log_target else value).drop("beta")
