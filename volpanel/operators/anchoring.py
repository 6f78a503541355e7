"""Survey expectations against a blended twelve-month target, and the anchoring score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volpanel.functions import market as M


def blended_target(survey: DataFrame, targets: DataFrame, date: str = "date") -> DataFrame:
    """Add ``meta``: the targets of the years in [d, d+365], weighted by the days in each.

    A missing next-year target falls back to the current one; a missing current one gives NULL. ``targets``
    is (year, meta), one row per year.
    """
    d = F.col(date)
    # One row per calendar year after the aggregation, so never more than 9,999 rows to broadcast. A target is the current
    # one of its year and the next one of the year before.
    year, meta = F.col("year").cast("int"), F.col("meta").cast("double")
    seen = targets.filter(meta.isNotNull()).select(
        F.explode(F.array(F.struct(year.alias("_y0"), meta.alias("_m0"), F.lit(None).cast("double").alias("_m1")),
                          F.struct((year - 1).alias("_y0"), F.lit(None).cast("double").alias("_m0"), meta.alias("_m1")))).alias("_t")
    )
    per_year = seen.select("_t.*").groupBy("_y0").agg(F.max("_m0").alias("_m0"), F.max("_m1").alias("_m1"))
    rows = survey.withColumns({"_y0": F.year(d), "_y1": F.year(F.date_add(d, 365))}).join(F.broadcast(per_year), "_y0", "left")
    share = F.datediff(F.make_date(F.col("_y0") + 1, F.lit(1), F.lit(1)), d) / F.lit(365.0)
    mixed = share * F.col("_m0") + (1 - share) * F.coalesce("_m1", "_m0")
    meta = F.when(F.col("_y0") == F.col("_y1"), F.col("_m0")).otherwise(mixed)
    return rows.select(*survey.columns, meta.alias("meta"))


def target_gap(survey: DataFrame, targets: DataFrame, expectation: str = "pi_expectation") -> DataFrame:
    """Survey with ``meta`` and ``gap`` = expectation − target."""
    return blended_target(survey, targets).withColumn("gap", F.col(expectation) - F.col("meta"))


def anchoring(gaps: DataFrame, scale: float = 2.0) -> DataFrame:
    """(date, gap, dispersion, theta_baseline)."""
    return gaps.select("date", "gap", "dispersion", M.theta(F.col("gap"), scale).alias("theta_baseline"))
