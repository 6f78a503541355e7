"""Alignment across calendars by last known label, never using the future.

The match is on the *label*: the right row with the greatest time not after the left time is taken even if
its values are NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from volpanel.functions.text import LOCAL_ZONE
from volpanel.operators.panel import SERIES, is_daily, range_buckets
from volpanel.session import stage


def _last_known(both: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Left rows of the united sides with the newest right row; a right row sorts before a left row at its label."""
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    return hit.select("_l.*", *[F.col(f"_r.{v}").alias(v) for v in values])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = SERIES,
    left_time: str = "date",
    right_time: str = "date",
    values: Sequence[str] | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Backward as-of join; right holds one row per (keys, right_time).

    DATE keys: union of both sides and one window, so one shuffle. TIMESTAMP keys (or an explicit number of
    ``buckets``): the united sides are split into evenly filled ranges of (keys, time), the window runs inside a
    range, and each range starts from the last right row of the ranges before it, found by a partial ``max``.
    """
    keys, values = list(keys), list(values or [c for c in right.columns if c not in {*keys, right_time}])
    lefts = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_l"))
    rights = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_r")
    )
    both = lefts.unionByName(rights, allowMissingColumns=True)
    if is_daily(left, left_time) and is_daily(right, right_time) and buckets is None:
        return _last_known(both, keys, values)

    ranged = range_buckets(both, keys, "_t", buckets)
    known = F.when(F.col("_r").isNotNull(), F.col("_t"))
    newest = ranged.groupBy(*keys, "_bucket").agg(F.max_by(F.struct("_t", "_r"), known).alias("_m"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = newest.withColumn("_m", F.last("_m", ignorenulls=True).over(before)).filter(F.col("_m").isNotNull())
    starts = carried.select(*keys, "_bucket", "_m._t", F.lit(0).alias("_side"), "_m._r")
    return _last_known(ranged.unionByName(starts, allowMissingColumns=True), [*keys, "_bucket"], values)


def known_by_day(right: DataFrame, time: str, values: Sequence[str], zone: str = LOCAL_ZONE) -> DataFrame:
    """Instants as the days at whose local midnight they are known: one row per such day, that of its last instant.

    An instant exactly at midnight belongs to that day, any later one to the next day.
    """
    local = F.convert_timezone(F.current_timezone(), F.lit(zone), F.col(time).cast("timestamp_ntz"))
    day = F.to_date(local)
    known = F.when(local == day.cast("timestamp_ntz"), day).otherwise(F.date_add(day, 1))
    newest = [F.max_by(v, time).alias(v) for v in values]
    return right.filter(F.col(time).isNotNull()).groupBy(known.alias("_known")).agg(*newest).withColumnRenamed("_known", time)


def asof_shared(
    left: DataFrame, right: DataFrame, left_time: str = "date", right_time: str = "date",
    values: Sequence[str] | None = None, staged: bool = False, zone: str = LOCAL_ZONE,
) -> DataFrame:
    """As-of join of one series shared by every left series (an index, a survey)."""
    return asof_shared_all(left, [right], left_time, right_time, [values] if values else None, staged, zone)


def asof_shared_all(
    left: DataFrame, rights: Sequence[DataFrame], left_time: str = "date", right_time: str = "date",
    values: Sequence[Sequence[str]] | None = None, staged: bool = False, zone: str = LOCAL_ZONE,
) -> DataFrame:
    """As-of join of any number of shared series, each at its own last label.

    A right series of instants is seen from a left day's midnight in ``zone``.

    All matches are found by one pass over the distinct left dates, at most one row per calendar day, and joined back by
    date; the planner broadcasts that calendar when its measured size allows. The left side feeds both steps,
    so it is staged unless the caller says it already is.
    """
    if not is_daily(left, left_time):
        raise TypeError("the left side of a shared as-of join needs DATE keys")
    names = [list(v) for v in values] if values else [[c for c in r.columns if c != right_time] for r in rights]
    left = left if staged else stage(left, "asof-left")
    both = left.select(F.col(left_time).alias("_t")).distinct().withColumn("_side", F.lit(1))
    for i, (right, own) in enumerate(zip(rights, names)):
        if not is_daily(right, right_time):
            right = known_by_day(right, right_time, own, zone)
        rows = right.filter(F.col(right_time).isNotNull())
        rows = rows.select(F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*own).alias(f"_r{i}"))
        both = both.unionByName(rows, allowMissingColumns=True)
    w = Window.partitionBy("_all").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = [F.last(f"_r{i}", ignorenulls=True).over(w).alias(f"_r{i}") for i in range(len(names))]
    calendar = both.withColumn("_all", F.lit(0)).select("_t", "_side", *last).filter("_side = 1")
    found = calendar.select(F.col("_t").alias(left_time), *[F.col(f"_r{i}.{v}").alias(v) for i, own in enumerate(names) for v in own])
    return left.join(found, left_time, "left").select(*left.columns, *[v for own in names for v in own])


def asof_point(
    df: DataFrame, value: str, at: DataFrame, at_time: str, keys: Sequence[str] = SERIES, time: str = "date"
) -> DataFrame:
    """Latest ``value`` at or before one calibration time per series (``at`` has one row per series)."""
    keys = list(keys)
    hit = df.join(at.select(*keys, at_time), keys).filter(F.col(time) <= F.col(at_time))
    return hit.groupBy(*keys, at_time).agg(F.max_by(value, time).alias(value), F.max(time).alias(f"{value}_{time}"))
