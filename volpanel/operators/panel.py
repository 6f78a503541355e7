"""Panels: one row per (series, time), and windows that count rows of a series.

Two physical forms give the same values:

* DATE-keyed panels hold at most one row per calendar day and series, so a series is short whatever the
  raw volume was (a century is 36,525 rows). They use one window per series; later groupings by series
  reuse that partitioning.
* TIMESTAMP-keyed panels have no such bound: one series may hold most of the rows. They are range-partitioned
  by (series, time), which splits a long series wherever it needs to, numbered, and cut into blocks of
  ``block_rows`` rows. Each block gets copies of the few rows before and after it that its frames reach, and
  all blocks run in parallel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.session import stage

SERIES = ("series_id",)
BLOCK_ROWS = 4096


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN compares greater than every number in Spark, so panels carry NULL only."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def to_panel(df: DataFrame, series: Column | str, time: Column | str, **values: Column | str) -> DataFrame:
    """(series_id, date, values…) from any table; null dates dropped, NaN turned into NULL."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    cols = [as_col(series).alias("series_id"), as_col(time).alias("date")]
    cols += [as_col(v).alias(k) for k, v in values.items()]
    return nan_to_null(df.select(*cols).filter(F.col("date").isNotNull()))


def is_daily(df: DataFrame, time: str) -> bool:
    return isinstance(df.schema[time].dataType, T.DateType)


def require_daily(df: DataFrame, time: str) -> None:
    """One window over a whole series is for DATE keys alone; anything finer would put a long series into one task."""
    if not is_daily(df, time):
        raise TypeError(f"{time} must be a DATE here, one row per day and series; aggregate instants to days first")


def series_window(keys: Sequence[str] = SERIES, time: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(time)


def rolling(
    agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, min_periods: int | None = None
) -> Column:
    """``agg`` over the last ``n`` rows, NULL until ``min_periods`` (default n) values are present."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if min_periods is None else min_periods), agg(x).over(frame))


def forward(
    agg: Callable[[Column], Column], x: Column, w: WindowSpec, n: int, min_periods: int | None = None
) -> Column:
    """``agg`` over rows t+1…t+n; row t+n has to exist."""
    frame = w.rowsBetween(1, n)
    enough = F.count(x).over(frame) >= (n if min_periods is None else min_periods)
    return F.when(enough & (F.count(F.lit(1)).over(frame) == n), agg(x).over(frame))


def range_buckets(df: DataFrame, keys: Sequence[str], time: str, buckets: int | None = None) -> DataFrame:
    """``df`` staged in evenly filled ranges of (keys, time), each row carrying its range number ``_bucket``.

    Ranges follow the data, so a series with a third of all rows spreads over a third of the ranges, in time
    order. The number is written with the rows and does not change when a task runs again.
    """
    by = [*keys, time]
    spread = df.repartitionByRange(buckets, *by) if buckets else df.repartitionByRange(*by)
    return stage(spread.withColumn("_bucket", F.spark_partition_id()), "ranges")


def number_rows(df: DataFrame, keys: Sequence[str] = SERIES, time: str = "date") -> DataFrame:
    """Add ``rn`` (0-based row number) and ``n`` (rows of the series); TIMESTAMP panels are numbered by ranges."""
    if not is_daily(df, time):
        return number_rows_spread(df, keys, time)
    w = series_window(keys, time)
    return df.withColumns(
        {"rn": F.row_number().over(w).cast("long") - 1, "n": F.count(F.lit(1)).over(Window.partitionBy(*keys))}
    )


def number_rows_spread(
    df: DataFrame, keys: Sequence[str] = SERIES, time: str = "date", buckets: int | None = None
) -> DataFrame:
    """``rn`` and ``n`` without putting a series into one task.

    Rows are numbered inside ranges; range sizes are counted with partial aggregation, and only those counts,
    one row per series and range, are summed along the series.
    """
    keys = list(keys)
    d = range_buckets(df, keys, time, buckets)
    along = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    offsets = sizes.select(
        *keys,
        "_bucket",
        F.coalesce(F.sum("_c").over(along), F.lit(0)).alias("_offset"),
        F.sum("_c").over(Window.partitionBy(*keys)).alias("n"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(time)
    return (
        d.withColumn("_i", F.row_number().over(inside).cast("long") - 1)
        .join(offsets, keys + ["_bucket"])
        .withColumn("rn", F.col("_i") + F.col("_offset"))
        .select(*df.columns, "rn", "n")
    )


@dataclass(frozen=True)
class Framed:
    """A panel ready for row windows: add columns over ``window``, then ``close`` the result."""

    df: DataFrame
    window: WindowSpec
    blocked: bool

    def close(self, out: DataFrame) -> DataFrame:
        return out.filter("_own").drop("_own", "_block", "rn", "n") if self.blocked else out


def framed(
    df: DataFrame,
    keys: Sequence[str] = SERIES,
    time: str = "date",
    back: int = 0,
    ahead: int = 0,
    block_rows: int | None = None,
) -> Framed:
    """Window over a panel for expressions reaching ``back`` rows behind and ``ahead`` rows in front.

    Expressions stacked on each other (a rolling mean of a lag) need the sum of their reaches.
    """
    if is_daily(df, time) and block_rows is None:
        return Framed(df, series_window(keys, time), False)
    size = block_rows or BLOCK_ROWS
    numbered = number_rows_spread(df, keys, time)
    first = F.floor(F.greatest(F.col("rn") - ahead, F.lit(0)) / size)
    last = F.floor(F.least(F.col("rn") + back, F.col("n") - 1) / size)
    copies = numbered.withColumn("_block", F.explode(F.sequence(first, last))).withColumn(
        "_own", F.col("_block") == F.floor(F.col("rn") / size)
    )
    return Framed(copies, series_window([*keys, "_block"], time), True)
