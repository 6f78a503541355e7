"""Panels built from the driver's tables, standing in for market, macro and news data.

Raw rows are aggregated to one row per series and day first, with hash aggregation combined before the
shuffle, so no series or day is ever gathered whatever share of the raw rows it holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volpanel.functions import market as M
from volpanel.operators import features as W
from volpanel.operators.text import NEGATIVE, NEUTRAL, POSITIVE, signed
from volpanel.sources.exchange import paired_closes

FIRST_DAY = "1995-01-02"
HEADLINE_DAYS = 2000
# A prime, so that scaled prices are no short decimals, which two engines may round apart at a tie.
PRICE_UNIT = 99_991
# The query's own small lexicon, frequent words of the four languages.
GOOD_WORDS = ("for", "with", "by", "und", "et", "los")
BAD_WORDS = ("that", "on", "as", "die", "que", "el")
TENORS = (13, 42, 72)
DELTAS = (25, 50, 75)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column, digits: int = 6) -> Column:
    """Six decimals, negative zero removed."""
    return F.round(c, digits) + F.lit(0.0)


def unit_price() -> Column:
    """Unit price moved to the level of a currency pair, so that volatilities come out in usual sizes."""
    return F.col("l_extendedprice") / F.col("l_quantity") / PRICE_UNIT + 5


def _row_order() -> Column:
    """Total order of a day's trades as one fixed-width number, which keeps the aggregation hash based.

    Order key, line number, price in cents and quantity; rows equal in all of them have the same price.
    """
    low = F.col("l_linenumber") * F.lit(10**13) + F.round(F.col("l_extendedprice") * 100).cast("long") * 1000
    low = low + F.col("l_quantity").cast("long")
    return F.col("l_orderkey").cast("decimal(20,0)") * F.lit(10**14).cast("decimal(15,0)") + low


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, open, high, low, close, mean, trades) from lineitem unit prices, one scan."""
    px = unit_price()
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("date"),
        px.alias("px"), _row_order().alias("seq"),
    )
    return rows.groupBy("series_id", "date").agg(
        F.min_by("px", "seq").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
        F.max_by("px", "seq").alias("close"), F.avg("px").alias("mean"), F.count(F.lit(1)).alias("trades"),
    )


def mean_prices(daily: DataFrame) -> DataFrame:
    """(series_id, date, close): the day's mean price of bars."""
    return daily.select("series_id", "date", F.col("mean").alias("close"))


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with the high/low daily variance."""
    return W.range_variance(bars(spark, sf_dir))


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of daily contract rows: brand as ticker, trades and open interest from line items.

    ``open`` is missing where the brand traded once that day.
    """
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("ticker"))
    px = unit_price()
    daily = li.join(part, "l_partkey").groupBy(F.to_date("l_shipdate").alias("date"), "ticker").agg(
        F.avg(px).alias("settlement"), F.min(px).alias("low"), F.max(px).alias("high"),
        F.count(F.lit(1)).cast("double").alias("trades"), F.sum("l_quantity").alias("open_interest"),
    )
    return daily.select(
        F.lit("front").alias("series_id"), "date", "ticker", "settlement",
        F.when(F.col("trades") > 1, F.col("low")).alias("open"), F.col("high").alias("last"), "low", "high",
        "open_interest", "trades",
    )


def official(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, value): scaled daily mean order price by priority, a second calendar."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / PRICE_UNIT).alias("value")
    )


def risk_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, vix_close, dxy_close): two priorities as an exogenous pair."""
    long = official(spark, sf_dir).select("date", F.col("series_id").alias("ticker"), F.col("value").alias("close"))
    return paired_closes(long, {"vix": "1-URGENT", "dxy": "5-LOW"})


def attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, share_pct): share of urgent orders per day."""
    o = table(spark, sf_dir, "orders")
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.try_divide(urgent, F.count(F.lit(1))) * 100).alias("share_pct")
    )


def attention_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = attention(spark, sf_dir).withColumn("series_id", F.lit("attention"))
    return W.surprise(one, "share_pct").drop("series_id")


def hourly_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, n, total, share_pct) by event type and hour; ``date`` is a TIMESTAMP."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("hour", "ts").cast("timestamp").alias("date"), "event_type")
    n = e.groupBy("date", F.col("event_type").alias("series_id")).agg(F.count(F.lit(1)).alias("events"))
    return n.withColumn("total", F.sum("events").over(Window.partitionBy("date"))).select(
        "series_id", "date", "events", "total", (F.try_divide(F.col("events"), F.col("total")) * 100).alias("share_pct")
    )


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, title, url, language, query) from documents."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("doc_id") % HEADLINE_DAYS).cast("int")).alias("date"),
        F.col("text").alias("title"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("language"), F.col("source").alias("query"), "doc_id",
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, label, score, signed_score, doc_id) of labelled documents."""
    rows = headlines(spark, sf_dir).select("date", "doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    label = F.when(F.col("toxic") == 1, NEGATIVE).when(F.col("quality") == 1, POSITIVE).otherwise(NEUTRAL)
    rows = rows.select("doc_id", "date", label.alias("label"), F.lit(0.75).alias("score"))
    return rows.withColumn("signed_score", signed(F.col("label"), F.col("score")))


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(date, pi_expectation, dispersion): mean and spread of order prices, scaled."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        (F.avg("o_totalprice") / PRICE_UNIT).alias("pi_expectation"), (F.stddev_samp("o_totalprice") / PRICE_UNIT).alias("dispersion")
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, meta): yearly mean; the last dates look a year ahead of the data, so their target falls back."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year"))
    return o.agg((F.avg("o_totalprice") / PRICE_UNIT).alias("meta"))


def surface(daily: DataFrame) -> DataFrame:
    """(series_id, refdate, maturity_date, delta_pct, iv_pct): month-start quotes scaled to trailing volatility."""
    vol = W.range_vol(daily, [21]).filter(F.col("range_vol_21").isNotNull())
    month = F.add_months(F.trunc("date", "month"), 1)
    level = vol.groupBy("series_id", month.alias("refdate")).agg(F.avg("range_vol_21").alias("level"))
    quotes = F.array(
        *[
            F.struct(F.lit(t).alias("t"), F.lit(float(d)).alias("delta_pct"), F.lit(0.8 + t / 400 + abs(d - 50) / 500).alias("k"))
            for t in TENORS for d in DELTAS
        ]
    )
    q = level.withColumn("_q", F.explode(quotes))
    return q.select(
        "series_id", "refdate", F.date_add("refdate", F.col("_q.t")).alias("maturity_date"),
        F.col("_q.delta_pct").alias("delta_pct"), (F.col("level") * F.col("_q.k")).alias("iv_pct"),
    )


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, reference_date, release_date, value): monthly order counts by priority."""
    o = table(spark, sf_dir, "orders")
    month = F.to_date(F.trunc(F.to_date("o_orderdate"), "month"))
    m = o.groupBy(F.col("o_orderpriority").alias("series_id"), month.alias("reference_date")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )
    return m.withColumn("release_date", F.date_add("reference_date", 60))


def trade_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date, close): mean unit price per day."""
    px = unit_price()
    return table(spark, sf_dir, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("date")
    ).agg(F.avg(px).alias("close"))


def persistence_forecast(dataset: DataFrame) -> DataFrame:
    return dataset.select("series_id", "date", M.annual_pct(F.col("rv_m")).alias("rv_forecast"))
