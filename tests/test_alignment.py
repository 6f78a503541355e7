import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import business_days, close_to, day, frame, pandas_sorted, walk
from volpanel.operators import features as W
from volpanel.operators.anchoring import anchoring, blended_target, target_gap
from volpanel.operators.asof import asof_join, asof_point, asof_shared
from volpanel.operators.contracts import front_contract
from volpanel.operators.keep import keep_one, read_table, union_all, upsert, upsert_table
from volpanel.plans import datasets as D
from volpanel.plans import diagnostics as G
from volpanel.session import scratch_path


def sides(spark, seed=0):
    rng = np.random.default_rng(seed)
    days = business_days(60)
    left = pd.DataFrame([(s, d) for s in "ab" for d in days if rng.random() < 0.7], columns=["series_id", "date"])
    right = pd.DataFrame(
        [(s, d, None if rng.random() < 0.3 else rng.random()) for s in "ab" for d in days[5:] if rng.random() < 0.3],
        columns=["series_id", "date", "v"],
    )
    return left, right


def expected(left, right):
    out = []
    for s, g in left.groupby("series_id"):
        r = right[right.series_id == s].set_index("date").v.astype(float)
        out.append(g.assign(v=r.reindex(pd.Index(sorted(g.date)), method="ffill").to_numpy()))
    return pd.concat(out).reset_index(drop=True)


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_asof_takes_the_last_label_even_if_null(spark, buckets):
    left, right = sides(spark)
    got = asof_join(frame(spark, left), frame(spark, right, "series_id string, date date, v double"), buckets=buckets)
    close_to(pandas_sorted(got, "series_id", "date").v, expected(left, right).v)


def test_asof_on_timestamps(spark):
    t0 = dt.datetime(2024, 1, 1)
    left = spark.createDataFrame([("a", t0 + dt.timedelta(days=40 * i)) for i in range(6)], "series_id string, date timestamp")
    right = spark.createDataFrame([("a", t0 + dt.timedelta(days=40), 1.0), ("a", t0 + dt.timedelta(days=130), 2.0)], "series_id string, date timestamp, v double")
    close_to(pandas_sorted(asof_join(left, right), "date").v, [np.nan, 1, 1, 1, 2, 2])


def test_asof_shared_and_point(spark):
    left, right = sides(spark, 1)
    one = right[right.series_id == "a"][["date", "v"]]
    got = pandas_sorted(asof_shared(frame(spark, left), frame(spark, one, "date date, v double")), "series_id", "date")
    both = pd.concat([one.assign(series_id=s) for s in "ab"])
    close_to(got.v, expected(left, both).v)
    series = frame(spark, walk(10)[["series_id", "date", "close"]])
    at = spark.createDataFrame([("a", day("2024-01-07"))], "series_id string, at date")
    hit = asof_point(series, "close", at, "at").collect()[0]
    assert hit["close_date"] == day("2024-01-05")


def test_dataset_values_do_not_change_when_the_future_is_cut(spark):
    pdf = walk(160, 2)
    news = pd.DataFrame({"date": business_days(160)[::3], "news": np.random.default_rng(0).normal(size=54)})

    def build(n, m):
        bars = W.range_variance(frame(spark, pdf[:n]))
        return pandas_sorted(D.base_dataset(bars, 5, frame(spark, news[:m]), "news", 4), "date")

    whole, cut = build(160, 54), build(100, 34)
    shared = whole.merge(cut, on="date", suffixes=("", "_c"))
    assert len(shared) == len(cut)
    for c in (*D.NEWS, "target"):
        close_to(shared[c], shared[c + "_c"])


def test_news_is_smoothed_on_its_own_calendar(spark):
    pdf = walk(60, 3)
    news = pd.DataFrame({"date": business_days(60)[::2], "news": np.arange(30.0)})
    out = pandas_sorted(D.base_dataset(W.range_variance(frame(spark, pdf)), 5, frame(spark, news), "news", 5), "date")
    smooth = pd.Series(news.news.rolling(5, min_periods=1).mean().to_numpy(), index=news.date)
    close_to(out.news, smooth.reindex(pd.Index(out.date), method="ffill"))


def contracts(spark, rows):
    return spark.createDataFrame(
        rows, "series_id string, date date, ticker string, settlement double, open double, last double, low double, high double, open_interest double, trades double"
    )


def test_instants_give_what_the_same_rows_give_as_days(spark):
    """Front contract, bar quality and lead/lag on a long intraday calendar and on as many days."""
    n, rng = 300, np.random.default_rng(2)
    bars = walk(n, 5)
    minute = {d: pd.Timestamp("2024-03-01 10:00") + pd.Timedelta(minutes=i) for i, d in enumerate(bars.date)}
    inside = lambda pdf: spark.createDataFrame(pdf.assign(date=[minute[d] for d in pdf.date])).repartition(3)
    days, instants = G.bar_quality(frame(spark, bars)).collect()[0], G.bar_quality(inside(bars)).collect()[0]
    close_to(list(days)[1:], list(instants)[1:])
    returns = bars[["series_id", "date"]].assign(ret=rng.normal(size=n))
    rate = pd.DataFrame({"date": bars.date, "value": np.exp(rng.normal(0, 0.1, n).cumsum())})
    a, b = (pandas_sorted(G.lead_lag(*(f(p) for p in (returns, rate)), (-2, 0, 1)), "shift") for f in (lambda p: frame(spark, p), inside))
    close_to(a.r, b.r)
    chain = pd.concat([bars[["series_id", "date"]].assign(
        ticker=t, trades=rng.integers(0, 5, n), open_interest=1.0, settlement=1.0, open=1.0, last=1.0, low=1.0, high=1.0) for t in ("x", "y")])
    a, b = (pandas_sorted(front_contract(f(chain)), "date") for f in (lambda p: frame(spark, p), inside))
    assert a.ticker.tolist() == b.ticker.tolist() and a.contract_changed.tolist() == b.contract_changed.tolist() and a.contract_changed.sum() > 50


def test_front_contract_rolls_and_fills(spark):
    d1, d2 = day("2024-01-02"), day("2024-01-03")
    df = contracts(spark, [
        ("f", d1, "A", 5.0, None, 5.0, 4.0, 6.0, 10.0, 100.0), ("f", d1, "B", 7.0, 6.5, 7.0, 6.0, 8.0, 99.0, 50.0),
        ("f", d2, "A", 5.1, 5.0, 5.1, 4.1, 6.1, 10.0, None), ("f", d2, "B", 7.1, 7.0, 7.1, 6.1, 8.1, 5.0, 50.0),
        ("f", d2, "C", 9.1, 9.0, 9.1, 9.1, 9.1, 6.0, 50.0),
    ])
    filled = pandas_sorted(front_contract(df), "date")
    assert filled.ticker.tolist() == ["A", "C"] and filled.contract_changed.tolist() == [False, True]
    assert filled.open.tolist() == [6.5, 9.0]
    own = pandas_sorted(front_contract(df, fill_from_next=False), "date")
    assert np.isnan(own.open[0]) and own.settlement.tolist() == [5.0, 9.1]
    assert front_contract(contracts(spark, [])).count() == 0


def test_keep_one_orders_nulls_last_and_is_deterministic(spark):
    df = spark.createDataFrame([("k", day("2024-01-02"), 1), ("k", None, 2), ("k", day("2024-01-01"), 3)], "k string, date date, v int")
    assert keep_one(df, ["k"], ["date"]).collect()[0].v == 2
    assert keep_one(df, ["k"], ["date"], "first").collect()[0].v == 3
    assert keep_one(df, ["k"], ["date"]).columns == df.columns


def test_upsert_prefers_new_or_history(spark):
    h = spark.createDataFrame([("a", day("2024-01-01"), 1.0), ("b", day("2024-01-01"), 2.0)], "k string, date date, v double")
    n = spark.createDataFrame([("a", day("2024-01-01"), 9.0), ("c", day("2024-01-01"), 3.0)], "k string, date date, v double")
    newest = {r.k: r.v for r in upsert(h, n, ["k", "date"]).collect()}
    assert newest == {"a": 9.0, "b": 2.0, "c": 3.0}
    assert {r.k: r.v for r in upsert(h, n, ["k", "date"], keep="first").collect()}["a"] == 1.0


@pytest.mark.parametrize("parts", [(), ("q",)])
def test_upsert_table_is_idempotent(spark, parts):
    path = scratch_path(spark, "t")
    schema = "q string, date date, v double"
    first = spark.createDataFrame([("x", day("2024-01-01"), 1.0), ("y", day("2024-01-01"), 2.0)], schema)
    second = spark.createDataFrame([("x", day("2024-01-01"), 5.0), ("x", day("2024-01-02"), 6.0)], schema)
    for batch in (first, second, second):
        out = upsert_table(batch, path, ["q", "date"], partition_by=parts)
    assert sorted(map(str, out.collect())) == sorted(map(str, read_table(spark, path).collect()))
    got = sorted((r.q, r.date.isoformat(), r.v) for r in read_table(spark, path).collect())
    assert got == [("x", "2024-01-01", 5.0), ("x", "2024-01-02", 6.0), ("y", "2024-01-01", 2.0)]


def test_an_unfinished_version_is_not_read(spark):
    path = scratch_path(spark, "t")
    row = spark.createDataFrame([("x", day("2024-01-01"), 1.0)], "q string, date date, v double")
    upsert_table(row, path, ["q", "date"])
    row.withColumn("v", F.lit(9.0)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", False).parquet(f"{path}/version=2")
    assert [r.v for r in read_table(spark, path).collect()] == [1.0]
    upsert_table(row.withColumn("v", F.lit(3.0)), path, ["q", "date"])
    assert [r.v for r in read_table(spark, path).collect()] == [3.0]


def test_union_all_needs_a_frame():
    with pytest.raises(ValueError):
        union_all([])


def test_blended_target(spark):
    targets = spark.createDataFrame([(2023, 3.25), (2024, 3.0)], "year int, meta double")
    days = [day("2023-07-01"), day("2024-01-01"), day("2024-06-01"), day("2022-06-01"), day("2023-01-01")]
    survey = spark.createDataFrame([(d, 4.0, 0.4) for d in days], "date date, pi_expectation double, dispersion double")
    got = {r.date: r.meta for r in blended_target(survey, targets).collect()}
    w = 184 / 365
    close_to([got[days[0]], got[days[1]], got[days[2]]], [w * 3.25 + (1 - w) * 3.0, 3.0, 3.0])
    assert got[days[3]] is None
    out = {r.date: r for r in anchoring(target_gap(survey, targets)).collect()}
    close_to([out[days[1]].theta_baseline], [np.exp(-0.5)])
