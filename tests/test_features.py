import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from helpers import business_days, close_to, frame, pandas_sorted, walk
from volpanel.functions import market as M
from volpanel.operators import features as W
from volpanel.operators.panel import framed, nan_to_null, number_rows, number_rows_spread, range_buckets, to_panel


def test_har_features_and_target_match_pandas(spark):
    pdf = pd.concat([walk(80, 1), walk(60, 2, series="b")])
    out = pandas_sorted(W.har_features(W.range_variance(frame(spark, pdf)), horizons=[5]), "series_id", "date")
    for key, g in pdf.groupby("series_id"):
        v = np.log(g.high / g.low) ** 2 / (4 * math.log(2))
        got = out[out.series_id == key]
        close_to(got.rv_d, v)
        close_to(got.rv_w, v.rolling(5).mean())
        close_to(got.rv_m, v.rolling(22).mean())
        close_to(got.target_5, np.sqrt(v.rolling(5).mean().shift(-5) * 252) * 100)


def test_realized_and_range_vol(spark):
    pdf = walk(60, 3)
    df = frame(spark, pdf)
    r = np.log(pdf.close).diff()
    close_to(pandas_sorted(W.realized_vol(df, windows=[21]), "date").rv_21, r.rolling(21).std() * math.sqrt(252) * 100)
    v = np.log(pdf.high / pdf.low) ** 2 / (4 * math.log(2))
    close_to(pandas_sorted(W.range_vol(df, [21]), "date").range_vol_21, np.sqrt(v.rolling(21).mean() * 252) * 100)


def test_range_variance_does_not_depend_on_scale(spark):
    pdf = walk(30, 4)
    scaled = pdf.assign(high=pdf.high * 1000, low=pdf.low * 1000)
    a = pandas_sorted(W.range_variance(frame(spark, pdf)), "date").variance
    close_to(a, pandas_sorted(W.range_variance(frame(spark, scaled)), "date").variance)


def test_signed_variance_adds_up_and_gap(spark):
    pdf = walk(40, 5)
    out = pandas_sorted(W.gap_and_sign(W.range_variance(frame(spark, pdf))), "date")
    close_to((out.rv_d_pos + out.rv_d_neg)[1:], out.variance[1:])
    assert out.rv_d_pos[0] == 0.0 and out.rv_d_neg[0] == 0.0
    close_to(out.overnight, np.log(pdf.open / pdf.close.shift(1)) ** 2)


def test_forward_skew_matches_pandas_with_missing_returns(spark):
    rng = np.random.default_rng(6)
    r = pd.Series(rng.normal(0, 0.01, 120))
    r[::21] = np.nan
    r[60:85] = 0.25
    pdf = pd.DataFrame({"series_id": "a", "date": business_days(120), "ret": r})
    out = pandas_sorted(W.forward_skew(frame(spark, pdf, "series_id string, date date, ret double"), "ret", [10, 21]), "date")
    close_to(out.skew_10, r.rolling(10, min_periods=7).skew().shift(-10), 1e-7)
    close_to(out.skew_21, r.rolling(21, min_periods=18).skew().shift(-21), 1e-7)


def test_surprise_matches_pandas_and_uses_no_future(spark):
    rng = np.random.default_rng(7)
    x = pd.Series(rng.normal(5, 1, 150))
    pdf = pd.DataFrame({"series_id": "a", "date": business_days(150), "x": x})
    out = pandas_sorted(W.surprise(frame(spark, pdf), "x"), "date").surprise
    mean, sd = x.rolling(63, min_periods=21).mean(), x.rolling(63, min_periods=21).std()
    close_to(out, (x - mean) / sd, 1e-9)
    cut = pandas_sorted(W.surprise(frame(spark, pdf[:100]), "x"), "date").surprise
    close_to(cut, out[:100])


def test_surprise_of_a_constant_is_null(spark):
    pdf = pd.DataFrame({"series_id": "a", "date": business_days(40), "x": 0.1})
    assert pandas_sorted(W.surprise(frame(spark, pdf), "x"), "date").surprise.isna().all()


def test_row_blocks_give_the_series_window_result(spark):
    pdf = pd.concat([walk(333, 8), walk(7, 9, series="b"), walk(64, 10, series="c")])
    df = W.range_variance(frame(spark, pdf))
    plain = pandas_sorted(W.har_features(df, horizons=[3, 21]), "series_id", "date")
    blocks = pandas_sorted(W.har_features(df, horizons=[3, 21], block_rows=16), "series_id", "date")
    assert list(plain.columns) == list(blocks.columns)
    pd.testing.assert_frame_equal(plain, blocks)


def test_a_hot_series_spreads_over_ranges_and_blocks(spark):
    """One series holds most of the rows: no range and no block holds more than its share."""
    t0 = pd.Timestamp("2024-01-01")
    long = [("hot", (t0 + pd.Timedelta(minutes=i)).to_pydatetime(), float(i % 7)) for i in range(4000)]
    short = [(f"s{j}", (t0 + pd.Timedelta(minutes=i)).to_pydatetime(), float(i)) for j in range(20) for i in range(50)]
    df = spark.createDataFrame(long + short, "series_id string, date timestamp, x double")
    ranges = range_buckets(df, ["series_id"], "date", 10).groupBy("_bucket").count().collect()
    assert len(ranges) >= 9 and max(r["count"] for r in ranges) < 1000
    fr = framed(df, back=62, block_rows=256)
    sizes = fr.df.groupBy("series_id", "_block").count().collect()
    assert max(r["count"] for r in sizes) <= 256 + 62 and len(sizes) >= 16 + 20
    out = fr.close(fr.df.withColumn("m", F.avg("x").over(fr.window.rowsBetween(-62, 0))))
    got = pandas_sorted(out.filter("series_id = 'hot'"), "date").m
    close_to(got, pd.Series([r[2] for r in long]).rolling(63, min_periods=1).mean())


def test_timestamp_panels_take_the_block_path(spark):
    n = 500
    ts = pd.date_range("2024-01-01", periods=n, freq="h")
    x = np.random.default_rng(1).normal(0, 1, n)
    rows = [("a", t.to_pydatetime(), float(v)) for t, v in zip(ts, x)]
    df = spark.createDataFrame(rows, "series_id string, date timestamp, x double")
    out = pandas_sorted(W.surprise(df, "x", block_rows=64), "date").surprise
    s = pd.Series(x)
    close_to(out, (s - s.rolling(63, min_periods=21).mean()) / s.rolling(63, min_periods=21).std(), 1e-9)


def test_row_numbers_agree_across_ranges(spark):
    df = frame(spark, pd.concat([walk(400, 11)[["series_id", "date", "close"]], walk(5, 1, series="b")[["series_id", "date", "close"]]]))
    a = pandas_sorted(number_rows(df), "series_id", "date")
    b = pandas_sorted(number_rows_spread(df, buckets=7), "series_id", "date")
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_exogenous_changes_smooth_shift(spark):
    pdf = pd.DataFrame({"date": business_days(30), "v": np.arange(30.0) ** 2, "d": np.arange(1.0, 31.0)})
    out = pandas_sorted(W.exogenous_changes(frame(spark, pdf), "v", "d"), "date")
    close_to(out.vix_change, pdf.v.diff())
    close_to(out.dxy_return, np.log(pdf.d).diff())
    sm = pandas_sorted(W.smooth(frame(spark, pdf), "v", 5, ()), "date").v
    close_to(sm, pdf.v.rolling(5, min_periods=1).mean())
    keyed = frame(spark, pdf.assign(series_id="a"))
    moved = pandas_sorted(W.shifted(keyed, "v", [-1, 0, 1]), "date")
    close_to(moved.v_s1, pdf.v.shift(1))
    close_to(moved.v_sm1, pdf.v.shift(-1))


def test_roll_days_have_no_return(spark):
    pdf = pd.DataFrame({"series_id": "a", "date": business_days(4), "settlement": [1.0, 2.0, 4.0, 8.0], "contract_changed": [False, False, True, False]})
    out = pandas_sorted(W.roll_free_returns(frame(spark, pdf)), "date").ret
    close_to(out, [np.nan, math.log(2), np.nan, math.log(2)])


def test_gap_breaks(spark):
    pdf = pd.DataFrame({"series_id": "a", "date": [pd.Timestamp(d).date() for d in ("2024-01-01", "2024-01-03", "2024-01-20")], "x": [1.0, 2.0, 3.0]})
    out = pandas_sorted(W.gap_breaks(frame(spark, pdf), "x", 5), "ts")
    assert out.is_break.tolist() == [False, False, True, False]
    assert out.ts[2] == pd.Timestamp("2024-01-17 12:00:00") and np.isnan(out.x[2])


def test_panel_drops_nan_and_null_dates(spark):
    df = spark.createDataFrame([("a", "2024-01-01", float("nan")), ("a", None, 1.0), ("a", "2024-01-02", 2.0)], "s string, d string, v double")
    out = to_panel(df, "s", F.to_date("d"), value="v")
    assert sorted(map(tuple, out.select("series_id", "value").collect()), key=str) == [("a", 2.0), ("a", None)]
    assert nan_to_null(df.filter("d IS NULL")).collect()[0].v == 1.0


def test_running_total_and_thinning(spark):
    pdf = pd.DataFrame({"series_id": "a", "date": business_days(10), "x": np.arange(10.0)})
    df = frame(spark, pdf)
    close_to(pandas_sorted(W.running_total(df, "x"), "date").running, pdf.x.cumsum())
    assert pandas_sorted(W.every_nth(number_rows(df), 4), "date").x.tolist() == [0.0, 4.0, 8.0]


def test_signal_band_and_theta(spark):
    df = spark.createDataFrame([(11.0, 10.0), (11.01, 10.0), (8.9, 10.0), (None, 10.0)], "f double, i double")
    assert [r[0] for r in df.select(M.dead_band_signal(F.col("f"), F.col("i"), 1.0)).collect()] == [0, 1, -1, 0]
    got = [r[0] for r in spark.createDataFrame([(0.0,), (-2.0,)], "g double").select(M.theta(F.col("g"))).collect()]
    close_to(got, [1.0, math.exp(-1)])
