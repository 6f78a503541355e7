import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import business_days, close_to, day, frame, pandas_sorted
from volpanel.functions import market as M
from volpanel.functions import small_stats as Q
from volpanel.functions.normal import norm_cdf
from volpanel.operators import chains
from volpanel.operators import metrics as E
from volpanel.operators import trades as B
from volpanel.operators.options import with_option_prices
from volpanel.operators.spikes import spike_windows
from volpanel.operators.surface import atm_tenors, wide_to_long
from volpanel.plans import experiments as P

N = NormalDist()


def test_normal_distribution(spark):
    xs = [i / 9 for i in range(-360, 361)]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").coalesce(1).select(norm_cdf(F.col("x"))).collect()]
    want = [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs]
    np.testing.assert_allclose(got, want, atol=1e-15)


def test_prices_parity_and_vega(spark):
    rows = [(5.0, 5.0 * m, t, s) for m in (0.7, 1.0, 1.4) for t in (0.05, 1.0) for s in (0.1, 0.6)]
    df = spark.createDataFrame(rows, "f double, k double, t double, s double")
    f, k, t, s = (F.col(c) for c in "fkts")
    out = with_option_prices(df, f, k, t, s, 0.1).withColumn("v", M.futures_vega(f, k, t, s, 0.1))
    up = with_option_prices(out.withColumn("s2", s + 1e-5), f, k, t, F.col("s2"), 0.1, "call_up", "put_up")
    for r in up.collect():
        close_to([r.call - r.put], [math.exp(-0.1 * r.t) * (r.f - r.k)], 1e-12)
        assert abs((r.call_up - r.call) / 1e-5 - r.v) < 1e-4
        d1 = (math.log(r.f / r.k) + r.s**2 / 2 * r.t) / (r.s * math.sqrt(r.t))
        want = math.exp(-0.1 * r.t) * (r.f * N.cdf(d1) - r.k * N.cdf(d1 - r.s * math.sqrt(r.t)))
        close_to([r.call], [want], 1e-9)


def test_price_needs_positive_time_and_volatility(spark):
    df = spark.createDataFrame([(5.0, 0.0)], "f double, t double")
    with pytest.raises(PySparkException):
        with_option_prices(df, F.col("f"), F.col("f"), F.col("t"), F.lit(0.1)).collect()


def test_sizing_reaches_the_target_vega(spark):
    df = spark.createDataFrame([(5.0, 12.0)], "f double, iv double")
    r = df.select(M.straddle_contracts(1000.0, F.col("f"), 21, F.col("iv")).alias("n"), M.straddle_vega_point(F.col("f"), 21, F.col("iv")).alias("v")).collect()[0]
    assert abs(r.n * r.v - 1000) < 1e-9
    cost = df.select(M.round_trip_cost(F.lit(2.0), F.lit(1.0), F.lit(-10.0), 0.05)).collect()[0][0]
    assert abs(cost - 1.5) < 1e-12


def greedy(rns, horizon):
    out, free = [], -1
    for r in sorted(rns):
        if r >= free:
            out.append(r)
            free = r + horizon
    return out


@pytest.mark.parametrize("horizon,block", [(1, 4), (5, 8), (7, 7), (21, 64)])
def test_non_overlapping_choice_equals_the_sequential_rule(spark, horizon, block):
    rng = np.random.default_rng(horizon)
    picks = {s: sorted(int(i) for i in rng.choice(300, n, replace=False)) for s, n in (("a", 250), ("b", 40), ("c", 3))}
    df = spark.createDataFrame([(s, i) for s, v in picks.items() for i in v], "series_id string, entry_rn long")
    got = B.pick_without_overlap(df, horizon, ["series_id"], block).collect()
    for s, v in picks.items():
        assert sorted(r.entry_rn for r in got if r.series_id == s) == greedy(v, horizon)


def test_choice_along_a_million_rows_of_one_series(spark):
    rng = np.random.default_rng(8)
    keep = np.flatnonzero(rng.random(1_000_000) < 0.3)
    pdf = pd.DataFrame({"series_id": "a", "entry_rn": keep})
    got = B.pick_without_overlap(spark.createDataFrame(pdf).repartition(4), 13, ["series_id"], 64).toPandas().entry_rn.sort_values().tolist()
    assert got == greedy(keep.tolist(), 13)


def test_choice_over_levels_and_missing_blocks(spark, monkeypatch):
    monkeypatch.setattr(chains.entry_states, "__defaults__", (3,))
    rns = [*range(0, 90, 2), *range(400, 470), 900, 905, 1500]
    df = spark.createDataFrame([(s, i) for s in "ab" for i in rns[: 60 if s == "b" else None]], "series_id string, entry_rn long")
    got = B.pick_without_overlap(df, 5, ["series_id"], 8).collect()
    for s in "ab":
        assert sorted(r.entry_rn for r in got if r.series_id == s) == greedy(rns[: 60 if s == "b" else None], 5)


def test_intraday_trades_equal_those_of_the_same_rows_as_days(spark):
    prices, forecast, implied = market(spark, 400, 3)
    as_days = pandas_sorted(B.run_backtest(*(frame(spark, p) for p in (prices, forecast, implied)), 7), "entry_date")
    minute = {d: pd.Timestamp("2024-03-01 10:00") + pd.Timedelta(minutes=i) for i, d in enumerate(prices.date)}
    inside = [spark.createDataFrame(p.assign(date=[minute[d] for d in p.date])).repartition(3) for p in (prices, forecast, implied)]
    out = pandas_sorted(B.run_backtest(*inside, 7), "entry_date")
    assert out.entry_date.tolist() == [minute[d] for d in as_days.entry_date] and out.exit_date.tolist() == [minute[d] for d in as_days.exit_date]
    close_to(out.pnl_net, as_days.pnl_net)


def test_a_horizon_beyond_the_block_is_followed_too(spark):
    """A horizon longer than a block widens the blocks; the choice stays that of the sequential rule."""
    rns = sorted(int(i) for i in np.random.default_rng(3).choice(20_000, 500, replace=False))
    df = spark.createDataFrame([("a", i) for i in rns], "series_id string, entry_rn long")
    for horizon in (9, 3000):
        got = sorted(r.entry_rn for r in B.pick_without_overlap(df, horizon, ["series_id"], 8).collect())
        assert got == greedy(rns, horizon)


def market(spark, n=160, seed=0):
    rng = np.random.default_rng(seed)
    days = business_days(n)
    price = 5 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    prices = pd.DataFrame({"series_id": "a", "date": days, "close": price})
    forecast = prices.assign(rv_forecast=rng.normal(15, 3, n))[["series_id", "date", "rv_forecast"]][10:]
    implied = prices.assign(iv_proxy=rng.normal(15, 3, n))[["series_id", "date", "iv_proxy"]].drop(index=[30, 31])
    return prices, forecast, implied


def brute_force(prices, forecast, implied, horizon, band):
    pos = {d: i for i, d in enumerate(prices.date)}
    fc, iv = dict(zip(forecast.date, forecast.rv_forecast)), dict(zip(implied.date, implied.iv_proxy))
    out, free = [], -1
    for d in sorted(set(fc) & set(iv)):
        spread = fc[d] - iv[d]
        sig = 1 if spread > band else -1 if spread < -band else 0
        i = pos[d]
        if sig == 0 or i < free:
            continue
        if i + horizon >= len(prices):
            break
        s0, s1 = prices.close[i], prices.close[i + horizon]
        t, sg = horizon / 365, iv[d] / 100
        d1 = sg * math.sqrt(t) / 2
        premium = 2 * s0 * (N.cdf(d1) - N.cdf(-d1))
        n = 1000 / (2 * s0 * N.pdf(d1) * math.sqrt(t) * 0.01)
        gross = sig * n * (abs(s1 - s0) - premium)
        out.append((d, prices.date[i + horizon], sig, n, premium, gross, gross - n * premium * 0.05))
        free = i + horizon
    return out


def test_backtest_equals_a_loop(spark):
    data = market(spark)
    out = B.run_backtest(*(frame(spark, x) for x in data), horizon=21, bands=[0.5, 2.0])
    for band in (0.5, 2.0):
        got = pandas_sorted(out.filter(F.col("band_pct") == band), "entry_date")
        want = brute_force(*data, 21, band)
        assert got.entry_date.tolist() == [w[0] for w in want] and got.exit_date.tolist() == [w[1] for w in want]
        assert got.signal.tolist() == [w[2] for w in want]
        for c, j in (("n_contracts", 3), ("premium", 4), ("pnl_gross", 5), ("pnl_net", 6)):
            close_to(got[c], [w[j] for w in want], 1e-9)
        assert (got.entry_date[1:].to_numpy() >= got.exit_date[:-1].to_numpy()).all()


def test_summary_and_empty_groups(spark):
    trades = spark.createDataFrame(
        [("a", 1.0, 1, 2.0, 1.0, 1.0), ("a", 1.0, -1, 2.0, 1.0, -1.0), ("a", 1.0, 1, 2.0, 1.0, 4.0)],
        "series_id string, band_pct double, signal int, n_contracts double, premium double, pnl_net double")
    grid = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "series_id string, band_pct double")
    out = {r.band_pct: r for r in B.summarize(trades, grid).collect()}
    assert out[2.0].n_trades == 0 and out[2.0].sharpe is None
    r = np.array([0.5, -0.5, 2.0])
    close_to([out[1.0].win_rate, out[1.0].total_pnl, out[1.0].sharpe], [2 / 3, 4.0, r.mean() / r.std(ddof=1) * math.sqrt(12)])
    assert (out[1.0].n_long_vol, out[1.0].n_short_vol) == (2, 1)


def test_sharpe_edge_cases(spark):
    df = spark.createDataFrame([("one", 1.0), ("flat", 2.0), ("flat", 2.0)], "k string, x double")
    out = {r.k: r.s for r in df.groupBy("k").agg(E.sharpe("x", 252).alias("s")).collect()}
    assert out == {"one": None, "flat": 0.0}


def test_deflated_sharpe(spark):
    rows = [("a", 0.5, 10, 1.2, 0.1, 3.2), ("a", 1.0, 8, 1.0, -0.2, 3.5), ("a", 1.5, 1, None, None, None), ("b", 1.0, 9, 0.4, 0.0, 3.0)]
    s = spark.createDataFrame(rows, "series_id string, band_pct double, n_trades long, sharpe double, ret_skew double, ret_kurtosis double")
    out = {r.series_id: r for r in B.deflated_sharpe(s).collect()}
    sd = np.std([1.2, 1.0], ddof=1)
    bar = sd * ((1 - Q.EULER_MASCHERONI) * N.inv_cdf(1 - 1 / 2) + Q.EULER_MASCHERONI * N.inv_cdf(1 - 1 / (2 * math.e)))
    z = (1.0 - bar) * math.sqrt(7) / math.sqrt(1 + 0.2 + 2.5 / 4)
    close_to([out["a"].benchmark, out["a"].dsr], [bar, N.cdf(z)], 1e-12)
    assert out["b"].dsr is None and out["b"].n_trials == 1


def test_more_trials_raise_the_bar_and_one_is_an_error(spark):
    df = spark.createDataFrame([(n,) for n in (2, 5, 50)], "n int").coalesce(1)
    got = [r[0] for r in df.select(E.expected_best_sharpe(F.lit(1.0), F.col("n"))).collect()]
    assert got == sorted(got)
    with pytest.raises(PySparkException):
        spark.createDataFrame([(1,)], "n int").select(E.expected_best_sharpe(F.lit(1.0), F.col("n"))).collect()


def test_small_statistics():
    def exact(k, n):
        p = [math.comb(n, i) / 2**n for i in range(n + 1)]
        return min(1.0, sum(x for x in p if x <= p[k] * (1 + 1e-12)))

    for n in (1, 2, 7, 40, 401):
        for k in {0, n // 3, n // 2, n}:
            low = min(k, n - k)
            got = 1.0 if 2 * low >= n else min(1.0, 2 * Q.incomplete_beta([n - low], [low + 1], [0.5])[0])
            assert abs(got - exact(k, n)) < 1e-12
    # Two-sided t at 2.0 with 10 and 1 degrees of freedom (tabulated).
    p = lambda t, v: Q.incomplete_beta([v / 2], [0.5], [v / (v + t * t)])[0]
    assert abs(p(2.0, 10) - 0.07338803477074) < 1e-10
    assert abs(p(1.0, 1) - 0.5) < 1e-12


def test_surface_interpolates_total_variance(spark):
    r0 = day("2024-01-01")
    rows = [("s", r0, day("2024-01-11"), 50.0, 10.0), ("s", r0, day("2024-01-31"), 50.0, 20.0), ("s", r0, day("2024-01-31"), 25.0, 99.0)]
    df = spark.createDataFrame(rows, "series_id string, refdate date, maturity_date date, delta_pct double, iv_pct double")
    out = {r.tenor: r for r in atm_tenors(df, [5, 10, 20, 30, 60]).collect()}
    mid = math.sqrt((0.01 * 10 + 0.5 * (0.04 * 30 - 0.01 * 10)) / 20) * 100
    close_to([out[t].iv_atm_pct for t in (5, 10, 20, 30, 60)], [10, 10, mid, 20, 20])
    assert out[20].target_date == day("2024-01-21")


def test_wide_sheet_drops_notes_and_text_cells(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-02-01", "1.5", "n/a"), ("2024-01-01", "total", "9", "9")], "refdate string, maturity_date string, `25` string, `50` string")
    out = wide_to_long(df, ["refdate"], ["25", "50"]).collect()
    assert [(r.delta_pct, r.iv_pct) for r in out] == [(25.0, 1.5)]


def spikes(values, top, gap):
    taken = []
    for v, d in sorted(((-v, d) for d, v in values.items() if v == v)):
        if len(taken) < top and all(abs((d - t).days) >= gap for t in taken):
            taken.append(d)
    return sorted(taken)


@pytest.mark.parametrize("top,gap", [(2, 10), (15, 10), (5, 3)])
def test_spikes_equal_the_greedy_rule(spark, top, gap):
    rng = np.random.default_rng(top)
    days = business_days(400)
    values = dict(zip(days, np.round(rng.normal(0, 1, 400).cumsum(), 1)))
    df = spark.createDataFrame([("a", d, float(v)) for d, v in values.items()], "series_id string, date date, v double")
    got = pandas_sorted(spike_windows(df, "v", top, 3, gap), "spike_date")
    assert got.spike_date.tolist() == spikes(values, top, gap)
    assert (got.window_start[0] - got.spike_date[0]).days == -3


def test_signal_today(spark):
    rv = spark.createDataFrame([("a", day("2024-01-02"), 10.0), ("a", day("2024-01-03"), 14.0), ("a", day("2024-01-04"), None)], "series_id string, date date, range_vol_21 double")
    iv = spark.createDataFrame([("a", day("2024-01-03"), 12.0), ("a", day("2024-01-02"), 40.0)], "series_id string, refdate date, iv_atm_pct double")
    spot = spark.createDataFrame([("a", day("2024-01-04"), 5.0)], "series_id string, date date, close double")
    r = P.signal_today(rv, iv, spot).collect()[0]
    assert (r.signal, r.date, r.spot_date) == (1, day("2024-01-03"), day("2024-01-04"))
