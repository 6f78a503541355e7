import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import business_days, close_to, frame, pandas_sorted, walk
from volpanel.functions import small_stats as S
from volpanel.operators import chains
from volpanel.operators import features as W
from volpanel.operators import garch as Z
from volpanel.operators import metrics as E
from volpanel.operators import trend as Y
from volpanel.operators.folds import CountedFolds, LastShare, StepFolds, assign_folds, expanding_folds, fold_table
from volpanel.operators.panel import number_rows
from volpanel.operators.regression import fit_folds, predict_folds
from volpanel.operators.trend import one_sided_gap
from volpanel.plans import datasets as D
from volpanel.plans import experiments as P
from volpanel.plans import forecasts as C
from volpanel.session import scratch_path, stage, staging


def numbered(spark, n, series="a"):
    pdf = pd.DataFrame({"series_id": series, "date": business_days(n), "x": np.arange(n, dtype=float)})
    return number_rows(frame(spark, pdf))


def counted(n, k, purge):
    size = n // (k + 1)
    out = []
    for i in range(1, k + 1):
        test, train = range(size * i, min(n, size * (i + 1))), range(max(0, size * i - purge))
        if len(train) and len(test):
            out.append((i, list(train), list(test)))
    return out


def stepped(n, first, step, purge):
    out, i = [], 0
    while first + i * step < n:
        a = first + i * step
        train, test = range(max(0, a - purge)), range(a, min(n, a + step))
        if len(train) and len(test):
            out.append((i, list(train), list(test)))
        i += 1
    return out


@pytest.mark.parametrize(
    "scheme,want",
    [
        (CountedFolds(5, 21, 5), counted(203, 5, 26)),
        (CountedFolds(5, 60, 0), counted(203, 5, 60)),
        (expanding_folds(4), counted(203, 4, 0)),
        (StepFolds(50, 21, 10, 5), stepped(203, 50, 21, 15)),
        (StepFolds(10, 21, 10, 5), stepped(203, 10, 21, 15)),
        (LastShare(0.2), [(1, list(range(163)), list(range(163, 203)))]),
    ],
)
def test_folds(spark, scheme, want):
    data = numbered(spark, 203)
    bounds = {r.fold: r for r in fold_table(data, scheme).collect()}
    assert sorted(bounds) == [w[0] for w in want]
    rows = assign_folds(data, scheme).collect()
    for i, train, test in want:
        b = bounds[i]
        assert (b.train_end, b.test_start, b.test_end) == (len(train), test[0], test[-1] + 1)
        assert sorted(r.rn for r in rows if r.test_fold == i) == test
        assert sorted(r.rn for r in rows if r.first_train_fold is not None and r.first_train_fold <= i) == train


def test_too_small_dataset_is_an_error(spark):
    with pytest.raises(PySparkException):
        fold_table(numbered(spark, 4), CountedFolds(5)).collect()


def supervised(spark, n=400, constant=False, seed=0):
    rng = np.random.default_rng(seed)
    v = np.exp(rng.normal(-9.5, 0.5, n))
    pdf = pd.DataFrame({"series_id": "a", "date": business_days(n), "rv_d": v, "rv_w": pd.Series(v).rolling(5, min_periods=1).mean(),
                        "rv_m": pd.Series(v).rolling(22, min_periods=1).mean(), "dispersion": 0.4})
    if not constant:
        pdf["dispersion"] = rng.normal(1, 0.2, n)
    else:
        pdf.loc[n // 2:, "dispersion"] = 0.9
    pdf["target"] = np.sqrt(pdf.rv_m * 252) * 100 * np.exp(rng.normal(0, 0.1, n))
    return pdf


@pytest.mark.parametrize("log_target", [True, False])
@pytest.mark.parametrize("constant", [True, False])
def test_walk_forward_equals_lstsq(spark, log_target, constant):
    pdf = supervised(spark, constant=constant)
    features = ["rv_d", "rv_w", "rv_m", "dispersion"]
    data = number_rows(frame(spark, pdf))
    sets = {"har": features[:3], "full": features}
    scheme = CountedFolds(5, 21, 5)
    coefs = fit_folds(data, sets, scheme, log_target=log_target)
    out = pandas_sorted(predict_folds(data, coefs, sets, scheme, log_target), "config", "date")
    for config, cols in sets.items():
        want = []
        for _, train, test in counted(len(pdf), 5, 26):
            x = lambda i: np.column_stack([np.ones(len(i)), pdf.loc[i, cols]])
            y = np.log(pdf.target) if log_target else pdf.target
            beta = np.linalg.pinv(x(train)) @ y[train]
            want.append(np.exp(x(test) @ beta) if log_target else x(test) @ beta)
        close_to(out[out.config == config].rv_forecast, np.concatenate(want), 1e-6)


def test_residual_corrected_and_ensemble(spark):
    pdf = supervised(spark)
    data = number_rows(frame(spark, pdf))
    scheme = CountedFolds(5, 21, 5)
    got = pandas_sorted(C.residual_corrected(data, ["rv_d", "rv_w", "rv_m"], scheme), "date")
    base = np.sqrt(pdf.rv_m * 252) * 100
    want = []
    for _, train, test in counted(len(pdf), 5, 26):
        x = lambda i: np.column_stack([np.ones(len(i)), pdf.loc[i, ["rv_d", "rv_w", "rv_m"]]])
        beta = np.linalg.pinv(x(train)) @ (pdf.target - base)[train]
        want.append(np.maximum(base[test] + x(test) @ beta, 0))
    close_to(got.rv_forecast, np.concatenate(want), 1e-6)
    rows = C.walk_forward(data, {"a": ["rv_d"], "b": ["rv_m"]}, scheme)
    both = pandas_sorted(rows, "date", "config").groupby("date").rv_forecast.mean()
    close_to(pandas_sorted(C.ensemble(rows), "date").rv_forecast, both)


def test_errors_pooled_and_mean(spark):
    pdf = pd.DataFrame({"series_id": "a", "fold": [1, 1, 2, 2, 3, 3], "target": [1.0, 2, 3, 5, 4, 4], "rv_forecast": [1.0, 1, 4, 5, 3, 4]})
    df = frame(spark, pdf)
    per = pandas_sorted(E.error_metrics(df, ["series_id", "fold"]), "fold")
    close_to(per.r2_oos, [-1.0, 0.5, np.nan])
    pooled = E.error_metrics(df, ["series_id"]).collect()[0]
    e = pdf.target - pdf.rv_forecast
    close_to([pooled.rmse, pooled.mae, pooled.r2_oos], [math.sqrt((e**2).mean()), e.abs().mean(), 1 - (e**2).sum() / ((pdf.target - pdf.target.mean()) ** 2).sum()])
    mean = E.mean_over_folds(E.error_metrics(df, ["series_id", "fold"]), ["series_id"]).collect()[0]
    assert mean.r2_oos is None and abs(mean.mae - e.abs().mean()) < 1e-12


def test_directional_hits(spark):
    rows = [("a", 2.0, 3.0, 1.0), ("a", 0.5, 3.0, 1.0), ("a", 1.0, 1.0, 1.0), ("a", None, 1.0, 1.0)]
    r = E.directional_hits(spark.createDataFrame(rows, "series_id string, rv_forecast double, target double, reference double"), ["series_id"]).collect()[0]
    assert (r.n, r.hits) == (3, 2) and abs(r.p_value - 1.0) < 1e-12


def test_correlation_guards_constants(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("b", 3.0, 7.0), ("b", None, 9.0)], "k string, x double, y double")
    out = {r.k: r for r in E.correlations(df, ["k"], "x", "y", p_value=True).collect()}
    assert out["a"].r is None and out["a"].p_value is None
    assert out["b"].n == 3 and abs(out["b"].r - np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1]) < 1e-12


def test_verdict_codes(spark):
    pooled = spark.createDataFrame([("a", "base", 0.05), ("a", "layer", 0.08), ("b", "base", -0.1), ("b", "layer", -0.2)], "series_id string, config string, r2_oos double")
    fold = spark.createDataFrame(
        [("a", "base", 1, 0.1), ("a", "layer", 1, 0.2), ("a", "base", 2, 0.1), ("a", "layer", 2, 0.3), ("b", "base", 1, 0.1), ("b", "layer", 1, 0.0)],
        "series_id string, config string, fold long, r2_oos double")
    out = {r.series_id: r for r in E.verdict(pooled, fold, "base", "layer").collect()}
    assert (out["a"].forecast_verdict, out["a"].layer_verdict, out["a"].better) == ("weak", "helps", 2)
    assert (out["b"].forecast_verdict, out["b"].layer_verdict, out["b"].worse) == ("none", "no help", 1)


def test_ablation_finds_a_planted_signal(spark):
    rng = np.random.default_rng(3)
    pdf = supervised(spark, 500).drop(columns=["dispersion"])
    pdf["news"] = rng.normal(size=500)
    pdf["target"] *= np.exp(0.5 * pdf.news)
    a = P.ablation(number_rows(frame(spark, pdf)), D.NEWS, CountedFolds(5, 5, 2))
    v = a.verdict.collect()[0]
    assert v.other_r2 > v.base_r2 + 0.2 and v.layer_verdict == "helps"


def test_no_valid_fold_is_an_error(spark):
    pdf = supervised(spark, 30).drop(columns=["dispersion"]).assign(news=0.0)
    with pytest.raises(ValueError):
        P.ablation(number_rows(frame(spark, pdf)), D.NEWS, CountedFolds(5, 40, 0))


def test_one_sided_gap_equals_filter_on_each_prefix(spark):
    rng = np.random.default_rng(4)
    y = np.cumsum(rng.normal(0, 0.01, 70)) + 4
    months = [d.date() for d in pd.date_range("2015-01-01", periods=70, freq="MS")]
    pdf = pd.DataFrame({"series_id": "a", "reference_date": months, "y": y})
    got = pandas_sorted(one_sided_gap(frame(spark, pdf), "y"), "reference_date").gap
    want = np.full(70, np.nan)
    for t in range(24, 70):
        k = np.diff(np.eye(t + 1), n=2, axis=0)
        trend = np.linalg.solve(np.eye(t + 1) + 14400 * k.T @ k, y[: t + 1])
        want[t] = y[t] - trend[-1]
    close_to(got, want, 1e-9)
    cut = pandas_sorted(one_sided_gap(frame(spark, pdf[:50]), "y"), "reference_date").gap
    close_to(cut, got[:50])


def garch_costs(squares, start, omega, alpha, beta):
    """Negative log-likelihoods of many parameter sets, day by day."""
    s, total = omega + (alpha + beta) * start, 0.0
    for x in squares:
        total = total + np.log(s) + x / s
        s = omega + alpha * x + beta * s
    return 0.5 * total


def test_garch_recursion_and_recovery():
    rng = np.random.default_rng(5)
    omega, alpha, beta = 0.05, 0.08, 0.88
    r, s = np.empty(4000), omega / (1 - alpha - beta)
    for t in range(4000):
        r[t] = rng.normal(0, math.sqrt(s))
        s = omega + alpha * r[t] ** 2 + beta * s
    (w, a, b), start = Z.fit_parameters(r)
    assert abs(a - alpha) < 0.03 and abs(b - beta) < 0.06
    mine, true = garch_costs(r * r, start, np.array([w, omega]), np.array([a, alpha]), np.array([b, beta]))
    assert mine <= true + 1e-6
    first, h = 2.0, 5
    path = [first]
    for _ in range(h - 1):
        path.append(w + (a + b) * path[-1])
    close_to([Z.mean_variance_ahead(np.array([first]), w, a, b, h)[0]], [np.mean(path)])


@pytest.mark.parametrize("alpha,beta", [(0.5, 0.2), (0.7, 0.05), (0.3, 0.3)])
def test_garch_fit_reaches_the_whole_region(alpha, beta):
    rng = np.random.default_rng(12)
    omega = 0.4
    r, s = np.empty(3000), omega / (1 - alpha - beta)
    for t in range(3000):
        r[t] = rng.normal(0, math.sqrt(s))
        s = omega + alpha * r[t] ** 2 + beta * s
    (w, a, b), start = Z.fit_parameters(r)
    assert abs(a - alpha) < 0.1 and abs(b - beta) < 0.15
    near = [(w * x, a + y, b + z) for x in (0.98, 1, 1.02) for y in (-0.01, 0, 0.01) for z in (-0.01, 0, 0.01)]
    costs = garch_costs(r * r, start, *(np.array(v) for v in zip((w, a, b), (omega, alpha, beta), *near)))
    assert costs[0] <= costs.min() + 1e-3


def test_garch_derivatives_and_blocks():
    rng = np.random.default_rng(3)
    for n in (3, 63, 64, 65, 200):
        x = rng.normal(0, 1.3, n) ** 2
        like = Z.Likelihood(x, 1.1)
        for point in (np.array([0.2, 0.1, 0.8]), np.array([0.5, 0.5, 0.0]), np.array([0.7, 0.0, 0.3])):
            value, gradient, curve = like(point)
            assert abs(value - garch_costs(x, 1.1, *point)) < 1e-9 * max(1, abs(value))
            h = 1e-5
            ends = [[like(point + sign * h * axis) for sign in (1, -1)] for axis in np.eye(3)]
            close_to([(a[0] - b[0]) / (2 * h) for a, b in ends], gradient, 1e-4)
            close_to(np.array([(a[1] - b[1]) / (2 * h) for a, b in ends]), curve, 1e-4)


@pytest.mark.parametrize("seed", range(6))
def test_no_point_of_a_fine_grid_beats_a_garch_fit(seed):
    rng = np.random.default_rng(seed)
    r = rng.normal(0, 1, 400) if seed % 2 else rng.standard_t(4, 400) * np.exp(0.5 * np.sin(np.arange(400) / 40))
    found = Z.fit(r)
    assert found.converged
    a, b, c = (x.ravel() for x in np.meshgrid(np.linspace(0, 0.98, 50), np.linspace(0, 0.98, 50), np.linspace(-1, 1, 21)))
    inside = a + b <= Z.MOST_PERSISTENCE
    a, b, c = a[inside], b[inside], c[inside]
    assert found.cost <= garch_costs(r * r, found.start, np.mean(r * r) * (1 - a - b) * np.exp(c), a, b).min() + 1e-9


def test_garch_folds_of_many_series_at_once(spark):
    pdf = pd.concat([walk(260, i, series=f"s{i}") for i in range(3)])
    scheme = CountedFolds(3, 5, 0)
    df = frame(spark, pdf)
    data = number_rows(D.base_dataset(W.close_variance(df).dropna(), 5).drop("rn", "n"))
    fits = pandas_sorted(Z.garch_fits(data, df, scheme, 5), "series_id", "fold")
    assert len(fits) == 9 and fits.converged.all()
    for own in fits[fits.fold == 2].itertuples():
        r = np.diff(np.log(pdf[pdf.series_id == own.series_id].close.to_numpy()))
        day = pdf[pdf.series_id == own.series_id].date.to_numpy()[1:]
        first = own.days[0]["day"]
        assert len(own.days) > 10 and (pd.Timestamp(day[0]) - pd.Timestamp(0)).days < first
        costs = garch_costs((r * 100) ** 2, 1.0, own.omega, own.alpha, own.beta)
        assert np.isfinite(costs)


def test_garch_without_a_maximum_is_not_fitted():
    assert Z.fit_parameters(np.r_[1.0, np.zeros(200)]) is None


def test_garch_forecast_uses_no_future(spark):
    pdf = walk(260, 6)
    scheme = CountedFolds(2, 5, 0)

    def run(bars):
        df = frame(spark, bars)
        data = number_rows(D.base_dataset(W.close_variance(df).dropna(), 5).drop("rn", "n"))
        return pandas_sorted(Z.garch_forecasts(data, df, scheme, 5), "fold", "date"), df

    out, _ = run(pdf)
    assert len(out) and (out.garch_forecast > 0).all()
    shaken = pdf.copy()
    last = out[out.fold == 1].date.max()
    late = pd.Series(shaken.date) > last
    shaken.loc[late.to_numpy(), "close"] *= 1.5
    again, _ = run(shaken)
    close_to(again[again.fold == 1].garch_forecast[:50], out[out.fold == 1].garch_forecast[:50])


def test_autocorrelation_matches_pandas(spark):
    pdf = pd.DataFrame({"series_id": "a", "date": business_days(90), "v": np.random.default_rng(6).normal(size=90)})
    out = pandas_sorted(E.autocorrelation(frame(spark, pdf), "v"), "lag")
    close_to(out.acf, [pdf.v.autocorr(k) for k in out.lag], 1e-9)


def test_coefficient_spread_and_newest(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None)], "k string, coef double")
    r = E.coefficient_spread(df, ["k"]).collect()[0]
    assert (r.coef_mean, r.coef_sd, r.n_folds) == (2.0, 1.0, 2)
    bars = frame(spark, walk(5)[["series_id", "date", "close"]])
    assert E.newest_row(bars, ["close"]).collect()[0].date == business_days(5)[-1]


def test_horizon_sweep_tests_the_same_rows(spark):
    bars = W.range_variance(frame(spark, walk(300, 7)))
    out = pandas_sorted(P.horizon_sweep(bars, (1, 5, 21)), "horizon", "model")
    assert out.model.tolist() == ["har", "persistence"] * 3
    assert (out.n_obs[::2].to_numpy() == out.n_obs[1::2].to_numpy()).all()


def test_log_fit_leaves_out_zero_volatility(spark):
    pdf = supervised(spark, 200)
    pdf.loc[5, "target"] = 0.0
    data = number_rows(frame(spark, pdf))
    coefs = fit_folds(data, {"har": ["rv_m"]}, LastShare(0.2), log_target=True).collect()[0]
    keep = [i for i in range(160) if i != 5]
    x = np.column_stack([np.ones(159), pdf.rv_m[keep]])
    close_to(coefs.beta, np.linalg.pinv(x) @ np.log(pdf.target[keep]), 1e-6)
    assert coefs.n_train == 159


def test_staged_tables_go_with_their_owner(spark):
    with staging(spark) as folder:
        rows = stage(spark.range(5), "owned")
        assert rows.count() == 5 and os.path.isdir(folder.removeprefix("file://"))
        with staging(spark) as inner:
            assert scratch_path(spark, "x").startswith(inner) and inner.startswith(folder)
    assert not os.path.exists(folder.removeprefix("file://"))
    assert not scratch_path(spark, "x").startswith(folder)


def test_level_feature_has_the_least_squares_slope(spark):
    """A price level of mean 5000 and spread 1 beside variances; the same fit when a constant column joins it."""
    rng = np.random.default_rng(21)
    pdf = supervised(spark, 300)
    pdf["level"] = 5000 + rng.normal(size=300)
    pdf["fixed"] = 3.5
    pdf["target"] = 0.30 * pdf.level + 200 * pdf.rv_m + rng.normal(0, 0.01, 300) - 1490
    data = number_rows(frame(spark, pdf))
    coefs = fit_folds(data, {"x": ["rv_m", "level"], "y": ["rv_m", "level", "fixed"]}, CountedFolds(3, 5, 0))
    for r in coefs.collect():
        names = ["rv_m", "level"] if r.config == "x" else ["rv_m", "level", "fixed"]
        x = np.column_stack([np.ones(r.train_end), pdf[names][: r.train_end]])
        want = np.linalg.lstsq(x - 0, pdf.target[: r.train_end], rcond=None)[0]
        got = [r.beta[0]] + [r.beta[1 + r.features.index(n)] for n in names]
        close_to(x @ got, x @ want, 1e-7)
        if r.config == "x":
            close_to(got[2], want[2], 1e-6)


def test_hot_intraday_series_is_fitted_without_a_window_over_its_rows(spark):
    """One TIMESTAMP series with nearly all rows; moments merge to the digits of one pass over them."""
    n, rng = 20_000, np.random.default_rng(4)
    x = 5000 + rng.normal(size=n)
    y = 2.5 * x + rng.normal(0, 0.01, n) - 12_000
    start = pd.Timestamp("2024-01-02")
    pdf = pd.DataFrame({"series_id": "hot", "date": start + pd.to_timedelta(np.arange(n), "min"), "x": x, "target": y, "rn": np.arange(n), "n": n})
    cold = pdf[:60].assign(series_id="cold", n=60)
    data = spark.createDataFrame(pd.concat([pdf, cold])).repartition(6)
    coefs = fit_folds(data, {"c": ["x"]}, CountedFolds(4, 5, 0))
    plan = coefs._jdf.queryExecution().optimizedPlan().toString()
    raw = plan[plan.index("covar_pop") :]
    assert "Window" in plan[: plan.index("covar_pop")] and "Window" not in raw
    got = {(r.series_id, r.fold): r for r in coefs.collect()}
    assert len(got) == 8
    for (name, _), r in got.items():
        own = pdf if name == "hot" else cold
        slope, level = np.polyfit(own.x[: r.train_end] - 5000, own.target[: r.train_end], 1)
        close_to([r.beta[1], r.beta[0] + 5000 * r.beta[1]], [slope, level], 1e-9)


def test_no_tested_garch_row_is_lost(spark):
    pdf = walk(150, 8)
    pdf.loc[:70, "close"] = 100.0
    df = frame(spark, pdf)
    data = number_rows(D.base_dataset(W.close_variance(df).dropna(), 5).drop("rn", "n"))
    scheme = CountedFolds(5, 1, 0)
    out = Z.garch_forecasts(data, df, scheme, 5).toPandas()
    tested = assign_folds(data, scheme).filter("test_fold IS NOT NULL").count()
    assert len(out) == tested and (out.fitted == out.garch_forecast.notna()).all()
    assert not out.fitted[out.fold == 1].any() and out.fitted[out.fold == 5].all()


def test_incomplete_beta_of_large_counts():
    total = np.array([2e6, 1e4])
    k = np.array([999_000.0, 4_900.0])
    p = 2 * S.incomplete_beta(total - k, k + 1, np.full(2, 0.5))
    z = (k + 0.5 - total / 2) / np.sqrt(total / 4)
    close_to(p, [math.erfc(-v / math.sqrt(2)) for v in z], 1e-3)


def direct_gap(y, min_window=24):
    gains, level, before, out = Y.trend_gains(14400.0), 0.0, 0.0, []
    for i, v in enumerate(y):
        if i < 2:
            level, before = v, level
        else:
            k1, k2 = gains[min(i - 1, len(gains)) - 1]
            ahead = 2 * level - before
            level, before = ahead + k1 * (v - ahead), level + k2 * (v - ahead)
        out.append(v - level if i >= min_window else np.nan)
    return out


def test_one_sided_gap_of_a_million_rows_in_one_series(spark):
    n = 1_000_000
    rows = spark.range(n).select(
        F.lit("a").alias("series_id"), F.timestamp_seconds(F.col("id") * 60).alias("at"), (4 + F.sin(F.col("id") / 5000) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 1e5).alias("y"),
    )
    few = rows.limit(30).withColumn("series_id", F.lit("b"))
    out = one_sided_gap(rows.repartition(4).unionByName(few), "y", time="at").toPandas().sort_values(["series_id", "at"])
    long, short = out[out.series_id == "a"], out[out.series_id == "b"]
    assert len(long) == n and len(short) == 30
    close_to(long.gap, direct_gap(long.y.to_numpy()), 1e-9)
    close_to(short.gap, direct_gap(short.y.to_numpy()), 1e-9)


@pytest.mark.parametrize("block", [3, 50])
def test_one_sided_gap_blocks_levels_and_nulls(spark, block, monkeypatch):
    monkeypatch.setattr(chains.entry_states, "__defaults__", (2,))
    pdf = walk(140, 3)[["series_id", "date", "close"]].rename(columns={"date": "reference_date"})
    whole = pandas_sorted(one_sided_gap(frame(spark, pdf), "close", block_rows=10_000), "reference_date").gap
    close_to(pandas_sorted(one_sided_gap(frame(spark, pdf), "close", block_rows=block), "reference_date").gap, whole, 1e-10)
    close_to(whole, direct_gap(pdf.close.to_numpy()), 1e-10)
    pdf.loc[60, "close"] = np.nan
    gaps = pandas_sorted(one_sided_gap(frame(spark, pdf), "close", block_rows=block), "reference_date").gap
    assert gaps[24:60].notna().all() and gaps[60:].isna().all()


def test_trend_gains_settle_or_fail():
    assert len(Y.trend_gains(1e7)) < 20_000
    with pytest.raises(ArithmeticError):
        Y.trend_gains(14400.0, limit=50)
