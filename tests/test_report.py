import datetime as dt

import numpy as np
import pandas as pd
import pytest

from helpers import business_days, frame, walk
from volpanel.operators.asof import asof_shared
from volpanel.plans import report


def write(spark, folder, name, pdf):
    path = str(folder / name)
    frame(spark, pdf).write.parquet(path)
    return path


def study_tables(spark, folder, n=520):
    rng = np.random.default_rng(9)
    days = business_days(n)
    bars = walk(n, 9).drop(columns="series_id")
    futures = bars.assign(ticker=["A" if i % 42 < 21 else "B" for i in range(n)], settlement=bars.close * 1000, last=bars.close * 1000,
                          contract_changed=[i % 21 == 0 and i > 0 for i in range(n)])[["date", "ticker", "settlement", "open", "last", "low", "high", "contract_changed"]]
    quotes = [(days[i], days[i] + dt.timedelta(days=t), float(d), 12.0 + t / 50) for i in range(100, n, 100) for t in (10, 40) for d in (25, 50)]
    tables = {
        "bars": bars, "futures": futures,
        "official": pd.DataFrame({"date": days, "value": bars.close * 1.001, "tipo": "venda"}),
        "tone": pd.DataFrame({"date": days, "tone": rng.normal(size=n), "query": "q"}),
        "volume": pd.DataFrame({"date": days, "share_pct": rng.uniform(0, 5, n), "query": "q"}),
        "sentiment": pd.DataFrame({"date": days, "sentiment_mean": rng.normal(size=n)}),
        "credibility": pd.DataFrame({"date": days, "theta_baseline": rng.uniform(0, 1, n), "dispersion": rng.uniform(0.2, 0.6, n)}),
        "surface": pd.DataFrame(quotes, columns=["refdate", "maturity_date", "delta_pct", "iv_pct"]),
    }
    return {k: write(spark, folder, k, v) for k, v in tables.items()}


def test_study_runs_over_clean_tables(spark, tmp_path):
    tables = study_tables(spark, tmp_path)
    names = report.write_study(spark, tables, str(tmp_path / "out"), {"tone": "q", "volume": "q"}, horizon=5)
    assert {"news_pooled", "surprise_verdict", "fiscal_mean", "credibility_per_fold", "signal", "trades", "deflated_sharpe",
            "layer_weights", "sample", "lead_lag", "skew_theta", "volatility_correlation", "bars_sweep",
            "persistence_pooled", "attention_trades", "attention_weights", "forecast_implied", "lead_lag_bars", "futures_quality"} <= set(names)
    pooled = spark.read.json(str(tmp_path / "out" / "news_pooled")).collect()
    assert sorted(r.config for r in pooled) == ["base", "news"]
    assert spark.read.json(str(tmp_path / "out" / "sample")).collect()[0].n_rolls == 24
    same_day = {r["shift"]: r.r for r in spark.read.json(str(tmp_path / "out" / "lead_lag")).collect()}
    assert same_day[0] > 0.99 and abs(same_day[1]) < 0.3


def test_parts_without_tables_are_left_out(spark, tmp_path):
    tables = study_tables(spark, tmp_path, 200)
    only = {"bars": tables["bars"], "tone": tables["tone"]}
    assert list(report.ablations(spark, only, {"tone": "q"}, 5)) == ["news"]
    assert "sample" not in report.diagnostics(spark, {"bars": tables["bars"]})
    a = report.preliminary(spark, only, {"tone": "q"}, 5)
    assert {r.n_folds for r in a.mean.collect()} == {5}


def test_queries_are_told_apart(spark, tmp_path):
    days = business_days(30)
    two = pd.concat([pd.DataFrame({"date": days, "tone": float(i), "query": q}) for i, q in enumerate(("a", "b"))])
    tables = {"tone": write(spark, tmp_path, "tone", two), "again": write(spark, tmp_path, "again", pd.concat([two, two]))}
    assert {r.tone for r in report._shared(spark, tables, "tone", "tone", {"tone": "b"}).collect()} == {1.0}
    with pytest.raises(ValueError, match="holds a series per query"):
        report._shared(spark, tables, "tone", "tone", {})
    with pytest.raises(ValueError, match="several rows"):
        report._shared(spark, tables, "again", "tone", {"again": "a"})


def test_instants_are_seen_from_the_markets_midnight(spark):
    """The tone of a UTC day, stamped 21:00 of the evening before, is known on that day and no earlier, in any session zone."""
    left = spark.createDataFrame([("x", dt.date(2024, 1, d)) for d in (1, 2, 3)], "series_id string, date date")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            right = spark.sql("SELECT timestamp_seconds(s) AS date, v FROM VALUES (1704153600L, 2.0D), (1704240000L, CAST(NULL AS DOUBLE)) AS t(s, v)")
            got = [(r.date.day, r.v) for r in asof_shared(left, right).orderBy("date").collect()]
            assert got == [(1, None), (2, 2.0), (3, None)]
            midnight = spark.sql("SELECT timestamp_seconds(1704164400L) AS date, 5.0D AS v")
            assert [r.v for r in asof_shared(left, midnight).orderBy("date").collect()] == [None, 5.0, 5.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
