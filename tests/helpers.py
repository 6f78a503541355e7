import datetime as dt

import numpy as np
import pandas as pd


def business_days(n, start="2024-01-01"):
    return [d.date() for d in pd.bdate_range(start, periods=n)]


def walk(n, seed=0, start="2024-01-01", series="a", sigma=0.01):
    """Random-walk bars of one series."""
    rng = np.random.default_rng(seed)
    close = 5 * np.exp(np.cumsum(rng.normal(0, sigma, n)))
    high = close * (1 + np.abs(rng.normal(0, 0.003, n)))
    low = close * (1 - np.abs(rng.normal(0, 0.003, n)))
    open_ = close * (1 + rng.normal(0, 0.002, n))
    return pd.DataFrame(
        {"series_id": series, "date": business_days(n, start), "open": open_, "high": high, "low": low, "close": close}
    )


def frame(spark, pdf, schema=None):
    rows = [tuple(None if isinstance(v, float) and v != v else v for v in r) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, schema or list(pdf.columns))


def pandas_sorted(df, *by):
    out = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns)
    return out.sort_values(list(by)).reset_index(drop=True)


def day(text):
    return dt.date.fromisoformat(text)


def close_to(a, b, tol=1e-10):
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    assert a.shape == b.shape
    assert np.array_equal(np.isnan(a), np.isnan(b))
    np.testing.assert_allclose(a, b, rtol=tol, atol=tol, equal_nan=True)
