"""Statistics of already aggregated rows: Arrow UDFs over one row per group, vectorised with NumPy.

They never see panel rows. Sums and counts are made by Spark first.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER_MASCHERONI = 0.5772156649015329


def _log_beta(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    return lgamma(a) + lgamma(b) - lgamma(a + b)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by Lentz's continued fraction, element-wise."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    guard = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    with np.errstate(all="ignore"):
        c = np.ones_like(t)
        d = 1 / guard(1 - (p + q) * t / (p + 1))
        h = d.copy()
        m = 0
        while True:
            m += 1
            even = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m))
            d, c = 1 / guard(1 + even * d), guard(1 + even / c)
            h = h * d * c
            odd = -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
            d, c = 1 / guard(1 + odd * d), guard(1 + odd / c)
            step = d * c
            h = h * step
            # A step repeats its last digits at the latest; far more terms than the larger parameter's root are never needed.
            if np.all((np.abs(step - 1) < 1e-15) | np.isnan(step)):
                break
            if m > 1000 + 50 * math.sqrt(float(np.max(p) + np.max(q))):
                worst = np.nanmax(np.abs(step - 1))
                if worst > 1e-13:
                    raise ArithmeticError(f"incomplete beta: last step {worst:g} after {m} terms")
                break
        front = np.exp(p * np.log(t) + q * np.log1p(-t) - _log_beta(p, q)) / p
        value = np.where(t <= 0, 0.0, front * h)
    return np.where(swap, 1 - value, value)


@F.pandas_udf(T.DoubleType())
def _binomial_half(hits: pd.Series, n: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=n.index, dtype=float)
    ok = (n > 0) & hits.notna()
    if ok.any():
        total = n[ok].to_numpy(float)
        k = np.minimum(hits[ok].to_numpy(float), total - hits[ok].to_numpy(float))
        lower = incomplete_beta(total - k, k + 1, np.full_like(total, 0.5))
        out[ok] = np.where(2 * k >= total, 1.0, np.minimum(1.0, 2 * lower))
    return out


def binomial_p_half(hits: Column, n: Column) -> Column:
    """Exact two-sided binomial p-value against one half; NULL for n = 0."""
    return F.when(n > 0, _binomial_half(hits.cast("double"), n.cast("double")))


@F.pandas_udf(T.DoubleType())
def _pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=n.index, dtype=float)
    ok = (n > 2) & r.notna()
    if ok.any():
        df = n[ok].to_numpy(float) - 2
        out[ok] = incomplete_beta(df / 2, np.full_like(df, 0.5), 1 - np.minimum(r[ok].to_numpy(float) ** 2, 1.0))
    return out


def pearson_p(r: Column, n: Column) -> Column:
    """Two-sided t-test p-value of a correlation ``r`` over ``n`` pairs; NULL below three pairs."""
    return F.when((n > 2) & r.isNotNull(), _pearson_p(r, n.cast("double")))


@F.pandas_udf(T.DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    inverse = NormalDist().inv_cdf
    return p.map(lambda v: inverse(v) if 0 < v < 1 else np.nan, na_action="ignore").astype(float)


def normal_quantile(p: Column) -> Column:
    return _normal_quantile(p)


def _solve(g: np.ndarray, v: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Minimum-norm coefficients of the raw design from cross-products of shifted features; position 0 is the intercept."""
    n, m, y0 = g[0, 0], g[0, 1:] / g[0, 0], v[0] / g[0, 0]
    centred, cross = g[1:, 1:] - n * np.outer(m, m), v[1:] - m * v[0]
    spread, at = np.diag(centred), m + shift
    # What digits cannot tell from a constant: lost in its own sum of squares, or in the digits of the level itself.
    moves = (spread > 1e-12 * np.diag(g)[1:]) & (spread > n * (1e-11 * np.abs(at)) ** 2)
    sd = np.sqrt(np.where(moves, spread, 1.0))
    used = np.flatnonzero(moves)
    roots, vectors = np.linalg.eigh((centred / np.outer(sd, sd))[np.ix_(used, used)])
    real = roots > 1e-11 * max(1, len(used))
    slopes = np.zeros(len(m))
    slopes[used] = vectors[:, real] @ ((vectors[:, real].T @ (cross / sd)[used]) / roots[real]) / sd[used]
    beta = np.r_[y0 - slopes @ at, slopes]
    free = [np.eye(len(m))[j] for j in np.flatnonzero(~moves)]
    for z in vectors[:, ~real].T:
        direction = np.zeros(len(m))
        direction[used] = z / sd[used]
        free.append(direction)
    if free:
        null = np.stack([np.r_[-d @ at, d] for d in free], axis=1)
        null = null / np.linalg.norm(null, axis=0)
        beta = beta - null @ np.linalg.lstsq(null, beta, rcond=None)[0]
    return beta


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def solve_normal_equations(gram: pd.Series, xty: pd.Series, picked: pd.Series, shift: pd.Series) -> pd.Series:
    """Least squares with intercept from sufficient statistics, one aggregated row per fit.

    ``gram`` is the full k×k cross-product row by row of (1, features − ``shift``), ``picked`` the positions a feature set
    uses, 0 among them. Centring and scaling come from the sums themselves, so a feature's level and unit don't
    matter; what a constant or dependent feature leaves open gets the smallest coefficients, as a pseudo-inverse of the raw design gives.
    Positions not picked get 0; a fit without rows is NULL.
    """
    out: list[np.ndarray | None] = [None] * len(gram)
    for i, ids in enumerate(picked):
        if gram.iloc[i] is None or xty.iloc[i] is None or shift.iloc[i] is None:
            continue
        v = np.asarray(xty.iloc[i], dtype=float)
        k, at = len(v), np.asarray(ids, dtype=int)
        g = np.asarray(gram.iloc[i], dtype=float).reshape(k, k)
        if not g[0, 0] > 0:
            continue
        full = np.zeros(k)
        full[at] = _solve(g[np.ix_(at, at)], v[at], np.asarray(shift.iloc[i], dtype=float)[at[1:] - 1])
        out[i] = full
    return pd.Series(out, dtype=object)
