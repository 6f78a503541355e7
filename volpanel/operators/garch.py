"""GARCH(1,1) walk-forward forecasts, all series and folds in parallel.

A fit is sequential in time, so its unit is one fold of one DATE-keyed series: at most one number per calendar day, whatever the raw
volume behind the daily panel was. Each (series, fold) is a row of its own that carries the series' returns, and rows are dealt evenly to tasks.

The likelihood and its first and second derivatives are linear recursions with the same coefficient β. They run in blocks of days: within a block as one
matrix product for all days and recursions at once, across blocks as a short chain of carried values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volpanel.functions.market import TRADING_DAYS, log_return
from volpanel.operators.folds import Scheme, assign_folds, fold_table
from volpanel.operators.panel import SERIES, require_daily, series_window
from volpanel.session import stage

RESCALE = 100.0
LEAST_ROWS = 3
MOST_PERSISTENCE = 0.9999
#: Starts (α, β) over the admissible region; the highest of the maxima reached from them counts.
STARTS = (
    (0.10, 0.80), (0.05, 0.90), (0.05, 0.50), (0.05, 0.10), (0.25, 0.65), (0.30, 0.30), (0.50, 0.20), (0.60, 0.35), (0.85, 0.05),
)
#: Of the sample variance; a likelihood that still rises there has no maximum.
LEAST_OMEGA = 1e-13
#: A fit has converged once a Newton step promises no more than this share of the likelihood.
GAIN = 1e-13
#: A step that promises less than this share is as good as none where rounding hides what it gains.
NOISE = 1e-9
MOST_STEPS = 200
DAYS_AT_ONCE = 64
#: The admissible region, EDGES @ (ω, α, β) >= BOUNDS, where ω is a share of the sample variance.
EDGES = np.array([[0.0, 1, 0], [0, 0, 1], [0, -1, -1], [1, 0, 0], [-1, 0, 0]])
BOUNDS = np.array([0.0, 0, -MOST_PERSISTENCE, LEAST_OMEGA, -1 / LEAST_OMEGA])

_LAG = np.subtract.outer(np.arange(DAYS_AT_ONCE), np.arange(DAYS_AT_ONCE))


def recursion(inputs: np.ndarray, beta: float, before: Sequence[float]) -> np.ndarray:
    """y_t = β·y_{t−1} + u_t for each row u of ``inputs``, with y_{−1} from ``before``."""
    k, n = inputs.shape
    blocks = -(-n // DAYS_AT_ONCE)
    padded = np.zeros((k, blocks * DAYS_AT_ONCE))
    padded[:, :n] = inputs
    powers = float(beta) ** np.arange(DAYS_AT_ONCE + 1)
    inside = padded.reshape(k, blocks, DAYS_AT_ONCE) @ np.where(_LAG >= 0, powers[np.abs(_LAG)], 0.0).T
    carried, carry = np.empty((k, blocks)), np.asarray(before, float)
    for b in range(blocks):
        carried[:, b] = carry
        carry = powers[-1] * carry + inside[:, b, -1]
    return (inside + carried[:, :, None] * powers[1:]).reshape(k, -1)[:, :n]


def conditional_variance(r: np.ndarray, omega: float, alpha: float, beta: float, start: float) -> np.ndarray:
    """σ² for rows 0…n: entry t uses returns before t; the last entry is the next day's variance.

    ``start`` stands for the squared return and the variance before the first row.
    """
    return recursion((omega + alpha * np.r_[start, r * r])[None], beta, [start])[0]


def _back_cast(r: np.ndarray) -> float:
    """Exponentially weighted mean of the first squared returns, the usual start of the recursion."""
    m = min(len(r), 75)
    w = 0.94 ** np.arange(m)
    return float(np.sum(w * r[:m] ** 2) / w.sum())


class Likelihood:
    """Negative log-likelihood of squared returns of mean 1, with derivatives in (ω, α, β)."""

    def __init__(self, squares: np.ndarray, start: float):
        self.squares, self.start = squares, start
        self.yesterday = np.r_[start, squares[:-1]]

    def __call__(self, point: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Value, gradient and matrix of second derivatives."""
        omega, alpha, beta = point
        s = recursion((omega + alpha * self.yesterday)[None], beta, [self.start])[0]
        # By ω, α, β; then what β changes in those three.
        by = recursion(np.stack([np.ones_like(s), self.yesterday, np.r_[self.start, s[:-1]]]), beta, np.zeros(3))
        delayed = np.concatenate([np.zeros((3, 1)), by[:, :-1]], axis=1)
        twice = recursion(delayed * np.array([[1.0], [1.0], [2.0]]), beta, np.zeros(3))
        ratio = self.squares / s
        first, second = 0.5 * (1 - ratio) / s, 0.5 * (2 * ratio - 1) / s**2
        curve, mixed = (by * second) @ by.T, twice @ first
        curve[2, :] += mixed
        curve[:2, 2] += mixed[:2]
        return 0.5 * float((np.log(s) + ratio).sum()), by @ first, curve


def _pressure(gradient: np.ndarray, held: list[int]) -> np.ndarray:
    """How much the gradient pushes against each of the edges held; negative where the descent leads away."""
    return np.linalg.lstsq(EDGES[held].T, gradient, rcond=None)[0]


def _step(gradient: np.ndarray, curve: np.ndarray, held: list[int], damping: float = 0.0) -> np.ndarray:
    """Newton step along the edges held, negative curvature turned around."""
    free = np.eye(3)
    if held:
        _, sizes, rows = np.linalg.svd(EDGES[held])
        free = rows[int((sizes > 1e-12).sum()) :].T
    if not free.shape[1]:
        return np.zeros(3)
    sizes, axes = np.linalg.eigh(free.T @ curve @ free)
    sizes = np.maximum(np.abs(sizes), 1e-14 * max(1.0, float(np.abs(sizes).max())))
    return -free @ (axes @ ((axes.T @ (free.T @ gradient)) / (sizes + damping * sizes.max())))


def newton(likelihood: Likelihood, first: Sequence[float]) -> tuple[np.ndarray, float, bool]:
    """Point (ω, α, β) and value of a minimum reached from ``first`` by Newton steps; whether the steps have come to rest.

    A step ends at an edge of the region, runs along the edges that it would cross, and is halved until the value falls as promised. Only once nothing is
    left to gain along the edges, one whose other side the descent wants is left, by a step damped until it turns inside.
    """
    point = np.array(first, float)
    value, gradient, curve = likelihood(point)
    for _ in range(MOST_STEPS):
        slack = EDGES @ point - BOUNDS
        on = [i for i in range(len(EDGES)) if slack[i] <= 1e-14]
        held: list[int] = []
        while True:
            step = _step(gradient, curve, held)
            crossed = [i for i in on if i not in held and EDGES[i] @ step < 0]
            if not crossed:
                break
            held.append(min(crossed, key=lambda i: EDGES[i] @ step))
        gain = float(-gradient @ step)
        if gain < GAIN * max(1.0, abs(value)):
            inner = list(held)
            while inner and (pressure := _pressure(gradient, inner)).min() < -1e-9 * max(1.0, abs(value)):
                inner.pop(int(pressure.argmin()))
            if inner == held:
                last = point + step  # whose error is the square of what it mends
                return last if (EDGES @ last >= BOUNDS).all() else point, value, True
            damping = 1e-3
            while damping < 1e15:
                step = _step(gradient, curve, inner, damping)
                if all(EDGES[i] @ step >= 0 for i in on if i not in inner):
                    break
                damping *= 10
            gain = float(-gradient @ step)
            if gain <= 0:
                return point, value, True
            held = inner
        drift = EDGES @ step
        room = [(max(slack[i], 0.0) / -drift[i], i) for i in range(len(EDGES)) if i not in held and slack[i] + drift[i] < 0]
        share, edge = min(room, default=(1.0, None))
        while share > 1e-14:
            moved = point + share * step
            if edge is not None:
                moved += EDGES[edge] * (BOUNDS[edge] - EDGES[edge] @ moved) / (EDGES[edge] @ EDGES[edge])
            moved = np.where(np.abs(moved) < 1e-15, 0.0, moved)
            found = likelihood(moved)
            if np.isfinite(found[0]) and (found[0] <= value - 1e-4 * share * gain or gain < 1e-7 and found[0] <= value + 1e-9):
                break
            share, edge = share / 2, None
        else:
            return point, value, gain < NOISE * max(1.0, abs(value))
        point, (value, gradient, curve) = moved, found
    return point, value, False


@dataclass(frozen=True)
class Fit:
    omega: float
    alpha: float
    beta: float
    start: float
    cost: float
    converged: bool


def fit(r: np.ndarray) -> Fit | None:
    """The greatest likelihood found from ``STARTS``; None where it has no maximum."""
    sample, start = float(np.mean(r * r)), _back_cast(r)
    likelihood = Likelihood(r * r / sample, start / sample)
    with np.errstate(all="ignore"):  # a step too far is a value that isn't finite, and is halved
        found = [newton(likelihood, (1 - alpha - beta, alpha, beta)) for alpha, beta in STARTS]
    least = min(f[1] for f in found)
    (omega, alpha, beta), cost, converged = min(found, key=lambda f: (f[1] > least + NOISE, not f[2], f[1]))
    if not np.isfinite(cost) or not LEAST_OMEGA < omega < 1 / LEAST_OMEGA:
        return None
    return Fit(omega * sample, float(alpha), float(beta), start, cost + 0.5 * len(r) * float(np.log(sample)), converged)


def fit_parameters(r: np.ndarray) -> tuple[np.ndarray, float] | None:
    """(ω, α, β) of the greatest likelihood found, and the start of the recursion; None where the likelihood has no maximum."""
    found = fit(r)
    return found and (np.array([found.omega, found.alpha, found.beta]), found.start)


def mean_variance_ahead(first: np.ndarray, omega: float, alpha: float, beta: float, horizon: int) -> np.ndarray:
    """Average of the 1…horizon step forecasts in closed form."""
    p = alpha + beta
    level = omega / (1 - p)
    return level + (first - level) * (1 - p**horizon) / (horizon * (1 - p))


def _annual(ahead: np.ndarray, omega: float, alpha: float, beta: float, horizon: int) -> np.ndarray:
    return np.sqrt(mean_variance_ahead(ahead, omega, alpha, beta, horizon) / RESCALE**2 * TRADING_DAYS) * 100


def _returns(prices: DataFrame, keys: Sequence[str], price: str, time: str) -> DataFrame:
    require_daily(prices, time)
    r = prices.select(*keys, time, log_return(F.col(price), series_window(keys, time)).alias("r"))
    return r.filter(F.col("r").isNotNull())


def filtered_forecasts(
    prices: DataFrame, omega: float, alpha: float, beta: float, horizon: int = 21, keys: Sequence[str] = SERIES,
    price: str = "close", time: str = "date",
) -> DataFrame:
    """(keys, date, garch_forecast) with known parameters (of returns ×100), filtered through the whole series."""
    keys = list(keys)
    schema = T.StructType([*[prices.schema[k] for k in keys], T.StructField(time, T.DateType()), T.StructField("garch_forecast", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        x = pdf["r"].to_numpy() * RESCALE
        ahead = conditional_variance(x, omega, alpha, beta, _back_cast(x))[1:]
        return pdf[[*keys, time]].assign(garch_forecast=_annual(ahead, omega, alpha, beta, horizon))

    return _returns(prices, keys, price, time).groupBy(*keys).applyInPandas(run, schema)


def garch_fits(
    numbered: DataFrame, prices: DataFrame, scheme: Scheme, horizon: int = 21, keys: Sequence[str] = SERIES,
    price: str = "close", time: str = "date",
) -> DataFrame:
    """(keys, fold, omega, alpha, beta, cost, converged, days): per fold the parameters from its train dates and, in ``days``, the forecasts of its test dates.

    Parameters are NULL where a training stretch has fewer than three returns, none but zeros, or a likelihood without a maximum.
    """
    keys = list(keys)
    spark = numbered.sparkSession
    dates = fold_table(numbered, scheme, keys).join(numbered.select(*keys, "rn", F.col(time).alias("_d")), keys)
    ends = dates.groupBy(*keys, "fold").agg(
        F.max(F.when(F.col("rn") == F.col("train_end") - 1, F.col("_d"))).alias("_train_last"),
        F.min(F.when(F.col("rn") == F.col("test_start"), F.col("_d"))).alias("_test_first"),
        F.max(F.when(F.col("rn") == F.col("test_end") - 1, F.col("_d"))).alias("_test_last"),
    )
    # A DATE-keyed series is short; with its returns in one row, a fold of it is a row too.
    series = _returns(prices, keys, price, time).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("day"), "r"))).alias("_r"))
    work = ends.join(series, keys).select(
        F.struct(*keys, "fold").alias("_of"), *(F.unix_date(c).alias(c) for c in ("_train_last", "_test_first", "_test_last")),
        F.transform("_r", lambda x: F.unix_date(x["day"])).alias("_days"), F.transform("_r", lambda x: x["r"]).alias("_returns"),
    )
    of, days = work.schema["_of"].dataType, "array<struct<day:int,garch_forecast:double>>"
    schema = T.StructType([T.StructField("_of", T.StringType()), *T._parse_datatype_string(
        f"omega double, alpha double, beta double, cost double, converged boolean, days {days}"
    ).fields])

    def fits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                name, train_last, test_first, test_last, day, r = row
                x = np.asarray(r, float) * RESCALE
                train = x[day <= train_last] if train_last is not None and train_last == train_last else x[:0]
                found = fit(train) if len(train) >= LEAST_ROWS and np.any(train) else None
                if found is None:
                    out.append((name, None, None, None, None, None, []))
                    continue
                ahead = conditional_variance(x, found.omega, found.alpha, found.beta, found.start)[1:]
                test = (day >= test_first) & (day <= test_last)
                made = _annual(ahead[test], found.omega, found.alpha, found.beta, horizon)
                told = [{"day": int(d), "garch_forecast": float(v)} for d, v in zip(day[test], made)]
                out.append((name, found.omega, found.alpha, found.beta, found.cost, found.converged, told))
            yield pd.DataFrame(out, columns=[f.name for f in schema.fields]).astype({"converged": object})

    spread = work.withColumn("_of", F.to_json("_of")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = spread.mapInPandas(fits, schema).withColumn("_of", F.from_json("_of", of))
    return made.select("_of.*", "omega", "alpha", "beta", "cost", "converged", "days")


def garch_forecasts(
    numbered: DataFrame, prices: DataFrame, scheme: Scheme, horizon: int = 21, keys: Sequence[str] = SERIES,
    price: str = "close", time: str = "date",
) -> DataFrame:
    """Out-of-sample forecasts per tested row: parameters from the fold's train dates, then filtered with those
    parameters through each test date, averaged over the horizon and annualised.

    ``numbered`` is the supervised dataset (rn, n, target); ``prices`` the full price panel behind it. Every tested row
    stays: where a fold has no fit (see ``garch_fits``), ``fitted`` is false and the forecast NULL. ``converged`` tells whether the
    search for the fold's parameters came to rest.
    """
    keys = list(keys)
    tested = assign_folds(numbered, scheme).filter(F.col("test_fold").isNotNull())
    tested = tested.select(*keys, F.col("test_fold").alias("fold"), time, "target")
    fits = stage(garch_fits(numbered, prices, scheme, horizon, keys, price, time), "garch-fits")  # one row per fold, fitted once
    days = fits.select(*keys, "fold", "converged", F.explode("days").alias("_day"))
    made = days.select(*keys, "fold", F.date_from_unix_date("_day.day").alias(time), F.col("_day.garch_forecast").alias("garch_forecast"), "converged")
    out = tested.join(made, [*keys, "fold", time], "left")
    return out.withColumns({"fitted": F.col("garch_forecast").isNotNull(), "converged": F.coalesce("converged", F.lit(False))})
