"""J5 with sparse changepoints and a band that grows (the prior structure of
the additive model: Laplace on slope changes, normal on seasonality).

The trend is a line with possible slope changes at evenly spaced days of the
first part of the history.  Their sizes carry an absolute penalty, so most are
exactly zero; level, slope, yearly and weekly Fourier terms and holidays are
solved for exactly and eliminated from the system, and the changes that remain
are found by coordinate descent on one matrix of cross-products per series.
The penalty follows the noise level, which is re-estimated until it settles.

Ahead of the history, slopes go on changing at the rate and with the mean size
that the history shows.  A change at time s moves the trend by (h - s) times
its size at horizon h, so the variance grows with h**3 in closed form.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.operators.forecast import T_ORIGIN, Z80, _with_holiday_flag, default_holidays, future_frame

YEARLY_DAYS, WEEKLY_DAYS = 730, 14  # history that yearly and weekly terms need


@dataclass(frozen=True)
class Priors:
    """Scales of the priors, for values scaled to at most 1 and history to
    unit length; `changes` sites in the first `reach` of the history."""
    changes: int = 25
    reach: float = 0.8
    change: float = 0.05
    season: float = 10.0
    line: float = 5.0


def lasso(gram: np.ndarray, target: np.ndarray, penalty: np.ndarray, start: np.ndarray | None = None,
          sweeps: int = 20_000, tolerance: float = 1e-10) -> np.ndarray:
    """argmin x'Gx / 2 - b'x + sum(penalty * |x|) by coordinate descent.

    Every few sweeps the system is solved on the non-zero coordinates with
    their signs; if that meets the optimality conditions it is the answer."""
    x = np.zeros(len(target)) if start is None else start.copy()
    slope = target - gram @ x
    size = np.diag(gram)
    near = tolerance * max(1.0, np.abs(target).max(initial=0.0))
    for sweep in range(sweeps):
        change = 0.0
        for i in np.flatnonzero(size > 0):
            pull = slope[i] + size[i] * x[i]
            new = np.sign(pull) * max(abs(pull) - penalty[i], 0.0) / size[i]
            if new != x[i]:
                slope -= gram[:, i] * (new - x[i])
                change = max(change, abs(new - x[i]) * size[i])
                x[i] = new
        if change <= near:
            break
        if sweep % 20 == 19:
            on = np.flatnonzero(x)
            signs = np.sign(x[on])
            exact = np.linalg.lstsq(gram[np.ix_(on, on)], target[on] - penalty[on] * signs, rcond=None)[0]
            if (np.sign(exact) == signs).all():
                left = target - gram[:, on] @ exact
                if (np.abs(left) <= penalty + near).all():
                    x[:] = 0.0
                    x[on] = exact
                    break
    return x


def design(t: np.ndarray, sites: np.ndarray, days: pd.Series, holiday: np.ndarray, yearly: bool,
           weekly: bool) -> tuple[np.ndarray, np.ndarray]:
    """(smooth terms, slope changes): level, slope, Fourier terms, holidays;
    and one hinge per site."""
    smooth = [np.ones_like(t), t]
    day = days.dt.dayofyear.to_numpy() if yearly else None
    for k in range(1, 11 if yearly else 1):
        smooth += [np.sin(2 * np.pi * k * day / 365.25), np.cos(2 * np.pi * k * day / 365.25)]
    week = days.dt.dayofweek.to_numpy() if weekly else None
    for k in range(1, 4 if weekly else 1):
        smooth += [np.sin(2 * np.pi * k * week / 7), np.cos(2 * np.pi * k * week / 7)]
    return np.column_stack([*smooth, holiday]), np.maximum(t[:, None] - sites[None, :], 0.0)


@dataclass
class Fit:
    smooth: np.ndarray
    changes: np.ndarray
    sigma: float
    sites: np.ndarray
    scale: float             # of values
    origin: float            # first day
    length: float            # days of history
    yearly: bool
    weekly: bool


def fit_changes(smooth: np.ndarray, hinges: np.ndarray, n: np.ndarray, sy: np.ndarray, syy: np.ndarray,
                priors: Priors, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Smooth coefficients, slope changes and noise level of one series, from
    its counts and sums per day (values scaled)."""
    x = np.column_stack([smooth, hinges])
    gram, target = x.T @ (x * n[:, None]), x.T @ sy
    k, total, square = smooth.shape[1], float(n.sum()), float(syy.sum())
    ridge = np.r_[np.full(2, priors.line ** -2.0), np.full(k - 2, priors.season ** -2.0)]
    sigma = max(float(np.sqrt(max(square / total - (sy.sum() / total) ** 2, 0.0))), 1e-9)
    changes = np.zeros(hinges.shape[1])
    for _ in range(rounds):
        # The smooth block is solved for given changes and put into the system of the changes.
        own = gram[:k, :k] + np.diag(sigma ** 2 * ridge)
        gone = np.linalg.solve(own, np.column_stack([gram[:k, k:], target[:k]]))
        reduced = gram[k:, k:] - gram[k:, :k] @ gone[:, :-1]
        changes = lasso(reduced, target[k:] - gram[k:, :k] @ gone[:, -1],
                        np.full(len(changes), sigma ** 2 / priors.change), changes)
        beta = gone[:, -1] - gone[:, :-1] @ changes
        both = np.r_[beta, changes]
        new = max(float(np.sqrt(max(square - 2 * both @ target + both @ gram @ both, 0.0) / total)), 1e-9)
        settled = abs(new - sigma) <= 1e-7 * sigma
        sigma = new
        if settled:
            break
    return beta, changes, sigma


def fit_series(pdf: pd.DataFrame, priors: Priors) -> Fit:
    """Fit of one collapsed series (columns ds, t, n, sy, syy, is_holiday)."""
    t = pdf["t"].to_numpy(dtype=float)
    n, sy, syy = (pdf[c].to_numpy(dtype=float) for c in ("n", "sy", "syy"))
    origin, length = float(t.min()), max(float(t.max() - t.min()), 1.0)
    scale = float(np.abs(sy / n).max()) or 1.0
    count = min(priors.changes, max(len(pdf) - 2, 0))
    sites = np.linspace(0.0, priors.reach, count + 1)[1:]
    yearly, weekly = length + 1 >= YEARLY_DAYS, length + 1 >= WEEKLY_DAYS
    smooth, hinges = design((t - origin) / length, sites, pd.to_datetime(pdf["ds"]),
                            pdf["is_holiday"].to_numpy(dtype=float), yearly, weekly)
    beta, changes, sigma = fit_changes(smooth, hinges, n, sy / scale, syy / scale ** 2, priors)
    return Fit(beta, changes, sigma, sites, scale, origin, length, yearly, weekly)


def band(fit: Fit, ahead: np.ndarray) -> np.ndarray:
    """Standard error at times `ahead` of the end of the history (in units of
    its length; 0 inside): noise, and slope changes still to come."""
    size = float(np.abs(fit.changes).mean()) if len(fit.changes) else 0.0
    return fit.scale * np.sqrt(fit.sigma ** 2 + len(fit.changes) * 2 * size ** 2 * ahead ** 3 / 3)


def _days(prepared: DataFrame, keys: list[str], periods: int, holidays: DataFrame | None) -> DataFrame:
    hol = holidays if holidays is not None else default_holidays(prepared.sparkSession)
    return (_with_holiday_flag(future_frame(prepared, keys, periods, keep=("n", "sy", "syy")), hol)
            .withColumn("t", F.datediff("ds", F.lit(T_ORIGIN)).cast("double")))


def forecast_changepoints(prepared: DataFrame, keys: Sequence[str], periods: int = 30,
                          priors: Priors = Priors(), holidays: DataFrame | None = None) -> DataFrame:
    """History days with their fitted values and `periods` days more, from
    the collapsed series (`series_prepare`): keys, ds, is_future, trend, yhat
    and an 80 % band that widens with the horizon.  Yearly terms need two years
    of history, weekly ones two weeks; one day of history repeats itself."""
    keys = list(keys)
    rows = _days(prepared, keys, periods, holidays)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keys), *T._parse_datatype_string(
        "ds date, is_future boolean, trend double, yhat double, yhat_lower double, yhat_upper double")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        fit = fit_series(pdf[pdf["n"].notna()], priors)
        t = (pdf["t"].to_numpy(dtype=float) - fit.origin) / fit.length
        smooth, hinges = design(t, fit.sites, pd.to_datetime(pdf["ds"]), pdf["is_holiday"].to_numpy(dtype=float),
                                fit.yearly, fit.weekly)
        out = pdf[[*keys, "ds", "is_future"]].copy()
        out["trend"] = fit.scale * (smooth[:, :2] @ fit.smooth[:2] + hinges @ fit.changes)
        out["yhat"] = fit.scale * (smooth @ fit.smooth + hinges @ fit.changes)
        half = Z80 * band(fit, np.where(pdf["is_future"], t - t[pdf["n"].notna().to_numpy()].max(), 0.0))
        out["yhat_lower"], out["yhat_upper"] = out["yhat"] - half, out["yhat"] + half
        return out[schema.names]

    return rows.groupBy(*keys).applyInPandas(run, schema)


def trend_changes(prepared: DataFrame, keys: Sequence[str], priors: Priors = Priors(),
                  holidays: DataFrame | None = None) -> DataFrame:
    """The slope changes of every series that are not zero: keys, `ds` (the
    day of the change) and `change` (of the slope, per day)."""
    keys = list(keys)
    rows = _days(prepared, keys, 1, holidays).where("not is_future")
    schema = T.StructType([*(f for f in rows.schema.fields if f.name in keys),
                           *T._parse_datatype_string("ds date, change double")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        fit = fit_series(pdf, priors)
        on = np.flatnonzero(fit.changes)
        first = pd.Timestamp(pdf["ds"].iloc[0])
        out = pdf[keys].iloc[np.zeros(len(on), dtype=int)].reset_index(drop=True)
        out["ds"] = pd.Series([(first + pd.Timedelta(days=round(float(s) * fit.length))).date()
                               for s in fit.sites[on]], dtype=object)
        out["change"] = fit.scale * fit.changes[on] / fit.length
        return out[schema.names]

    return rows.groupBy(*keys).applyInPandas(run, schema)
