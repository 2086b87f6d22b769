"""J6 order search: seasonal ARMA models of every series, chosen from a grid.

Each series is fitted by the two-stage regression of Hannan and Rissanen.  The
first stage fits a long autoregression, whose errors stand for the unknown
shocks; the second regresses the (differenced) values on their lags and on
lagged shocks.  Values, differences and shocks are all linear in the lagged
values, so one matrix of lagged cross-products per series holds everything
that any model of the grid needs: every candidate is a small linear system cut
out of it, and no candidate reads the series again.

All candidates are scored on the same rows and on one-step errors of the
undifferenced values, so their AICc can be compared across differencing.

The per-series work is a grouped map over the collapsed series (J1), at most
one row per calendar day, so a group is bounded by the span in days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z80 = 1.2815515655                  # two-sided 80 % normal quantile
LEAST_ROWS = 30                     # scored rows that the seasonal grid needs,
LEAST_ROWS_PLAIN = 10               # and the grid without seasons


@dataclass(frozen=True)
class Grid:
    """Largest orders of a grid; `long_ar` is the first stage's order."""
    d: int
    p: int
    q: int
    seasonal: bool
    m: int
    long_ar: int

    @property
    def lags(self) -> int:
        """Lagged values that the candidates look back on."""
        span = self.d + self.m * self.seasonal
        return span + max(self.q, self.m * self.seasonal) + self.long_ar

    def orders(self) -> Iterator[tuple[int, int, int, int, int, int]]:
        s = (0, 1) if self.seasonal else (0,)
        return product(range(self.d + 1), range(self.p + 1), range(self.q + 1), s, s, s)


def seasonal_grid(m: int) -> Grid:
    return Grid(d=1, p=3, q=2, seasonal=True, m=m, long_ar=m + 1)


def plain_grid() -> Grid:
    return Grid(d=1, p=2, q=1, seasonal=False, m=0, long_ar=4)


@dataclass
class Model:
    """(p, d, q)(P, D, Q): `ar` and `ma` by lag from 1 up, `n` scored rows."""
    order: tuple[int, int, int, int, int, int]      # d, p, q, D, P, Q
    const: float
    ar: np.ndarray
    ma: np.ndarray
    n: int
    k: int
    sse: float
    aicc: float | None


def lagged(y: np.ndarray, lags: int) -> np.ndarray:
    """Rows (1, y[t], y[t - 1], ..., y[t - lags]) for every t that has them."""
    rows = np.lib.stride_tricks.sliding_window_view(y, lags + 1)[:, ::-1]
    return np.column_stack([np.ones(len(rows)), rows])


def difference(d: int, seasonal: int, m: int) -> np.ndarray:
    """Coefficients of (1 - B)^d (1 - B^m)^seasonal by lag."""
    out = np.ones(1)
    for lag, times in ((1, d), (m, seasonal)):
        for _ in range(times):
            out = np.convolve(out, np.r_[1.0, np.zeros(lag - 1), -1.0])
    return out


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least-norm solution of a symmetric system, so that collinear
    regressors (a constant series, say) share their effect."""
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    scale[np.diag(a) <= 0] = 1.0
    return np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-9)[0] / scale


def stable(coefficients: np.ndarray) -> bool:
    """Whether x[t] = sum of coefficients[j - 1] * x[t - j] dies out."""
    used = np.flatnonzero(coefficients)
    if not len(used):
        return True
    n = used[-1] + 1
    step = np.zeros((n, n))
    step[0] = coefficients[:n]
    step[1:, :-1] = np.eye(n - 1)
    return bool(np.abs(np.linalg.eigvals(step)).max() < 0.9995)


def _by_lag(values: np.ndarray, n: int, m: int, seasonal: int) -> np.ndarray:
    out = np.zeros(max(n, m * seasonal))
    out[:n] = values[:n]
    if seasonal:
        out[m - 1] += values[n]
    return out


def candidates(products: np.ndarray, rows: int, grid: Grid) -> list[Model]:
    """Every model of the grid, best AICc first, from the lagged
    cross-products of a series."""
    size, m = products.shape[0], grid.m
    found = []
    for d, seasonal in product(range(grid.d + 1), (0, 1) if grid.seasonal else (0,)):
        c = difference(d, seasonal, m)

        def w(j: int) -> np.ndarray:
            out = np.zeros(size)
            out[1 + j:1 + j + len(c)] = c
            return out
        one = np.eye(1, size)[0]
        long = np.stack([one, *(w(i) for i in range(1, grid.long_ar + 1))])
        a = solve(long @ products @ long.T, long @ products @ w(0))

        def e(j: int) -> np.ndarray:
            return w(j) - a[0] * one - sum(a[i] * w(j + i) for i in range(1, grid.long_ar + 1))
        every = [one, *(w(i) for i in range(1, grid.p + 1)), *(e(j) for j in range(1, grid.q + 1))]
        if grid.seasonal:
            every += [w(m), e(m)]
        every = np.stack([*every, w(0)])
        cross = every @ products @ every.T
        for p, q, sp, sq in product(range(grid.p + 1), range(grid.q + 1),
                                    *([(0, 1)] * 2 if grid.seasonal else [(0,)] * 2)):
            at = [0, *range(1, p + 1), *([grid.p + grid.q + 1] * sp),
                  *range(grid.p + 1, grid.p + q + 1), *([grid.p + grid.q + 2] * sq)]
            b = solve(cross[np.ix_(at, at)], cross[at, -1])
            sse = max(float(cross[-1, -1] - 2 * b @ cross[at, -1] + b @ cross[np.ix_(at, at)] @ b), 0.0)
            k = len(at) + 1
            aicc = rows * np.log(max(sse, 1e-12 * rows) / rows) + 2 * k + 2 * k * (k + 1) / (rows - k - 1)
            found.append(Model((d, p, q, seasonal, sp, sq), float(b[0]), _by_lag(b[1:1 + p + sp], p, m, sp),
                               _by_lag(b[1 + p + sp:], q, m, sq), rows, k, sse, float(aicc)))
    return sorted(found, key=lambda x: (x.aicc, x.k, x.order))


def search(y: np.ndarray, m: int) -> Model:
    """The best model whose AR part is stationary and whose MA part is
    invertible.  A series too short for the seasonal grid is searched without
    seasons; one too short for that drifts by its mean change."""
    centre, spread = float(y.mean()), float(y.std()) or 1.0
    x = (y - centre) / spread
    for grid, least in ((seasonal_grid(m), LEAST_ROWS), (plain_grid(), LEAST_ROWS_PLAIN)):
        rows = len(y) - grid.lags
        if rows < least:
            continue
        z = lagged(x, grid.lags)
        for best in candidates(z.T @ z, rows, grid):
            if stable(best.ar) and stable(-best.ma):
                break
        # Back to the scale of the series.
        level = centre * (1 - best.ar.sum()) if not (best.order[0] or best.order[3]) else 0.0
        best.const = best.const * spread + level
        best.sse *= spread * spread
        best.aicc += 2 * rows * float(np.log(spread))
        return best
    change = np.diff(y)
    drift = float(change.mean()) if len(change) else 0.0
    return Model((1, 0, 0, 0, 0, 0), drift, np.zeros(0), np.zeros(0), len(change), 1,
                 float(((change - drift) ** 2).sum()) if len(change) else 0.0, None)


def shocks(w: np.ndarray, model: Model) -> np.ndarray:
    """One-step errors of a differenced series; those before its start are 0."""
    errors = np.zeros(len(w))
    base = w - model.const
    for j, a in enumerate(model.ar, 1):
        if a:
            base[j:] -= a * w[:-j]
    used = [(j, b) for j, b in enumerate(model.ma, 1) if b]
    base[:len(model.ar)] = 0.0
    if not used:
        return base
    for t in range(len(model.ar), len(w)):
        errors[t] = base[t] - sum(b * errors[t - j] for j, b in used if t >= j)
    return errors


def forecast(y: np.ndarray, model: Model, m: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Values ahead and their standard errors, which grow with the weights
    by which a shock lives on in the undifferenced values."""
    d, _, _, seasonal, _, _ = model.order
    c = difference(d, seasonal, m)
    w = np.convolve(y, c)[len(c) - 1:len(y)]
    past, errors = list(w), list(shocks(w.copy(), model)) + [0.0] * periods
    values = list(y)
    for h in range(periods):
        t = len(past)
        nxt = model.const + sum(a * past[t - j] for j, a in enumerate(model.ar, 1) if a and t >= j)
        nxt += sum(b * errors[t - j] for j, b in enumerate(model.ma, 1) if b and 0 <= t - j)
        past.append(nxt)
        values.append(nxt - sum(x * values[len(values) - j] for j, x in enumerate(c[1:], 1) if len(values) >= j))
    # psi weights of the whole autoregression, differences included.
    whole = -np.convolve(c, np.r_[1.0, -model.ar])[1:]
    psi = np.zeros(periods)
    for h in range(periods):
        psi[h] = (1.0 if h == 0 else model.ma[h - 1] if h <= len(model.ma) else 0.0) + sum(
            whole[j - 1] * psi[h - j] for j in range(1, min(h, len(whole)) + 1))
    free = max(model.n - model.k + 1, 1)
    return np.array(values[len(y):]), np.sqrt(model.sse / free * np.cumsum(psi * psi))


MODEL_FIELDS = ("n long, d int, p int, q int, seasonal_d int, seasonal_p int, seasonal_q int, k int, sse double, "
                "aicc double, const double, ar array<double>, ma array<double>")


def _searched(prepared: DataFrame, keys: Sequence[str], m: int, periods: int) -> DataFrame:
    keys = list(keys)
    fields = [f for f in prepared.schema.fields if f.name in keys]
    schema = T.StructType([*fields, *T._parse_datatype_string(
        MODEL_FIELDS + ", last_ds date, path array<double>, spread array<double>")])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        y = (pdf["sy"] / pdf["n"]).to_numpy(dtype=float)
        model = search(y, m)
        path, spread = forecast(y, model, m, periods) if periods else (np.zeros(0), np.zeros(0))
        d, p, q, sd, sp, sq = model.order
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in (f.name for f in fields)), model.n, d, p, q, sd, sp, sq, model.k,
                              model.sse, model.aicc, model.const, model.ar.tolist(), model.ma.tolist(),
                              pdf["ds"].iloc[-1], path.tolist(), spread.tolist()]], columns=schema.names)

    return prepared.select(*keys, "ds", "n", "sy").groupBy(*keys).applyInPandas(run, schema)


def arma_models(prepared: DataFrame, keys: Sequence[str], m: int = 12) -> DataFrame:
    """One model per series of the collapsed input (`series_prepare`):
    its orders (p, d, q)(seasonal_p, seasonal_d, seasonal_q) with season `m`,
    scored rows `n`, parameters `k`, `sse`, `aicc` and coefficients by lag.

    Observations of a series count as equally spaced, in the order of their
    days.  Seasonal terms add lag m itself, not products with shorter lags.  A
    constant series has errors of 0 and the smallest model; a series of fewer
    than 17 days drifts by its mean change and has no AICc."""
    return _searched(prepared, keys, m, 0).drop("last_ds", "path", "spread")


def forecast_arma(prepared: DataFrame, keys: Sequence[str], m: int = 12, periods: int = 30) -> DataFrame:
    """J6 horizon: `periods` days after each series' last one from its chosen
    model, with an 80 % band that widens with the horizon."""
    if not 1 <= periods <= 365:
        raise ValueError("periods must be in 1..365")
    keys = list(keys)
    rows = _searched(prepared, keys, m, periods).select(
        *keys, "last_ds", F.concat(F.lit("("), F.concat_ws(",", "p", "d", "q"), F.lit(")("),
                                   F.concat_ws(",", "seasonal_p", "seasonal_d", "seasonal_q"),
                                   F.lit(f"){m}")).alias("model"),
        F.posexplode(F.arrays_zip("path", "spread")).alias("_h", "_v"))
    band = Z80 * F.col("_v.spread")
    return rows.select(*keys, F.date_add("last_ds", F.col("_h") + 1).alias("ds"), "model",
                       F.col("_v.path").alias("yhat"), (F.col("_v.path") - band).alias("yhat_lower"),
                       (F.col("_v.path") + band).alias("yhat_upper"))
