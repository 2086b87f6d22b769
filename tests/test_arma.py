"""J6 order search against explicit regressions and planted orders."""

import datetime as dt
from collections import Counter
from itertools import product

import numpy as np
import pytest

from shelfline.operators import arma

DAY = dt.date(2022, 1, 1)


def plain_candidates(y, grid):
    """Every model of the grid by least squares on its own design matrix."""
    n, out = len(y), {}
    rows = np.arange(grid.lags, n)
    for d, sd in product(range(grid.d + 1), (0, 1) if grid.seasonal else (0,)):
        w = y.copy()
        for lag in [1] * d + [grid.m] * sd:
            w = np.r_[np.full(lag, np.nan), w[lag:] - w[:-lag]]
        long = np.column_stack([np.ones(len(rows)), *(w[rows - i] for i in range(1, grid.long_ar + 1))])
        a = np.linalg.lstsq(long, w[rows], rcond=1e-9)[0]
        e = np.full(n, np.nan)
        for t in range(grid.long_ar, n):
            e[t] = w[t] - a[0] - sum(a[i] * w[t - i] for i in range(1, grid.long_ar + 1))
        for p, q in product(range(grid.p + 1), range(grid.q + 1)):
            for sp, sq in product((0, 1), (0, 1)) if grid.seasonal else [(0, 0)]:
                x = np.column_stack([np.ones(len(rows)), *(w[rows - i] for i in range(1, p + 1)),
                                     *([w[rows - grid.m]] * sp), *(e[rows - j] for j in range(1, q + 1)),
                                     *([e[rows - grid.m]] * sq)])
                b = np.linalg.lstsq(x, w[rows], rcond=1e-9)[0]
                sse, k = float(((w[rows] - x @ b) ** 2).sum()), x.shape[1] + 1
                n_rows = len(rows)
                out[d, p, q, sd, sp, sq] = (n_rows * np.log(sse / n_rows) + 2 * k + 2 * k * (k + 1) / (n_rows - k - 1),
                                            b, sse, k)
    return out


def walk(rng, n, ar=(), ma=(), d=0, scale=1.0, level=0.0, m=12, season=0.0):
    e = rng.normal(0, scale, n + 100)
    w = np.zeros(n + 100)
    for t in range(n + 100):
        w[t] = e[t] + sum(a * w[t - j] for j, a in enumerate(ar, 1) if t >= j)
        w[t] += sum(b * e[t - j] for j, b in enumerate(ma, 1) if t >= j) + (season * w[t - m] if t >= m else 0)
    w = w[100:]
    for _ in range(d):
        w = np.cumsum(w)
    return w + level


def random_series(seed, n):
    rng = np.random.default_rng(seed)
    kind = seed % 5
    return [walk(rng, n, (0.5,), (0.3,), level=50), walk(rng, n, (0.4, 0.3), level=100),
            walk(rng, n, d=1, level=20), walk(rng, n, season=0.7, level=5), rng.poisson(7, n).astype(float)][kind]


def frame(spark, series):
    rows = [(s, DAY + dt.timedelta(days=i), 2, 2 * float(v)) for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "sku string, ds date, n long, sy double").repartition(8)


def test_thousand_series_equal_explicit_regressions(spark):
    series = {f"s{i}": random_series(i, 75 + i % 40 if i < 100 else 18 + i % 30) for i in range(1000)}
    got = {r.sku: r for r in arma.arma_models(frame(spark, series), ["sku"]).collect()}
    assert len(got) == 1000
    for name, y in series.items():
        grid = arma.seasonal_grid(12) if len(y) - arma.seasonal_grid(12).lags >= arma.LEAST_ROWS else arma.plain_grid()
        want, r = plain_candidates(y, grid), got[name]
        order = (r.d, r.p, r.q, r.seasonal_d, r.seasonal_p, r.seasonal_q)
        aicc, b, sse, k = want[order]
        assert r.n == len(y) - grid.lags and r.k == k
        assert r.aicc == pytest.approx(aicc, abs=1e-5) and r.sse == pytest.approx(sse, rel=1e-6)
        assert r.const == pytest.approx(b[0], rel=1e-4, abs=1e-4)

        def by_lag(n, s, v):
            out = np.zeros(max(n, 12 * s))
            out[:n] = v[:n]
            out[11:12] += v[n:n + 1] if s else 0.0
            return out
        p, sp = r.p, r.seasonal_p
        ar, ma = by_lag(p, sp, b[1:1 + p + sp]), by_lag(r.q, r.seasonal_q, b[1 + p + sp:])
        assert r.ar == pytest.approx(ar.tolist(), abs=1e-5) and r.ma == pytest.approx(ma.tolist(), abs=1e-5)
        for other, (value, c, _, _) in want.items():             # nothing better was left out
            if value < aicc - 1e-5:
                o_p, o_sp = other[1], other[4]
                assert not (arma.stable(by_lag(o_p, o_sp, c[1:1 + o_p + o_sp]))
                            and arma.stable(-by_lag(other[2], other[5], c[1 + o_p + o_sp:])))


@pytest.mark.parametrize("planted, args", [
    ((0, 1, 0, 0, 0, 0), {"ar": (0.7,)}), ((0, 2, 0, 0, 0, 0), {"ar": (0.5, 0.35)}), ((0, 0, 1, 0, 0, 0), {"ma": (0.6,)}),
    ((1, 0, 0, 0, 0, 0), {"d": 1}), ((0, 0, 0, 0, 1, 0), {"season": 0.6}), ((1, 1, 0, 0, 0, 0), {"ar": (0.6,), "d": 1})])
def test_planted_orders_are_recovered(planted, args):
    found = Counter(arma.search(walk(np.random.default_rng(i), 900, level=30, **args), 12).order for i in range(30))
    assert found.most_common(1)[0][0] == planted


def test_coefficients_of_a_long_series():
    y = walk(np.random.default_rng(5), 20_000, (0.6,), (0.4,), level=10)
    z = arma.lagged(y - y.mean(), arma.seasonal_grid(12).lags)
    model = next(x for x in arma.candidates(z.T @ z, len(z), arma.seasonal_grid(12)) if x.order == (0, 1, 1, 0, 0, 0))
    assert model.ar[0] == pytest.approx(0.6, abs=0.03) and model.ma[0] == pytest.approx(0.4, abs=0.03)
    assert model.sse / model.n == pytest.approx(1.0, abs=0.03)


def test_forecasts(spark):
    rng = np.random.default_rng(2)
    trend = np.arange(200) * 2.0 + 5
    season = 50 + 10 * np.sin(2 * np.pi * np.arange(240) / 12) + rng.normal(0, 0.01, 240)
    series = {"trend": trend, "season": season, "flat": np.full(90, 7.0), "one": np.array([3.0]),
              "two": np.array([3.0, 5.0]), "ar": walk(rng, 400, (0.8,), level=100), "walk": walk(rng, 400, d=1)}
    got = {}
    for r in arma.forecast_arma(frame(spark, series), ["sku"], periods=24).orderBy("ds").collect():
        got.setdefault(r.sku, []).append(r)
    assert all(len(v) == 24 and v[0].ds == DAY + dt.timedelta(days=len(series[s])) for s, v in got.items())
    assert [r.yhat for r in got["trend"]] == pytest.approx([5 + 2.0 * (200 + h) for h in range(24)], rel=1e-4)
    want = 50 + 10 * np.sin(2 * np.pi * np.arange(240, 264) / 12)
    assert [r.yhat for r in got["season"]] == pytest.approx(want.tolist(), abs=0.1)
    assert all(r.yhat == pytest.approx(7.0) and r.yhat_upper == pytest.approx(7.0) for r in got["flat"])
    assert {r.yhat for r in got["one"]} == {3.0} and [r.yhat for r in got["two"]][:2] == [7.0, 9.0]
    widths = {s: [r.yhat_upper - r.yhat_lower for r in v] for s, v in got.items()}
    assert all(b >= a - 1e-9 for w in widths.values() for a, b in zip(w, w[1:]))
    assert widths["walk"][-1] > 3 * widths["walk"][0]


def test_the_band_covers_what_comes():
    inside = []
    for i in range(150):
        y = walk(np.random.default_rng(1000 + i), 420, (0.6,), level=10)
        yhat, spread = arma.forecast(y[:400], arma.search(y[:400], 12), 12, 20)
        inside.append(np.abs(y[400:] - yhat) <= arma.Z80 * spread)
    assert 0.72 <= np.mean(inside) <= 0.88
