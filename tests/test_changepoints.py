"""Sparse changepoints against a plain solver and planted breaks."""

import datetime as dt

import numpy as np
import pytest

from shelfline.operators import changepoints as C

DAY = dt.date(2021, 3, 1)


def plain_lasso(gram, target, penalty, steps=200_000):
    """Accelerated proximal gradient steps."""
    size = np.linalg.eigvalsh(gram)[-1]
    x = z = np.zeros(len(target))
    k = 1.0
    for _ in range(steps):
        step = z - (gram @ z - target) / size
        new = np.sign(step) * np.maximum(np.abs(step) - penalty / size, 0.0)
        k, before = (1 + np.sqrt(1 + 4 * k * k)) / 2, k
        z = new + (before - 1) / k * (new - x)
        if np.abs(new - x).max() < 1e-14:
            return new
        x = new
    return x


@pytest.mark.parametrize("seed", range(12))
def test_lasso_equals_a_plain_solver(seed):
    rng = np.random.default_rng(seed)
    t = np.linspace(0, 1, 300)
    x = np.maximum(t[:, None] - np.linspace(0, 0.8, 11)[None, 1:], 0) if seed % 2 else rng.normal(size=(300, 12))
    y = x[:, 2] * 3 - x[:, 5] * 2 + rng.normal(0, 0.05, 300)
    gram, target, penalty = x.T @ x, x.T @ y, np.full(x.shape[1], 0.05 if seed % 3 else 2.0)
    got, want = C.lasso(gram, target, penalty), plain_lasso(gram, target, penalty)

    def cost(v):
        return v @ gram @ v / 2 - target @ v + (penalty * np.abs(v)).sum()
    assert cost(got) <= cost(want) + 1e-9 * abs(cost(want))
    left = target - gram @ got                     # optimality conditions
    on = got != 0
    assert np.abs(left[on] - penalty[on] * np.sign(got[on])).max(initial=0) < 1e-6
    assert (np.abs(left[~on]) <= penalty[~on] + 1e-6).all()


def test_the_whole_fit_equals_a_plain_minimum():
    rng = np.random.default_rng(7)
    t = np.linspace(0, 1, 200)
    sites = np.linspace(0, 0.8, 9)[1:]
    smooth = np.column_stack([np.ones(200), t, np.sin(40 * t)])
    hinges = np.maximum(t[:, None] - sites, 0)
    y = 0.3 + 0.4 * t - 0.9 * np.maximum(t - 0.5, 0) + 0.05 * np.sin(40 * t) + rng.normal(0, 0.02, 200)
    n = rng.integers(1, 4, 200).astype(float)
    priors = C.Priors()
    beta, changes, sigma = C.fit_changes(smooth, hinges, n, n * y, n * y * y, priors)
    f = smooth @ beta + hinges @ changes
    assert sigma == pytest.approx(np.sqrt((n * (y - f) ** 2).sum() / n.sum()), rel=1e-6)

    def cost(b, c):
        r = y - smooth @ b - hinges @ c
        ridge = (b[:2] ** 2).sum() / priors.line ** 2 + (b[2:] ** 2).sum() / priors.season ** 2
        return (n * r * r).sum() / 2 / sigma ** 2 + np.abs(c).sum() / priors.change + ridge / 2
    best = cost(beta, changes)
    for _ in range(2000):
        step = 10 ** rng.uniform(-6, -2)
        assert cost(beta + step * rng.normal(size=3), changes + step * rng.normal(size=8) * (rng.random(8) < 0.5)
                    ) >= best - 1e-6 * abs(best)
    assert (changes == 0).sum() >= 3


def frame(spark, series):
    rows = [(s, DAY + dt.timedelta(days=i), 2, 2 * float(v), 2 * float(v) ** 2) for s, y in series.items()
            for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "sku string, ds date, n long, sy double, syy double").repartition(5)


def test_planted_breaks_and_the_band(spark):
    rng = np.random.default_rng(1)
    t = np.arange(500)
    noise = rng.normal(0, 2.0, 500)
    series = {"line": 100 + 0.5 * t + noise, "break": 100 + 0.5 * t - 1.2 * np.maximum(t - 240, 0) + noise,
              "two": 100 + 1.0 * np.maximum(t - 112, 0) - 1.5 * np.maximum(t - 320, 0) + noise,
              "flat": np.full(60, 3.0), "one": np.array([5.0]), "zero": np.zeros(20)}
    data = frame(spark, series)
    found = {}
    for r in C.trend_changes(data, ["sku"]).collect():
        found.setdefault(r.sku, []).append(((r.ds - DAY).days, r.change))

    def near(name, day, reach=48):
        return sum(c for d, c in found.get(name, []) if abs(d - day) <= reach)
    assert near("break", 240) == pytest.approx(-1.2, abs=0.15)
    assert near("two", 112) == pytest.approx(1.0, abs=0.15) and near("two", 320) == pytest.approx(-1.5, abs=0.2)
    assert sum(abs(c) for _, c in found.get("line", [])) < 0.1
    assert len(found["break"]) <= 8

    got = {}
    for r in C.forecast_changepoints(data, ["sku"], 60).orderBy("ds").collect():
        got.setdefault(r.sku, []).append(r)
    assert {s: len(v) for s, v in got.items()} == {s: len(y) + 60 for s, y in series.items()}
    ahead = {s: [r for r in v if r.is_future] for s, v in got.items()}
    assert [r.yhat for r in ahead["line"]] == pytest.approx((100 + 0.5 * np.arange(500, 560)).tolist(), abs=3)
    assert [r.yhat for r in ahead["break"]] == pytest.approx(
        (100 + 0.5 * np.arange(500, 560) - 1.2 * np.arange(260, 320)).tolist(), abs=8)
    width = [r.yhat_upper - r.yhat_lower for r in ahead["break"]]
    assert all(b > a for a, b in zip(width, width[1:])) and width[-1] > 1.2 * width[0]
    assert len({round(r.yhat_upper - r.yhat_lower, 9) for r in got["break"] if not r.is_future}) == 1
    assert all(r.yhat == pytest.approx(3.0, abs=0.01) for r in got["flat"])
    assert all(r.yhat == pytest.approx(5.0, abs=0.01) for r in got["one"])
    assert all(r.yhat == pytest.approx(0.0, abs=1e-6) for r in got["zero"])


def test_the_variance_of_changes_to_come():
    rng = np.random.default_rng(3)
    fit = C.Fit(np.zeros(3), np.array([0.3, 0.0, -0.2, 0.1, 0.0]), 0.0, np.zeros(5), 1.0, 0.0, 100.0, False, False)
    size, h, ends = 0.6 / 5, 0.7, []
    for _ in range(60_000):
        s = rng.uniform(0, h, rng.poisson(5 * h))
        ends.append((rng.laplace(0, size, len(s)) * (h - s)).sum())
    assert float(C.band(fit, np.array([h]))[0]) == pytest.approx(np.std(ends), rel=0.03)
