"""Forecast fit quality on the reference's synthetic series, holidays, J6."""

import datetime as dt
import random

import numpy as np
import pytest

from shelfline.operators import forecast as J


def _synthetic(spark, sku="S", days=100):
    start = dt.date(2023, 1, 1)
    rows = [(sku, start + dt.timedelta(days=i), 100 + 0.5 * i + 10 * (i % 7)) for i in range(days)]
    return spark.createDataFrame(rows, "sku string, date date, units_sold double")


def test_trend_and_weekday_recovered_exactly(spark):
    prep = J.series_prepare(_synthetic(spark), ["sku"])
    hol = J.us_holidays(spark, 2023, 2023).filter("ds > date '2030-01-01'")  # no holidays
    models = J.fit_trend_season(prep, ["sku"], hol).first()
    assert models["slope"] == pytest.approx(0.5, abs=1e-9)
    assert models["sigma"] == pytest.approx(0.0, abs=1e-6)
    fc = J.score(J.fit_trend_season(prep, ["sku"], hol), J.future_frame(prep, ["sku"], 30), ["sku"], hol)
    start = dt.date(2023, 1, 1)
    for r in fc.collect():
        i = (r["ds"] - start).days
        assert r["yhat"] == pytest.approx(100 + 0.5 * i + 10 * (i % 7), abs=1e-6)
    assert fc.count() == 130


def test_us_holidays_2024(spark):
    h = {r["ds"]: r["holiday"] for r in J.us_holidays(spark, 2024, 2024).collect()}
    assert h[dt.date(2024, 1, 15)] == "Martin Luther King Jr. Day"
    assert h[dt.date(2024, 5, 27)] == "Memorial Day"
    assert h[dt.date(2024, 9, 2)] == "Labor Day"
    assert h[dt.date(2024, 11, 28)] == "Thanksgiving"
    assert h[dt.date(2024, 6, 19)] == "Juneteenth National Independence Day"
    h21 = {r["ds"]: r["holiday"] for r in J.us_holidays(spark, 2021, 2021).collect()}
    assert h21[dt.date(2021, 7, 5)] == "Independence Day (observed)"      # July 4 was a Sunday
    assert h21[dt.date(2021, 12, 24)] == "Christmas Day (observed)"       # Dec 25 was a Saturday


def test_pooled_rows_equal_weighted_fit(spark):
    # two stores on the same days: pooled fit equals the fit of the mean series
    base = _synthetic(spark)
    pooled = base.unionByName(base)
    hol = J.us_holidays(spark, 2023, 2023)
    a = J.fit_trend_season(J.series_prepare(pooled, ["sku"]), ["sku"], hol).first()
    b = J.fit_trend_season(J.series_prepare(base, ["sku"]), ["sku"], hol).first()
    assert a["slope"] == pytest.approx(b["slope"]) and a["n_obs"] == 2 * b["n_obs"]


def test_ar_select_prefers_seasonal_on_periodic_series(spark):
    start = dt.date(2023, 1, 1)
    rows = [("P", start + dt.timedelta(days=i), float([5, 9, 2, 7, 1, 8, 3, 6, 4, 0, 2, 5][i % 12]))
            for i in range(120)]
    prep = J.series_prepare(spark.createDataFrame(rows, "sku string, date date, units_sold double"), ["sku"])
    best = J.forecast_ar_select(prep, ["sku"], m=12).first()
    assert best["model"] == "seasonal_naive" and best["sse"] == 0.0


def test_piecewise_runs_per_series(spark):
    prep = J.series_prepare(_synthetic(spark).unionByName(_synthetic(spark, "T", 60)), ["sku"])
    out = J.forecast_piecewise(prep, ["sku"], periods=10)
    assert out.filter("sku = 'S'").count() == 110 and out.filter("sku = 'T'").count() == 70
    err = max(abs(r["yhat"] - (100 + 0.5 * ((r["ds"] - dt.date(2023, 1, 1)).days)
                               + 10 * (((r["ds"] - dt.date(2023, 1, 1)).days) % 7)))
              for r in out.filter("sku = 'S' and not is_future").collect())
    assert err < 2.0


def _py_ar_forecast(y, model, m, periods):
    y = np.asarray(y, dtype=float)
    t = np.arange(m + 1, len(y))                     # rows with m+1 lags
    y0, y1, ym, ym1 = y[t], y[t - 1], y[t - m], y[t - m - 1]

    def ols(a, b):
        bb = np.mean((b - b.mean()) * (a - a.mean())) / np.var(b)
        return a.mean() - bb * b.mean(), bb
    hist = list(y[-m:])
    out = []
    for h in range(1, periods + 1):
        if model == "drift":
            p = y[-1] + h * np.mean(y0 - y1)
        elif model == "ar1":
            a, b = ols(y0, y1)
            p = a + b * hist[-1]
        elif model == "seasonal_naive":
            p = hist[-m]
        else:
            a, b = ols(y0 - ym, y1 - ym1)
            d = y[-1] - y[-1 - m]
            for _ in range(h):
                d = a + b * d
            p = hist[-m] + d
        hist.append(p)
        out.append(p)
    return out


def test_ar_horizon_matches_python_recursion(spark):
    rnd = random.Random(11)
    start = dt.date(2023, 1, 1)
    series = {
        "P": [float([5, 9, 2, 7, 1, 8, 3, 6, 4, 0, 2, 5][i % 12]) for i in range(80)],
        "R": [10.0 + 0.8 * i + rnd.gauss(0, 2) for i in range(80)],
        "Q": [50.0 + 10 * ((i % 12) > 5) + rnd.gauss(0, 1) + 0.1 * i for i in range(80)],
    }
    rows = [(k, start + dt.timedelta(days=i), v) for k, ys in series.items() for i, v in enumerate(ys)]
    prep = J.series_prepare(spark.createDataFrame(rows, "sku string, date date, units_sold double"), ["sku"])
    fc = J.forecast_ar(prep, ["sku"], m=12, periods=15).collect()
    for k, ys in series.items():
        got = sorted((r["ds"], r["yhat"], r["model"]) for r in fc if r["sku"] == k)
        assert len(got) == 15 and got[0][0] == start + dt.timedelta(days=80)
        want = _py_ar_forecast(ys, got[0][2], 12, 15)
        np.testing.assert_allclose([g[1] for g in got], want, rtol=1e-7, atol=1e-7)


def test_short_series_keep_a_model_and_a_horizon(spark):
    start = dt.date(2023, 1, 1)
    rows = [(f"S{n}", start + dt.timedelta(days=i), float(3 * i + (i % 2))) for n in (1, 2, 3, 5, 13, 14, 15, 40)
            for i in range(n)]
    prep = J.series_prepare(spark.createDataFrame(rows, "sku string, date date, units_sold double"), ["sku"])
    best = {r["sku"]: r for r in J.forecast_ar_select(prep, ["sku"]).collect()}
    assert set(best) == {f"S{n}" for n in (1, 2, 3, 5, 13, 14, 15, 40)}
    assert best["S1"]["model"] == best["S2"]["model"] == best["S3"]["model"] == "drift"
    assert best["S15"]["n"] == 2 and best["S15"]["model"] not in ("ar1", "seasonal_diff_ar1")
    out = J.forecast_ar(prep, ["sku"], periods=5).collect()
    assert len(out) == 8 * 5 and all(r["yhat"] is not None for r in out)
    assert {r["yhat"] for r in out if r["sku"] == "S1"} == {0.0}


def test_dates_without_known_holidays_are_refused(spark):
    prep = J.series_prepare(spark.createDataFrame([("S", dt.date(2250, 1, 1), 1.0)],
                                                  "sku string, date date, units_sold double"), ["sku"])
    with pytest.raises(Exception, match="holidays are known"):
        J.forecast_trend_season(prep, ["sku"], 3).collect()


def test_stock_of_all_stores_meets_demand_of_all_stores(spark):
    from shelfline.operators import reorder as R
    from shelfline.plans.flows import clearance_plan
    d = dt.date(2024, 1, 1)
    sales = spark.createDataFrame(
        [("A", "x", d, 5, 2.0, 100), ("A", "x", d + dt.timedelta(days=1), 5, 3.0, 40), ("B", "x", d, 5, 4.0, 30)],
        "store_id string, sku string, date date, units_sold int, price double, on_hand int")
    fc = spark.createDataFrame([("x", True, 100.0)], "sku string, is_future boolean, yhat double")
    cfg = R.ReorderConfig(budget=1e9, shelf_space=1e9, min_service_level=0.9)
    orders, _ = clearance_plan(fc, sales, None, cfg)
    row = orders.first()
    assert (row["on_hand"], row["price"], row["order_qty"]) == (70, 3.0, 20)


def test_piecewise_equals_a_plain_ridge_solve(spark):
    from shelfline.sources import fixtures as V
    sales = V.retail_sales(spark, "/root/testdata/sf0.001")
    one = sales.groupBy("sku").count().orderBy("count", ascending=False).first()["sku"]
    prep = J.series_prepare(sales.where(sales["sku"] == one), ["sku"])
    rows = sorted((r["ds"], r["n"], r["sy"]) for r in prep.collect())
    holidays = {r["ds"] for r in J.us_holidays(spark, rows[0][0].year, rows[-1][0].year + 1).collect()}
    days = [d for d, _, _ in rows] + [rows[-1][0] + dt.timedelta(days=i) for i in range(1, 11)]
    t = np.array([(d - rows[0][0]).days for d in days], dtype=float)
    t /= max(t[len(rows) - 1], 1.0)
    cuts = np.linspace(0, 0.8, min(25, len(rows) - 1) + 2)[1:-1]
    dow = np.array([(d.weekday() + 1) % 7 + 1 for d in days], dtype=float)
    doy = np.array([d.timetuple().tm_yday for d in days], dtype=float)
    waves = [f(2 * np.pi * k * x / p) for x, p, top in ((doy, 365.25, 10), (dow, 7.0, 3))
             for k in range(1, top + 1) for f in (np.sin, np.cos)]
    X = np.column_stack([np.ones(len(days)), t, *(np.maximum(0, t - c) for c in cuts), *waves,
                         [float(d in holidays) for d in days]])
    n, y = np.array([x[1] for x in rows], dtype=float), np.array([x[2] / x[1] for x in rows])
    root = np.sqrt(n)[:, None]
    shrink = np.sqrt(np.array([1e-9, 1e-9] + [1.0] * (X.shape[1] - 2)))
    # ridge as ordinary least squares on an extended system
    beta = np.linalg.lstsq(np.vstack([X[:len(rows)] * root, np.diag(shrink)]),
                           np.concatenate([y * root[:, 0], np.zeros(X.shape[1])]), rcond=None)[0]
    got = {r["ds"]: r["yhat"] for r in J.forecast_piecewise(prep, ["sku"], 10).collect()}
    assert len(got) == len(days)
    assert np.allclose([got[d] for d in days], X @ beta, rtol=1e-5, atol=1e-4)


def test_a_rerun_replaces_the_models_of_its_date(spark, tmp_path):
    from shelfline.plans.flows import auto_forecast
    rows = [(f"s{k}", "A", "north", dt.date(2024, 1, 1) + dt.timedelta(days=i), 5 + k + i % 7)
            for k in range(3) for i in range(40)]
    sales = spark.createDataFrame(rows, "sku string, store_id string, region string, date date, units_sold int")
    path, day = f"{tmp_path}/models", dt.date(2026, 1, 1)
    one = sorted(map(tuple, auto_forecast(spark, sales, ["sku"], 5, path, day).collect()), key=str)
    auto_forecast(spark, sales, ["sku"], 5, path, day + dt.timedelta(days=1))
    again = sorted(map(tuple, auto_forecast(spark, sales, ["sku"], 5, path, day).collect()), key=str)
    assert one == again and len(one) == 3 * 45
    assert J.load_models(spark, path, day).count() == 3
    assert spark.read.parquet(path).count() == 6
