"""Our operators against the pandas behaviour the reference relies on, on
random small frames (pandas is the brute force here)."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest

from shelfline.operators import quality as Q
from shelfline.operators import transform as X


def _random_series(rnd, n_days=25, p_keep=0.5, p_null=0.2):
    start = dt.date(2024, 2, 20)
    days = sorted(rnd.sample(range(n_days), max(2, int(n_days * p_keep))))
    rows = []
    for d in days:
        v = None if rnd.random() < p_null else float(rnd.randint(0, 9))
        w = None if rnd.random() < p_null else rnd.randint(0, 5)
        rows.append((start + dt.timedelta(days=d), v, w))
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_completion_matches_pandas_asfreq(spark, seed):
    rnd = random.Random(seed)
    rows = _random_series(rnd)
    df = spark.createDataFrame(rows, "date date, sales double, items bigint")
    pdf = pd.DataFrame(rows, columns=["date", "sales", "items"])
    pdf["date"] = pd.to_datetime(pdf["date"])
    pdf = pdf.set_index("date")
    # Asfreq then forward fill everything
    want_ffill = pdf.asfreq("D").ffill()
    got = X.calendar_complete(df, keys=(), fill="ffill").toPandas().set_index("date").sort_index()
    assert list(pd.to_datetime(got.index)) == list(want_ffill.index)
    np.testing.assert_array_equal(got["sales"].to_numpy(dtype=float), want_ffill["sales"].to_numpy(dtype=float))
    # Asfreq with method="ffill" fills only the inserted days
    want_pad = pdf.asfreq("D", method="ffill")
    got = X.calendar_complete(df, keys=(), fill="pad").toPandas().set_index("date").sort_index()
    np.testing.assert_array_equal(got["sales"].to_numpy(dtype=float), want_pad["sales"].to_numpy(dtype=float))
    np.testing.assert_array_equal(got["items"].to_numpy(dtype=float), want_pad["items"].to_numpy(dtype=float))


@pytest.mark.parametrize("seed", range(4))
def test_quality_metrics_match_pandas(spark, seed):
    rnd = random.Random(100 + seed)
    rows = [(rnd.choice([None, 1.0, 2.0, -1.0, 0.0]), rnd.choice([None, 0, 3, 2000]), rnd.choice(["a", "b", None]))
            for _ in range(rnd.randint(5, 30))]
    df = spark.createDataFrame(rows, "sales double, items bigint, store_id string")
    pdf = pd.DataFrame(rows, columns=["sales", "items", "store_id"])
    m = {r["metric"]: r["value"] for r in Q.quality_metrics(df).collect()}
    assert m["total_rows"] == len(pdf)
    assert m["duplicate_rows"] == int(pdf.duplicated().sum())
    for c in pdf.columns:
        assert m[f"{c}_null_count"] == int(pdf[c].isnull().sum())
        assert m[f"{c}_null_ratio"] == pytest.approx(pdf[c].isnull().sum() / len(pdf))
    assert m["overall_null_ratio"] == pytest.approx(pdf.isnull().sum().sum() / (len(pdf) * 3))
    assert m["negative_sales_count"] == int((pdf["sales"] < 0).sum())
    assert m["zero_items_count"] == int((pdf["items"] == 0).sum())
    assert m["extreme_items_count"] == int((pdf["items"] > 1000).sum())


@pytest.mark.parametrize("seed", range(3))
def test_zscore_matches_pandas(spark, seed):
    rnd = random.Random(200 + seed)
    vals = [float(rnd.randint(0, 100)) for _ in range(rnd.randint(2, 15))]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, sales double")
    s = pd.Series(vals)
    want = ((s - s.mean()) / s.std()).to_numpy() if s.std() > 0 else np.zeros(len(s))
    got = [r["sales_normalized"] for r in X.zscore(df).orderBy("i").collect()]
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-12)


def test_group_first_and_mean_match_pandas(spark):
    rows = [(dt.date(2024, 1, 1), "s", "Food", 1.0, 1, 0.5), (dt.date(2024, 1, 1), "s", "Food", 2.0, 2, 1.5),
            (dt.date(2024, 1, 2), "s", "Food", 3.0, 3, -1.0)]
    df = X.calendar_features(spark.createDataFrame(
        rows, "date date, store_id string, product_category string, sales double, items bigint, sales_normalized double"))
    got = {r["date"]: r for r in X.daily_group(df).collect()}
    assert got[dt.date(2024, 1, 1)]["sales"] == 3.0 and got[dt.date(2024, 1, 1)]["items"] == 3
    assert got[dt.date(2024, 1, 1)]["sales_normalized"] == 1.0 and got[dt.date(2024, 1, 1)]["year"] == 2024
