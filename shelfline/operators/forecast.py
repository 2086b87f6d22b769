"""Demand forecasting for every series at once.

The reference fits one additive model (trend + weekly/yearly seasonality +
US holidays) per request.  Here every series is fitted in one job with
closed-form least squares expressed as aggregates:

* J1 collapses the input to one row per (series, day) keeping n, Σy, Σy², so
  pooled fits stay exact and a series holds at most one row per calendar
  day: every per-series window below is bounded by the series' span in days,
  whatever the data volume or key skew.
* J4 fits trend + weekday effects jointly with the within estimator
  (demean y and t per weekday, slope = Σỹt̃ / Σt̃²), then month-of-year
  (with >= 730 days of history) and holiday effects as residual means, and
  an 80 % band from the residual standard deviation.  All of it is window
  aggregates over ONE shuffle on the series keys.
* J5 (fuller piecewise-linear + Fourier model, ridge) is a grouped-map
  Pandas UDF over the collapsed series; J6 selects among simple
  autoregressive candidates by AIC with built-in regression aggregates.
"""

from __future__ import annotations

import datetime as dt
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.columns import ntz_literal

T_ORIGIN = dt.date(2020, 1, 1)      # day 0 of the trend variable
Z80 = 1.2815515655                  # two-sided 80 % normal quantile
YEARLY_MIN_DAYS = 730               # yearly effect only with >= 2 years
DEFAULT_PERIODS = 30
# Span of the holiday calendar joined to the series: a fixed, data-free
# table of ~22 rows per year (~6.6k rows), so its broadcast size is proven.
HOLIDAY_YEARS = (1900, 2199)

# US federal holiday rules (public calendar).
FIXED_DATE_HOLIDAYS = [
    # name, month, day, first year
    ("New Year's Day", 1, 1, 1870),
    ("Juneteenth National Independence Day", 6, 19, 2021),
    ("Independence Day", 7, 4, 1870),
    ("Veterans Day", 11, 11, 1938),
    ("Christmas Day", 12, 25, 1870),
]
NTH_WEEKDAY_HOLIDAYS = [
    # name, month, weekday, n-th
    ("Martin Luther King Jr. Day", 1, "MON", 3),
    ("Washington's Birthday", 2, "MON", 3),
    ("Labor Day", 9, "MON", 1),
    ("Columbus Day", 10, "MON", 2),
    ("Thanksgiving", 11, "THU", 4),
]
LAST_WEEKDAY_HOLIDAYS = [("Memorial Day", 5, "MON")]


# ---------------------------------------------------------------- J1
def series_prepare(df: DataFrame, keys: Sequence[str], date: str = "date", y: str = "units_sold") -> DataFrame:
    """One row per (series, ds) with n, Σy and Σy² (partial aggregation
    before the shuffle, so a hot series is combined map-side)."""
    yv = F.col(y).cast("double")
    return (df.groupBy(*keys, F.col(date).cast("date").alias("ds"))
              .agg(F.count(yv).alias("n"), F.sum(yv).alias("sy"), F.sum(yv * yv).alias("syy"))
              .filter(F.col("n") > 0))


# ---------------------------------------------------------------- J2
def us_holidays_for_years(years: DataFrame) -> DataFrame:
    """(ds, holiday) for every year in the one-column frame `years`,
    including weekend-observed days (Saturday -> Friday, Sunday -> Monday).
    One projection: every rule is a (date, name) struct of the year, the
    array is exploded and rules that do not apply (null date) dropped."""
    y = F.col("year")
    items = []
    for name, month, day, first in FIXED_DATE_HOLIDAYS:
        d = F.when(y >= first, F.make_date(y, F.lit(month), F.lit(day)))
        dow = F.dayofweek(d)
        observed = (F.when(dow == 7, F.date_sub(d, 1)).when(dow == 1, F.date_add(d, 1)))
        items.append(F.struct(d.alias("ds"), F.lit(name).alias("holiday")))
        items.append(F.struct(observed.alias("ds"), F.lit(name + " (observed)").alias("holiday")))
    for name, month, wd, nth in NTH_WEEKDAY_HOLIDAYS:
        first_day = F.make_date(y, F.lit(month), F.lit(1))
        d = F.date_add(F.next_day(F.date_sub(first_day, 1), wd), 7 * (nth - 1))
        items.append(F.struct(d.alias("ds"), F.lit(name).alias("holiday")))
    for name, month, wd in LAST_WEEKDAY_HOLIDAYS:
        last_day = F.last_day(F.make_date(y, F.lit(month), F.lit(1)))
        d = F.date_sub(F.next_day(last_day, wd), 7)
        items.append(F.struct(d.alias("ds"), F.lit(name).alias("holiday")))
    return (years.select(F.inline(F.array(*items)))
                 .filter(F.col("ds").isNotNull()))


def us_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return us_holidays_for_years(years)


def holidays_for(prepared: DataFrame, periods: int = DEFAULT_PERIODS) -> DataFrame:
    """J2 as reported: the holidays of the years from the first history date
    to the end of the horizon (the span is one scalar aggregate)."""
    span = prepared.agg(F.min(F.year("ds")).alias("lo"),
                        F.max(F.year(F.date_add("ds", periods))).alias("hi")).first()
    if span["lo"] is None:
        return us_holidays(prepared.sparkSession, 1, 0)
    return us_holidays(prepared.sparkSession, int(span["lo"]), int(span["hi"]))


def default_holidays(spark: SparkSession) -> DataFrame:
    """Holiday calendar used for fitting and scoring (fixed span, no data
    lineage, so it adds no pass over the input).  Dates outside the span are
    refused where the calendar is joined (`_with_holiday_flag`)."""
    return us_holidays(spark, *HOLIDAY_YEARS)


def with_holidays(df: DataFrame, holidays: DataFrame, date: str = "ds") -> DataFrame:
    """Dates matched to the holiday calendar (left join; names of
    holidays falling on the same day joined with ", ").  The calendar side
    is one row per date of a fixed small table, so it is broadcast."""
    names = holidays.groupBy(F.col("ds").alias("_hd")).agg(
        F.array_join(F.array_sort(F.collect_list("holiday")), ", ").alias("holiday"))
    return (df.join(F.broadcast(names), F.col(date) == F.col("_hd"), "left").drop("_hd")
              .withColumn("is_holiday", F.col("holiday").isNotNull()))


# ---------------------------------------------------------------- J3
def future_frame(prepared: DataFrame, keys: Sequence[str], periods: int = DEFAULT_PERIODS,
                 keep: Sequence[str] = ()) -> DataFrame:
    """History dates of each series plus `periods` further days, which
    its last row emits, so the input is read once; `keep` columns stay on the
    history rows and are null on the others."""
    if not 1 <= periods <= 365:
        raise ValueError("periods must be in 1..365")
    last = F.max("ds").over(Window.partitionBy(*keys)) == F.col("ds")
    days = F.when(F.col("_is_end"), F.sequence(F.col("ds"), F.date_add("ds", periods))).otherwise(F.array("ds"))
    rows = (prepared.select(*keys, *keep, "ds", last.alias("_is_end"))
            .select(*keys, *keep, F.col("ds").alias("_seen"), F.explode(days).alias("ds")))
    ahead = F.col("ds") > F.col("_seen")
    return rows.select(*keys, "ds", ahead.alias("is_future"), *(F.when(~ahead, F.col(c)).alias(c) for c in keep))


def horizon_frame(models: DataFrame, keys: Sequence[str], periods: int = DEFAULT_PERIODS) -> DataFrame:
    """J3 from a model table, which holds each series' last day: the
    `periods` days after it, without reading any history."""
    if not 1 <= periods <= 365:
        raise ValueError("periods must be in 1..365")
    days = F.sequence(F.date_add("last_ds", 1), F.date_add("last_ds", periods))
    return models.select(*keys, F.explode(days).alias("ds"), F.lit(True).alias("is_future"))


def _known_year(date: str, value: Column) -> Column:
    """`value`, or an error for a date whose holidays no calendar here has."""
    known = F.year(date).between(*HOLIDAY_YEARS)
    return F.when(known | F.col(date).isNull(), value).otherwise(F.raise_error(F.concat(
        F.lit(f"holidays are known for {HOLIDAY_YEARS[0]}-{HOLIDAY_YEARS[1]}, not for "), F.col(date).cast("string")
    )).cast("double"))


def _with_holiday_flag(df: DataFrame, holidays: DataFrame) -> DataFrame:
    hol = holidays.select("ds").distinct().withColumn("_hol", F.lit(1.0))
    return (df.join(F.broadcast(hol), "ds", "left")
              .withColumn("is_holiday", _known_year("ds", F.coalesce(F.col("_hol"), F.lit(0.0)))).drop("_hol"))


def _fit_rows(prepared: DataFrame, keys: Sequence[str], holidays: DataFrame) -> DataFrame:
    """Every (series, ds) row with its fitted value `yfit` and its series'
    coefficients, computed by window aggregates after ONE repartition on the
    series keys (all window specs are the keys or keys + weekday / month, so
    no further exchange is planned)."""
    keys = list(keys)
    rows = (_with_holiday_flag(prepared, holidays)
            .repartition(*keys)
            .withColumns({"t": F.datediff("ds", F.lit(T_ORIGIN)).cast("double"),
                          "w": F.dayofweek("ds"), "mo": F.month("ds")}))
    ws = Window.partitionBy(*keys)
    wsw = Window.partitionBy(*keys, "w")
    wsm = Window.partitionBy(*keys, "mo")
    n, sy, t = F.col("n").cast("double"), F.col("sy"), F.col("t")
    rows = rows.withColumns({
        "first_ds": F.min("ds").over(ws), "last_ds": F.max("ds").over(ws),
        "n_w": F.sum(n).over(wsw), "nt_w": F.sum(n * t).over(wsw), "sy_w": F.sum(sy).over(wsw)})
    rows = rows.withColumns({"tbar": F.col("nt_w") / F.col("n_w"), "ybar": F.col("sy_w") / F.col("n_w")})
    tb, yb = F.col("tbar"), F.col("ybar")
    rows = rows.withColumns({
        "sxy": F.sum(t * sy - tb * sy - yb * n * t + n * tb * yb).over(ws),
        "sxx": F.sum(n * (t - tb) * (t - tb)).over(ws)})
    rows = rows.withColumn("slope", F.when(F.col("sxx") > 0, F.col("sxy") / F.col("sxx")).otherwise(0.0))
    rows = rows.withColumn("a_w", yb - F.col("slope") * tb)
    rows = rows.withColumns({
        "span_days": F.datediff("last_ds", "first_ds") + 1,
        "r1": sy / n - (F.col("a_w") + F.col("slope") * t)})
    yearly = F.col("span_days") >= YEARLY_MIN_DAYS
    rows = rows.withColumn("m_row", F.when(yearly, F.sum(n * F.col("r1")).over(wsm) / F.sum(n).over(wsm))
                           .otherwise(0.0))
    rows = rows.withColumn("r2", F.col("r1") - F.col("m_row"))
    hol = F.col("is_holiday")
    rows = rows.withColumn("h", F.coalesce(
        F.sum(hol * n * F.col("r2")).over(ws) / F.sum(F.when(hol > 0, n)).over(ws), F.lit(0.0)))
    rows = rows.withColumn("yfit", F.col("a_w") + F.col("slope") * t + F.col("m_row") + F.col("h") * hol)
    yf = F.col("yfit")
    rows = rows.withColumns({
        "N": F.sum(n).over(ws),
        "Sr": F.sum(sy - n * yf).over(ws),
        "Srr": F.sum(F.col("syy") - 2.0 * yf * sy + n * yf * yf).over(ws),
        **{f"a{k}": F.max(F.when(F.col("w") == k, F.col("a_w"))).over(ws) for k in range(1, 8)},
        **{f"m{k}": F.max(F.when(F.col("mo") == k, F.col("m_row"))).over(ws) for k in range(1, 13)},
    })
    var = (F.col("Srr") - F.col("Sr") * F.col("Sr") / F.col("N")) / (F.col("N") - 1)
    return rows.withColumn("sigma", F.when(F.col("N") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0))


def _model_cols(keys: Sequence[str]) -> list[Column]:
    return [
        *keys,
        F.col("slope"),
        F.array(*[F.col(f"a{k}") for k in range(1, 8)]).alias("weekday_effect"),
        F.array(*[F.coalesce(F.col(f"m{k}"), F.lit(0.0)) for k in range(1, 13)]).alias("month_effect"),
        F.col("h").alias("holiday_effect"),
        F.col("sigma"),
        F.col("N").cast("bigint").alias("n_obs"), "first_ds", "last_ds", "span_days"]


def fit_trend_season(prepared: DataFrame, keys: Sequence[str], holidays: DataFrame) -> DataFrame:
    """J4 fit -> model table, one row per series:
    keys, slope, weekday_effect (7), month_effect (12), holiday_effect,
    sigma, n_obs, first_ds, last_ds, span_days."""
    rows = _fit_rows(prepared, keys, holidays)
    return rows.filter(F.col("ds") == F.col("last_ds")).select(*_model_cols(keys))


def score(models: DataFrame, frame: DataFrame, keys: Sequence[str], holidays: DataFrame) -> DataFrame:
    """Evaluate a saved model table on (keys, ds) rows.  A weekday never
    seen in history falls back to the mean of the seen weekday intercepts."""
    keys = list(keys)
    j = _with_holiday_flag(frame, holidays).join(models, keys)
    yhat = _yhat(j)
    band = F.lit(Z80) * F.col("sigma")
    extra = [c for c in frame.columns if c not in keys and c != "ds"]
    return j.select(*keys, "ds", *extra, yhat.alias("yhat"), (yhat - band).alias("yhat_lower"),
                    (yhat + band).alias("yhat_upper"))


def _yhat(models_like: DataFrame) -> Column:
    seen = F.filter("weekday_effect", lambda x: x.isNotNull())
    fallback = F.aggregate(seen, F.lit(0.0), lambda acc, x: acc + x) / F.greatest(F.size(seen), F.lit(1))
    a = F.coalesce(F.element_at("weekday_effect", F.dayofweek("ds")), fallback)
    m = F.element_at("month_effect", F.month("ds"))
    t = F.datediff("ds", F.lit(T_ORIGIN)).cast("double")
    return a + F.col("slope") * t + m + F.col("holiday_effect") * F.col("is_holiday")


def forecast_trend_season(prepared: DataFrame, keys: Sequence[str], periods: int = DEFAULT_PERIODS,
                          holidays: DataFrame | None = None) -> DataFrame:
    """J4 end to end in one pass over the fitted rows: every history row
    emits itself with its fitted value, and each series' last row also emits
    the `periods` horizon days (it carries the series' coefficients, which
    are window aggregates present on every row).  No model-table join and
    no second evaluation of the fit: J1's aggregate and the fit's
    repartition are the only shuffles."""
    if not 1 <= periods <= 365:
        raise ValueError("periods must be in 1..365")
    keys = list(keys)
    hol = holidays if holidays is not None else default_holidays(prepared.sparkSession)
    rows = _fit_rows(prepared, keys, hol)
    days = F.when(F.col("ds") == F.col("last_ds"),
                  F.sequence(F.col("ds"), F.date_add("ds", periods))).otherwise(F.array(F.col("ds")))
    out = rows.select(*_model_cols(keys), F.col("ds").alias("_obs"), "yfit", days.alias("_days"))
    out = out.select("*", F.explode("_days").alias("ds")).drop("_days")
    out = _with_holiday_flag(out, hol)
    is_future = F.col("ds") > F.col("_obs")
    yhat = F.when(is_future, _yhat(out)).otherwise(F.col("yfit"))
    band = F.lit(Z80) * F.col("sigma")
    return out.select(*keys, "ds", is_future.alias("is_future"), yhat.alias("yhat"),
                      (yhat - band).alias("yhat_lower"), (yhat + band).alias("yhat_upper"))


# ---------------------------------------------------------------- J5
def _piecewise_design(t: np.ndarray, changepoints: np.ndarray, dow: np.ndarray, doy: np.ndarray,
                      hol: np.ndarray) -> np.ndarray:
    cols = [np.ones_like(t), t]
    cols += [np.maximum(0.0, t - c) for c in changepoints]
    for k in range(1, 11):                       # yearly Fourier, order 10
        cols += [np.sin(2 * np.pi * k * doy / 365.25), np.cos(2 * np.pi * k * doy / 365.25)]
    for k in range(1, 4):                        # weekly Fourier, order 3
        cols += [np.sin(2 * np.pi * k * dow / 7.0), np.cos(2 * np.pi * k * dow / 7.0)]
    cols.append(hol)
    return np.column_stack(cols)


def forecast_piecewise(prepared: DataFrame, keys: Sequence[str], periods: int = DEFAULT_PERIODS,
                       n_changepoints: int = 25, changepoint_range: float = 0.8,
                       ridge: float = 1.0, holidays: DataFrame | None = None) -> DataFrame:
    """Linear trend with up to `n_changepoints` hinges in the first 80 %
    of history, yearly (order 10) and weekly (order 3) Fourier terms and a
    holiday term, fitted by weighted ridge least squares per series.

    A grouped-map Pandas UDF over the J1-collapsed series: each group is at
    most one row per calendar day of that series, so group size is bounded
    by the history span, not by the data volume."""
    keys = list(keys)
    hol = holidays if holidays is not None else default_holidays(prepared.sparkSession)
    both = (_with_holiday_flag(future_frame(prepared, keys, periods, keep=("n", "sy")), hol)
            .withColumn("t", F.datediff("ds", F.lit(T_ORIGIN)).cast("double"))
            .withColumn("dow", F.dayofweek("ds").cast("double"))
            .withColumn("doy", F.dayofyear("ds").cast("double")))
    key_fields = [f for f in both.schema.fields if f.name in keys]
    out_schema = T.StructType(key_fields + [
        T.StructField("ds", T.DateType()), T.StructField("is_future", T.BooleanType()),
        T.StructField("yhat", T.DoubleType()), T.StructField("yhat_lower", T.DoubleType()),
        T.StructField("yhat_upper", T.DoubleType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        obs = pdf["n"].notna() & (pdf["n"] > 0)
        h = pdf[obs]
        t_all = pdf["t"].to_numpy()
        t0, t1 = float(h["t"].min()), float(h["t"].max())
        scale = max(t1 - t0, 1.0)
        ts = (t_all - t0) / scale
        hist_ts = (h["t"].to_numpy() - t0) / scale
        ncp = min(n_changepoints, max(len(h) - 1, 0))
        cps = (np.linspace(0, changepoint_range * hist_ts.max(), ncp + 2)[1:-1]
               if ncp > 0 else np.array([]))
        X = _piecewise_design(ts, cps, pdf["dow"].to_numpy(), pdf["doy"].to_numpy(),
                              pdf["is_holiday"].to_numpy())
        Xh = X[obs.to_numpy()]
        wts = h["n"].to_numpy(dtype=float)
        yh = h["sy"].to_numpy(dtype=float) / wts
        penalty = np.full(X.shape[1], ridge)
        penalty[:2] = 1e-9                        # do not shrink level and base slope
        A = Xh.T @ (Xh * wts[:, None]) + np.diag(penalty)
        b = Xh.T @ (wts * yh)
        beta = np.linalg.solve(A, b)
        fit_all = X @ beta
        resid = yh - Xh @ beta
        sigma = float(np.sqrt(np.sum(wts * resid ** 2) / max(wts.sum() - 1, 1.0)))
        out = pdf[keys + ["ds", "is_future"]].copy()
        out["yhat"] = fit_all
        out["yhat_lower"] = fit_all - Z80 * sigma
        out["yhat_upper"] = fit_all + Z80 * sigma
        return out

    return both.groupBy(*keys).applyInPandas(fit, schema=out_schema)


# ---------------------------------------------------------------- J6
AR_CANDIDATES = ("drift", "ar1", "seasonal_naive", "seasonal_diff_ar1")


def _ar_lags(prepared: DataFrame, keys: Sequence[str], m: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("ds")
    y = (F.col("sy") / F.col("n"))
    return prepared.select(*keys, "ds", y.alias("y")).withColumns({
        "y1": F.lag("y", 1).over(w), "ym": F.lag("y", m).over(w), "ym1": F.lag("y", m + 1).over(w),
        "_last": F.array(*[F.lag("y", m - 1 - i).over(w) for i in range(m - 1)], F.col("y")),
        "_is_last": F.lead("ds").over(w).isNull()})


def _line(y: str, x: str, intercept: str, slope: str) -> list[Column]:
    """Least-squares line; a constant regressor gives the mean and slope 0."""
    flat = (F.regr_sxx(y, x) == 0) & (F.regr_count(y, x) > 0)
    return [F.when(flat, F.avg(F.when(F.col(x).isNotNull(), F.col(y)))).otherwise(F.regr_intercept(y, x)).alias(intercept),
            F.when(flat, 0.0).otherwise(F.regr_slope(y, x)).alias(slope)]


def _ar_fit(r: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Regression sums of every candidate, in one grouped pass.  Series with
    lags of a season score all candidates on the rows that have them; a
    shorter series has no such rows and scores drift and AR(1) on the rows
    that have one lag (suffix 0)."""
    full = F.col("ym1").isNotNull()
    r = r.withColumns({
        "dy0": F.col("y") - F.col("y1"), "x0": F.when(F.col("y1").isNotNull(), F.col("y")), "y10": F.col("y1"),
        "fy": F.when(full, F.col("y")), "fy1": F.when(full, F.col("y1")),
        "dy": F.when(full, F.col("y") - F.col("y1")),
        "dm": F.when(full, F.col("y") - F.col("ym")), "dm1": F.when(full, F.col("y1") - F.col("ym1"))})
    return r.groupBy(*keys).agg(
        F.count(F.when(full, 1)).alias("n_full"), F.count("dy0").alias("n_short"),
        F.var_pop("dy").alias("v_dy"), F.avg("dy").alias("c_dy"),
        F.regr_syy("fy", "fy1").alias("syy1"), F.regr_sxy("fy", "fy1").alias("sxy1"),
        F.regr_sxx("fy", "fy1").alias("sxx1"),
        *_line("fy", "fy1", "i1", "s1"),
        F.sum(F.col("dm") * F.col("dm")).alias("sse_sn"),
        F.regr_syy("dm", "dm1").alias("syy2"), F.regr_sxy("dm", "dm1").alias("sxy2"),
        F.regr_sxx("dm", "dm1").alias("sxx2"),
        *_line("dm", "dm1", "a2", "b2"),
        F.var_pop("dy0").alias("v_dy0"), F.avg("dy0").alias("c_dy0"),
        F.regr_syy("x0", "y10").alias("syy0"), F.regr_sxy("x0", "y10").alias("sxy0"),
        F.regr_sxx("x0", "y10").alias("sxx0"),
        *_line("x0", "y10", "i0", "s0"),
        F.max_by(F.struct("ds", "y", "ym", "_last"), "ds").alias("end"))


def _ar_choose(g: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add n (rows scored), model, k, sse, aic and the chosen parameters c_drift,
    a1, b1, a2, b2.  A candidate with k parameters competes only with at least
    k + 2 scored rows; drift needs none: it is the fallback of every series
    (a single observation repeats itself)."""
    is_full = F.col("n_full") >= 2
    n = F.when(is_full, F.col("n_full")).otherwise(F.col("n_short"))
    nn = n.cast("double")

    def ols_sse(syy: str, sxy: str, sxx: str) -> Column:
        return F.when(F.col(sxx) > 0, F.col(syy) - F.col(sxy) * F.col(sxy) / F.col(sxx)).otherwise(F.col(syy))

    def either(full: Column, short: Column) -> Column:
        return F.when(is_full, full).otherwise(short)

    cands = [("drift", 1, F.lit(True), nn * either(F.col("v_dy"), F.col("v_dy0"))),
             ("ar1", 2, n >= 4, either(ols_sse("syy1", "sxy1", "sxx1"), ols_sse("syy0", "sxy0", "sxx0"))),
             ("seasonal_naive", 0, is_full, F.col("sse_sn")),
             ("seasonal_diff_ar1", 2, is_full & (n >= 4), ols_sse("syy2", "sxy2", "sxx2"))]
    scored = [F.when(ok, F.struct(
        F.when(n > 0, nn * F.log(F.greatest(sse, F.lit(1e-12)) / nn) + F.lit(2.0 * k)).alias("aic"),
        F.lit(k).alias("k"), F.lit(name).alias("model"),
        F.greatest(F.coalesce(sse, F.lit(0.0)), F.lit(0.0)).alias("sse"))) for name, k, ok, sse in cands]
    best = F.array_min(F.filter(F.array(*scored), lambda x: x.isNotNull()))
    return g.withColumn("_best", best).withColumns({
        "n": n, "model": F.col("_best.model"), "k": F.col("_best.k"), "sse": F.col("_best.sse"),
        "aic": F.col("_best.aic"), "c_drift": F.coalesce(either(F.col("c_dy"), F.col("c_dy0")), F.lit(0.0)),
        "a1": either(F.col("i1"), F.col("i0")), "b1": either(F.col("s1"), F.col("s0"))}).drop("_best")


def forecast_ar_select(prepared: DataFrame, keys: Sequence[str], m: int = 12) -> DataFrame:
    """Choose per series among drift, AR(1), seasonal naive (lag m) and
    AR(1) on lag-m differences by AIC = n ln(SSE/n) + 2k, all candidates
    scored on the same rows (those with m+1 lags available; a series with
    fewer than two such rows has drift and AR(1) on its rows with one lag).
    Every series gets a model.  Lags come from one ordered window per series
    (bounded by its days), parameters and SSE from built-in regression
    aggregates in one grouped pass."""
    keys = list(keys)
    return _ar_choose(_ar_fit(_ar_lags(prepared, keys, m), keys), keys).select(
        *keys, "n", "model", "k", "sse", "aic")


def forecast_ar(prepared: DataFrame, keys: Sequence[str], m: int = 12,
                periods: int = DEFAULT_PERIODS) -> DataFrame:
    """J6 horizon: `periods` steps ahead of each series' last observation
    with its AIC-chosen model.  The recursion runs in the `aggregate`
    higher-order function over sequence(1..periods), seeded with the
    series' last m values (bounded state, JVM-side, no Python).  The last
    values come out of the same grouped pass as the fit, so the input is
    read once."""
    if not 1 <= periods <= 365:
        raise ValueError("periods must be in 1..365")
    keys = list(keys)
    st = _ar_choose(_ar_fit(_ar_lags(prepared, keys, m), keys), keys).select(
        *keys, "model", "c_drift", "a1", "b1", "a2", "b2", F.col("end.ds").alias("last_ds"),
        F.col("end.y").alias("y_t"), (F.col("end.y") - F.col("end.ym")).alias("d_t"),
        F.col("end._last").alias("_last"))

    def d_hat(h: Column) -> Column:      # closed form of d_{T+h} = a2 + b2 d_{T+h-1}
        b2, a2 = F.col("b2"), F.col("a2")
        return F.when(b2 == 1.0, F.col("d_t") + h * a2).otherwise(
            a2 * (F.lit(1.0) - F.pow(b2, h)) / (F.lit(1.0) - b2) + F.pow(b2, h) * F.col("d_t"))

    def step(acc: Column, h: Column) -> Column:
        hd = h.cast("double")
        back_m = F.element_at(acc, F.size(acc) - m + 1)          # value m steps before the next one
        pred = (F.when(F.col("model") == "drift", F.col("y_t") + hd * F.col("c_drift"))
                 .when(F.col("model") == "ar1", F.col("a1") + F.col("b1") * F.element_at(acc, -1))
                 .when(F.col("model") == "seasonal_naive", back_m)
                 .otherwise(back_m + d_hat(hd)))
        return F.concat(acc, F.array(pred))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(periods)), F.col("_last").cast("array<double>"), step)
    fc = st.select(*keys, "model", "last_ds", F.slice(path, m + 1, periods).alias("_f"))
    return fc.select(*keys, "model", "last_ds", F.posexplode("_f").alias("_h", "yhat")).withColumn(
        "ds", F.date_add(F.col("last_ds"), F.col("_h") + 1)).select(*keys, "ds", "model", "yhat")


# ---------------------------------------------------------------- J7 / J9
def save_models(models: DataFrame, path: str, model_date: dt.date) -> None:
    """Model table as Parquet partitioned by model_date (one directory
    per fit), keyed by the series columns.  Saving a date again replaces its
    models, as a key of a store would; other dates stay."""
    (models.withColumn("model_date", F.lit(model_date))
           .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy("model_date").parquet(path))


def load_models(spark: SparkSession, path: str, model_date: dt.date) -> DataFrame:
    return spark.read.parquet(path).filter(F.col("model_date") == F.lit(model_date))


def forecast_metadata(forecast: DataFrame, horizon: int, model_type: str,
                      generated_at: dt.datetime) -> DataFrame:
    """Request metadata beside every forecast row."""
    return forecast.withColumns({"horizon": F.lit(horizon), "model_type": F.lit(model_type),
                                 "generated_at": ntz_literal(generated_at)})
