"""Registered forecasting queries.

Series: one per SKU over the whole retail_sales table (stores pooled, so
several observations per day; the J1 collapse keeps n and sums exact)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfline.operators import arma as A
from shelfline.operators import changepoints as C
from shelfline.operators import forecast as J
from shelfline.operators import reorder as R
from shelfline.plans.oracle_views import with_views
from shelfline.plans.registry import register
from shelfline.session import scratch_dir
from shelfline.sources import fixtures as V

KEYS = ("sku",)
PERIODS = 30
MODEL_DATE = dt.date(2026, 12, 31)
GENERATED_AT = dt.datetime(2026, 12, 31, 0, 0, 0)
K8_CFG = R.ReorderConfig(budget=1e12, shelf_space=1e10)


def r(df, cols, d=3):
    return df.withColumns({c: F.round(F.col(c), d) for c in cols})


def prepared(spark, sf_dir):
    return J.series_prepare(V.retail_sales(spark, sf_dir), KEYS)


# ---------------------------------------------------------------- oracle text
O_PREP = """
select sku, date as ds, count(units_sold) as n, sum(cast(units_sold as double)) as sy,
       sum(cast(units_sold as double) * units_sold) as syy
from retail_sales group by sku, date"""
O_YEARS = f"""
select unnest(range(min(year(ds)), max(year(ds + {PERIODS})) + 1)) as year from prep"""
O_FIXED = """
select make_date(year, 1, 1) as ds, 'New Year''s Day' as holiday from years
union all select make_date(year, 6, 19), 'Juneteenth National Independence Day' from years where year >= 2021
union all select make_date(year, 7, 4), 'Independence Day' from years
union all select make_date(year, 11, 11), 'Veterans Day' from years where year >= 1938
union all select make_date(year, 12, 25), 'Christmas Day' from years"""


def _nth(month: int, target: int, nth: int) -> str:
    f = f"make_date(year, {month}, 1)"
    return f"{f} + cast(((({target} - dayofweek({f})) + 7) % 7) + {7 * (nth - 1)} as integer)"


O_HOL = f"""
select ds, holiday from fixed
union all
select case when dayofweek(ds) = 6 then ds - 1 else ds + 1 end, holiday || ' (observed)'
from fixed where dayofweek(ds) in (0, 6)
union all select {_nth(1, 1, 3)}, 'Martin Luther King Jr. Day' from years
union all select {_nth(2, 1, 3)}, 'Washington''s Birthday' from years
union all select {_nth(9, 1, 1)}, 'Labor Day' from years
union all select {_nth(10, 1, 2)}, 'Columbus Day' from years
union all select {_nth(11, 4, 4)}, 'Thanksgiving' from years
union all select make_date(year, 5, 31) - cast(((dayofweek(make_date(year, 5, 31)) - 1) + 7) % 7 as integer),
                 'Memorial Day' from years"""
O_FIT = """
select p.*, cast(p.ds - date '2020-01-01' as double) as t, dayofweek(p.ds) + 1 as w, month(p.ds) as mo,
       case when hd.ds is not null then 1.0 else 0.0 end as is_holiday
from prep p left join (select distinct ds from hol) hd on p.ds = hd.ds"""
O_S1 = """
select *, min(ds) over (partition by sku) as first_ds, max(ds) over (partition by sku) as last_ds,
       sum(n * t) over (partition by sku, w) / sum(n) over (partition by sku, w) as tbar,
       sum(sy) over (partition by sku, w) / sum(n) over (partition by sku, w) as ybar
from fit"""
O_S2 = """
select *, case when sxx > 0 then sxy / sxx else 0.0 end as slope from (
  select *, sum(t * sy - tbar * sy - ybar * n * t + n * tbar * ybar) over (partition by sku) as sxy,
            sum(n * (t - tbar) * (t - tbar)) over (partition by sku) as sxx
  from s1)"""
O_S3 = """
select *, sy / n - (a_w + slope * t) as r1 from (
  select *, ybar - slope * tbar as a_w, cast((last_ds - first_ds) + 1 as integer) as span_days from s2)"""
O_S4 = """
select *, r1 - m_row as r2 from (
  select *, case when span_days >= 730
                 then sum(n * r1) over (partition by sku, mo) / sum(n) over (partition by sku, mo)
                 else 0.0 end as m_row
  from s3)"""
O_S5 = """
select *, a_w + slope * t + m_row + h * is_holiday as yfit from (
  select *, coalesce(sum(is_holiday * n * r2) over (partition by sku)
                     / sum(case when is_holiday > 0 then n end) over (partition by sku), 0.0) as h
  from s4)"""
O_MODELS = """
select sku, slope, h as holiday_effect,
       case when nn > 1 then sqrt(greatest((srr - sr * sr / nn) / (nn - 1), 0.0)) else 0.0 end as sigma,
       cast(nn as bigint) as n_obs, first_ds, last_ds, span_days,
       """ + ", ".join(f"a{k}" for k in range(1, 8)) + ", " + ", ".join(f"coalesce(m{k}, 0.0) as m{k}" for k in range(1, 13)) + """
from (
  select *, sum(n) over (partition by sku) as nn, sum(sy - n * yfit) over (partition by sku) as sr,
         sum(syy - 2.0 * yfit * sy + n * yfit * yfit) over (partition by sku) as srr,
         """ + ", ".join(f"max(case when w = {k} then a_w end) over (partition by sku) as a{k}" for k in range(1, 8)) + """,
         """ + ", ".join(f"max(case when mo = {k} then m_row end) over (partition by sku) as m{k}" for k in range(1, 13)) + """
  from s5) where ds = last_ds"""
O_FRAME = f"""
select sku, ds, false as is_future from prep
union all
select sku, cast(unnest(generate_series(last + 1, last + {PERIODS}, interval 1 day)) as date), true
from (select sku, max(ds) as last from prep group by sku)"""
_A = "case dayofweek(f.ds) + 1 " + " ".join(f"when {k} then a{k}" for k in range(1, 8)) + " end"
_MEAN_A = ("((" + " + ".join(f"coalesce(a{k}, 0.0)" for k in range(1, 8)) + ") / greatest(("
           + " + ".join(f"case when a{k} is not null then 1 else 0 end" for k in range(1, 8)) + "), 1))")
_M = "case month(f.ds) " + " ".join(f"when {k} then m{k}" for k in range(1, 13)) + " end"
O_SCORED = f"""
select f.sku, f.ds, f.is_future,
       coalesce({_A}, {_MEAN_A}) + slope * cast(f.ds - date '2020-01-01' as double) + {_M}
         + holiday_effect * (case when hd.ds is not null then 1.0 else 0.0 end) as yhat, sigma
from frame f join models m on f.sku = m.sku
left join (select distinct ds from hol) hd on f.ds = hd.ds"""
FORECAST_CTES = [("prep", O_PREP), ("years", O_YEARS), ("fixed", O_FIXED), ("hol", O_HOL),
                 ("fit", O_FIT), ("s1", O_S1), ("s2", O_S2), ("s3", O_S3), ("s4", O_S4),
                 ("s5", O_S5), ("models", O_MODELS), ("frame", O_FRAME), ("scored", O_SCORED)]
O_FORECAST_SELECT = """
select sku, ds, is_future, round(yhat, 3) as yhat, round(yhat - 1.2815515655 * sigma, 3) as yhat_lower,
       round(yhat + 1.2815515655 * sigma, 3) as yhat_upper from scored"""


def fsql(body: str) -> str:
    return with_views(body, "retail_sales", ctes=FORECAST_CTES)


def forecast_rows(spark, sf_dir):
    return J.forecast_trend_season(prepared(spark, sf_dir), KEYS, PERIODS)


# ---------------------------------------------------------------- J1
@register("series_prepare", fsql("select sku, ds, n, sy, syy from prep"))
def q_series_prepare(spark, sf_dir):
    return prepared(spark, sf_dir)


# ---------------------------------------------------------------- J2
@register("us_holidays", fsql("select ds, holiday from hol"))
def q_us_holidays(spark, sf_dir):
    return J.holidays_for(prepared(spark, sf_dir), PERIODS)


# ---------------------------------------------------------------- G3
@register("holiday_join", fsql("""
select p.sku, p.ds, h.holiday, h.holiday is not null as is_holiday
from prep p left join (select ds, string_agg(holiday, ', ' order by holiday) as holiday
                       from hol group by ds) h on p.ds = h.ds"""))
def q_holiday_join(spark, sf_dir):
    prep = prepared(spark, sf_dir).select("sku", "ds")
    return J.with_holidays(prep, J.default_holidays(spark))


# ---------------------------------------------------------------- J3
@register("future_frame", fsql("select sku, ds, is_future from frame"))
def q_future_frame(spark, sf_dir):
    return J.future_frame(prepared(spark, sf_dir), KEYS, PERIODS)


# ---------------------------------------------------------------- J4
@register("forecast_trend_season", fsql(O_FORECAST_SELECT))
def q_forecast_trend_season(spark, sf_dir):
    return r(forecast_rows(spark, sf_dir), ["yhat", "yhat_lower", "yhat_upper"])


# ---------------------------------------------------------------- J5 (rows only)
@register("forecast_piecewise")
def q_forecast_piecewise(spark, sf_dir):
    return J.forecast_piecewise(prepared(spark, sf_dir), KEYS, PERIODS)


# ---------------------------------------------------------------- J6
O_LAGS = """
select sku, ds, y, lag(y, 1) over w as y1, lag(y, 12) over w as ym, lag(y, 13) over w as ym1
from (select sku, ds, sy / n as y from prep) window w as (partition by sku order by ds)"""
_FULL = ("case when ym1 is not null then y end", "case when ym1 is not null then y1 end")
_ONE = ("case when y1 is not null then y end", "y1")
_SEASON = ("case when ym1 is not null then y - ym end", "case when ym1 is not null then y1 - ym1 end")


def _ols(pair, tag: str) -> str:
    return ", ".join(f"regr_{f}({pair[0]}, {pair[1]}) as {f}{tag}" for f in ("syy", "sxy", "sxx"))


O_ARG = f"""
select sku, count(ym1) as n_full, count(y1) as n_short,
       var_pop(case when ym1 is not null then y - y1 end) as v_full, var_pop(y - y1) as v_short,
       {_ols(_FULL, "1")}, {_ols(_ONE, "0")}, {_ols(_SEASON, "2")},
       sum(case when ym1 is not null then (y - ym) * (y - ym) end) as sse_sn
from lg group by sku"""


def _residual(tag: str) -> str:
    return f"case when sxx{tag} > 0 then syy{tag} - sxy{tag} * sxy{tag} / sxx{tag} else syy{tag} end"


O_CANDS = f"""
select sku, n, model, k, greatest(coalesce(sse, 0.0), 0.0) as sse,
       case when n > 0 then n * ln(greatest(sse, 1e-12) / n) + 2.0 * k end as aic
from (select *, case when n_full >= 2 then n_full else n_short end as n, n_full >= 2 as long from g),
     lateral (values ('drift', 1, true, n * case when long then v_full else v_short end),
                     ('ar1', 2, n >= 4, case when long then {_residual("1")} else {_residual("0")} end),
                     ('seasonal_naive', 0, long, sse_sn),
                     ('seasonal_diff_ar1', 2, long and n >= 4, {_residual("2")})) v(model, k, fits, sse)
where fits"""
O_AR_CTES = [("prep", O_PREP), ("lg", O_LAGS), ("g", O_ARG), ("cands", O_CANDS)]
O_AR_SELECT = """
select sku, n, model, k, round(sse, 3) as sse, round(aic, 3) as aic from (
  select *, row_number() over (partition by sku order by aic nulls first, k, model) as rk from cands)
where rk = 1"""


@register("forecast_ar_select", with_views(O_AR_SELECT, "retail_sales", ctes=O_AR_CTES))
def q_forecast_ar_select(spark, sf_dir):
    return r(J.forecast_ar_select(prepared(spark, sf_dir), KEYS, m=12), ["sse", "aic"])


# ---------------------------------------------------------------- J6 horizon
def _line(pair, a: str, b: str) -> str:
    y, x = pair
    flat = f"regr_sxx({y}, {x}) = 0"
    return (f"case when {flat} then avg(case when {x} is not null then {y} end) else regr_intercept({y}, {x}) end as {a}, "
            f"case when {flat} then 0.0 else regr_slope({y}, {x}) end as {b}")


O_PARAMS = f"""
select sku, avg(case when ym1 is not null then y - y1 end) as c_full, avg(y - y1) as c_short,
       {_line(_FULL, "i1", "s1")}, {_line(_ONE, "i0", "s0")}, {_line(_SEASON, "a2", "b2")},
       max(ds) as last_ds, max_by(y, ds) as y_t, max_by(y - ym, ds) as d_t, list(y order by ds)[-12:] as tail
from lg group by sku"""
O_AR_START = """
select p.sku, b.model, last_ds, y_t, d_t, tail, a2, b2,
       coalesce(case when n_full >= 2 then c_full else c_short end, 0.0) as c,
       case when n_full >= 2 then i1 else i0 end as a1, case when n_full >= 2 then s1 else s0 end as b1
from params p join g on p.sku = g.sku
join (select *, row_number() over (partition by sku order by aic nulls first, k, model) as rk from cands) b
  on b.sku = p.sku and rk = 1"""
O_AR_PATH = f"""
select sku, 0 as h, tail as path from ar_start
union all
select r.sku, r.h + 1, list_append(r.path, case s.model
         when 'drift' then y_t + (r.h + 1) * c
         when 'ar1' then a1 + b1 * r.path[-1]
         when 'seasonal_naive' then r.path[-12]
         else r.path[-12] + case when b2 = 1.0 then d_t + (r.h + 1) * a2
                                 else a2 * (1.0 - b2 ** (r.h + 1)) / (1.0 - b2) + b2 ** (r.h + 1) * d_t end end)
from ar_path r join ar_start s on r.sku = s.sku where r.h < {PERIODS}"""


@register("forecast_ar_horizon", with_views("""
select r.sku, cast(last_ds + r.h as date) as ds, s.model, round(path[-1], 3) as yhat
from ar_path r join ar_start s on r.sku = s.sku where r.h > 0""", "retail_sales", ctes=[
    *O_AR_CTES, ("params", O_PARAMS), ("ar_start", O_AR_START), ("ar_path", O_AR_PATH)]))
def q_forecast_ar_horizon(spark, sf_dir):
    return r(J.forecast_ar(prepared(spark, sf_dir), KEYS, m=12, periods=PERIODS), ["yhat"])


# ------------------------------------------------- J6 order search, J5 sparse
# Iterated regressions: tests compare them with plain solvers.
@register("forecast_arma_select")
def q_forecast_arma_select(spark, sf_dir):
    """The order that the search chooses for every SKU."""
    return r(A.arma_models(prepared(spark, sf_dir), KEYS, m=12).drop("ar", "ma", "const"), ["sse", "aicc"])


@register("forecast_arma_horizon")
def q_forecast_arma_horizon(spark, sf_dir):
    return r(A.forecast_arma(prepared(spark, sf_dir), KEYS, m=12, periods=PERIODS),
             ["yhat", "yhat_lower", "yhat_upper"])


@register("forecast_changepoints")
def q_forecast_changepoints(spark, sf_dir):
    return r(C.forecast_changepoints(prepared(spark, sf_dir), KEYS, PERIODS),
             ["trend", "yhat", "yhat_lower", "yhat_upper"])


@register("trend_changes")
def q_trend_changes(spark, sf_dir):
    return r(C.trend_changes(prepared(spark, sf_dir), KEYS), ["change"], 6)


# ---------------------------------------------------------------- J7
MODEL_COLS = (["sku", "slope", "holiday_effect", "sigma", "n_obs", "first_ds", "last_ds", "span_days"]
              + [f"a{k}" for k in range(1, 8)] + [f"m{k}" for k in range(1, 13)])


def flat_models(models):
    return models.select(
        "sku", "slope", "holiday_effect", "sigma", "n_obs", "first_ds", "last_ds", "span_days",
        *[F.col("weekday_effect")[k - 1].alias(f"a{k}") for k in range(1, 8)],
        *[F.col("month_effect")[k - 1].alias(f"m{k}") for k in range(1, 13)])


def _fit_and_save(spark, sf_dir):
    prep = prepared(spark, sf_dir)
    hol = J.default_holidays(spark)
    models = J.fit_trend_season(prep, KEYS, hol)
    path = scratch_dir(spark, "models")
    J.save_models(models, path, MODEL_DATE)
    return prep, hol, J.load_models(spark, path, MODEL_DATE).drop("model_date")


@register("model_table", fsql("select " + ", ".join(
    c if c in ("sku", "n_obs", "first_ds", "last_ds", "span_days") else f"round({c}, 6) as {c}"
    for c in MODEL_COLS) + " from models"))
def q_model_table(spark, sf_dir):
    _, _, saved = _fit_and_save(spark, sf_dir)
    flat = flat_models(saved)
    return r(flat, [c for c in MODEL_COLS if c not in ("sku", "n_obs", "first_ds", "last_ds", "span_days")], 6)


# ---------------------------------------------------------------- J8
@register("score_saved_model", fsql(O_FORECAST_SELECT + " where is_future"))
def q_score_saved_model(spark, sf_dir):
    _, hol, saved = _fit_and_save(spark, sf_dir)
    fut = J.horizon_frame(saved, KEYS, PERIODS)
    return r(J.score(saved, fut, KEYS, hol), ["yhat", "yhat_lower", "yhat_upper"])


# ---------------------------------------------------------------- J9
@register("forecast_metadata", fsql(f"""
select sku, ds, is_future, yhat, yhat_lower, yhat_upper, {PERIODS} as horizon,
       'trend_season' as model_type, timestamp '2026-12-31 00:00:00' as generated_at
from ({O_FORECAST_SELECT})"""))
def q_forecast_metadata(spark, sf_dir):
    fc = r(forecast_rows(spark, sf_dir), ["yhat", "yhat_lower", "yhat_upper"])
    return J.forecast_metadata(fc, PERIODS, "trend_season", GENERATED_AT)


# ---------------------------------------------------------------- P4
@register("auto_forecast", fsql(O_FORECAST_SELECT))
def q_auto_forecast(spark, sf_dir):
    from shelfline.plans.flows import auto_forecast
    out = auto_forecast(spark, V.retail_sales(spark, sf_dir), KEYS, PERIODS,
                        scratch_dir(spark, "auto_forecast"), MODEL_DATE)
    return r(out, ["yhat", "yhat_lower", "yhat_upper"])


# ---------------------------------------------------------------- K8
def o_clearance(latest: str, params_key: str) -> str:
    return f"""
select d.sku, round(d.demand, 3) as demand, l.on_hand, l.price,
       cast(ceil(greatest(0.0, case when coalesce(p.moq, 0.0) > 0 then p.moq else 0.0 end,
                          d.demand * 0.95 - l.on_hand) - 1e-6) as bigint) as order_qty,
       'Optimal' as status
from (select sku, sum(yhat) as demand from scored where is_future group by sku) d
join ({latest}) l on d.sku = l.sku
left join sku_params p on {params_key} = p.sku"""


O_STOCK = """
select sku, cast(sum(on_hand) as bigint) as on_hand, max_by(price, (date, store_id)) as price
from (select sku, store_id, max(date) as date, max_by(on_hand, date) as on_hand, max_by(price, date) as price
      from retail_sales group by sku, store_id)
group by sku"""


def _orders(fc, spark, sf_dir, keys):
    from shelfline.plans.flows import clearance_plan
    orders, _ = clearance_plan(fc, V.retail_sales(spark, sf_dir), V.sku_params(spark, sf_dir), K8_CFG, keys=keys)
    return orders.select(*keys, F.round("demand", 3).alias("demand"), F.col("on_hand").cast("bigint").alias("on_hand"),
                         "price", "order_qty", "status")


@register("clearance_plan_from_forecast", with_views(
    o_clearance(O_STOCK, "d.sku"), "retail_sales", "sku_params", ctes=FORECAST_CTES))
def q_clearance_plan_from_forecast(spark, sf_dir):
    return _orders(forecast_rows(spark, sf_dir), spark, sf_dir, KEYS)


# ---------------------------------------------------------------- per store and SKU
# The oracle names a series 'store|sku' and runs the texts above over it.
STORE_KEYS = ("store_id", "sku")
O_BY_STORE = """
select store_id || '|' || sku as sku, date, units_sold, price, on_hand from retail_sales"""


def _store_ctes(ctes):
    return [("series", O_BY_STORE)] + [(n, t.replace("from retail_sales", "from series")) for n, t in ctes]


def _named(df):
    return df.withColumn("sku", F.concat_ws("|", "store_id", "sku")).drop("store_id")


def prepared_by_store(spark, sf_dir):
    return J.series_prepare(V.retail_sales(spark, sf_dir), STORE_KEYS)


@register("forecast_by_store", with_views(O_FORECAST_SELECT, "retail_sales", ctes=_store_ctes(FORECAST_CTES)))
def q_forecast_by_store(spark, sf_dir):
    fc = J.forecast_trend_season(prepared_by_store(spark, sf_dir), STORE_KEYS, PERIODS)
    return r(_named(fc), ["yhat", "yhat_lower", "yhat_upper"])


@register("model_table_by_store", with_views("select " + ", ".join(
    c if c in ("sku", "n_obs", "first_ds", "last_ds", "span_days") else f"round({c}, 6) as {c}"
    for c in MODEL_COLS) + " from models", "retail_sales", ctes=_store_ctes(FORECAST_CTES)))
def q_model_table_by_store(spark, sf_dir):
    path = scratch_dir(spark, "models")
    prep = prepared_by_store(spark, sf_dir)
    J.save_models(J.fit_trend_season(prep, STORE_KEYS, J.default_holidays(spark)), path, MODEL_DATE)
    saved = _named(J.load_models(spark, path, MODEL_DATE).drop("model_date"))
    return r(flat_models(saved), [c for c in MODEL_COLS if c not in (
        "sku", "n_obs", "first_ds", "last_ds", "span_days")], 6)


@register("forecast_ar_select_by_store", with_views(O_AR_SELECT, "retail_sales", ctes=_store_ctes(O_AR_CTES)))
def q_forecast_ar_select_by_store(spark, sf_dir):
    """At this grain half of the series are too short for seasonal lags."""
    return r(_named(J.forecast_ar_select(prepared_by_store(spark, sf_dir), STORE_KEYS, m=12)), ["sse", "aic"])


@register("clearance_plan_by_store", with_views(o_clearance(
    """select sku, cast(max_by(on_hand, date) as bigint) as on_hand, max_by(price, date) as price
from series group by sku""", "split_part(d.sku, '|', 2)"), "retail_sales", "sku_params",
    ctes=_store_ctes(FORECAST_CTES)))
def q_clearance_plan_by_store(spark, sf_dir):
    fc = J.forecast_trend_season(prepared_by_store(spark, sf_dir), STORE_KEYS, PERIODS)
    return _named(_orders(fc, spark, sf_dir, STORE_KEYS))
