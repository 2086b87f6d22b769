"""Registered cleaning / feature / completion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import transform as X
from shelfline.plans.oracle_views import with_views
from shelfline.plans.registry import register
from shelfline.schemas import DAILY_SALES, DAILY_SALES_COLUMNS
from shelfline.sources import fixtures as V

# ---- oracle building blocks: the cleaned daily sales and its features
O_CLEAN = """
select date, sales, items, coalesce(store_id, 'nan') as store_id,
       coalesce(product_category, 'nan') as product_category
from daily_sales
where date is not null and sales is not null and items is not null"""
O_FEAT = """
select c.*, cast(year(date) as integer) as year, cast(month(date) as integer) as month, cast(day(date) as integer) as day,
       dayofweek(date) in (0, 6) as is_weekend,
       case when st.s > 0 then (c.sales - st.m) / st.s else 0.0 end as sales_normalized
from clean c, (select avg(sales) as m, stddev_samp(sales) as s from clean) st"""
O_GROUP = """
select date, store_id, product_category, sum(sales) as sales, cast(sum(items) as bigint) as items,
       any_value(year) as year, any_value(month) as month, any_value(day) as day,
       any_value(is_weekend) as is_weekend, avg(sales_normalized) as sales_normalized
from feat group by date, store_id, product_category"""
CLEAN_CTES = [("clean", O_CLEAN), ("feat", O_FEAT)]


def clean_sales(spark, sf_dir):
    return X.drop_incomplete(X.coerce_types(V.daily_sales(spark, sf_dir)))


def featured_sales(spark, sf_dir):
    return X.zscore(X.calendar_features(clean_sales(spark, sf_dir)))


def rounded(df, cols, digits=6):
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


@register("required_columns", with_views(
    "select date, sales, items, store_id, product_category from daily_sales", "daily_sales"))
def q_required_columns(spark, sf_dir):
    df = X.require_columns(V.daily_sales(spark, sf_dir), DAILY_SALES_COLUMNS)
    return df.select(*DAILY_SALES_COLUMNS)


@register("coerce_types", with_views(
    """select date, sales, items, coalesce(store_id, 'nan') as store_id,
              coalesce(product_category, 'nan') as product_category from daily_sales""",
    "daily_sales"))
def q_coerce_types(spark, sf_dir):
    return X.coerce_types(V.daily_sales(spark, sf_dir))


@register("drop_incomplete", with_views("select * from clean", "daily_sales", ctes=CLEAN_CTES[:1]))
def q_drop_incomplete(spark, sf_dir):
    return clean_sales(spark, sf_dir)


@register("fill_zero", with_views(
    """select date, coalesce(sales, 0.0) as sales, coalesce(items, 0) as items, store_id,
              product_category from daily_sales""", "daily_sales"))
def q_fill_zero(spark, sf_dir):
    return X.fill_zero(V.daily_sales(spark, sf_dir), expected={"date": "date", "sales": "double"})


@register("calendar_features", with_views(
    """select date, sales, items, store_id, product_category, year, month, day, is_weekend
       from feat""", "daily_sales", ctes=CLEAN_CTES))
def q_calendar_features(spark, sf_dir):
    return X.calendar_features(clean_sales(spark, sf_dir))


@register("currency_normalize", with_views(
    """select date, round(sales * 1.2, 6) as sales, items, store_id, product_category
       from clean""", "daily_sales", ctes=CLEAN_CTES[:1]))
def q_currency_normalize(spark, sf_dir):
    return rounded(X.currency_normalize(clean_sales(spark, sf_dir)), ["sales"])


@register("sales_zscore", with_views(
    """select date, sales, items, store_id, product_category,
              round(sales_normalized, 6) as sales_normalized from feat""",
    "daily_sales", ctes=CLEAN_CTES))
def q_sales_zscore(spark, sf_dir):
    return rounded(X.zscore(clean_sales(spark, sf_dir)), ["sales_normalized"])


@register("series_filter", with_views(
    "select * from retail_sales where store_id = 'STORE_007'", "retail_sales"))
def q_series_filter(spark, sf_dir):
    return X.series_filter(V.retail_sales(spark, sf_dir), sku="", store_id="STORE_007", region=None)


@register("trim_strings", with_views(
    """select date, sales, items, trim(store_id) as store_id,
              trim(product_category) as product_category from daily_sales""", "daily_sales"))
def q_trim_strings(spark, sf_dir):
    return X.trim_strings(V.daily_sales(spark, sf_dir), schema=DAILY_SALES)


@register("revenue_stock_features", with_views(
    """select store_id, sku, date, units_sold, price, on_hand,
              cast(price * units_sold as double) as daily_revenue, on_hand < 50 as is_low_stock,
              round(case when units_sold <> 0 then cast(on_hand as double) / units_sold end, 9)
                as stock_days_remaining
       from retail_sales""", "retail_sales"))
def q_revenue_stock_features(spark, sf_dir):
    df = X.revenue_stock_features(V.retail_sales(spark, sf_dir))
    return df.withColumns({"daily_revenue": F.col("daily_revenue").cast("double"),
                           "stock_days_remaining": F.round("stock_days_remaining", 9)})


@register("low_stock_records", with_views(
    "select * from retail_sales where on_hand < 50", "retail_sales"))
def q_low_stock_records(spark, sf_dir):
    return X.low_stock_records(V.retail_sales(spark, sf_dir))


@register("parse_payload", """
select event_id, try_cast(json_extract(props, '$.k') as bigint) as k,
       case when json_valid(props) then null else props end as props_raw
from events""")
def q_parse_payload(spark, sf_dir):
    ev = V.table(spark, sf_dir, "events").select("event_id", "props")
    df = X.parse_payload(ev, "props", "k bigint", out="payload")
    return df.select("event_id", F.col("payload.k").alias("k"), F.col("payload_raw").alias("props_raw"))


# ---------------------------------------------------------------- D1 / D2 (one series)
O_DAY_TOTALS = """
select date, sum(sales) as sales, cast(sum(items) as bigint) as items from clean group by date"""
O_SINGLE_PAD = """
select cal.date, round(t.sales, 6) as sales, t.items
from (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
      from totals) cal
asof left join totals t on cal.date >= t.date"""


def day_totals(spark, sf_dir):
    return clean_sales(spark, sf_dir).groupBy("date").agg(
        F.sum("sales").alias("sales"), F.sum("items").alias("items"))


@register("calendar_complete_ffill", with_views(
    O_SINGLE_PAD, "daily_sales", ctes=CLEAN_CTES[:1] + [("totals", O_DAY_TOTALS)]))
def q_calendar_complete_ffill(spark, sf_dir):
    out = X.calendar_complete(day_totals(spark, sf_dir), keys=(), fill="ffill")
    return rounded(out, ["sales"])


@register("calendar_complete_pad", with_views(
    O_SINGLE_PAD, "daily_sales", ctes=CLEAN_CTES[:1] + [("totals", O_DAY_TOTALS)]))
def q_calendar_complete_pad(spark, sf_dir):
    out = X.calendar_complete(day_totals(spark, sf_dir), keys=(), fill="pad",
                              on_duplicate="raise")  # one row per date by construction
    return rounded(out, ["sales"])


# The same on days with gaps and with nulls that were there before: D1 fills
# those nulls too, D2 leaves them.
O_GAP_TOTALS = """
select date, case when day(date) % 7 = 0 then null else sales end as sales,
       case when day(date) % 7 = 3 then null else items end as items
from totals where day(date) % 5 <> 0"""
GAP_CTES = CLEAN_CTES[:1] + [("totals", O_DAY_TOTALS), ("gaps", O_GAP_TOTALS)]


def gap_totals(spark, sf_dir):
    day = F.dayofmonth("date")
    return day_totals(spark, sf_dir).where(day % 5 != 0).withColumns({
        "sales": F.when(day % 7 != 0, F.col("sales")), "items": F.when(day % 7 != 3, F.col("items"))})


@register("calendar_complete_ffill_gaps", with_views("""
select date, round(last_value(sales ignore nulls) over w, 6) as sales, last_value(items ignore nulls) over w as items
from (select c.date, g.sales, g.items
      from (select cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date from gaps) c
      left join gaps g on c.date = g.date)
window w as (order by date rows between unbounded preceding and current row)""", "daily_sales", ctes=GAP_CTES))
def q_calendar_complete_ffill_gaps(spark, sf_dir):
    return rounded(X.calendar_complete(gap_totals(spark, sf_dir), keys=(), fill="ffill"), ["sales"])


@register("calendar_complete_pad_gaps", with_views(
    O_SINGLE_PAD.replace("totals", "gaps"), "daily_sales", ctes=GAP_CTES))
def q_calendar_complete_pad_gaps(spark, sf_dir):
    out = X.calendar_complete(gap_totals(spark, sf_dir), keys=(), fill="pad", on_duplicate="raise")
    return rounded(out, ["sales"])


# ---------------------------------------------------------------- D3 (per series)
O_SERIES_PAD = """
select cal.date, cal.store_id, cal.product_category, round(g.sales, 6) as sales, g.items,
       g.year, g.month, g.day, g.is_weekend, round(g.sales_normalized, 6) as sales_normalized
from (select store_id, product_category,
             cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
      from grp group by store_id, product_category) cal
asof left join grp g
  on cal.store_id = g.store_id and cal.product_category = g.product_category and cal.date >= g.date"""


@register("calendar_complete_by_series", with_views(
    O_SERIES_PAD, "daily_sales", ctes=CLEAN_CTES + [("grp", O_GROUP)]))
def q_calendar_complete_by_series(spark, sf_dir):
    grouped = X.daily_group(featured_sales(spark, sf_dir))
    out = X.calendar_complete(grouped, keys=("store_id", "product_category"), fill="pad",
                                   on_duplicate="raise")  # E1 output is unique per key and date
    return rounded(out, ["sales", "sales_normalized"])


@register("daily_group", with_views(
    """select date, store_id, product_category, round(sales, 6) as sales, items, year, month, day,
              is_weekend, round(sales_normalized, 6) as sales_normalized from grp""",
    "daily_sales", ctes=CLEAN_CTES + [("grp", O_GROUP)]))
def q_daily_group(spark, sf_dir):
    return rounded(X.daily_group(featured_sales(spark, sf_dir)), ["sales", "sales_normalized"])
