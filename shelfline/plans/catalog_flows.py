"""Registered end-to-end flows (P1, P2, P3, P5; P4 and P6 live with their
modules)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from shelfline.plans import flows as P
from shelfline.plans.catalog_quality import (
    AS_OF, CONTRACT_RULES_SQL, DS_COLS, O_BROKEN, broken_sales, metrics_sql, validate_sql,
)
from shelfline.plans.oracle_views import with_views
from shelfline.plans.presets import settings_for
from shelfline.plans.registry import register
from shelfline.schemas import PROCESSED_REFERENCE
from shelfline.session import scratch_dir
from shelfline.sources import fixtures as V
from shelfline.sources import sinks as B

# CSV semantics of the raw file: an empty id reads as missing, then 'nan'.
O_RAW_CSV = """
select date, sales, items, coalesce(nullif(store_id, ''), 'nan') as store_id,
       coalesce(nullif(product_category, ''), 'nan') as product_category
from daily_sales"""

O_READ_CSV = """
select date, sales, items, nullif(store_id, '') as store_id, nullif(product_category, '') as product_category
from daily_sales"""


def _stage_csv(spark, sf_dir) -> str:
    path = os.path.join(scratch_dir(spark, "bronze"), "daily_sales.csv")
    B.write_as(V.daily_sales(spark, sf_dir), path, fmt="csv", compression="none")
    return path


# ---------------------------------------------------------------- P1
@register("etl_simple", with_views("""
select date, store_id, product_category, round(sales * 1.2, 6) as sales, items,
       cast(year(date) as integer) as year, cast(month(date) as integer) as month, cast(day(date) as integer) as day, dayofweek(date) in (0, 6) as is_weekend
from (
  select c.store_id, c.product_category, c.date,
         last_value(g.sales ignore nulls) over w as sales, last_value(g.items ignore nulls) over w as items
  from (select store_id, product_category,
               cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
        from g group by store_id, product_category) c
  left join g on c.store_id = g.store_id and c.product_category = g.product_category and c.date = g.date
  window w as (partition by c.store_id, c.product_category order by c.date
               rows between unbounded preceding and current row))""",
    "daily_sales", ctes=[("raw", O_RAW_CSV), ("g", """
select store_id, product_category, date, sum(sales) as sales, cast(sum(items) as bigint) as items
from raw group by store_id, product_category, date""")]))
def q_etl_simple(spark, sf_dir):
    out = P.etl_simple(spark, _stage_csv(spark, sf_dir), scratch_dir(spark, "silver"))
    back = spark.read.parquet(out)
    return back.select("date", "store_id", "product_category", F.round("sales", 6).alias("sales"),
                       "items", "year", "month", "day", "is_weekend")


# ---------------------------------------------------------------- P2
O_P2 = """
select cal.date, cal.store_id, cal.product_category, round(g.sales, 6) as sales, g.items,
       g.year, g.month, g.day, g.is_weekend, round(g.sales_normalized, 6) as sales_normalized
from (select store_id, product_category,
             cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as date
      from grp group by store_id, product_category) cal
asof left join grp g
  on cal.store_id = g.store_id and cal.product_category = g.product_category and cal.date >= g.date"""
O_P2_CTES = [
    ("clean", O_RAW_CSV.replace("from daily_sales", "from daily_sales where date is not null and sales is not null and items is not null")),
    ("feat", """
select c.*, cast(year(date) as integer) as year, cast(month(date) as integer) as month, cast(day(date) as integer) as day,
       dayofweek(date) in (0, 6) as is_weekend,
       case when st.s > 0 then (c.sales - st.m) / st.s else 0.0 end as sales_normalized
from clean c, (select avg(sales) as m, stddev_samp(sales) as s from clean) st"""),
    ("grp", """
select date, store_id, product_category, sum(sales) as sales, cast(sum(items) as bigint) as items,
       any_value(year) as year, any_value(month) as month, any_value(day) as day,
       any_value(is_weekend) as is_weekend, avg(sales_normalized) as sales_normalized
from feat group by date, store_id, product_category"""),
]


def run_validated(spark, sf_dir):
    """P2 over the staged file with the settings that let it go on after a
    failed raw validation; (stage metrics, settings)."""
    settings = settings_for("development", scratch_dir(spark, "validated"))
    return P.etl_validated(spark, _stage_csv(spark, sf_dir), settings, AS_OF), settings


@register("etl_validated", with_views(O_P2, "daily_sales", ctes=O_P2_CTES))
def q_etl_validated(spark, sf_dir):
    _, settings = run_validated(spark, sf_dir)
    back = spark.read.parquet(settings.data_path)
    return back.withColumns({"sales": F.round("sales", 6),
                             "sales_normalized": F.round("sales_normalized", 6)})


@register("etl_validation_report", with_views(f"""
select 'raw' as phase, section, name, "column", round(observed, 6) as observed, success from ({validate_sql("", "raw_csv", "rm")})
union all
select 'processed', 'schema', 'type ' || f, c, cast(n as double), n = 0
from (select {", ".join(f"count(*) filter (where {c} is null) as n{i}" for i, c in enumerate(PROCESSED_REFERENCE))}
      from done),
     lateral (values {", ".join(f"('{c}', '{t}', n{i})" for i, (c, t) in enumerate(PROCESSED_REFERENCE.items()))}) v(c, f, n)
union all
select 'processed', 'metrics', metric, null, round(value, 6), null from pm""",
    "daily_sales", ctes=O_P2_CTES + [
        ("raw_csv", O_READ_CSV), ("rm", metrics_sql("raw_csv", DS_COLS)),
        ("done", O_P2.replace("round(g.sales, 6)", "g.sales").replace("round(g.sales_normalized, 6)", "g.sales_normalized")),
        ("pm", metrics_sql("done", list(PROCESSED_REFERENCE)))]))
def q_etl_validation_report(spark, sf_dir):
    """What the saved report of the validated flow (P2) holds: raw validation
    with drift, processed checks and metrics of the written data."""
    _, settings = run_validated(spark, sf_dir)
    return spark.read.parquet(settings.report_path).withColumn("observed", F.round("observed", 6))


# ---------------------------------------------------------------- P3
@register("etl_zero_fill", with_views("""
select date, coalesce(sales, 0.0) as sales, coalesce(items, 0) as items, nullif(store_id, '') as store_id,
       nullif(product_category, '') as product_category from daily_sales""", "daily_sales"))
def q_etl_zero_fill(spark, sf_dir):
    out = P.etl_zero_fill(spark, _stage_csv(spark, sf_dir), scratch_dir(spark, "zero_filled"))
    return spark.read.parquet(out)


# ---------------------------------------------------------------- P5
@register("contract_run", with_views("""
select count(*) as valid_records, cast(0 as bigint) as invalid_records,
       round(sum(cast(price as double) * units_sold), 2) as total_revenue,
       cast(sum(units_sold) as bigint) as total_units_sold, count(distinct store_id) as unique_stores,
       count(distinct sku) as unique_skus, cast(min(date) as timestamp) as min_date,
       cast(max(date) as timestamp) as max_date, count(*) filter (where on_hand < 50) as low_stock_count,
       min(cast(price as double)) as min_price, max(cast(price as double)) as max_price,
       min(on_hand) as min_on_hand, max(on_hand) as max_on_hand
from retail_sales""", "retail_sales"))
def q_contract_run(spark, sf_dir):
    return P.contract_run(spark, V.retail_sales(spark, sf_dir), scratch_dir(spark, "typed_contract"), AS_OF)


O_VALID = " and ".join(f"({p})" for _, _, p in CONTRACT_RULES_SQL)


@register("contract_run_broken", with_views("""
select count(*) filter (where ok) as valid_records, count(*) filter (where not ok) as invalid_records,
       round(sum(cast(price as double) * units_sold) filter (where ok), 2) as total_revenue,
       cast(sum(units_sold) filter (where ok) as bigint) as total_units_sold,
       count(distinct store_id) filter (where ok) as unique_stores, count(distinct sku) filter (where ok) as unique_skus,
       cast(min(date) filter (where ok) as timestamp) as min_date,
       cast(max(date) filter (where ok) as timestamp) as max_date,
       count(*) filter (where ok and on_hand < 50) as low_stock_count,
       min(cast(price as double)) filter (where ok) as min_price,
       max(cast(price as double)) filter (where ok) as max_price,
       min(on_hand) filter (where ok) as min_on_hand, max(on_hand) filter (where ok) as max_on_hand
from checked""", "retail_sales", ctes=[
    ("broken", O_BROKEN), ("checked", f"select *, {O_VALID} as ok from broken")]))
def q_contract_run_broken(spark, sf_dir):
    """P5 on rows of which some break the contract."""
    return P.contract_run(spark, broken_sales(spark, sf_dir), scratch_dir(spark, "typed_contract"), AS_OF)
