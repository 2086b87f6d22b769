"""Registered data-quality queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfline.functions import rules as RL
from shelfline.operators import quality as Q
from shelfline.plans.catalog_transform import CLEAN_CTES, O_GROUP, featured_sales
from shelfline.plans.oracle_views import with_views
from shelfline.plans.registry import register
from shelfline.sources import fixtures as V

AS_OF = dt.date(2026, 12, 31)
DS_COLS = ["date", "sales", "items", "store_id", "product_category"]


def r6(df, cols):
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# ---- oracle predicates (row passes), written independently in SQL
RAW_RULES_SQL = [
    ("date", "not_null", "date is not null"),
    ("sales", "not_null", "sales is not null"),
    ("items", "not_null", "items is not null"),
    ("store_id", "not_null", "store_id is not null"),
    ("product_category", "not_null", "product_category is not null"),
    ("date", "greater_than_or_equal_to(2020-01-01)", "date is null or date >= date '2020-01-01'"),
    ("date", "less_than_or_equal_to(2026-12-31)", "date is null or date <= date '2026-12-31'"),
    ("sales", "greater_than_or_equal_to(0)", "sales is null or sales >= 0"),
    ("sales", "less_than(1000000)", "sales is null or sales < 1000000"),
    ("items", "greater_than_or_equal_to(0)", "items is null or items >= 0"),
    ("items", "less_than(10000)", "items is null or items < 10000"),
    ("store_id", "str_length(1,50)", "store_id is null or length(store_id) between 1 and 50"),
    ("store_id", "str_matches(^[A-Za-z0-9_-]+$)", "store_id is null or regexp_matches(store_id, '^[A-Za-z0-9_-]+$')"),
    ("product_category", "str_length(1,100)", "product_category is null or length(product_category) between 1 and 100"),
    ("product_category", "isin", "product_category is null or product_category in ('Electronics','Clothing','Food','Home','Beauty','Sports')"),
]
CONTRACT_RULES_SQL = [
    (c, "not_null", f"{c} is not null")
    for c in ("store_id", "sku", "date", "units_sold", "price", "on_hand")
] + [
    ("price", "greater_than(0)", "price is null or price > 0"),
    ("price", "less_than_or_equal_to(10000)", "price is null or price <= 10000"),
    ("units_sold", "greater_than_or_equal_to(0)", "units_sold is null or units_sold >= 0"),
    ("units_sold", "less_than_or_equal_to(1000)", "units_sold is null or units_sold <= 1000"),
    ("on_hand", "greater_than_or_equal_to(0)", "on_hand is null or on_hand >= 0"),
    ("on_hand", "less_than_or_equal_to(100000)", "on_hand is null or on_hand <= 100000"),
    ("date", "less_than_or_equal_to(2026-12-31)", "date is null or date <= date '2026-12-31'"),
]
DOC_RULES_SQL = [
    ("store_id", r"str_matches(^STORE_\d{3}$)", r"store_id is null or regexp_matches(store_id, '^STORE_\d{3}$')"),
    ("sku", r"str_matches(^SKU_[A-Z]{2,10}_\d{3}$)", r"sku is null or regexp_matches(sku, '^SKU_[A-Z]{2,10}_\d{3}$')"),
    ("price", "greater_than_or_equal_to(0.01)", "price is null or price >= 0.01"),
    ("price", "two_decimals", "price is null or cast(price as decimal(20,6)) * 100 = floor(cast(price as decimal(20,6)) * 100)"),
]


def rules_sql(table: str, rules) -> str:
    parts = [f"""select {i} as rule_order, '{c}' as "column", '{chk}' as "check",
       count(*) filter (where not ({p})) as failures, count(*) filter (where not ({p})) = 0 as passed
from {table}""" for i, (c, chk, p) in enumerate(rules)]
    return "\nunion all\n".join(parts)


def reasons_sql(rules) -> str:
    return "concat_ws(',', " + ", ".join(
        f"case when not ({p}) then '{c}:{chk}' end" for c, chk, p in rules) + ")"


def metrics_sql(table: str, cols, business=True) -> str:
    """Long (metric, value) quality metrics of `table`, independently in SQL."""
    n = f"(select count(*) from {table})"
    rows = [("total_rows", f"cast({n} as double)"), ("total_columns", f"{float(len(cols))}")]
    for c in cols:
        cnt = f"(select count(*) from {table} where {c} is null)"
        rows.append((f"{c}_null_count", f"cast({cnt} as double)"))
        rows.append((f"{c}_null_ratio", f"case when {n} > 0 then {cnt} / {n} else 0.0 end"))
    alln = " + ".join(f"(select count(*) from {table} where {c} is null)" for c in cols)
    rows.append(("overall_null_ratio", f"case when {n} > 0 then ({alln}) / ({n} * {len(cols)}) else 0.0 end"))
    dup = (f"(select coalesce(sum(k - 1), 0) from (select count(*) as k from {table} "
           f"group by {', '.join(cols)}))")
    rows.append(("duplicate_rows", f"cast({dup} as double)"))
    rows.append(("duplicate_ratio", f"case when {n} > 0 then {dup} / {n} else 0.0 end"))
    if business:
        for name, p in [("negative_sales_count", "sales < 0"), ("zero_sales_count", "sales = 0"),
                        ("extreme_sales_count", "sales > 100000"), ("negative_items_count", "items < 0"),
                        ("zero_items_count", "items = 0"), ("extreme_items_count", "items > 1000")]:
            rows.append((name, f"cast((select count(*) from {table} where {p}) as double)"))
    return "\nunion all\n".join(f"select '{m}' as metric, cast(round({v}, 6) as double) as value"
                                 for m, v in rows)


# ---------------------------------------------------------------- E2
@register("batch_summary", with_views("""
select count(*) as records, cast(sum(price * units_sold) as decimal(20,2)) as total_revenue,
       cast(sum(units_sold) as bigint) as total_units_sold, count(distinct store_id) as unique_stores,
       count(distinct sku) as unique_skus, min(date) as min_date, max(date) as max_date,
       count(*) filter (where on_hand < 50) as low_stock_count
from retail_sales""", "retail_sales"))
def q_batch_summary(spark, sf_dir):
    return Q.batch_summary(V.retail_sales(spark, sf_dir))


# ---------------------------------------------------------------- E3
@register("range_profile", with_views("""
select min(date) as min_date, max(date) as max_date, min(price) as min_price, max(price) as max_price,
       min(units_sold) as min_units_sold, max(units_sold) as max_units_sold,
       min(on_hand) as min_on_hand, max(on_hand) as max_on_hand,
       cast(count(*) filter (where store_id is null) + count(*) filter (where sku is null)
          + count(*) filter (where date is null) + count(*) filter (where units_sold is null)
          + count(*) filter (where price is null) + count(*) filter (where on_hand is null) as bigint) as total_nulls
from retail_sales""", "retail_sales"))
def q_range_profile(spark, sf_dir):
    return Q.range_profile(V.retail_sales(spark, sf_dir))


# ---------------------------------------------------------------- E4
@register("quality_metrics", with_views(metrics_sql("daily_sales", DS_COLS), "daily_sales"))
def q_quality_metrics(spark, sf_dir):
    return r6(Q.quality_metrics(V.daily_sales(spark, sf_dir)), ["value"])


# ---------------------------------------------------------------- E5
@register("duplicate_metrics", with_views("""
select cast(coalesce(sum(k - 1), 0) as bigint) as duplicate_rows,
       round(case when sum(k) > 0 then sum(k - 1) / sum(k) else 0.0 end, 6) as duplicate_ratio
from (select count(*) as k from daily_sales
      group by date, sales, items, store_id, product_category)""", "daily_sales"))
def q_duplicate_metrics(spark, sf_dir):
    return r6(Q.duplicate_metrics(V.daily_sales(spark, sf_dir)), ["duplicate_ratio"])


# ---------------------------------------------------------------- E6
@register("business_rule_counts", with_views("""
select count(*) filter (where sales < 0) as negative_sales_count,
       count(*) filter (where sales = 0) as zero_sales_count,
       count(*) filter (where sales > 100000) as extreme_sales_count,
       count(*) filter (where items < 0) as negative_items_count,
       count(*) filter (where items = 0) as zero_items_count,
       count(*) filter (where items > 1000) as extreme_items_count
from daily_sales""", "daily_sales"))
def q_business_rule_counts(spark, sf_dir):
    return Q.business_rule_counts(V.daily_sales(spark, sf_dir))


# ---------------------------------------------------------------- E7
@register("series_distribution", with_views("""
select round(avg(sales), 6) as sales_mean, round(stddev_samp(sales), 6) as sales_stdev
from daily_sales""", "daily_sales"))
def q_series_distribution(spark, sf_dir):
    return r6(Q.series_distribution(V.daily_sales(spark, sf_dir)), ["sales_mean", "sales_stdev"])


# ---------------------------------------------------------------- E8
O_COMPLETED_COUNT = """
select count(*) as n from (
  select store_id, product_category,
         cast(unnest(generate_series(min(date), max(date), interval 1 day)) as date) as d
  from grp group by store_id, product_category)"""


@register("pipeline_metrics", with_views("""
select stage, input_rows, output_rows, greatest(input_rows - output_rows, 0) as rows_dropped,
       greatest(output_rows - input_rows, 0) as rows_added, features_added, success from (
  select 'validate' as stage, (select count(*) from daily_sales) as input_rows,
         (select count(*) from daily_sales) as output_rows, 0 as features_added, false as success
  union all
  select 'transform', (select count(*) from daily_sales), (select count(*) from clean), 5, true
  union all
  select 'group', (select count(*) from feat), (select count(*) from grp), 0, true
  union all
  select 'complete', (select count(*) from grp), (select n from completed), 0, true
  union all
  select 'check', (select n from completed), (select n from completed), 0, true)""",
    "daily_sales", ctes=CLEAN_CTES + [("grp", O_GROUP), ("completed", O_COMPLETED_COUNT)]))
def q_pipeline_metrics(spark, sf_dir):
    """Stage rows and success of the validated ETL flow (P2); the raw file is
    the daily_sales table staged as CSV, whose planted faults fail the raw
    validation.  Seconds differ from run to run and are left out."""
    from shelfline.plans.catalog_flows import run_validated
    metrics, _ = run_validated(spark, sf_dir)
    return metrics.drop("seconds")


# ---------------------------------------------------------------- F1
@register("raw_schema_checks", with_views(rules_sql("daily_sales", RAW_RULES_SQL), "daily_sales"))
def q_raw_schema_checks(spark, sf_dir):
    return Q.schema_checks(V.daily_sales(spark, sf_dir), RL.raw_rules(AS_OF))


# ---------------------------------------------------------------- F2
PROCESSED_EXPECTED = {
    "date": "timestamp", "sales": "float", "items": "integer", "store_id": "string",
    "product_category": "string", "year": "integer", "month": "integer", "day": "integer",
    "is_weekend": "boolean", "sales_normalized": "float",
}


def _processed_sql():
    parts = []
    for c, fam in PROCESSED_EXPECTED.items():
        parts.append(f"""select '{c}' as "column", '{fam}' as expected_type, '{fam}' as actual_type,
       true as type_ok, count(*) filter (where {c} is null) as null_count,
       count(*) filter (where {c} is null) = 0 as passed from feat""")
    return "\nunion all\n".join(parts)


@register("processed_schema_checks", with_views(_processed_sql(), "daily_sales", ctes=CLEAN_CTES))
def q_processed_schema_checks(spark, sf_dir):
    return Q.processed_schema_checks(featured_sales(spark, sf_dir), PROCESSED_EXPECTED)


# ---------------------------------------------------------------- F3
def _suite_sql(t: str) -> str:
    rows = [
        (0, "expect_table_row_count_to_be_between", None, f"(select count(*) from {t})",
         f"(select count(*) from {t}) between 1 and 1000000"),
        (1, "expect_table_columns_to_match_ordered_list", None, "null", "true"),
    ]
    for i, c in enumerate(DS_COLS):
        rows.append((2 + i, "expect_column_to_exist", c, "null", "true"))
    for i, c in enumerate(DS_COLS):
        rows.append((7 + i, "expect_column_values_to_not_be_null", c,
                     f"(select count(*) from {t} where {c} is null)",
                     f"(select count(*) from {t} where {c} is null) = 0"))
    bad = [
        ("expect_column_values_to_be_between", "sales", "sales is not null and not (sales between 0 and 1000000)"),
        ("expect_column_values_to_be_between", "items", "items is not null and not (items between 0 and 10000)"),
        ("expect_column_values_to_be_in_set", "product_category",
         "product_category is not null and product_category not in ('Electronics','Clothing','Food','Home','Beauty','Sports')"),
        ("expect_column_values_to_match_regex", "store_id",
         "store_id is not null and not regexp_matches(store_id, '^[A-Za-z0-9_-]+$')"),
    ]
    for i, (name, c, p) in enumerate(bad):
        rows.append((12 + i, name, c, f"(select count(*) from {t} where {p})",
                     f"(select count(*) from {t} where {p}) = 0"))
    rows.append((16, "expect_column_mean_to_be_between", "sales", f"(select avg(sales) from {t})",
                 f"coalesce((select avg(sales) from {t}) between 0 and 50000, false)"))
    rows.append((17, "expect_column_stdev_to_be_between", "sales", f"(select stddev_samp(sales) from {t})",
                 f"coalesce((select stddev_samp(sales) from {t}) between 0 and 100000, false)"))
    return "\nunion all\n".join(
        f"""select {i} as expectation_order, '{n}' as expectation, {("'" + c + "'") if c else 'cast(null as varchar)'} as "column",
       round(cast({o} as double), 6) as observed, {s} as success"""
        for i, n, c, o, s in rows)


@register("expectation_suite", with_views(_suite_sql("daily_sales"), "daily_sales"))
def q_expectation_suite(spark, sf_dir):
    return r6(Q.expectation_suite(V.daily_sales(spark, sf_dir)), ["observed"])


# ---------------------------------------------------------------- F4
@register("contract_checks", with_views(rules_sql("retail_sales", CONTRACT_RULES_SQL), "retail_sales"))
def q_contract_checks(spark, sf_dir):
    return Q.schema_checks(V.retail_sales(spark, sf_dir), RL.contract_rules(AS_OF))


# Rows that break the contract in several ways.
O_BROKEN = """
select * replace (
  case when on_hand % 13 = 0 then -price else price end as price,
  case when units_sold % 17 = 0 then null else store_id end as store_id,
  case when on_hand % 19 = 0 then 5000 else units_sold end as units_sold,
  case when on_hand % 23 = 0 then null else sku end as sku) from retail_sales"""


def broken_sales(spark, sf_dir):
    c = F.col
    return V.retail_sales(spark, sf_dir).select(
        F.when(c("units_sold") % 17 != 0, c("store_id")).alias("store_id"),
        F.when(c("on_hand") % 23 != 0, c("sku")).alias("sku"), "date",
        F.when(c("on_hand") % 19 == 0, F.lit(5000)).otherwise(c("units_sold")).cast("int").alias("units_sold"),
        F.when(c("on_hand") % 13 == 0, -c("price")).otherwise(c("price")).alias("price"), "on_hand")


@register("contract_checks_broken", with_views(
    rules_sql("broken", CONTRACT_RULES_SQL), "retail_sales", ctes=[("broken", O_BROKEN)]))
def q_contract_checks_broken(spark, sf_dir):
    return Q.schema_checks(broken_sales(spark, sf_dir), RL.contract_rules(AS_OF))


# ---------------------------------------------------------------- F5
@register("documented_contract_checks", with_views(
    rules_sql("retail_sales", DOC_RULES_SQL) + """
union all
select 4 as rule_order, 'store_id,sku,date' as "column", 'unique' as "check",
       cast(coalesce(sum(k) filter (where k > 1), 0) as bigint) as failures,
       coalesce(sum(k) filter (where k > 1), 0) = 0 as passed
from (select count(*) as k from retail_sales group by store_id, sku, date)""", "retail_sales"))
def q_documented_contract_checks(spark, sf_dir):
    return Q.documented_contract_checks(V.retail_sales(spark, sf_dir), RL.documented_rules())


# ---------------------------------------------------------------- F6
@register("quarantine_split", with_views(
    f"""select date, sales, items, store_id, product_category,
               {reasons_sql(RAW_RULES_SQL)} = '' as is_valid,
               {reasons_sql(RAW_RULES_SQL)} as reasons
        from daily_sales""", "daily_sales"))
def q_quarantine_split(spark, sf_dir):
    return Q.tag_quarantine(V.daily_sales(spark, sf_dir), RL.raw_rules(AS_OF))


# ---------------------------------------------------------------- F7
@register("schema_drift", with_views("""
select 'extra_column' as kind, c as "column", cast(null as varchar) as expected, t as actual, n as "rows",
       true as has_drift
from (select count(year) as n1, count(month) as n2, count(day) as n3, count(is_weekend) as n4,
             count(sales_normalized) as n5 from feat),
     lateral (values ('year', 'int32', n1), ('month', 'int32', n2), ('day', 'int32', n3),
                     ('is_weekend', 'bool', n4), ('sales_normalized', 'float64', n5)) v(c, t, n)
union all
select 'dtype_change', 'items', 'int64', 'int32', count(items), true from feat""",
    "daily_sales", ctes=CLEAN_CTES))
def q_schema_drift(spark, sf_dir):
    df = featured_sales(spark, sf_dir)
    return Q.schema_drift(df.withColumn("items", F.col("items").cast("int")))


# ---------------------------------------------------------------- F8
@register("dtype_match", with_views("""
select metric, value, n as "rows"
from (select count(date) as n1, count(sales) as n2, count(items) as n3, count(store_id) as n4,
             count(product_category) as n5 from daily_sales),
     lateral (values ('date_dtype_match', 1, n1), ('sales_dtype_match', 1, n2), ('items_dtype_match', 0, n3),
                     ('store_id_dtype_match', 1, n4), ('product_category_dtype_match', 1, n5)) v(metric, value, n)""",
    "daily_sales"))
def q_dtype_match(spark, sf_dir):
    df = V.daily_sales(spark, sf_dir)
    return Q.dtype_match(df.withColumn("items", F.col("items").cast("int")))


# ---------------------------------------------------------------- F9
@register("threshold_gate", with_views("""
select gate, observed, "limit", passed from (
  select 'null_ratio' as gate, value as observed, cast(0.1 as double) as "limit", value <= 0.1 as passed
  from m where metric = 'overall_null_ratio'
  union all
  select 'duplicate_ratio', value, cast(0.05 as double), value <= 0.05 from m where metric = 'duplicate_ratio'
  union all
  select 'row_count', value, cast(1000000.0 as double), value between 1 and 1000000 from m where metric = 'total_rows')""",
    "daily_sales", ctes=[("m", metrics_sql("daily_sales", DS_COLS))]))
def q_threshold_gate(spark, sf_dir):
    return Q.threshold_gate(r6(Q.quality_metrics(V.daily_sales(spark, sf_dir)), ["value"]))


# ---------------------------------------------------------------- F10
def validate_sql(drift: str = "", t: str = "daily_sales", m: str = "m") -> str:
    return f"""
select *, coalesce(bool_and(success) over (), true) as overall_success from (
  select 'metrics' as section, metric as name, cast(null as varchar) as "column", value as observed,
         cast(null as boolean) as success, 'daily_sales' as dataset from {m}
  union all
  select 'schema', "check", "column", cast(failures as double), passed, 'daily_sales'
  from ({rules_sql(t, RAW_RULES_SQL)})
  union all
  select 'expectations', expectation, "column", observed, success, 'daily_sales'
  from ({_suite_sql(t)}){drift})"""


VALIDATE_CTES = [("m", metrics_sql("daily_sales", DS_COLS))]


@register("validate_all", with_views(validate_sql(), "daily_sales", ctes=VALIDATE_CTES))
def q_validate_all(spark, sf_dir):
    df = V.daily_sales(spark, sf_dir)
    return r6(Q.validate_all(df, RL.raw_rules(AS_OF), dataset="daily_sales"), ["observed"])


@register("validate_all_drift", with_views(validate_sql("""
  union all
  select 'drift', 'dtype_change', 'items', cast(count(items) as double), false, 'daily_sales' from daily_sales"""),
    "daily_sales", ctes=VALIDATE_CTES))
def q_validate_all_drift(spark, sf_dir):
    """The same rows with `items` narrowed to 32 bits: drift fails the whole."""
    df = V.daily_sales(spark, sf_dir).withColumn("items", F.col("items").cast("int"))
    return r6(Q.validate_all(df, RL.raw_rules(AS_OF), dataset="daily_sales"), ["observed"])



# ---------------------------------------------------------------- B6
@register("emit_metrics", with_views("""
select metric as metric_name, value,
       case when lower(metric) like '%count%' then 'Count' else 'Percent' end as unit,
       'daily_sales' as dataset from m""", "daily_sales", ctes=[("m", metrics_sql("daily_sales", DS_COLS))]))
def q_emit_metrics(spark, sf_dir):
    m = r6(Q.quality_metrics(V.daily_sales(spark, sf_dir)), ["value"])
    return Q.metrics_long(m, "daily_sales", unit_rule="quality")
