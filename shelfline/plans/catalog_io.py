"""Registered source / sink queries."""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import functions as F

from shelfline.functions import rules as RL
from shelfline.operators import quality as Q
from shelfline.operators import transform as X
from shelfline.plans.catalog_quality import AS_OF, DS_COLS, RAW_RULES_SQL, _suite_sql, metrics_sql, rules_sql
from shelfline.plans.catalog_transform import CLEAN_CTES, O_GROUP, clean_sales, featured_sales
from shelfline.plans.oracle_views import with_views
from shelfline.plans.registry import register
from shelfline.schemas import DAILY_SALES, RETAIL_SALES
from shelfline.session import scratch_dir
from shelfline.sources import files as A
from shelfline.sources import fixtures as V
from shelfline.sources import sinks as B

REPORT_TIME = dt.datetime(2026, 12, 31, 12, 0, 0)


# ---------------------------------------------------------------- A1
# An empty CSV field reads as missing (as pandas.read_csv does in the reference).
@register("read_sales", with_views(
    """select date, sales, items, nullif(store_id, '') as store_id,
              nullif(product_category, '') as product_category from daily_sales""", "daily_sales"))
def q_read_sales(spark, sf_dir):
    path = os.path.join(scratch_dir(spark, "raw"), "daily_sales.csv")
    B.write_as(V.daily_sales(spark, sf_dir), path, fmt="csv", compression="none")
    return A.read_sales(spark, path, schema=DAILY_SALES)


# ------------------------------------------------------- A1 into F6: rejects
def bulk_rules() -> list[RL.Rule]:
    """Rules hold Columns, which need a session: built in a query, not on import."""
    return [RL.not_null("store_id"), RL.ge("items", 3)]


def stage_broken_csv(spark, sf_dir) -> str:
    """daily_sales as a CSV file in which some fields do not parse."""
    path = os.path.join(scratch_dir(spark, "broken"), "daily_sales.csv")
    k = F.col("items") % 50
    rows = V.daily_sales(spark, sf_dir).select(
        F.when(k == 9, "not a date").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(k == 7, F.concat(F.coalesce(F.col("sales").cast("string"), F.lit("")), F.lit("x"))).otherwise(
            F.col("sales").cast("string")).alias("sales"), "items", "store_id", "product_category")
    B.write_as(rows, path, fmt="csv", compression="none")
    return path


@register("rejected_records", with_views("""
select reasons, count(*) as records, cast(sum(case when reasons = '' then items end) as bigint) as valid_items
from (select items, case when items % 50 in (7, 9) then 'malformed'
                         else concat_ws(',', case when nullif(store_id, '') is null then 'store_id:not_null' end,
                                        case when items < 3 then 'items:greater_than_or_equal_to(3)' end) end as reasons
      from daily_sales) group by reasons""", "daily_sales"))
def q_rejected_records(spark, sf_dir):
    valid, rejects = A.split_rejects(A.read_tagged(spark, stage_broken_csv(spark, sf_dir), bulk_rules()))
    both = valid.select(F.lit("").alias("reasons"), "items").unionByName(
        rejects.select("reasons", F.lit(None).cast("long").alias("items")))
    return both.groupBy("reasons").agg(F.count(F.lit(1)).alias("records"), F.sum("items").alias("valid_items"))


# ---------------------------------------------------------------- A2
@register("read_remote_sales", """
select 'lineitem.parquet' as file, count(*) as rows, count(l_orderkey) as orders from lineitem""")
def q_read_remote_sales(spark, sf_dir):
    path = os.path.join(sf_dir, "lineitem.parquet")
    uri = path if "://" in path else "file://" + os.path.abspath(path)
    rows = A.read_remote_sales(spark, uri, schema="l_orderkey bigint, l_quantity double")
    return rows.groupBy(F.element_at(F.split("source_file", "/"), -1).alias("file")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("l_orderkey").alias("orders"))


# ---------------------------------------------------------------- A3 (rows only: listing)
@register("list_source_files")
def q_list_source_files(spark, sf_dir):
    return A.list_source_files(spark, os.path.join(sf_dir, "*.parquet"), limit=1000)


# ---------------------------------------------------------------- A4
@register("typed_convert", with_views("""
select store_id, sku, cast(date as timestamp) as date, cast(units_sold as integer) as units_sold,
       cast(price as double) as price, cast(on_hand as integer) as on_hand
from retail_sales""", "retail_sales"))
def q_typed_convert(spark, sf_dir):
    path = scratch_dir(spark, "typed")
    A.write_typed_parquet(A.typed_convert(V.retail_sales(spark, sf_dir)), path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- B1
@register("write_partitioned", with_views("""
select year, month, count(*) as rows, round(sum(sales), 4) as sales
from feat group by year, month""", "daily_sales", ctes=CLEAN_CTES))
def q_write_partitioned(spark, sf_dir):
    path = scratch_dir(spark, "partitioned")
    B.write_partitioned(X.calendar_features(clean_sales(spark, sf_dir)), path, by=("year", "month"))
    back = spark.read.parquet(path)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"),
                                             F.round(F.sum("sales"), 4).alias("sales"))


# ---------------------------------------------------------------- B2
@register("save_with_stats", with_views("""
select count(*) as rows_saved, 6 as columns_saved, true as success, true as has_bytes from retail_sales""",
    "retail_sales"))
def q_save_with_stats(spark, sf_dir):
    stats = B.save_with_stats(spark, V.retail_sales(spark, sf_dir), scratch_dir(spark, "saved"))
    return stats.select("rows_saved", "columns_saved", "success", (F.col("file_size") > 0).alias("has_bytes"))


# ---------------------------------------------------------------- B3
@register("medallion_layout", with_views("""
select 'bronze' as zone, count(*) as rows from daily_sales
union all select 'silver', count(*) from feat
union all select 'gold', count(*) from grp""", "daily_sales", ctes=CLEAN_CTES + [("grp", O_GROUP)]))
def q_medallion_layout(spark, sf_dir):
    root = scratch_dir(spark, "zones")
    raw = V.daily_sales(spark, sf_dir)
    silver = featured_sales(spark, sf_dir)
    gold = X.daily_group(silver)
    parts = []
    for zone, df, by in (("bronze", raw, ()), ("silver", silver, ("year", "month")), ("gold", gold, ())):
        path = B.write_zone(df, root, zone, by)
        parts.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))
                     .select(F.lit(zone).alias("zone"), "rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---------------------------------------------------------------- B4
@register("output_format", with_views("select * from retail_sales", "retail_sales"))
def q_output_format(spark, sf_dir):
    path = scratch_dir(spark, "json_out")
    B.write_as(V.retail_sales(spark, sf_dir), path, fmt="json", compression="gzip")
    return spark.read.schema(RETAIL_SALES).json(path)


# ---------------------------------------------------------------- B5
REPORT_SCHEMA = ("section string, name string, `column` string, observed double, success boolean, "
                 "report_time timestamp_ntz")


@register("validation_report", with_views(f"""
select 'metrics' as section, metric as name, cast(null as varchar) as "column", value as observed,
       cast(null as boolean) as success, 'daily_sales' as dataset,
       timestamp '2026-12-31 12:00:00' as report_time from m
union all
select 'schema', "check", "column", cast(failures as double), passed, 'daily_sales',
       timestamp '2026-12-31 12:00:00' from ({rules_sql("daily_sales", RAW_RULES_SQL)})
union all
select 'expectations', expectation, "column", observed, success, 'daily_sales',
       timestamp '2026-12-31 12:00:00' from ({_suite_sql("daily_sales")})""",
    "daily_sales", ctes=[("m", metrics_sql("daily_sales", DS_COLS))]))
def q_validation_report(spark, sf_dir):
    results = Q.validate_all(V.daily_sales(spark, sf_dir), RL.raw_rules(AS_OF), dataset="daily_sales")
    results = results.withColumn("observed", F.round("observed", 6)).drop("dataset", "overall_success")
    path = scratch_dir(spark, "reports")
    B.write_report(results, path, "daily_sales", REPORT_TIME)
    return B.read_report(spark, path, REPORT_SCHEMA)
