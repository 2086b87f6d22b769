"""Views over the given test tables with the shapes of the data model.

Each view is a plain DataFrame plan over the base Parquet tables, so all of
its work grows with them.  Joins are left to the optimizer: with AQE the
dimension side is broadcast only when its measured size is under
``spark.sql.autoBroadcastJoinThreshold``; otherwise it is a shuffle join.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture derivation: 25-year date shift so the
# "date >= 2020-01-01" rule is meaningful, and the category mapping.
DATE_SHIFT_DAYS = 9131
CATEGORY_BY_PART_TYPE = {
    "PROMO": "Electronics",
    "SMALL": "Clothing",
    "LARGE": "Food",
    "ECONOMY": "Home",
    "MEDIUM": "Beauty",
}
OTHER_CATEGORY = "Sports"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _store_id(nationkey: Column) -> Column:
    return F.concat(F.lit("STORE_"), F.lpad(nationkey.cast("string"), 3, "0"))


def _sku(p_type: Column, p_brand: Column) -> Column:
    return F.concat(F.lit("SKU_"), p_type, F.lit("_"),
                    F.lpad(F.regexp_extract(p_brand, r"([0-9]+)$", 1), 3, "0"))


def _shifted_date(ts: Column) -> Column:
    return F.date_add(ts.cast("date"), DATE_SHIFT_DAYS)


def _sales_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_retailprice")
    return (li.join(sup, li.l_suppkey == sup.s_suppkey)
              .join(part, li.l_partkey == part.p_partkey))


def retail_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store_id, sku, date, units_sold, price decimal(10,2), on_hand;
    unique on (store_id, sku, date)."""
    lines = _sales_lines(spark, sf_dir)
    return (lines
            .groupBy(_store_id(F.col("s_nationkey")).alias("store_id"),
                     _sku(F.col("p_type"), F.col("p_brand")).alias("sku"),
                     _shifted_date(F.col("l_shipdate")).alias("date"))
            .agg(F.sum("l_quantity").cast("int").alias("units_sold"),
                 F.max("p_retailprice").cast("decimal(10,2)").alias("price"),
                 F.sum((F.col("l_partkey") * 37 + F.col("l_suppkey") * 11) % 200)
                  .cast("int").alias("on_hand")))


def daily_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily sales with injected defects: negative and null sales, null
    items, empty store ids and an unknown category."""
    lines = _sales_lines(spark, sf_dir)
    ok = F.col("l_orderkey")
    cat = F.when(ok % 101 == 0, F.lit("InvalidCategory"))
    for ptype, name in CATEGORY_BY_PART_TYPE.items():
        cat = cat.when(F.col("p_type") == ptype, F.lit(name))
    cat = cat.otherwise(F.lit(OTHER_CATEGORY))
    return lines.select(
        _shifted_date(F.col("l_shipdate")).alias("date"),
        F.when(ok % 97 == 0, -F.col("l_extendedprice"))
         .when(ok % 89 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("l_extendedprice")).alias("sales"),
        F.when(ok % 83 == 0, F.lit(None).cast("bigint"))
         .otherwise(F.col("l_quantity").cast("bigint")).alias("items"),
        F.when(ok % 79 == 0, F.lit("")).otherwise(_store_id(F.col("s_nationkey"))).alias("store_id"),
        cat.alias("product_category"),
    )


def sku_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-SKU MOQ, unit cost and shelf space; brands divisible by 4 have no
    entry so the lookup defaults are exercised."""
    part = table(spark, sf_dir, "part")
    brand_no = F.regexp_extract("p_brand", r"([0-9]+)$", 1)
    return (part.filter(brand_no.cast("int") % 4 != 0)
                .groupBy(_sku(F.col("p_type"), F.col("p_brand")).alias("sku"))
                .agg(F.min("p_size").cast("double").alias("moq"),
                     (F.max("p_retailprice") * 0.5).alias("unit_cost"),
                     ((F.min("p_size") % 4 + 1).cast("double") * 0.5).alias("space_per_unit")))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("request_id"),
        F.col("ts"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")).alias("client_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), "POST").otherwise("GET").alias("method"),
        F.concat(F.lit("/"), F.col("event_type")).alias("path"),
        F.col("value").alias("processing_time"),
        F.when(F.col("event_type") == "error", 500)
         .when(F.col("event_id") % 20 == 0, 404).otherwise(200).alias("status_code"),
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("job_id"),
        F.concat(F.lit("user_"), (F.col("o_custkey") % 50).cast("string")).alias("user_id"),
        F.when(k % 4 == 0, "etl").when(k % 4 == 1, "forecast")
         .when(k % 4 == 2, "optimization").otherwise("batch_processing").alias("job_type"),
        F.when(k % 10 == 0, "failed").when(k % 37 == 0, "cancelled")
         .when(F.col("o_orderstatus") == "F", "completed")
         .when(F.col("o_orderstatus") == "P", "running").otherwise("queued").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("updated_at"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        (k % 5).cast("int").alias("retry_count"),
        F.lit(3).alias("max_retries"),
    )
