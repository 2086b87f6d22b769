"""Registered streaming queries.

Each query stages the test table into an input folder as time-ordered file
batches (a stand-in for files arriving over time), runs the streaming job to
completion (availableNow) and returns what its sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.operators import jobs as L
from shelfline.plans.catalog_logs import O_ENDPOINT_METRICS, LIMIT_PER_WINDOW, LIMIT_WINDOW_SECONDS, limited_sql, limiter_ctes
from shelfline.plans.catalog_quality import AS_OF, DS_COLS, RAW_RULES_SQL, metrics_sql, rules_sql
from shelfline.plans.oracle_views import with_views
from shelfline.plans.registry import register
from shelfline.schemas import DAILY_SALES
from shelfline.session import scratch_dir
from shelfline.sources import fixtures as V
from shelfline.streaming import ingest as S
from shelfline.streaming import processors as P
from shelfline.streaming import state as N

CHUNKS = 6
FILES_PER_CHUNK = 2


def stage_in_order(df: DataFrame, ts_col: str, in_dir: str, fmt: str = "parquet",
                   chunks: int = CHUNKS, files_per_chunk: int = FILES_PER_CHUNK) -> None:
    """Write `df` as `chunks` consecutive event-time slices, one write per
    slice so file modification times follow event time (the file source
    takes the oldest files first).  The input is scanned for its time span
    and to be laid out by slice; each slice is then read by itself.  Rows
    without a time arrive with the first slice."""
    spark = df.sparkSession
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    b = df.agg(F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    lo, hi = int(b["lo"] or 0), int(b["hi"] or 0)
    step = max(1, -(-(hi + 1 - lo) // chunks))
    laid = scratch_dir(spark, "slices")
    slot = F.coalesce(F.least(F.floor((t - lo) / step), F.lit(chunks - 1)), F.lit(0)).cast("int")
    df.withColumn("slice", slot).write.mode("overwrite").partitionBy("slice").parquet(laid)
    for i in range(chunks):
        part = spark.read.parquet(laid).where(F.col("slice") == i).drop("slice")
        w = part.repartitionByRange(files_per_chunk, ts_col).write.mode("append").format(fmt)
        if fmt == "csv":
            w = w.option("header", True)
        w.save(in_dir)


def _run(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _stage_sales_csv(spark: SparkSession, sf_dir: str) -> str:
    in_dir = scratch_dir(spark, "incoming_sales")
    stage_in_order(V.daily_sales(spark, sf_dir), "date", in_dir, fmt="csv")
    return in_dir


# ---------------------------------------------------------------- A5
# Files arrive as CSV: an empty id reads as missing and then becomes the
# text 'nan' (C2), so such rows are kept, as in the reference.
@register("stream_ingest", with_views("""
select date, sales, items, coalesce(nullif(store_id, ''), 'nan') as store_id,
       coalesce(nullif(product_category, ''), 'nan') as product_category, cast(year(date) as integer) as year,
       cast(month(date) as integer) as month, cast(day(date) as integer) as day, dayofweek(date) in (0, 6) as is_weekend
from daily_sales
where date is not null and sales is not null and items is not null""", "daily_sales"))
def q_stream_ingest(spark, sf_dir):
    in_dir = _stage_sales_csv(spark, sf_dir)
    out_dir = scratch_dir(spark, "ingested")
    _run(S.stream_ingest(spark, in_dir, out_dir, scratch_dir(spark, "ckpt_ingest"),
                         schema=DAILY_SALES, fmt="csv", max_files_per_trigger=FILES_PER_CHUNK))
    return spark.read.parquet(out_dir).drop("batch_id")


# ---------------------------------------------------------------- N3
# The counts of all batches added up are those of the whole table.
O_N3 = [(f"{c}_null_count", f"{c} is null") for c in DS_COLS] + [
    ("negative_sales_count", "sales < 0"), ("zero_sales_count", "sales = 0"), ("extreme_sales_count", "sales > 100000"),
    ("negative_items_count", "items < 0"), ("zero_items_count", "items = 0"), ("extreme_items_count", "items > 1000")]


@register("stream_quality", with_views(
    "select 'metric' as kind, 'total_rows' as name, cast(count(*) as double) as value from csv\nunion all\n"
    + "\nunion all\n".join(
        f"select 'metric', '{n}', cast(count(*) filter (where {p}) as double) from csv" for n, p in O_N3)
    + """
union all
select 'rule', "column" || ':' || "check", cast(failures as double) from (""" + rules_sql("csv", RAW_RULES_SQL) + ")",
    "daily_sales", ctes=[("csv", """
select date, sales, items, nullif(store_id, '') as store_id, nullif(product_category, '') as product_category
from daily_sales""")]))
def q_stream_quality(spark, sf_dir):
    in_dir = _stage_sales_csv(spark, sf_dir)
    out_dir = scratch_dir(spark, "stream_quality")
    _run(S.stream_quality(spark, in_dir, out_dir, scratch_dir(spark, "ckpt_quality"), AS_OF,
                          schema=DAILY_SALES, fmt="csv", max_files_per_trigger=FILES_PER_CHUNK))
    counts = spark.read.parquet(out_dir).where((F.col("kind") == "rule") | F.col("name").isin(
        "total_rows", *(n for n, _ in O_N3)))
    return counts.groupBy("kind", "name").agg(F.sum("value").alias("value"))


@register("stream_quality_folded", with_views(
    metrics_sql("csv", DS_COLS) + """
union all select 'sales_mean', round(avg(sales), 6) from csv
union all select 'sales_stdev', round(stddev_samp(sales), 6) from csv""", "daily_sales", ctes=[("csv", """
select date, sales, items, nullif(store_id, '') as store_id, nullif(product_category, '') as product_category
from daily_sales""")]))
def q_stream_quality_folded(spark, sf_dir):
    """Quality of all batches together, duplicates across batches included."""
    in_dir = _stage_sales_csv(spark, sf_dir)
    out_dir = scratch_dir(spark, "quality_state")
    _run(S.stream_quality_state(spark, in_dir, out_dir, scratch_dir(spark, "ckpt_state"), schema=DAILY_SALES, fmt="csv",
                                max_files_per_trigger=FILES_PER_CHUNK))
    return S.fold_quality(spark, out_dir).withColumn("value", F.round("value", 6))


def _stage_requests(spark, sf_dir) -> str:
    in_dir = scratch_dir(spark, "incoming_requests")
    stage_in_order(V.request_log(spark, sf_dir), "ts", in_dir)
    return in_dir


# ---------------------------------------------------------------- N1
@register("stream_rate_limit", with_views(
    "select *, false as late from (" + limited_sql("request_log") + ")", "request_log",
    ctes=limiter_ctes("request_log")))
def q_stream_rate_limit(spark, sf_dir):
    """Requests arrive in event-time order, so every decision is M3's."""
    in_dir = _stage_requests(spark, sf_dir)
    src = (spark.readStream.schema(V.request_log(spark, sf_dir).schema)
                .option("maxFilesPerTrigger", FILES_PER_CHUNK).parquet(in_dir))
    out_dir = scratch_dir(spark, "rate_limit")
    _run(N.write_append(N.stream_rate_limit(src, limit=LIMIT_PER_WINDOW, seconds=LIMIT_WINDOW_SECONDS),
                        out_dir, scratch_dir(spark, "ckpt_rate")))
    return spark.read.parquet(out_dir)


# ---------------------------------------------------------------- N2
@register("stream_endpoint_metrics", with_views("""
select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end,
       method || ' ' || path as endpoint, count(*) as request_count,
       cast(sum(case when status_code >= 400 then 1 else 0 end) as bigint) as error_count,
       round(avg(processing_time), 6) as avg, min(processing_time) as "min", max(processing_time) as "max"
from request_log group by all""", "request_log"))
def q_stream_endpoint_metrics(spark, sf_dir):
    """The last state of every window, those still open included."""
    in_dir = _stage_requests(spark, sf_dir)
    src = (spark.readStream.schema(V.request_log(spark, sf_dir).schema)
                .option("maxFilesPerTrigger", FILES_PER_CHUNK).parquet(in_dir))
    out_dir = scratch_dir(spark, "endpoint_windows")
    _run(N.write_batches(N.stream_endpoint_metrics(src), out_dir, scratch_dir(spark, "ckpt_endpoint")))
    return N.latest_changes(spark, out_dir, ["w", "endpoint"]).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"),
        F.col("w.end").cast("timestamp_ntz").alias("window_end"), "endpoint",
        "request_count", "error_count", F.round("avg", 6).alias("avg"), "min", "max")


# ------------------------------------------- N2 of the last response times
@register("stream_latest_times", O_ENDPOINT_METRICS)
def q_stream_latest_times(spark, sf_dir):
    """M1 from a stream: at its end the folded shares equal the batch result."""
    in_dir = _stage_requests(spark, sf_dir)
    src = (spark.readStream.schema(V.request_log(spark, sf_dir).schema)
                .option("maxFilesPerTrigger", FILES_PER_CHUNK).parquet(in_dir))
    out_dir = scratch_dir(spark, "latest_times")
    _run(N.write_batches(P.stream_latest_times(src), out_dir, scratch_dir(spark, "ckpt_latest")))
    return P.fold_latest_times(N.latest_changes(spark, out_dir, ["endpoint", "share"])).withColumn(
        "avg", F.round("avg", 6))


# ------------------------------------------------- N1 in event-time order
DELAY, LATENESS_SECONDS = "2 hours", 3600


def stage_out_of_order(requests: DataFrame, in_dir: str) -> None:
    """Requests arrive up to an hour after their time, in an order that
    follows their arrival; then the log ends."""
    late = F.pmod(F.xxhash64("request_id"), F.lit(LATENESS_SECONDS)).cast("int")
    arriving = requests.withColumn("arrival", F.col("ts") + F.make_dt_interval(secs=late))
    stage_in_order(arriving, "arrival", in_dir)
    P.closing_row(requests, DELAY).withColumn("arrival", F.col("ts")).coalesce(1).write.mode("append").parquet(in_dir)


@register("stream_ordered_limit", with_views(
    "select *, false as late from (" + limited_sql("request_log") + ")", "request_log",
    ctes=limiter_ctes("request_log")))
def q_stream_ordered_limit(spark, sf_dir):
    """M3's decisions although requests arrive out of order."""
    requests = V.request_log(spark, sf_dir)
    in_dir = scratch_dir(spark, "incoming_unordered")
    stage_out_of_order(requests, in_dir)
    src = (spark.readStream.schema(requests.schema)
                .option("maxFilesPerTrigger", FILES_PER_CHUNK).parquet(in_dir))
    out_dir = scratch_dir(spark, "ordered_limit")
    _run(N.write_append(P.stream_ordered_limit(src, LIMIT_PER_WINDOW, LIMIT_WINDOW_SECONDS, watermark=DELAY),
                        out_dir, scratch_dir(spark, "ckpt_ordered")))
    return spark.read.parquet(out_dir)


# ---------------------------------------------------------------- N4
@register("stream_job_state", with_views(
    "select job_id, user_id, job_type, priority, retry_count, max_retries, created_at, status, updated_at "
    "from job_log", "job_log"))
def q_stream_job_state(spark, sf_dir):
    updates = L.status_updates(V.job_log(spark, sf_dir))
    in_dir = scratch_dir(spark, "incoming_job_updates")
    stage_in_order(updates, "updated_at", in_dir)
    src = (spark.readStream.schema(updates.schema)
                .option("maxFilesPerTrigger", FILES_PER_CHUNK).parquet(in_dir))
    out_dir = scratch_dir(spark, "job_state")
    _run(N.write_batches(N.stream_job_state(src), out_dir, scratch_dir(spark, "ckpt_jobs")))
    changes = spark.read.parquet(out_dir).drop("batch_id")
    return L.job_state_fold(changes)
