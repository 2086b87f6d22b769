"""End-to-end ETL, forecast, contract and reorder flows (P1-P6) and the
stage metrics they report."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def auto_forecast(spark, sales: DataFrame, keys: Sequence[str], periods: int, model_path: str,
                  model_date, sku: str | None = None, store_id: str | None = None,
                  region: str | None = None, y: str = "units_sold") -> DataFrame:
    """Filter (C8) -> collapse (J1) -> fit (J4) -> save model table
    -> future frame (J3) -> score the saved models (J8).  The collapsed
    series (one row per series and day) are written once, so the sales are
    read once."""
    from shelfline.operators import forecast as J
    from shelfline.session import materialize
    from shelfline.operators.transform import series_filter
    data = series_filter(sales, sku=sku, store_id=store_id, region=region)
    prep = materialize(J.series_prepare(data, keys, y=y), "series")
    hol = J.default_holidays(spark)
    J.save_models(J.fit_trend_season(prep, keys, hol), model_path, model_date)
    models = J.load_models(spark, model_path, model_date).drop("model_date")
    return J.score(models, J.future_frame(prep, keys, periods), keys, hol)


def clearance_plan(forecast: DataFrame, sales: DataFrame, params: DataFrame | None, cfg,
                   keys: Sequence[str] = ("sku",)):
    """K8: demand over the horizon = Σ future yhat per series; on_hand = the
    latest stock of every (store, SKU) added up over the series' stores;
    price = that of the latest row (ties on the date broken by store); then
    the reorder plan (K1-K7).  Returns (orders, summary)."""
    from shelfline.operators import reorder as R
    from shelfline.session import materialize
    keys = list(keys)
    demand = (forecast.filter(F.col("is_future")).groupBy(*keys)
              .agg(F.sum("yhat").alias("demand")))
    per_store = sales.groupBy(*dict.fromkeys([*keys, "store_id"])).agg(
        F.max_by(F.struct("on_hand", "price"), "date").alias("last"), F.max("date").alias("date"))
    latest = per_store.groupBy(*keys).agg(
        F.sum("last.on_hand").alias("on_hand"),
        F.max_by("last.price", F.struct("date", "store_id")).alias("price"))
    rows = demand.join(latest, keys).withColumn("units_sold", F.col("demand"))
    # One row per series behind an expensive forecast lineage: write it once
    # to the shared folder so the plan's two passes read it instead of
    # re-running the forecast.
    rows = materialize(rows, "reorder_rows")
    return R.optimize(rows, params, cfg, by=tuple(k for k in keys if k != "sku"))


def etl_simple(spark, in_path: str, out_path: str, keys: Sequence[str] = ("store_id", "product_category"),
               rate: float = 1.2) -> str:
    """Read (A1) -> coerce (C2) -> one row per (series, day) -> forward-
    filled daily calendar (D1) -> currency rate (C6) -> date parts (C5) ->
    Parquet partitioned by year/month (B1)."""
    from shelfline.operators import transform as X
    from shelfline.session import materialize
    from shelfline.sources.files import read_sales
    from shelfline.sources.sinks import write_partitioned
    raw = X.coerce_types(read_sales(spark, in_path))
    daily = raw.groupBy(*keys, "date").agg(F.sum("sales").alias("sales"), F.sum("items").alias("items"))
    daily = materialize(daily, "daily")      # read for the calendar and for the rows without a date
    filled = X.calendar_complete(daily, keys=keys, fill="ffill")
    out = X.calendar_features(X.currency_normalize(filled, rate=rate))
    write_partitioned(out, out_path, by=("year", "month"))
    return out_path


def etl_validated(spark, in_path: str, settings, as_of, keys: Sequence[str] = ("store_id", "product_category"),
                  dataset: str = "daily_sales", run_id: str | None = None) -> DataFrame:
    """Read (A1) -> validate raw (F10 with drift) -> required columns,
    types, drop incomplete, date parts (C1-C5) -> z-score (C7) -> daily group
    (E1) -> per-series calendar pad (D3) -> processed checks (F2) and metrics
    (E4) -> publish.

    The raw file is parsed once, into a typed table that the validation, the
    z-score's scalars and the main pass read.  Every stage is a table of the
    run (`StageRun`): a failed one is tried again `settings.retries` times, and
    a run started again with its `run_id` goes on after its last finished
    stage.  If a check fails, of the raw or of the processed data, and the
    settings say so, the run stops with an error and `settings.data_path` keeps
    what was published there before.

    Everything found goes to `settings.report_path` (also when the run stops),
    with one row per result: phase, section, name, column, observed, success.
    Row counts of the stages (E8) are Observations filled while they are
    written.  Returns the stage metrics: stage, input_rows, output_rows,
    rows_dropped, rows_added, features_added, success, seconds (of the write
    for the stages that run in it)."""
    import os
    import time
    import uuid
    from pyspark.sql import Observation
    from shelfline.functions.rules import raw_rules
    from shelfline.operators import quality as Q
    from shelfline.operators import transform as X
    from shelfline.plans.stages import StageRun, publish
    from shelfline.schemas import DAILY_SALES_COLUMNS, PROCESSED_REFERENCE
    from shelfline.sources.files import read_sales
    result = ["phase", "section", "name", "column", "observed", "success"]
    run = StageRun(spark, os.path.join(settings.base, settings.environment, "runs", run_id or uuid.uuid4().hex),
                   settings.retries)
    count = F.count(F.lit(1)).alias("rows")

    def observed(df: DataFrame, name: str, counts: dict) -> DataFrame:
        counts[name] = Observation(f"stage_{name}_{uuid.uuid4().hex[:8]}")
        return df.observe(counts[name], count)

    def staged(name: str, build) -> tuple[DataFrame, dict]:
        """The stage's table and its record; every attempt has observations of its own."""
        counts: dict = {}
        table = run.table(name, lambda: build(counts), counts)
        return table, run.record(name)

    def as_report(phase: str, rows: DataFrame) -> DataFrame:
        return rows.withColumn("phase", F.lit(phase)).select(*result)

    def stop(phase: str) -> None:
        raise ValueError(f"{dataset}: validation failed for the {phase} data, see {settings.report_path}")

    raw, _ = staged("raw", lambda counts: read_sales(spark, in_path))
    results, checked = staged("validation", lambda counts: Q.validate_all(
        raw, raw_rules(as_of), dataset, settings.limits, settings.check_drift))
    validated = bool(Q.overall_success(results).first()["overall_success"])
    as_report("raw", results).write.mode("overwrite").parquet(settings.report_path)
    if settings.stop_on_failure and not validated:
        stop("raw")

    def group(counts: dict) -> DataFrame:
        clean = X.drop_incomplete(X.coerce_types(X.require_columns(observed(raw, "raw", counts), DAILY_SALES_COLUMNS)))
        feat = observed(X.zscore(X.calendar_features(clean)), "features", counts)
        return observed(X.daily_group(feat), "grouped", counts)
    grouped, written = staged("group", group)
    # E1 output is unique per key and date, and has no row without a date
    data, completed = staged("complete", lambda counts: observed(X.calendar_complete(
        grouped, keys=keys, fill="pad", on_duplicate="raise", undated="drop"), "completed", counts))

    began = time.monotonic()
    checks, _ = staged("checks", lambda counts: Q.processed_schema_checks(data, PROCESSED_REFERENCE).select(
        F.lit("schema").alias("section"), F.concat(F.lit("type "), F.col("expected_type")).alias("name"), "column",
        F.col("null_count").cast("double").alias("observed"), F.col("passed").alias("success")))
    metrics = Q.quality_metrics(data).select(
        F.lit("metrics").alias("section"), F.col("metric").alias("name"), F.lit(None).cast("string").alias("column"),
        F.col("value").alias("observed"), F.lit(None).cast("boolean").alias("success"))
    report = as_report("raw", results).unionByName(as_report("processed", checks.unionByName(metrics)))
    report.write.mode("overwrite").parquet(settings.report_path)
    processed_ok = checks.where(~F.col("success")).isEmpty()
    if settings.stop_on_failure and not processed_ok:
        stop("processed")
    publish(spark, settings.data_path, run.path("complete"))
    ended = time.monotonic()

    def stage(name, rows_in, rows_out, features, success, seconds):
        return (name, rows_in, rows_out, max(rows_in - rows_out, 0), max(rows_out - rows_in, 0), features, success,
                round(seconds, 3))

    n, n_out = written["rows"], completed["rows"]["completed"]
    return spark.createDataFrame(
        [stage("validate", n["raw"], n["raw"], 0, validated, checked["seconds"]),
         stage("transform", n["raw"], n["features"], 5, True, written["seconds"]),
         stage("group", n["features"], n["grouped"], 0, True, written["seconds"]),
         stage("complete", n["grouped"], n_out, 0, True, completed["seconds"]),
         stage("check", n_out, n_out, 0, processed_ok, ended - began)],
        "stage string, input_rows bigint, output_rows bigint, rows_dropped bigint, rows_added bigint, "
        "features_added int, success boolean, seconds double")


def etl_zero_fill(spark, in_path: str, out_path: str) -> str:
    """Read (A1) -> cast to the expected types and zero-fill nulls (C4)
    -> Parquet."""
    from shelfline.operators import transform as X
    from shelfline.sources.files import read_sales
    out = X.fill_zero(read_sales(spark, in_path), expected={"date": "date", "sales": "double"})
    out.write.mode("overwrite").parquet(out_path)
    return out_path


def contract_run(spark, sales: DataFrame, typed_path: str, as_of, threshold: int = 50) -> DataFrame:
    """P5: typed Parquet (A4) -> trim strings (C9) -> record contract
    with quarantine (F6) -> revenue / stock features (C10) -> batch summary
    (E2) and range profile (E3) of the valid records, in one aggregate."""
    from shelfline.functions.rules import contract_rules
    from shelfline.operators import quality as Q
    from shelfline.operators import transform as X
    from shelfline.sources.files import typed_convert, write_typed_parquet
    write_typed_parquet(typed_convert(sales), typed_path)
    typed = spark.read.parquet(typed_path)
    tagged = Q.tag_quarantine(X.trim_strings(typed), contract_rules(as_of))
    feat = X.revenue_stock_features(tagged, threshold)
    v = F.col("is_valid")
    on_valid = lambda c: F.when(v, c)
    return feat.agg(
        F.sum(F.when(v, 1).otherwise(0)).cast("bigint").alias("valid_records"),
        F.sum(F.when(v, 0).otherwise(1)).cast("bigint").alias("invalid_records"),
        F.round(F.sum(on_valid(F.col("daily_revenue"))), 2).alias("total_revenue"),
        F.sum(on_valid(F.col("units_sold"))).cast("bigint").alias("total_units_sold"),
        F.count_distinct(on_valid(F.col("store_id"))).alias("unique_stores"),
        F.count_distinct(on_valid(F.col("sku"))).alias("unique_skus"),
        F.min(on_valid(F.col("date"))).alias("min_date"), F.max(on_valid(F.col("date"))).alias("max_date"),
        F.sum(F.when(v & F.col("is_low_stock"), 1).otherwise(0)).cast("bigint").alias("low_stock_count"),
        F.min(on_valid(F.col("price"))).alias("min_price"), F.max(on_valid(F.col("price"))).alias("max_price"),
        F.min(on_valid(F.col("on_hand"))).alias("min_on_hand"),
        F.max(on_valid(F.col("on_hand"))).alias("max_on_hand"))
