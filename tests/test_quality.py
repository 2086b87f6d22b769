"""Rule engine, expectation suite, metrics and drift on small frames shaped
like the reference's valid / invalid fixtures."""

import datetime as dt

from shelfline.functions import rules as RL
from shelfline.operators import quality as Q

AS_OF = dt.date(2026, 12, 31)
SCHEMA = "date date, sales double, items bigint, store_id string, product_category string"


def _valid(spark):
    cats = ["Electronics", "Clothing", "Food"]
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), 100.0 + 10 * d + s, 1 + d + s, f"STORE_{s:03d}", c)
            for d in range(10) for s in range(2) for c in cats]
    return spark.createDataFrame(rows, SCHEMA)


def _invalid(spark):
    rows = [(None, 100.0, 1, "S1", "Food"), (dt.date(2024, 1, 2), -5.0, 2, "S2", "Food"),
            (dt.date(2024, 1, 3), 10.0, 3, "", "Toys")]
    return spark.createDataFrame(rows, SCHEMA)


def _failures(df):
    return {(r["column"], r["check"]): r["failures"] for r in df.collect()}


def test_valid_frame_passes_everything(spark):
    f = _failures(Q.schema_checks(_valid(spark), RL.raw_rules(AS_OF)))
    assert all(v == 0 for v in f.values())
    suite = Q.expectation_suite(_valid(spark)).collect()
    assert len(suite) == 18 and all(r["success"] for r in suite)


def test_invalid_frame_reports_all_failures(spark):
    f = _failures(Q.schema_checks(_invalid(spark), RL.raw_rules(AS_OF)))
    assert f[("date", "not_null")] == 1
    assert f[("sales", "greater_than_or_equal_to(0)")] == 1
    assert f[("store_id", "str_length(1,50)")] == 1
    assert f[("store_id", r"str_matches(^[A-Za-z0-9_-]+$)")] == 1
    assert f[("product_category", "isin")] == 1
    # a null fails only the not-null rule
    assert f[("date", "greater_than_or_equal_to(2020-01-01)")] == 0


def test_quarantine_split(spark):
    valid, invalid = Q.quarantine_split(_invalid(spark), RL.raw_rules(AS_OF))
    assert valid.count() == 0
    reasons = {r["store_id"]: set(r["reasons"]) for r in invalid.collect()}
    assert reasons["S1"] == {"date:not_null"}
    assert "product_category:isin" in reasons[""]


def test_quality_metrics_and_duplicates(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0, 1, "A", "Food")] * 3
                               + [(dt.date(2024, 1, 2), None, 0, "A", "Food")], SCHEMA)
    m = {r["metric"]: r["value"] for r in Q.quality_metrics(df).collect()}
    assert m["total_rows"] == 4 and m["duplicate_rows"] == 2 and m["duplicate_ratio"] == 0.5
    assert m["sales_null_count"] == 1 and m["sales_null_ratio"] == 0.25
    assert m["overall_null_ratio"] == 1 / 20
    assert m["zero_items_count"] == 1


def test_empty_frame_metrics(spark):
    m = {r["metric"]: r["value"] for r in Q.quality_metrics(spark.createDataFrame([], SCHEMA)).collect()}
    assert m["total_rows"] == 0 and m["sales_null_ratio"] == 0.0 and m["duplicate_ratio"] == 0.0


def test_schema_drift(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "date int, store_id string, extra double")
    rows = {(r["kind"], r["column"]) for r in Q.schema_drift(df).collect()}
    assert ("missing_column", "sales") in rows and ("extra_column", "extra") in rows
    assert ("dtype_change", "date") in rows


def test_batch_summary_empty_raises(spark):
    import pytest
    empty = spark.createDataFrame([], "store_id string, sku string, date date, units_sold int, "
                                      "price decimal(10,2), on_hand int")
    with pytest.raises(Exception):
        Q.batch_summary(empty).collect()


def test_validate_all_sections_and_gate(spark):
    import pytest
    res = Q.validate_all(_invalid(spark), RL.raw_rules(AS_OF), dataset="t")
    sections = {r["section"] for r in res.collect()}
    assert {"metrics", "schema", "expectations"} <= sections
    assert Q.overall_success(res).first()["overall_success"] is False
    with pytest.raises(ValueError):
        Q.fail_fast(res)
    ok = Q.validate_all(_valid(spark), RL.raw_rules(AS_OF))
    assert Q.overall_success(ok).first()["overall_success"] is True


def test_settings_of_environments():
    from shelfline.plans.presets import settings_for
    import pytest
    dev = settings_for("development", "s3a://bucket/root")
    assert dev.stop_on_failure is False and dev.retries == 1
    assert dev.data_path == "s3a://bucket/root/development/sales"
    assert settings_for("production", "/b", retries=7).stop_on_failure and settings_for("staging", "/b").retries == 2
    with pytest.raises(ValueError):
        settings_for("elsewhere", "/b")


def test_drift_fails_the_whole(spark):
    df = _valid(spark)
    drifted = df.withColumn("items", df["items"].cast("int"))
    rows = Q.validate_all(drifted, RL.raw_rules(AS_OF)).collect()
    drift = [r for r in rows if r["section"] == "drift"]
    assert [(r["name"], r["column"], r["observed"]) for r in drift] == [("dtype_change", "items", df.count())]
    assert not any(r["overall_success"] for r in rows)
    assert all(r["overall_success"] for r in Q.validate_all(drifted, RL.raw_rules(AS_OF), check_drift=False).collect())


def test_row_limit_is_an_argument(spark):
    df = _valid(spark)
    few = Q.Limits(max_rows=1)
    assert Q.overall_success(Q.validate_all(df, RL.raw_rules(AS_OF), limits=few)).first()[0] is (df.count() <= 1)
    assert Q.overall_success(Q.validate_all(df, RL.raw_rules(AS_OF), limits=Q.Limits(max_rows=None))).first()[0]
    gate = Q.threshold_gate(Q.quality_metrics(df), Q.Limits(min_rows=10 ** 6, max_rows=None)).collect()
    assert {r["gate"]: r["passed"] for r in gate}["row_count"] is False


def _csv(df, path):
    df.coalesce(1).write.option("header", True).csv(path)
    return path


def test_validated_flow_stops_on_bad_input_and_reports(spark, tmp_path):
    import os
    import pytest
    from shelfline.plans.flows import etl_validated
    from shelfline.plans.presets import settings_for
    bad = _csv(_invalid(spark), f"{tmp_path}/bad.csv")
    strict = settings_for("production", f"{tmp_path}/strict")
    with pytest.raises(ValueError, match="validation failed"):
        etl_validated(spark, bad, strict, AS_OF)
    report = spark.read.parquet(strict.report_path)
    assert report.where("phase = 'raw' and not success").count() > 0 and not os.path.exists(strict.data_path)
    good = _csv(_valid(spark), f"{tmp_path}/good.csv")
    stages = {r["stage"]: r for r in etl_validated(spark, good, settings_for("production", f"{tmp_path}/g"),
                                                   AS_OF).collect()}
    assert all(r["success"] and r["seconds"] >= 0 and r["rows_dropped"] >= 0 for r in stages.values())
    assert spark.read.parquet(f"{tmp_path}/g/production/sales").count() == stages["complete"]["output_rows"]
    phases = {r["phase"] for r in spark.read.parquet(f"{tmp_path}/g/production/report").collect()}
    assert phases == {"raw", "processed"}


def test_etl_units_and_dimensions(spark):
    m = spark.createDataFrame([("row_count", 3.0), ("load_time", 2.0), ("ratio", 0.5)], "metric string, value double")
    rows = {r["metric_name"]: r for r in Q.metrics_long(m, "d", "etl", dims={"region": "x"}).collect()}
    assert [rows[k]["unit"] for k in ("row_count", "load_time", "ratio")] == ["Count", "Seconds", "None"]
    assert rows["ratio"]["dimensions"] == {"dataset": "d", "region": "x"}
