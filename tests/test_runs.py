"""Staged runs: gate, publication, retry and resume; rejects; deep paging."""

import datetime as dt
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from shelfline.functions import rules as RL
from shelfline.operators import jobs as L
from shelfline.operators import transform as X
from shelfline.plans import flows, stages
from shelfline.plans.presets import settings_for
from shelfline.sources import files as A

from .test_quality import AS_OF, _csv, _valid


def _rows(spark, settings):
    return sorted(map(str, spark.read.parquet(settings.data_path).collect()))


def test_a_failed_check_leaves_the_old_data(spark, tmp_path, monkeypatch):
    settings = settings_for("production", f"{tmp_path}/p", retries=0)
    good = _csv(_valid(spark), f"{tmp_path}/good.csv")
    flows.etl_validated(spark, good, settings, AS_OF)
    before = _rows(spark, settings)
    flows.etl_validated(spark, good, settings, AS_OF)
    assert _rows(spark, settings) == before and before                # a rerun gives equal rows
    more = _csv(_valid(spark).withColumn("sales", F.col("sales") + 1), f"{tmp_path}/more.csv")
    monkeypatch.setattr("shelfline.schemas.PROCESSED_REFERENCE", {"date": "timestamp", "sales": "string"})
    with pytest.raises(ValueError, match="validation failed for the processed"):
        flows.etl_validated(spark, more, settings, AS_OF)
    assert _rows(spark, settings) == before
    report = spark.read.parquet(settings.report_path)
    assert report.where("phase = 'processed' and not success").count() == 1
    lax = settings_for("development", f"{tmp_path}/p")
    out = {r["stage"]: r for r in flows.etl_validated(spark, more, lax, AS_OF).collect()}
    assert out["check"]["success"] is False and _rows(spark, lax) != before


def test_a_run_goes_on_after_its_last_finished_stage(spark, tmp_path, monkeypatch):
    settings = settings_for("production", f"{tmp_path}/r", retries=0)
    good = _csv(_valid(spark), f"{tmp_path}/good.csv")
    whole = {r["stage"]: r for r in flows.etl_validated(spark, good, settings, AS_OF).collect()}
    want = _rows(spark, settings)

    def broken(*args, **kwargs):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(X, "calendar_complete", broken)
        with pytest.raises(RuntimeError):
            flows.etl_validated(spark, good, settings, AS_OF, run_id="one")
    folder = f"{settings.base}/production/runs/one"
    assert os.path.exists(f"{folder}/group.json") and not os.path.exists(f"{folder}/complete.json")
    with monkeypatch.context() as m:                                  # nothing before "complete" runs again
        for name in ("daily_group", "zscore", "coerce_types"):
            m.setattr(X, name, broken)
        m.setattr("shelfline.sources.files.read_sales", broken)
        again = {r["stage"]: r for r in flows.etl_validated(spark, good, settings, AS_OF, run_id="one").collect()}
    assert _rows(spark, settings) == want
    assert {k: (r["input_rows"], r["output_rows"]) for k, r in again.items()} == {
        k: (r["input_rows"], r["output_rows"]) for k, r in whole.items()}


def test_stages_are_tried_again(spark, tmp_path):
    tries = []

    def flaky(counts):
        tries.append(1)
        counts["all"] = Observation(f"flaky_{len(tries)}")
        if len(tries) < 3:
            raise RuntimeError("lost executor")
        return spark.range(5).observe(counts["all"], F.count(F.lit(1)).alias("rows"))
    run, counts = stages.StageRun(spark, f"{tmp_path}/run", retries=2), {}
    assert run.table("a", lambda: flaky(counts), counts).count() == 5 and len(tries) == 3
    assert run.record("a")["attempts"] == 3 and run.record("a")["rows"] == {"all": 5}
    assert run.table("a", lambda: flaky(counts), counts).count() == 5 and len(tries) == 3 and run.resumed == ["a"]
    del tries[:]
    with pytest.raises(RuntimeError):
        stages.StageRun(spark, f"{tmp_path}/run", retries=1).table("b", lambda: flaky({}))
    assert len(tries) == 2

    def wrong():
        tries.append(1)
        raise ValueError("bad data")
    with pytest.raises(ValueError):
        stages.StageRun(spark, f"{tmp_path}/run", retries=5).table("c", wrong)
    assert len(tries) == 3                                            # bad data is not tried again


def test_a_publication_that_was_cut_off_is_undone(spark, tmp_path):
    path = f"{tmp_path}/data"
    spark.range(3).write.parquet(f"{tmp_path}/one")
    stages.publish(spark, path, f"{tmp_path}/one")
    os.rename(path, f"{path}.previous")                               # ended between the two renames
    stages.recover(spark, path)
    assert spark.read.parquet(path).count() == 3
    spark.range(7).write.parquet(f"{tmp_path}/two")
    stages.publish(spark, path, f"{tmp_path}/two")
    assert spark.read.parquet(path).count() == 7 and not os.path.exists(f"{path}.previous")


CSV = """date,sales,items,store_id,product_category
2024-01-01,1.5,3,A,Food
2024-13-45,1.5,3,A,Food
2024-01-02,abc,3,A,Food
2024-01-02,2.5,3,A
2024-01-02,2.5,3,A,Food,extra

2024-01-03,-4.0,3,A,Food
2024-01-04,4.0,3,,Food
"""
JSON = """{"date": "2024-01-01", "sales": 1.5, "items": 3, "store_id": "A", "product_category": "Food"}
{"date": "2024-01-01", "sales": "x", "items": 3, "store_id": "A", "product_category": "Food"}
not json at all
{"date": "2024-01-02", "sales": -1.0, "items": 3, "store_id": "A"
{"date": "2024-01-02", "sales": -1.0, "items": 3, "store_id": "A", "product_category": "Food"}
"""


@pytest.mark.parametrize("fmt, text, valid, reasons", [
    ("csv", CSV, 1, ["malformed"] * 4 + ["sales:greater_than_or_equal_to(0)", "store_id:not_null"]),
    ("json", JSON, 1, ["malformed"] * 3 + ["sales:greater_than_or_equal_to(0)"])])
def test_every_record_is_valid_or_a_reject(spark, tmp_path, fmt, text, valid, reasons):
    path = f"{tmp_path}/in.{fmt}"
    with open(path, "w") as f:
        f.write(text)
    rules = [RL.ge("sales", 0), RL.not_null("store_id")]
    good, rejects = A.split_rejects(A.read_tagged(spark, path, rules))
    found = rejects.collect()
    assert good.count() == valid and sorted(r.reasons for r in found) == sorted(reasons)
    records = [x for x in text.split("\n") if x.strip()][1 if fmt == "csv" else 0:]
    assert valid + len(found) == len(records)
    assert {r.record for r in found if r.reasons == "malformed"} < set(records)
    assert all(r.source_file.endswith(f"in.{fmt}") for r in found)
    assert good.first().date == dt.date(2024, 1, 1)
    assert all('"sales":-' in r.record for r in found if r.reasons.startswith("sales"))


def test_walking_all_pages_gives_every_row_once(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(i, t + dt.timedelta(hours=i % 5) if i % 7 else None, None if i % 11 == 3 else i % 3) for i in range(61)]
    df = spark.createDataFrame(rows, "job_id long, created_at timestamp, priority int").repartition(3)
    for order in ([("created_at", "desc"), ("job_id", "asc")], [("priority", "asc"), ("created_at", "asc"), ("job_id", "desc")]):
        by = [F.col(c).asc_nulls_first() if w == "asc" else F.col(c).desc_nulls_last() for c, w in order]
        want, got, cursor = [r.job_id for r in df.orderBy(*by).collect()], [], None
        while True:
            page = L.page_keyset(df, order, cursor, 20).collect()
            got += [r.job_id for r in page]
            assert all(r.has_more is (len(got) < 61) for r in page)
            cursor = page[-1].next_cursor
            if cursor is None:
                break
        assert got == want
    cursor = L.page_keyset(df, order, None, 5).first().next_cursor
    with pytest.raises(ValueError):
        L.page_keyset(df, [("job_id", "asc")], cursor)
    with pytest.raises(ValueError):
        L.page_keyset(df, [("job_id", "up")])
