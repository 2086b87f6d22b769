"""Sources and sinks: suffix rule, CSV semantics, partitioned layout, stats, report."""

import datetime as dt
import os

import pytest

from shelfline.schemas import DAILY_SALES
from shelfline.session import scratch_dir
from shelfline.sources import files as A
from shelfline.sources import sinks as B


def _sales(spark):
    rows = [(dt.date(2024, 1, 31), 10.0, 1, "S1", "Food"), (dt.date(2024, 2, 1), None, 2, "", "Home"),
            (dt.date(2024, 2, 2), 5.5, None, "S2", "Food")]
    return spark.createDataFrame(rows, "date date, sales double, items bigint, store_id string, product_category string")


def test_format_by_suffix():
    assert A.format_of("a/b.CSV") == "csv" and A.format_of("x.parquet") == "parquet"
    with pytest.raises(ValueError):
        A.format_of("data.xlsx")


def test_csv_round_trip_empty_is_missing(spark):
    path = os.path.join(scratch_dir(spark, "t_csv"), "s.csv")
    B.write_as(_sales(spark), path, fmt="csv", compression="none")
    back = {r["date"]: r for r in A.read_sales(spark, path, schema=DAILY_SALES).collect()}
    assert back[dt.date(2024, 2, 1)]["store_id"] is None and back[dt.date(2024, 2, 1)]["sales"] is None
    assert back[dt.date(2024, 2, 2)]["items"] is None


def test_partitioned_layout_and_stats(spark):
    from shelfline.operators.transform import calendar_features
    path = scratch_dir(spark, "t_part")
    B.write_partitioned(calendar_features(_sales(spark)), path, by=("year", "month"))
    assert sorted(os.listdir(os.path.join(path, "year=2024"))) == ["month=1", "month=2"]
    stats = B.save_with_stats(spark, _sales(spark), scratch_dir(spark, "t_saved")).first()
    assert stats["rows_saved"] == 3 and stats["columns_saved"] == 5 and stats["file_size"] > 0


def test_report_round_trip(spark):
    path = scratch_dir(spark, "t_rep")
    res = spark.createDataFrame([("schema", "not_null", "date", 1.0, False)],
                                "section string, name string, `column` string, observed double, success boolean")
    B.write_report(res, path, "daily", dt.datetime(2026, 1, 2, 3, 4, 5))
    back = B.read_report(spark, path, "section string, name string, `column` string, observed double, "
                                      "success boolean, report_time timestamp_ntz").first()
    assert back["dataset"] == "daily" and back["report_time"] == dt.datetime(2026, 1, 2, 3, 4, 5)


def test_listing_reads_no_content(spark):
    out = A.list_source_files(spark, "/root/testdata/sf0.001/*.parquet", limit=3).collect()
    assert len(out) == 3 and all(r["length"] > 0 for r in out)
