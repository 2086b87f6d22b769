"""Duplicates by fingerprint, mergeable quality state, the condensed limiter."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from shelfline.operators import quality as Q
from shelfline.operators import requests as M
from shelfline.session import scratch_dir
from shelfline.streaming import ingest as S

from .test_requests import SCHEMA, T0, _brute_limiter

WIDE = "date date, sales double, items bigint, store_id string, product_category string"


def _rows(seed, n=300):
    rnd = random.Random(seed)
    return [(rnd.choice([None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)]), rnd.choice([None, 0.0, -0.0, 1.5, -2.0, 2e5]),
             rnd.choice([None, 0, 5, -1, 5000]), rnd.choice([None, "A", "B", ""]), rnd.choice([None, "A", "Food"]))
            for _ in range(n)]


def _metrics(df, **args):
    return {r["metric"]: r["value"] for r in Q.quality_metrics(df, **args).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_fingerprints_count_as_whole_rows_do(spark, seed):
    rows = _rows(seed)
    df = spark.createDataFrame(rows, WIDE).repartition(4)
    found = _metrics(df)
    assert found == _metrics(df, compare_rows=True)
    assert found["duplicate_rows"] == len(rows) - len(set(rows))         # 0.0 == -0.0
    assert found["date_null_count"] == sum(r[0] is None for r in rows)
    assert found["extreme_items_count"] == sum((r[2] or 0) > 1000 for r in rows)
    got = Q.duplicate_metrics(df, compare_rows=True).first()
    assert got.duplicate_rows == len(rows) - len(set(rows)) == Q.duplicate_metrics(df).first().duplicate_rows


def test_rows_are_compared_where_fingerprints_collide(spark, monkeypatch):
    df = spark.createDataFrame(_rows(7, 40), WIDE)
    monkeypatch.setattr(Q, "row_fingerprint", lambda d: (F.lit(1).cast("long"), F.lit(2).cast("long")))
    distinct = df.distinct().count()
    assert _metrics(df)["duplicate_rows"] == 39
    assert _metrics(df, compare_rows=True)["duplicate_rows"] == 40 - distinct
    assert Q.duplicate_metrics(df, compare_rows=True).first().duplicate_rows == 40 - distinct


def test_many_columns_take_several_flag_words(spark):
    row = tuple(None if i % 7 == 0 else i for i in range(150))
    df = spark.createDataFrame([row, row, tuple(range(150))], ", ".join(f"c{i} int" for i in range(150)))
    found = _metrics(df)
    assert all(found[f"c{i}_null_count"] == (2 if i % 7 == 0 else 0) for i in range(150))
    assert found["duplicate_rows"] == 1
    assert len(Q.fingerprint_counts(df).columns) == 3 + 3


def test_stream_state_folds_to_the_whole_table(spark):
    rows = [(dt.date(2024, 1, 1 + i % 5), float(i % 11) * 1e6 + 0.1, 5, f"S{i % 2}", "Food") for i in range(200)]
    rows += [(None, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, WIDE)
    in_dir, out = scratch_dir(spark, "t_parts"), scratch_dir(spark, "t_state")
    for i in range(4):                                           # equal rows arrive in different batches
        spark.createDataFrame(rows[i::4], WIDE).coalesce(1).write.mode("append").option("header", True).csv(in_dir)
    S.stream_quality_state(spark, in_dir, out, scratch_dir(spark, "t_ck"), max_files_per_trigger=1).awaitTermination()
    assert spark.read.parquet(f"{out}/rows").select("batch_id").distinct().count() == 4
    got = {r.metric: r.value for r in S.fold_quality(spark, out).collect()}
    want = _metrics(df)
    assert {k: got[k] for k in want} == want and want["duplicate_rows"] == len(rows) - len(set(rows)) > 20
    sales = [r[1] for r in rows if r[1] is not None]
    assert got["sales_mean"] == pytest.approx(statistics.mean(sales), rel=1e-12)
    assert got["sales_stdev"] == pytest.approx(statistics.stdev(sales), rel=1e-12)
    into = scratch_dir(spark, "t_compact")
    S.compact_quality(spark, out, into)
    again = {r.metric: r.value for r in S.fold_quality(spark, into).collect()}
    assert again.keys() == got.keys() and all(again[k] == pytest.approx(got[k], rel=1e-12) for k in got)


def test_one_client_that_never_rests_is_spread(spark):
    rnd = random.Random(23)
    t, rows = T0, []
    for i in range(6000):                          # many requests at one time, no quiet spell
        t = t + dt.timedelta(milliseconds=rnd.choice([0, 0, 0, 1, 20, 300]))
        rows.append((rnd.randrange(10 ** 9) * 10_000 + i, t, "hot", "GET", "/a", 1.0, 200))
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    out = M.rate_limit_decisions(df, limit=7, seconds=2)
    assert {r.request_id: r.allowed for r in out.collect()} == _brute_limiter(rows, 7, 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        shares = [r["count"] for r in M.rate_limit_decisions(df, limit=7, seconds=2).groupBy(
            F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(shares) == 6000 and max(shares) < 6000 / 4
