"""Custom stateful operators: late and shuffled arrival, untimed rows, hot
keys, idle clients."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfline.operators import requests as M
from shelfline.plans.catalog_stream import stage_in_order
from shelfline.session import scratch_dir
from shelfline.streaming import processors as P
from shelfline.streaming import state as N

from .test_requests import SCHEMA, T0, _brute_limiter, _requests


def _arrive(spark, df, batches, name):
    """One file per batch, in this order."""
    in_dir = scratch_dir(spark, name)
    for part in batches:
        part.coalesce(1).write.mode("append").parquet(in_dir)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(in_dir)


def _run(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_ordered_limit_of_shuffled_arrival(spark):
    df, rows = _requests(spark, n=500, seed=11)
    rnd = random.Random(2)
    arrival = sorted(rows, key=lambda r: (r[1] + dt.timedelta(seconds=rnd.uniform(0, 290)), r[0]))
    batches = [spark.createDataFrame(arrival[i:i + 60], SCHEMA) for i in range(0, len(rows), 60)]
    assert any(a[1] > b[1] for a, b in zip(arrival, arrival[1:]))
    src = _arrive(spark, df, [*batches, P.closing_row(df, "5 minutes")], "t_shuffled")
    out = scratch_dir(spark, "t_ordered")
    _run(N.write_append(P.stream_ordered_limit(src, 3, 60, watermark="5 minutes"), out, scratch_dir(spark, "t_ck")))
    got = spark.read.parquet(out).collect()
    assert len(got) == len(rows) and {r.request_id: r.allowed for r in got} == _brute_limiter(rows, 3, 60)
    assert {(r.request_id, r.ts, r.client_id, r.path) for r in got} == {
        (r[0], r[1], r[2], r[4]) for r in rows}


def test_ordered_limit_counts_what_comes_after_the_watermark(spark):
    rows = [(i, T0 + dt.timedelta(seconds=20 * i), "c", "GET", "/a", 1.0, 200) for i in range(30)]
    df = spark.createDataFrame(rows, SCHEMA)
    late = spark.createDataFrame([(99, T0, "c", "GET", "/a", 1.0, 200)], SCHEMA)
    src = _arrive(spark, df, [df.where("request_id < 20"), df.where("request_id >= 20"), late,
                              P.closing_row(df, "1 minute")], "t_late")
    out = scratch_dir(spark, "t_late_out")
    q = _run(N.write_append(P.stream_ordered_limit(src, 2, 60, watermark="1 minute"), out, scratch_dir(spark, "t_ck")))
    got = {r.request_id: r.allowed for r in spark.read.parquet(out).collect()}
    assert got == _brute_limiter(rows, 2, 60)
    assert N.late_rows(q) >= 1


def test_latest_times_equal_the_batch(spark):
    df, rows = _requests(spark, n=600, seed=4)
    rnd = random.Random(3)
    shuffled = rnd.sample(rows, len(rows))                        # any order of arrival
    shuffled[5] = (*shuffled[5][:1], None, *shuffled[5][2:])      # without a time
    shuffled[9] = (*shuffled[9][:5], None, shuffled[9][6])        # without a response time
    df = spark.createDataFrame(shuffled, SCHEMA)
    src = _arrive(spark, df, [spark.createDataFrame(shuffled[i:i + 150], SCHEMA) for i in range(0, 600, 150)], "t_times")
    out = scratch_dir(spark, "t_latest")
    _run(N.write_batches(P.stream_latest_times(src, n=25, shares=3), out, scratch_dir(spark, "t_ck")))
    changes = N.latest_changes(spark, out, ["endpoint", "share"])
    assert changes.agg(F.max(F.size("last"))).first()[0] <= 25 and changes.count() == 9
    got = sorted(map(tuple, P.fold_latest_times(changes, 25).collect()))
    want = sorted(map(tuple, M.endpoint_metrics(df, last_n=25).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want]) and [g[4:] for g in got] == [w[4:] for w in want]


def test_untimed_requests_are_allowed(spark):
    rows = [(1, T0, "c", "GET", "/a", 1.0, 200), (2, None, "c", "GET", "/a", 1.0, 200),
            (3, T0 + dt.timedelta(seconds=1), "c", "GET", "/a", 1.0, 200), (4, None, None, "GET", None, 1.0, 200),
            (5, T0, None, "GET", None, 1.0, 200), (6, T0, None, "GET", None, 1.0, 200)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
    assert {r.request_id: r.allowed for r in M.rate_limit_decisions(df, limit=1, seconds=60).collect()} == want
    in_dir = scratch_dir(spark, "t_untimed")
    stage_in_order(df, "ts", in_dir, chunks=2, files_per_chunk=1)
    src = spark.readStream.schema(df.schema).parquet(in_dir)
    out = scratch_dir(spark, "t_untimed_out")
    _run(N.write_append(N.stream_rate_limit(src, limit=1, seconds=60), out, scratch_dir(spark, "t_ck")))
    assert {r.request_id: r.allowed for r in spark.read.parquet(out).collect()} == want


@pytest.mark.parametrize("watermark", [None, "1 day"])
def test_updates_that_come_late(spark, watermark):
    schema = "job_id bigint, status string, updated_at timestamp"
    early = [(1, "running", T0 + dt.timedelta(days=1)), (2, "done", T0 + dt.timedelta(days=9))]
    late = [(1, "failed", T0 + dt.timedelta(days=2)), (3, "queued", T0 + dt.timedelta(days=9, hours=1))]
    df = spark.createDataFrame(early, schema)
    src = _arrive(spark, df, [df, df.where("job_id = 2"), spark.createDataFrame(late, schema)],
                  "t_updates")             # a watermark holds from the batch after the next
    out = scratch_dir(spark, "t_jobs")
    q = _run(N.write_batches(N.stream_job_state(src, watermark=watermark), out, scratch_dir(spark, "t_ck")))
    changes = spark.read.parquet(out)
    last = {r.job_id: r.s.status for r in changes.groupBy("job_id").agg(
        F.max_by(F.struct("status"), F.struct("updated_at")).alias("s")).collect()}
    assert last == {1: "failed" if watermark is None else "running", 2: "done", 3: "queued"}
    assert N.late_rows(q) == (0 if watermark is None else 1)
