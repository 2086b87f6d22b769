"""Stateful streaming operators.

* N1: the sliding-window limiter per client with `applyInPandasWithState`;
  state = the accepted timestamps of the last window (at most `limit`
  values), with a watermark a timeout drops idle clients.  A client's rows of
  one micro-batch form one group, so group size is bounded by the trigger
  size, not by the client's history.
* N2: endpoint counts / errors / avg / min / max per event-time window with
  a watermark (update mode: every change of a window is emitted, also of
  those still open when the input ends; closed ones drop their state).
* N4: current job state per job id and day as a streaming max_by aggregation
  in update mode.
"""

from __future__ import annotations

import os
from collections import deque
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfline.operators.requests import (
    HEALTH_PATHS, RATE_LIMIT_PER_MINUTE, RATE_WINDOW_SECONDS, limit_segment,
)
from shelfline.session import STATE_STORE_CONF

LIMITER_OUT = T.StructType([
    T.StructField("request_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("client_id", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("allowed", T.BooleanType()), T.StructField("late", T.BooleanType())])
LIMITER_STATE = T.StructType([T.StructField("accepted_us", T.ArrayType(T.LongType()))])


def set_state_store(spark) -> None:
    """Keep keyed state in RocksDB with changelog checkpoints, whichever
    session the caller made."""
    for name, value in STATE_STORE_CONF.items():
        spark.conf.set(name, value)


def _limiter_state_fn(limit: int, seconds: int, exempt: frozenset, expires: bool):
    window_us = seconds * 1_000_000

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        accepted = deque(state.get[0]) if state.exists else deque()
        pdf = pd.concat(list(pdfs), ignore_index=True)
        untimed = pdf[pdf["ts"].isna()]
        if len(untimed):               # in no window: allowed and not remembered, as in M3
            yield untimed[["request_id", "ts", "client_id", "path"]].assign(allowed=True, late=False)
            pdf = pdf[pdf["ts"].notna()]
            if not len(pdf):
                return
        us = pdf["ts"].astype("datetime64[us]").astype("int64")
        pdf = pdf.assign(_us=us).sort_values(["_us", "request_id"], kind="stable")
        times = pdf["_us"].to_numpy(dtype="int64")
        allowed = np.ones(len(pdf), dtype=bool)               # exempt paths are allowed
        limited = ~pdf["path"].isin(list(exempt)).to_numpy()
        # A request from before the newest accepted one came out of order: it
        # is decided against the window as it stands now and not remembered.
        late = limited & (times < accepted[-1]) if accepted else np.zeros(len(pdf), dtype=bool)
        for i in np.flatnonzero(late):
            held = sum(times[i] - window_us <= t <= times[i] for t in accepted)
            allowed[i] = held < limit
        idx = np.flatnonzero(limited & ~late)
        allowed[idx] = limit_segment(times[idx], accepted, limit, window_us)
        state.update((list(accepted),))
        if expires:       # idle clients go once event time passes their last request + window
            state.setTimeoutTimestamp(max(int(times.max()) // 1000 + seconds * 1000 + 1,
                                          state.getCurrentWatermarkMs() + 1))
        out = pdf[["request_id", "ts", "client_id", "path"]].copy()
        out["allowed"], out["late"] = allowed, late
        yield out
    return fn


def stream_rate_limit(requests: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE,
                      seconds: int = RATE_WINDOW_SECONDS, exempt=tuple(HEALTH_PATHS),
                      watermark: str | None = None) -> DataFrame:
    """M3 on a stream.  Rows that arrive in event-time order per client
    are decided as M3 does; a row that comes after a newer accepted one gets
    a decision too and is marked `late`.

    Without `watermark` no row is dropped, and every client keeps its state
    (at most `limit` timestamps).  With it the state of idle clients expires,
    and Spark drops rows that are older than the watermark; the query's
    progress counts them (numRowsDroppedByWatermark).  A client's rows of one
    micro-batch are one group, so bound the trigger (maxFilesPerTrigger or
    its like) at the source: a backlog then arrives in pieces."""
    if requests.isStreaming:
        set_state_store(requests.sparkSession)
    r = requests.select("request_id", F.col("ts").cast("timestamp_ltz").alias("ts"), "client_id", "path")
    if watermark is not None:
        r = r.withWatermark("ts", watermark)
    return r.groupBy("client_id").applyInPandasWithState(
        _limiter_state_fn(limit, seconds, frozenset(exempt), watermark is not None), LIMITER_OUT, LIMITER_STATE,
        "append", GroupStateTimeout.NoTimeout if watermark is None else GroupStateTimeout.EventTimeTimeout
    ).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def stream_endpoint_metrics(requests: DataFrame, window: str = "1 hour",
                            watermark: str = "1 hour") -> DataFrame:
    """Per event-time window and "METHOD path".  Requests later than the
    watermark are dropped and counted (`late_rows`); those without a time lie
    in no window."""
    if requests.isStreaming:
        set_state_store(requests.sparkSession)
    r = (requests.withColumn("ts", F.col("ts").cast("timestamp"))
                 .withColumn("endpoint", F.concat_ws(" ", "method", "path"))
                 .withWatermark("ts", watermark))
    return r.groupBy(F.window("ts", window).alias("w"), "endpoint").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)).cast("bigint").alias("error_count"),
        F.avg("processing_time").alias("avg"), F.min("processing_time").alias("min"),
        F.max("processing_time").alias("max"))


def stream_job_state(updates: DataFrame, key: str = "job_id", ts: str = "updated_at",
                     sequence: str = "update_seq", watermark: str | None = "1 day") -> DataFrame:
    """L3 on a stream: latest update per job and day of the update
    (update mode).  The day is a window under the watermark, so state of
    days that can get no more updates is dropped; readers fold the days of a
    job with L3.  An update whose day has closed is dropped, and the query's
    progress counts it (`late_rows`), as is one without a time.  With
    `watermark` None none is dropped, and every job keeps its state."""
    if updates.isStreaming:
        set_state_store(updates.sparkSession)
    cols = [c for c in updates.columns if c != key]
    ties = [sequence] if sequence in updates.columns else []
    order = F.struct(ts, *ties, *[c for c in cols if c not in (ts, *ties)])
    if watermark is None:
        agg = updates.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s"))
    else:
        timed = updates.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", watermark)
        agg = timed.groupBy(key, F.window("_at", "1 day")).agg(F.max_by(F.struct(*cols), order).alias("s"))
    return agg.select(key, *[F.col(f"s.{c}").alias(c) for c in cols])


def late_rows(query: StreamingQuery) -> int:
    """Rows that the watermark of a query dropped, over the batches that its
    progress still holds (spark.sql.streaming.numRecentProgressUpdates)."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress
               for op in p["stateOperators"])


def write_batches(df: DataFrame, out_dir: str, checkpoint: str, mode: str = "update") -> StreamingQuery:
    """Sink for update-mode results: every micro-batch of changed rows goes
    to its own batch_id=<n> directory (overwrite, so replays are
    idempotent); readers fold the changes by their key."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))
    return (df.writeStream.outputMode(mode).foreachBatch(run)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_changes(spark, out_dir: str, keys: list[str]) -> DataFrame:
    """Fold what `write_batches` wrote: of each key the row of its last batch."""
    changes = spark.read.parquet(out_dir)
    cols = [c for c in changes.columns if c not in (*keys, "batch_id")]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("s"))
    return last.select(*keys, *[F.col(f"s.{c}").alias(c) for c in cols])


def write_append(df: DataFrame, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Append-mode file sink (exactly-once through the sink's own log)."""
    return (df.writeStream.outputMode("append").format("parquet").option("path", out_dir)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
