"""Custom stateful operators on `transformWithState` (N1 in event-time order,
N2 with the last response times and their percentiles).

State lives in RocksDB (`session.STATE_STORE_CONF`).  Every state is bounded:
the last n times of an endpoint's share, or the requests of a client that the
watermark has not passed yet and at most `limit` accepted times.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from shelfline.operators.requests import (
    HEALTH_PATHS, LAST_N_TIMES, RATE_LIMIT_PER_MINUTE, RATE_WINDOW_SECONDS, endpoint_key, latest_n, limit_segment,
    response_time_stats,
)
from shelfline.streaming.state import LIMITER_OUT, set_state_store

NO_ID, NO_TIME = -(1 << 63), -(1 << 62)      # stand for null in states and batches
TIME = "us long, request_id long, processing_time double"
LATEST_OUT = ("endpoint string, share int, request_count long, error_count long, "
              "last array<struct<us:long,request_id:long,processing_time:double>>")


class LatestTimes(StatefulProcessor):
    """Request and error counts and the `n` latest response times of one share
    of an endpoint's requests; every batch that changes them is emitted."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "requests long, errors long")
        self.last = handle.getListState("last", TIME)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        requests, errors = self.counts.get() if self.counts.exists() else (0, 0)
        held = list(self.last.get())
        for pdf in rows:
            requests += len(pdf)
            errors += int((pdf["status_code"] >= 400).sum())
            spent = [None if v != v else v for v in pdf["processing_time"].tolist()]
            held += list(zip(pdf["us"].tolist(), pdf["request_id"].tolist(), spent))
            held = sorted(map(tuple, held), key=lambda x: x[:2])[-self.n:]
        self.counts.update((requests, errors))
        self.last.put(held)
        times = [{"us": t, "request_id": i, "processing_time": v} for t, i, v in held]
        yield pd.DataFrame({"endpoint": [key[0]], "share": [key[1]], "request_count": [requests],
                            "error_count": [errors], "last": [times]})

    def close(self) -> None:
        pass


def stream_latest_times(requests: DataFrame, n: int = LAST_N_TIMES, shares: int = 8) -> DataFrame:
    """N2 of the last `n` response times: per "METHOD path" and share of its
    requests, counts and the latest times, whenever they change.

    An endpoint's requests are dealt to `shares` states by their id, so a hot
    endpoint is not one task; `fold_latest_times` puts the shares together.
    "Latest" is by (time, request id), whatever the order of arrival; no row is
    late and none is dropped.  Requests without a time count, and their
    response times come before all others."""
    set_state_store(requests.sparkSession)
    us = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp_ltz")), F.lit(NO_TIME))
    r = endpoint_key(requests).select(
        "endpoint", F.pmod(F.xxhash64("request_id"), F.lit(shares)).cast("int").alias("share"),
        us.alias("us"), F.coalesce("request_id", F.lit(NO_ID)).alias("request_id"), "processing_time", "status_code")
    return r.groupBy("endpoint", "share").transformWithStateInPandas(
        statefulProcessor=LatestTimes(n), outputStructType=LATEST_OUT, outputMode="Update", timeMode="None")


def fold_latest_times(changes: DataFrame, n: int = LAST_N_TIMES) -> DataFrame:
    """From the latest row of every share (`latest_changes`), M1: counts over
    all requests and count / avg / min / max / p95 / p99 of the last `n`."""
    counts = changes.groupBy("endpoint").agg(F.sum("request_count").alias("request_count"),
                                             F.sum("error_count").alias("error_count"))
    times = changes.select("endpoint", F.inline("last"))
    last = latest_n(times, ["endpoint"], [F.desc("us"), F.desc("request_id")], n)
    return counts.join(response_time_stats(last), "endpoint", "left")


class OrderedLimiter(StatefulProcessor):
    """The sliding-window limiter of one client in event-time order: requests
    wait until the watermark has passed them, so that all earlier ones are
    there, and are then decided in (time, request id) order."""

    def __init__(self, limit: int, seconds: int, exempt: Sequence[str]):
        self.limit, self.window, self.exempt = limit, seconds * 1_000_000, set(exempt)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, request_id long, path string")
        self.accepted = handle.getListState("accepted", "us long")
        self.timer = handle.getValueState("timer", "at long")

    def _wake(self, at_ms: int | None) -> None:
        """One timer: when the watermark passes the first waiting request or,
        if there is none, when the accepted ones have left the window."""
        if self.timer.exists():
            (old,) = self.timer.get()
            if old == at_ms:
                return
            self.handle.deleteTimer(old)
            self.timer.clear()
        if at_ms is not None:
            self.handle.registerTimer(at_ms)
            self.timer.update((at_ms,))

    def _next(self, waiting: list, accepted: list[int], watermark_ms: int) -> None:
        first = min((us for us, _, _ in waiting), default=None)
        at = (accepted[-1] + self.window if accepted else None) if first is None else first
        self._wake(None if at is None else max(-(-at // 1000), watermark_ms + 1))

    def _rows(self, key, found: list, allowed) -> pd.DataFrame:
        return pd.DataFrame({
            "request_id": pd.array([None if i == NO_ID else i for _, i, _ in found], dtype="Int64"),
            "ts": pd.to_datetime(pd.Series([us for us, _, _ in found], dtype="float64").astype("Int64"), unit="us", utc=True),
            "client_id": pd.Series([key[0]] * len(found), dtype=object),
            "path": pd.Series([p for _, _, p in found], dtype=object),
            "allowed": np.asarray(allowed, dtype=bool), "late": np.zeros(len(found), dtype=bool)})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        waiting, free = [tuple(x) for x in self.waiting.get()], []
        for pdf in rows:
            for us, i, path in zip(pdf["us"].tolist(), pdf["request_id"].tolist(), pdf["path"].tolist()):
                (free if path in self.exempt else waiting).append((int(us), int(i), path))
        self.waiting.put(waiting)
        self._next(waiting, sorted(x for x, in self.accepted.get()), timerValues.getCurrentWatermarkInMs())
        if free:
            yield self._rows(key, free, np.ones(len(free)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(x) for x in self.waiting.get())
        ready = [x for x in waiting if x[0] <= passed * 1000]
        waiting = waiting[len(ready):]
        accepted = deque(sorted(x for x, in self.accepted.get()))
        allowed = limit_segment(np.array([us for us, _, _ in ready], dtype="int64"), accepted, self.limit, self.window)
        while accepted and accepted[0] + self.window < passed * 1000 and not waiting:
            accepted.popleft()
        for state, values in ((self.waiting, waiting), (self.accepted, [(us,) for us in accepted])):
            if values:
                state.put(values)
            elif state.exists():
                state.clear()                       # an idle client keeps nothing
        self._next(waiting, list(accepted), passed)
        if ready:
            yield self._rows(key, ready, allowed)

    def close(self) -> None:
        pass


def stream_ordered_limit(requests: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE,
                         seconds: int = RATE_WINDOW_SECONDS, exempt=tuple(HEALTH_PATHS),
                         watermark: str = "10 minutes") -> DataFrame:
    """N1 in event-time order: M3's decisions, whatever the order of arrival
    within the watermark.

    A request is decided once the watermark has passed it, so decisions come
    that much later (`closing_row` ends a finite log).  Exempt requests are
    decided at once.  Requests that come after the watermark are dropped and
    counted (`late_rows`); those without a time cannot be placed and are left
    out.  A client keeps the requests within the watermark's delay and at most
    `limit` accepted times, and nothing once it is idle for the window."""
    set_state_store(requests.sparkSession)
    r = (requests.select("request_id", F.col("ts").cast("timestamp_ltz").alias("ts"), "client_id", "path")
         .where(F.col("ts").isNotNull()).withWatermark("ts", watermark)
         .withColumns({"us": F.unix_micros("ts"), "request_id": F.coalesce("request_id", F.lit(NO_ID))}))
    return r.groupBy("client_id").transformWithStateInPandas(
        statefulProcessor=OrderedLimiter(limit, seconds, tuple(exempt)), outputStructType=LIMITER_OUT,
        outputMode="Append", timeMode="EventTime").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def closing_row(requests: DataFrame, delay: str) -> DataFrame:
    """A request of no client, `delay` and a second after the last one of a
    finite log: when it has arrived, the watermark passes all others.  It is
    itself never decided."""
    end = requests.agg(F.max("ts").alias("ts")).select(
        (F.col("ts") + F.expr(f"INTERVAL {delay}") + F.expr("INTERVAL 1 SECOND")).alias("ts"))
    return end.select(*(F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) if f.nullable
                        else F.lit(0).cast(f.dataType).alias(f.name) for f in requests.schema.fields))
