"""Request-log analytics (H1, M1-M4).

Hot keys are expected (one endpoint or client may carry a third of all
requests), so nothing here sorts a whole key in one task:

* H1 keeps the last N per key by a two-level tree merge of per-task top-N
  lists (salt = input partition id), with Catalyst's window-group limit
  pruning every task before each shuffle.
* M2 counts a client's trailing 60 s per request inside time buckets; the
  last 60 s of each bucket are copied into the next as context rows, so a
  window partition is one client-bucket, not one client.
* M3 is recursive in its own output (only accepted requests count).  What
  must be seen in order are a client's request times, condensed to packed
  cells; `mapInPandas` walks them with bounded state (at most `limit`
  accepted timestamps), and the requests are joined with the accepted times
  by (client, time).
"""

from __future__ import annotations

import math
from collections import deque
from typing import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.columns import epoch_micros

# Fixed values of the reference's request middleware.
HEALTH_PATHS = ["/health", "/health/liveness", "/health/readiness"]
RATE_LIMIT_PER_MINUTE = 60
RATE_WINDOW_SECONDS = 60
LAST_N_TIMES = 1000


def endpoint_key(df: DataFrame) -> DataFrame:
    return df.withColumn("endpoint", F.concat_ws(" ", F.col("method"), F.col("path")))


# ---------------------------------------------------------------- H1
def latest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = LAST_N_TIMES,
             salts: int | None = None, salt_col: str | None = None) -> DataFrame:
    """H1: the first n rows per key under `order` (a unique order: add a
    tie-break), as a two-level tree merge of per-task top-n lists.

    Catalyst's window-group limit keeps at most n rows per window group in
    every map task before each shuffle, for n up to the session's
    spark.sql.optimizer.windowGroupLimitThreshold (1,000 unless set; the
    session is not changed here).  Beyond it the salted groups are ranked
    whole, with equal results.  Level 1 groups by
    (keys, salt) with salt = input partition id mod `salts` (by default the
    root of the number of shuffle partitions), so one level-1 task merges
    the top-n lists of about (map tasks / salts) tasks; level 2 merges at
    most salts x n rows per key.  A hot key therefore never funnels n x (all
    map tasks) rows into one task.  `salt_col` salts by a column hash
    instead."""
    keys = list(keys)
    spark = df.sparkSession
    salts = salts or max(4, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    salt = (F.abs(F.xxhash64(F.col(salt_col))) % salts) if salt_col else (F.spark_partition_id() % salts)
    level1 = (df.withColumn("_salt", salt)
                .withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
                .filter(F.col("_rn") <= n).drop("_rn", "_salt"))
    return (level1.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
                  .filter(F.col("_rn") <= n).drop("_rn"))


def latest_response_times(requests: DataFrame, n: int = LAST_N_TIMES) -> DataFrame:
    r = endpoint_key(requests)
    return latest_n(r, ["endpoint"], [F.desc("ts"), F.desc("request_id")], n)


# ---------------------------------------------------------------- M1
def endpoint_metrics(requests: DataFrame, last_n: int = LAST_N_TIMES) -> DataFrame:
    """M1: per "METHOD path": request and error counts over all requests,
    and count / avg / min / max / p95 / p99 over the last `last_n` response
    times, percentiles by index sorted[int(n * p)] (not interpolated).

    The per-endpoint list is bounded by `last_n` (after H1)."""
    r = endpoint_key(requests)
    counts = r.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)).cast("bigint").alias("error_count"))
    last = latest_n(r, ["endpoint"], [F.desc("ts"), F.desc("request_id")], last_n)
    return counts.join(response_time_stats(last), "endpoint", "left")


def response_time_stats(last: DataFrame) -> DataFrame:
    """Count, mean, extremes and percentiles by index of each endpoint's rows,
    whose number the caller has bounded."""
    stats = last.groupBy("endpoint").agg(
        F.count("processing_time").alias("count"), F.avg("processing_time").alias("avg"),
        F.min("processing_time").alias("min"), F.max("processing_time").alias("max"),
        F.sort_array(F.collect_list("processing_time")).alias("_v"))
    nv = F.size("_v")
    pick = lambda p: F.element_at("_v", (F.floor(nv * F.lit(p)) + 1).cast("int"))
    stats = stats.select("endpoint", "count", "avg", "min", "max",
                         pick(0.95).alias("p95"), pick(0.99).alias("p99"))
    return stats


# ---------------------------------------------------------------- M2
def client_rate(requests: DataFrame, seconds: int = RATE_WINDOW_SECONDS, bucket_seconds: int = 600,
                client: str = "client_id") -> DataFrame:
    """M2: per request, the client's requests in the trailing `seconds`
    (inclusive lower edge, the request itself included).

    Exact for bucket_seconds >= seconds: a row whose trailing window crosses
    its bucket start finds the earlier rows among the context copies."""
    if bucket_seconds < seconds:
        raise ValueError("bucket_seconds must be >= seconds")
    us = epoch_micros(requests, "ts")
    b_us = bucket_seconds * 1_000_000
    base = requests.withColumns({"_us": us, "_bucket": F.floor(us / F.lit(b_us)), "_ctx": F.lit(False)})
    ctx = (base.filter(F.col("_us") - F.col("_bucket") * b_us >= b_us - seconds * 1_000_000)
               .withColumns({"_bucket": F.col("_bucket") + 1, "_ctx": F.lit(True)}))
    w = (Window.partitionBy(client, "_bucket").orderBy("_us")
               .rangeBetween(-seconds * 1_000_000, 0))
    out = base.unionByName(ctx).withColumn("requests_in_window", F.count(F.lit(1)).over(w))
    return out.filter(~F.col("_ctx")).drop("_us", "_bucket", "_ctx")


# ---------------------------------------------------------------- M3
def limit_segment(ts, accepted: deque, limit: int, window_us: int):
    """Limiter decisions for one client's non-exempt requests `ts` (int64
    microseconds, sorted), given the accepted timestamps still in `accepted`
    (updated in place).  Returns a boolean numpy array.

    Only accepted requests change the state, so when the state is full every
    request up to the expiry of the oldest accepted one is rejected at once
    (one `searchsorted`); Python steps run per accepted request and per
    rejected run, so a hot client costs O(accepted) steps, and accepted
    requests are bounded by limit x time span / window, not by volume."""
    import numpy as np
    n = len(ts)
    allowed = np.zeros(n, dtype=bool)
    i = 0
    while i < n:
        t = int(ts[i])
        while accepted and accepted[0] < t - window_us:     # evict strictly older
            accepted.popleft()
        if len(accepted) < limit:
            accepted.append(t)
            allowed[i] = True
            i += 1
        else:
            # rejected until a request later than accepted[0] + window
            i = max(i + 1, int(np.searchsorted(ts, accepted[0] + window_us, side="right")))
    return allowed


def limit_condensed(times, counts, accepted: deque, limit: int, window_us: int):
    """`limit_segment` for a client's distinct request times (sorted) and how
    many requests came at each: the number allowed at each time."""
    import numpy as np
    n = len(times)
    allowed = np.zeros(n, dtype=np.int64)
    i = 0
    while i < n:
        t = int(times[i])
        while accepted and accepted[0] < t - window_us:
            accepted.popleft()
        free = min(int(counts[i]), limit - len(accepted))
        if free > 0:
            accepted.extend([t] * free)
            allowed[i] = free
            i += 1
        else:
            i = max(i + 1, int(np.searchsorted(times, accepted[0] + window_us, side="right"))) if accepted else n
    return allowed


CELLS_PER_WINDOW = 64


def _decide_cells(limit: int, window_us: int):
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = None, deque()
        for pdf in batches:
            client, times, allowed = [], [], []
            # cells arrive sorted by (client, run, cell)
            for c, z, r, us, n in zip(pdf["_c"], pdf["_z"], pdf["_run"], pdf["times"], pdf["counts"]):
                if (c, z, r) != current:
                    current, accepted = (c, z, r), deque()
                us = np.asarray(us, dtype="int64")
                k = limit_condensed(us, np.asarray(n, dtype="int64"), accepted, limit, window_us)
                on = np.flatnonzero(k)
                client += [(c, z)] * len(on)
                times.append(us[on])
                allowed.append(k[on])
            yield pd.DataFrame({"_c": pd.Series([c for c, _ in client], dtype=object),
                                "_z": np.array([z for _, z in client], dtype=bool),
                                "_us": np.concatenate([np.zeros(0, "int64"), *times]),
                                "_free": np.concatenate([np.zeros(0, "int64"), *allowed])})
    return run


def rate_limit_decisions(requests: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE,
                         seconds: int = RATE_WINDOW_SECONDS,
                         exempt: Sequence[str] = tuple(HEALTH_PATHS)) -> DataFrame:
    """M3: sliding-window limiter decision per request, processed per client
    in (ts, request_id) order; only accepted requests are remembered; health
    paths are exempt and not remembered.

    What the limiter must see of a client in order are the times of its
    requests and how many came at each.  These are condensed, by a partial
    aggregate, to one row per client and cell (a 64th of the window) with the
    packed times, and decided cell after cell; at most `limit` times a window
    come out as accepted.  The requests themselves are joined with the accepted
    times by (client, time), so a client with all requests is spread like any
    other, and of those at one time the first by id are allowed.

    A quiet spell longer than the window empties a client's state, so the runs
    between such spells (`quiet_runs`) are decided independently.

    A request without a time lies in no window: it is allowed and not
    remembered.  Requests without a client are those of one client."""
    window_us = seconds * 1_000_000
    cols = ["request_id", "ts", "client_id", "path"]
    is_exempt = F.coalesce(F.col("path").isin(list(exempt)), F.lit(False))
    r = requests.select(*cols).withColumns({
        "_us": epoch_micros(requests, "ts"), "_c": F.coalesce(F.col("client_id").cast("string"), F.lit("")),
        "_z": F.col("client_id").isNull()})
    unlimited = is_exempt | F.col("ts").isNull()
    limited = r.where(~unlimited)
    cell = max(1, window_us // CELLS_PER_WINDOW)
    times = limited.groupBy("_c", "_z", "_us").agg(F.count(F.lit(1)).alias("n"))
    cells = times.groupBy("_c", "_z", F.floor(F.col("_us") / F.lit(cell)).alias("_cell")).agg(
        F.sort_array(F.collect_list(F.struct("_us", "n"))).alias("_t"))
    cells = quiet_runs(cells.withColumn("_us", F.col("_t")[0]["_us"]), window_us).select(
        "_c", "_z", "_run", "_cell", F.col("_t._us").alias("times"), F.col("_t.n").alias("counts"))
    ordered = cells.repartition("_c", "_z", "_run").sortWithinPartitions("_c", "_z", "_run", "_cell")
    accepted = ordered.mapInPandas(_decide_cells(limit, window_us), "_c string, _z boolean, _us long, _free long")
    # One shuffle of the requests, by (client, time): join and rank share it.
    key = ["_c", "_z", "_us"]
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("request_id"))
    decided = limited.join(accepted.hint("merge"), key, "left").withColumn(
        "allowed", F.coalesce(rank <= F.col("_free"), F.lit(False)))
    return decided.select(*cols, "allowed").unionByName(
        r.where(unlimited).select(*cols, F.lit(True).alias("allowed")))


def quiet_runs(cells: DataFrame, window_us: int) -> DataFrame:
    """Add `_run`, the start of the client's run of active time slots that a
    cell lies in.  Slots are one window long, so between two slots with an
    empty slot in between lies more than a window.  Only the distinct (client,
    slot) pairs, at most one per window of time, are ordered."""
    slotted = cells.withColumn("_slot", F.floor(F.col("_us") / F.lit(window_us)))
    by_time = Window.partitionBy("_c", "_z").orderBy("_slot")
    gap = F.col("_slot") - F.lag("_slot").over(by_time) > 1
    first = F.last(F.when(F.coalesce(gap, F.lit(True)), F.col("_slot")), ignorenulls=True).over(
        by_time.rowsBetween(Window.unboundedPreceding, 0))
    runs = slotted.select("_c", "_z", "_slot").distinct().withColumn("_run", first)
    return slotted.join(runs, ["_c", "_z", "_slot"]).drop("_slot")


# ---------------------------------------------------------------- M4
def client_identity(df: DataFrame, forwarded_for: str = "x_forwarded_for", real_ip: str = "x_real_ip",
                    peer: str = "peer_host") -> DataFrame:
    """M4: first X-Forwarded-For entry, else X-Real-IP, else the peer
    address, else "unknown" (an empty header counts as absent)."""
    xff, rip, p = F.col(forwarded_for), F.col(real_ip), F.col(peer)
    ident = (F.when(xff.isNotNull() & (xff != ""), F.trim(F.split(xff, ",").getItem(0)))
              .when(rip.isNotNull() & (rip != ""), rip)
              .when(p.isNotNull(), p)
              .otherwise(F.lit("unknown")))
    return df.withColumn("client_ip", ident)
