"""Job-log analytics, paging and top-k."""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.functions.columns import ntz_literal

MAX_PAGE_SIZE = 100
DEEPEST_OFFSET = 100_000


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


# ---------------------------------------------------------------- L1 / H4
def recent_top_k(df: DataFrame, order: Sequence[str | Column], k: int = 50,
                 where: Column | None = None) -> DataFrame:
    """H4: filter, newest first, first k (planned as TakeOrderedAndProject:
    a per-task top-k, then a merge of at most k rows per task)."""
    if where is not None:
        df = df.filter(where)
    return df.orderBy(*_order(order)).limit(k)


def jobs_list(df: DataFrame, user_id: str | None = None, status: str | None = None,
              job_type: str | None = None, limit: int = 50) -> DataFrame:
    """L1: AND filter on user, status and type, newest first, limited;
    has_more = (returned == limit).  Filters are applied before the limit."""
    cond = F.lit(True)
    for c, v in (("user_id", user_id), ("status", status), ("job_type", job_type)):
        if v is not None:
            cond = cond & (F.col(c) == F.lit(v))
    top = recent_top_k(df, [F.desc("created_at"), F.desc("job_id")], limit, cond)
    # the window runs over at most `limit` rows (after the limit)
    return top.withColumn("has_more", F.count(F.lit(1)).over(Window.partitionBy()) == F.lit(limit))


# ---------------------------------------------------------------- L2
def job_metrics(df: DataFrame) -> DataFrame:
    """L2: per job status, retries, priority and, for completed jobs, the
    execution time in seconds (updated - created, fractions included); the
    progress too where the log has it."""
    secs = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("updated_at")) / F.lit(1e6)
    progress = ["progress"] if "progress" in df.columns else []
    return df.select("job_id", "job_type", "status", "created_at", "updated_at", "retry_count", "priority", *progress,
                     F.when(F.col("status") == "completed", secs).alias("execution_time_seconds"))


# ---------------------------------------------------------------- L3
def job_state_fold(updates: DataFrame, key: str = "job_id", ts: str = "updated_at",
                   sequence: str | None = "update_seq") -> DataFrame:
    """L3: current state per job = the latest update; of updates at the same
    instant the one with the highest `sequence` (when the log has that
    column), then the greatest row, so the result never depends on input
    order.  max_by is a partial aggregate: a job with very many updates is
    folded map-side."""
    cols = [c for c in updates.columns if c != key]
    ties = [sequence] if sequence in updates.columns else []
    order = F.struct(ts, *ties, *[c for c in cols if c not in (ts, *ties)])
    latest = updates.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("s"))
    return latest.select(key, *[F.col(f"s.{c}").alias(c) for c in cols if c not in ties])


def status_updates(jobs: DataFrame) -> DataFrame:
    """Updates implied by a job table: a 'queued' event at creation and the
    current status at the last update."""
    base = ["job_id", "user_id", "job_type", "priority", "retry_count", "max_retries", "created_at"]
    created = jobs.select(*base, F.lit("queued").alias("status"), F.col("created_at").alias("updated_at"),
                          F.lit(0).alias("update_seq"))
    current = jobs.select(*base, "status", "updated_at", F.lit(1).alias("update_seq"))
    return created.unionByName(current)


# ---------------------------------------------------------------- L4
def retryable_jobs(df: DataFrame) -> DataFrame:
    """L4: failed jobs under their retry limit, as they look after the retry
    is scheduled: queued, retry_count + 1, no error, progress 0."""
    r = df.filter((F.col("status") == "failed") & (F.col("retry_count") < F.col("max_retries")))
    return r.withColumns({"status": F.lit("queued"), "retry_count": F.col("retry_count") + 1,
                          "error_message": F.lit(None).cast("string"), "progress": F.lit(0.0)})


# ---------------------------------------------------------------- L5
def queue_statistics(df: DataFrame) -> DataFrame:
    """Waiting (queued), in flight (running) and delayed (failed jobs
    awaiting a retry) counts in one aggregate."""
    s = F.col("status")
    cnt = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return df.agg(
        cnt(s == "queued").alias("approximate_number_of_messages"),
        cnt(s == "running").alias("approximate_number_of_messages_not_visible"),
        cnt((s == "failed") & (F.col("retry_count") < F.col("max_retries")))
        .alias("approximate_number_of_messages_delayed"),
        F.count(F.lit(1)).alias("total_jobs"))


# ---------------------------------------------------------------- L6
def expired_jobs(df: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """Jobs created more than `days` before `as_of`."""
    cutoff = ntz_literal(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return df.filter(F.col("created_at") < cutoff)


# ---------------------------------------------------------------- H2 / H3
def page_offset(df: DataFrame, order: Sequence[str | Column], page: int = 1,
                page_size: int = 20, deepest: int = DEEPEST_OFFSET) -> DataFrame:
    """H2: one page by offset plus page info (total, total_pages, has_next,
    has_previous).  The slice is a TakeOrderedAndProject with offset (top
    offset+size per task, merged in one); the total is one count.  Pages that
    start after `deepest` rows are refused: that merge would hold them all, and
    `page_cursor` reaches them at the price of one page."""
    if page < 1:
        raise ValueError("page must be >= 1")
    if not 1 <= page_size <= MAX_PAGE_SIZE:
        raise ValueError("page_size must be in 1..100")
    if (page - 1) * page_size > deepest:
        raise ValueError(f"page {page} starts after {deepest} rows; go on from a key with page_cursor")
    total = df.count()
    total_pages = math.ceil(total / page_size) if total > 0 else 0
    items = df.orderBy(*_order(order)).offset((page - 1) * page_size).limit(page_size)
    return items.withColumns({
        "total": F.lit(total).cast("bigint"), "page": F.lit(page), "page_size": F.lit(page_size),
        "total_pages": F.lit(total_pages), "has_next": F.lit(page < total_pages),
        "has_previous": F.lit(page > 1)})


def page_cursor(df: DataFrame, key: str, cursor=None, limit: int = 20) -> DataFrame:
    """H3: keyset page after `cursor` on a unique key: limit+1 rows in key
    order tell has_more; next_cursor is the last returned key."""
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError("limit must be in 1..100")
    if cursor is not None:
        df = df.filter(F.col(key) > F.lit(cursor))
    probe = df.orderBy(key).limit(limit + 1)
    w_all = Window.partitionBy()                      # over at most limit+1 rows
    tagged = probe.withColumns({"_rn": F.row_number().over(Window.orderBy(key)),
                                "_cnt": F.count(F.lit(1)).over(w_all)})
    kept = tagged.filter(F.col("_rn") <= limit)
    has_more = F.col("_cnt") > limit
    return (kept.withColumns({"has_more": has_more,
                              "next_cursor": F.when(has_more, F.max(key).over(w_all))})
                .drop("_rn", "_cnt"))


def _encoded(order: Sequence[tuple[str, str]], values: Sequence[Column]) -> Column:
    """The opaque cursor of a row: its order and key values as base64 JSON."""
    spec = ",".join(f"{c} {way}" for c, way in order)
    body = F.to_json(F.struct(F.lit(spec).alias("o"), F.array(*(v.cast("string") for v in values)).alias("v")))
    return F.base64(body.cast("binary"))


def _decoded(cursor: str, order: Sequence[tuple[str, str]]) -> list[str | None]:
    body = json.loads(base64.b64decode(cursor))
    if body["o"] != ",".join(f"{c} {way}" for c, way in order):
        raise ValueError(f"the cursor belongs to the order {body['o']}")
    return body["v"]


def after_key(df: DataFrame, order: Sequence[tuple[str, str]], values: Sequence[str | None]) -> Column:
    """Rows behind a key in an order over several columns, each "asc" (nulls
    first) or "desc" (nulls last), as one predicate that sources can push."""
    types = {f.name: f.dataType for f in df.schema.fields}
    out, equal = F.lit(False), F.lit(True)
    for (name, way), text in zip(order, values):
        c, v = F.col(name), F.lit(text).cast(types[name])
        if way == "asc":
            behind = c.isNotNull() if text is None else c > v
        else:
            behind = F.lit(False) if text is None else (c < v) | c.isNull()
        out = out | (equal & F.coalesce(behind, F.lit(False)))
        equal = equal & c.eqNullSafe(v)
    return out


def page_keyset(df: DataFrame, order: Sequence[tuple[str, str]], cursor: str | None = None,
                limit: int = 20) -> DataFrame:
    """H3 over several columns with directions of their own, such as
    [("created_at", "desc"), ("job_id", "asc")]; together they must be unique.

    Returns the page after `cursor` with `has_more` and `next_cursor` (null on
    the last page), an opaque text that holds the last row's key and is refused
    with another order.  A page costs one top-(limit + 1), however deep it is."""
    if not 1 <= limit <= MAX_PAGE_SIZE:
        raise ValueError("limit must be in 1..100")
    if not order or any(way not in ("asc", "desc") for _, way in order):
        raise ValueError("order is a list of (column, 'asc' or 'desc')")
    if cursor is not None:
        df = df.filter(after_key(df, order, _decoded(cursor, order)))
    by = [F.col(c).asc_nulls_first() if way == "asc" else F.col(c).desc_nulls_last() for c, way in order]
    probe = df.orderBy(*by).limit(limit + 1)
    every = Window.partitionBy()                          # over at most limit+1 rows
    tagged = probe.withColumns({"_rn": F.row_number().over(Window.orderBy(*by)),
                                "_cnt": F.count(F.lit(1)).over(every)})
    has_more = F.col("_cnt") > limit
    key = _encoded(order, [F.col(c) for c, _ in order])
    last = F.max(F.when(F.col("_rn") == limit, key)).over(every)
    return (tagged.filter(F.col("_rn") <= limit)
            .withColumns({"has_more": has_more, "next_cursor": F.when(has_more, last)})
            .orderBy("_rn").drop("_rn", "_cnt"))
