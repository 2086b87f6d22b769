"""Registered job-log and request-log queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from shelfline.operators import jobs as L
from shelfline.operators import requests as M
from shelfline.plans.oracle_views import with_views
from shelfline.plans.registry import register
from shelfline.sources import fixtures as V

JOB_COLS = "job_id, user_id, job_type, status, created_at, updated_at, priority, retry_count, max_retries"
JOBS_AS_OF = dt.datetime(1998, 8, 1)
# Requests are sparse in the test log (about 67 per client in 30 days), so
# the registered limiter uses a one-day window and a limit of 3.
LIMIT_WINDOW_SECONDS = 86400
LIMIT_PER_WINDOW = 3


def jsql(body: str) -> str:
    return with_views(body, "job_log")


def rsql(body: str, ctes=None) -> str:
    return with_views(body, "request_log", ctes=ctes)


# ---------------------------------------------------------------- L1
@register("jobs_list", jsql(f"""
select *, count(*) over () = 50 as has_more from (
  select {JOB_COLS} from job_log where user_id = 'user_7' and job_type = 'etl'
  order by created_at desc, job_id desc limit 50)"""))
def q_jobs_list(spark, sf_dir):
    return L.jobs_list(V.job_log(spark, sf_dir), user_id="user_7", job_type="etl", limit=50)


# ---------------------------------------------------------------- L2
@register("job_metrics", jsql("""
select job_id, job_type, status, created_at, updated_at, retry_count, priority,
       case when status = 'completed' then cast(date_diff('second', created_at, updated_at) as double) end
         as execution_time_seconds
from job_log"""))
def q_job_metrics(spark, sf_dir):
    return L.job_metrics(V.job_log(spark, sf_dir))


# ---------------------------------------------------------------- L3
@register("job_state_fold", jsql(
    "select job_id, user_id, job_type, priority, retry_count, max_retries, created_at, status, updated_at "
    "from job_log"))
def q_job_state_fold(spark, sf_dir):
    return L.job_state_fold(L.status_updates(V.job_log(spark, sf_dir)))


# ---------------------------------------------------------------- L4
@register("retryable_jobs", jsql("""
select job_id, user_id, job_type, 'queued' as status, created_at, updated_at, priority,
       retry_count + 1 as retry_count, max_retries, cast(null as varchar) as error_message, cast(0.0 as double) as progress
from job_log where status = 'failed' and retry_count < max_retries"""))
def q_retryable_jobs(spark, sf_dir):
    return L.retryable_jobs(V.job_log(spark, sf_dir))


# ---------------------------------------------------------------- L5
@register("queue_statistics", jsql("""
select count(*) filter (where status = 'queued') as approximate_number_of_messages,
       count(*) filter (where status = 'running') as approximate_number_of_messages_not_visible,
       count(*) filter (where status = 'failed' and retry_count < max_retries)
         as approximate_number_of_messages_delayed,
       count(*) as total_jobs
from job_log"""))
def q_queue_statistics(spark, sf_dir):
    return L.queue_statistics(V.job_log(spark, sf_dir))


# ---------------------------------------------------------------- L6
@register("expired_jobs", jsql(f"""
select {JOB_COLS} from job_log where created_at < timestamp '1998-08-01 00:00:00' - interval 30 day"""))
def q_expired_jobs(spark, sf_dir):
    return L.expired_jobs(V.job_log(spark, sf_dir), JOBS_AS_OF, days=30)


# ---------------------------------------------------------------- H2
@register("page_offset", jsql(f"""
select {JOB_COLS}, (select count(*) from job_log) as total, 3 as page, 20 as page_size,
       cast(ceil((select count(*) from job_log) / 20.0) as integer) as total_pages,
       3 < ceil((select count(*) from job_log) / 20.0) as has_next, true as has_previous
from job_log order by created_at desc, job_id desc limit 20 offset 40"""))
def q_page_offset(spark, sf_dir):
    return L.page_offset(V.job_log(spark, sf_dir), [F.desc("created_at"), F.desc("job_id")],
                         page=3, page_size=20)


# ---------------------------------------------------------------- H3
@register("page_cursor", jsql(f"""
select {JOB_COLS}, cnt > 20 as has_more, case when cnt > 20 then max(job_id) over () end as next_cursor
from (select *, count(*) over () as cnt, row_number() over (order by job_id) as rn from (
        select * from job_log where job_id > 1000 order by job_id limit 21))
where rn <= 20"""))
def q_page_cursor(spark, sf_dir):
    return L.page_cursor(V.job_log(spark, sf_dir), "job_id", cursor=1000, limit=20)


# ---------------------------------------------------------------- H3, several columns
NEWEST = [("created_at", "desc"), ("job_id", "asc")]


@register("page_keyset", jsql(f"""
select {JOB_COLS}, true as has_more from job_log order by created_at desc, job_id limit 20 offset 40"""))
def q_page_keyset(spark, sf_dir):
    """The third page of the newest jobs, by the cursors of the first two."""
    jobs, cursor = V.job_log(spark, sf_dir), None
    for _ in range(2):
        cursor = L.page_keyset(jobs, NEWEST, cursor).first()["next_cursor"]
    return L.page_keyset(jobs, NEWEST, cursor).drop("next_cursor")


# ---------------------------------------------------------------- H4
@register("recent_top_k", jsql(f"""
select {JOB_COLS} from job_log where status = 'completed'
order by updated_at desc, job_id desc limit 50"""))
def q_recent_top_k(spark, sf_dir):
    return L.recent_top_k(V.job_log(spark, sf_dir), [F.desc("updated_at"), F.desc("job_id")], k=50,
                          where=F.col("status") == "completed")


# ---------------------------------------------------------------- H1
O_LAST = """
select * from (
  select method || ' ' || path as endpoint, request_id, ts, processing_time, status_code,
         row_number() over (partition by method || ' ' || path order by ts desc, request_id desc) as rn
  from request_log) where rn <= 1000"""


@register("latest_n_response_times", rsql(
    "select endpoint, request_id, ts, processing_time from last1000", ctes=[("last1000", O_LAST)]))
def q_latest_n_response_times(spark, sf_dir):
    out = M.latest_response_times(V.request_log(spark, sf_dir))
    return out.select("endpoint", "request_id", "ts", "processing_time")


# ---------------------------------------------------------------- M1
O_ENDPOINT_METRICS = rsql("""
select c.endpoint, c.request_count, c.error_count, s."count", round(s.avg, 6) as avg, s."min", s."max",
       s.v[cast(floor(len(s.v) * 0.95) as integer) + 1] as p95,
       s.v[cast(floor(len(s.v) * 0.99) as integer) + 1] as p99
from (select method || ' ' || path as endpoint, count(*) as request_count,
             cast(sum(case when status_code >= 400 then 1 else 0 end) as bigint) as error_count
      from request_log group by 1) c
left join (select endpoint, count(processing_time) as "count", avg(processing_time) as avg,
                  min(processing_time) as "min", max(processing_time) as "max",
                  list_sort(list(processing_time)) as v
           from last1000 group by endpoint) s on c.endpoint = s.endpoint""", ctes=[("last1000", O_LAST)])


@register("endpoint_metrics", O_ENDPOINT_METRICS)
def q_endpoint_metrics(spark, sf_dir):
    out = M.endpoint_metrics(V.request_log(spark, sf_dir))
    return out.withColumn("avg", F.round("avg", 6))


# ---------------------------------------------------------------- M2
@register("client_rate", rsql("""
select request_id, ts, client_id, method, path, processing_time, status_code,
       count(*) over (partition by client_id order by epoch_us(ts)
                      range between 60000000 preceding and current row) as requests_in_window
from request_log"""))
def q_client_rate(spark, sf_dir):
    return M.client_rate(V.request_log(spark, sf_dir), seconds=60)


# ---------------------------------------------------------------- M3
def limiter_ctes(log: str) -> list[tuple[str, str]]:
    """The limiter as recursive SQL: one step per request of a client, in
    order, carrying the accepted times of the window."""
    exempt = "o.path in ('/health', '/health/liveness', '/health/readiness')"
    live = f"list_filter(s.acc, lambda x: x >= o.us - {LIMIT_WINDOW_SECONDS * 1_000_000})"
    return [
        ("lim_o", f"""
select request_id, ts, client_id, path, epoch_us(ts) as us,
       row_number() over (partition by client_id order by ts, request_id) as rn from {log} where ts is not null"""),
        ("lim_s", f"""
select o.client_id, o.rn, o.request_id, o.ts, o.path, true as allowed,
       case when {exempt} then cast([] as bigint[]) else [o.us] end as acc
from lim_o o where rn = 1
union all
select o.client_id, o.rn, o.request_id, o.ts, o.path, {exempt} or len({live}) < {LIMIT_PER_WINDOW},
       case when {exempt} then s.acc when len({live}) < {LIMIT_PER_WINDOW} then list_append({live}, o.us)
            else {live} end
from lim_s s join lim_o o on o.client_id is not distinct from s.client_id and o.rn = s.rn + 1"""),
    ]


def limited_sql(log: str) -> str:
    return ("select request_id, ts, client_id, path, allowed from lim_s union all "
            f"select request_id, ts, client_id, path, true from {log} where ts is null")


O_HEALTH_LOG = """
select * replace (case when request_id % 6 = 0 then '/health' when request_id % 6 = 1 then '/health/readiness'
                       else path end as path) from request_log"""


def _limited(log):
    return M.rate_limit_decisions(log, limit=LIMIT_PER_WINDOW, seconds=LIMIT_WINDOW_SECONDS)


@register("rate_limit_decisions", rsql(limited_sql("request_log"), ctes=limiter_ctes("request_log")))
def q_rate_limit_decisions(spark, sf_dir):
    return _limited(V.request_log(spark, sf_dir))


@register("rate_limit_health_paths", rsql(
    limited_sql("health_log"), ctes=[("health_log", O_HEALTH_LOG), *limiter_ctes("health_log")]))
def q_rate_limit_health_paths(spark, sf_dir):
    """A third of the requests ask for health paths, which are exempt."""
    k = F.col("request_id") % 6
    return _limited(V.request_log(spark, sf_dir).withColumn("path", F.when(k == 0, "/health").when(
        k == 1, "/health/readiness").otherwise(F.col("path"))))


# ---------------------------------------------------------------- M4
def with_headers(requests):
    """Forwarding headers derived from each request: X-Forwarded-For with a
    proxy chain, an empty one, X-Real-IP, or only the peer (sometimes none)."""
    k = F.col("request_id")
    return requests.withColumns({
        "x_forwarded_for": F.when(k % 4 == 0, F.concat(F.lit(" "), F.col("client_id"), F.lit(" , 172.16.0.1")))
                            .when(k % 4 == 1, F.lit("")),
        "x_real_ip": F.when(k % 4 != 0, F.concat(F.lit("10.1.0."), (k % 7).cast("string"))),
        "peer_host": F.when(k % 8 != 3, F.lit("192.168.0.1")),
    })


@register("client_identity", rsql("""
select request_id, x_forwarded_for, x_real_ip, peer_host,
       case when x_forwarded_for is not null and x_forwarded_for <> ''
              then trim(split_part(x_forwarded_for, ',', 1))
            when x_real_ip is not null and x_real_ip <> '' then x_real_ip
            when peer_host is not null then peer_host else 'unknown' end as client_ip
from (select request_id,
             case when request_id % 4 = 0 then ' ' || client_id || ' , 172.16.0.1'
                  when request_id % 4 = 1 then '' end as x_forwarded_for,
             case when request_id % 4 <> 0 then '10.1.0.' || cast(request_id % 7 as varchar) end as x_real_ip,
             case when request_id % 8 <> 3 then '192.168.0.1' end as peer_host
      from request_log)"""))
def q_client_identity(spark, sf_dir):
    df = with_headers(V.request_log(spark, sf_dir))
    return M.client_identity(df).select("request_id", "x_forwarded_for", "x_real_ip", "peer_host", "client_ip")
