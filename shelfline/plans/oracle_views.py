"""DuckDB text of the fixture views, used as CTEs by the oracle SQL.

The same shapes as `shelfline.sources.fixtures` (which builds them with the
DataFrame API); only the base tables are registered in the oracle engine.
"""

VIEWS = {
    "retail_sales": """
select concat('STORE_', lpad(cast(s_nationkey as varchar), 3, '0')) as store_id,
       concat('SKU_', p_type, '_', lpad(regexp_extract(p_brand, '([0-9]+)$', 1), 3, '0')) as sku,
       cast(l_shipdate as date) + 9131 as date,
       cast(sum(l_quantity) as int) as units_sold,
       cast(max(p_retailprice) as decimal(10,2)) as price,
       cast(sum((l_partkey * 37 + l_suppkey * 11) % 200) as int) as on_hand
from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey
group by 1, 2, 3""",
    "daily_sales": """
select cast(l_shipdate as date) + 9131 as date,
       case when l_orderkey % 97 = 0 then -l_extendedprice when l_orderkey % 89 = 0 then null else l_extendedprice end as sales,
       case when l_orderkey % 83 = 0 then null else cast(l_quantity as bigint) end as items,
       case when l_orderkey % 79 = 0 then '' else concat('STORE_', lpad(cast(s_nationkey as varchar), 3, '0')) end as store_id,
       case when l_orderkey % 101 = 0 then 'InvalidCategory' when p_type = 'PROMO' then 'Electronics' when p_type = 'SMALL' then 'Clothing'
            when p_type = 'LARGE' then 'Food' when p_type = 'ECONOMY' then 'Home' when p_type = 'MEDIUM' then 'Beauty' else 'Sports' end as product_category
from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey""",
    "sku_params": """
select concat('SKU_', p_type, '_', lpad(regexp_extract(p_brand, '([0-9]+)$', 1), 3, '0')) as sku,
       cast(min(p_size) as double) as moq,
       max(p_retailprice) * 0.5 as unit_cost,
       cast(1 + min(p_size) % 4 as double) * 0.5 as space_per_unit
from part where cast(regexp_extract(p_brand, '([0-9]+)$', 1) as int) % 4 <> 0 group by 1""",
    "request_log": """
select event_id as request_id, ts, concat('10.0.0.', cast(user_id % 250 as varchar)) as client_id,
       case when event_type in ('purchase','signup') then 'POST' else 'GET' end as method,
       concat('/', event_type) as path, value as processing_time,
       case when event_type = 'error' then 500 when event_id % 20 = 0 then 404 else 200 end as status_code
from events""",
    "job_log": """
select o_orderkey as job_id, concat('user_', cast(o_custkey % 50 as varchar)) as user_id,
       case o_orderkey % 4 when 0 then 'etl' when 1 then 'forecast' when 2 then 'optimization' else 'batch_processing' end as job_type,
       case when o_orderkey % 10 = 0 then 'failed' when o_orderkey % 37 = 0 then 'cancelled' when o_orderstatus = 'F' then 'completed'
            when o_orderstatus = 'P' then 'running' else 'queued' end as status,
       o_orderdate as created_at, o_orderdate + interval 1 hour as updated_at,
       cast(substr(o_orderpriority, 1, 1) as int) as priority, cast(o_orderkey % 5 as int) as retry_count, 3 as max_retries
from orders""",
}


RECURSIVE = ("lim_s", "ar_path")     # CTEs that refer to themselves


def with_views(sql: str, *names: str, ctes: list[tuple[str, str]] | None = None) -> str:
    """Prefix `sql` with the CTEs of the named fixture views, followed by any
    extra (name, text) CTEs."""
    parts = [f"{n} as ({VIEWS[n]}\n)" for n in names]
    parts += [f"{n} as (\n{body}\n)" for n, body in (ctes or [])]
    recursive = "recursive " if any(n in RECURSIVE for n, _ in ctes or []) else ""
    return (f"with {recursive}" + ",\n".join(parts) + "\n" + sql) if parts else sql
