"""Registered reorder-planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfline.operators import reorder as R
from shelfline.plans.oracle_views import with_views
from shelfline.plans.registry import register
from shelfline.sources import fixtures as V

# Fixed parameters of the registered plans.  The whole retail_sales table is
# the demand input; budget and space are chosen so the global plan is
# Optimal at every test scale, and the per-store budget splits the stores.
GLOBAL_CFG = R.ReorderConfig(budget=1e12, shelf_space=1e10)
STORE_CFG = R.ReorderConfig(budget=5e7, shelf_space=1e10)
TIGHT_CFG = R.ReorderConfig(budget=1e6, shelf_space=1e10)

ROWS = "select store_id, sku, date, units_sold, price, on_hand from retail_sales"

# ---- shared oracle CTEs (independent SQL of the closed form)
O_LOOKUP = """
select r.store_id, r.sku, r.date, r.units_sold, r.price, r.on_hand,
       coalesce(p.moq, 0.0) as moq,
       coalesce(p.unit_cost, cast(r.price as double)) as unit_cost,
       coalesce(p.space_per_unit, 1.0) as space_per_unit,
       greatest(0.0, cast(r.units_sold - r.on_hand as double)) * 10.0 as shortage_cost
from retail_sales r left join sku_params p on r.sku = p.sku"""


def o_qty(by: str) -> str:
    keys = f"{by}, sku" if by else "sku"
    return f"""
select {keys}, cast(ceil(greatest(0.0, case when max(moq) > 0 then max(moq) else 0.0 end,
                             max(units_sold * 0.95 - on_hand)) - 1e-6) as bigint) as order_qty
from lk group by {keys}"""


def o_terms(by: str) -> str:
    join = f"l.{by} = q.{by} and l.sku = q.sku" if by else "l.sku = q.sku"
    return f"""
select l.*, q.order_qty, cast(0.0 as double) as discount,
       1.0 * q.order_qty + l.shortage_cost as row_cost,
       l.unit_cost * (1.0 - 0.0) * q.order_qty as order_value,
       l.space_per_unit * q.order_qty as space_used,
       l.unit_cost * 0.0 * q.order_qty as discount_value,
       least(1.0, cast(l.on_hand + q.order_qty as double) / greatest(cast(l.units_sold as double), 1.0)) as service_level
from lk l join qty q on {join}"""


def o_summary(by: str, budget: float, space: float) -> str:
    sel = f"{by}, " if by else ""
    grp = f"group by {by}" if by else ""
    return f"""
select {sel}sum(row_cost) as c, sum(unit_cost * order_qty) as budget_used,
       sum(space_used) as sp, sum(order_value) as ov, sum(discount_value) as dv,
       count(*) as n_rows, count(distinct sku) as n_skus,
       sum(unit_cost * order_qty) <= {budget!r} and sum(space_used) <= {space!r} as ok
from terms {grp}"""


def summary_cols(df):
    return df.select(*[c for c in df.columns if c not in ("n_rows", "n_skus", "status")],
                     "status", "n_rows", "n_skus").withColumns({
        c: F.round(F.col(c), 3) for c in ("total_cost", "budget_used", "total_order_value",
                                          "total_shelf_space_used", "total_discount_value")})


O_SUMMARY_SELECT = """
select {sel}case when ok then 'Optimal' else 'Infeasible' end as status,
       round(case when ok then c end, 3) as total_cost, round(budget_used, 3) as budget_used,
       round(case when ok then ov end, 3) as total_order_value, round(sp, 3) as total_shelf_space_used,
       round(case when ok then dv end, 3) as total_discount_value, n_rows, n_skus
from summ"""


def _rows(spark, sf_dir):
    return V.retail_sales(spark, sf_dir)


def _plan(spark, sf_dir, cfg, by=()):
    return R.build_plan(_rows(spark, sf_dir), V.sku_params(spark, sf_dir), cfg, by=by)


def _summary(spark, sf_dir, cfg, by=()):
    return R.sku_plan(_rows(spark, sf_dir), V.sku_params(spark, sf_dir), cfg, by=by)[1]


def _oracle_plan_sql(body: str, by: str = "", budget: float = 1e12, space: float = 1e10,
                     summary: bool = False) -> str:
    ctes = [("lk", O_LOOKUP), ("qty", o_qty(by)), ("terms", o_terms(by))]
    if summary:
        ctes.append(("summ", o_summary(by, budget, space)))
    return with_views(body, "retail_sales", "sku_params", ctes=ctes)


# ---------------------------------------------------------------- G1
@register("sku_params_lookup", with_views(
    "select store_id, sku, date, moq, unit_cost, space_per_unit from lk",
    "retail_sales", "sku_params", ctes=[("lk", O_LOOKUP)]))
def q_sku_params_lookup(spark, sf_dir):
    df = R.with_sku_params(_rows(spark, sf_dir), V.sku_params(spark, sf_dir))
    return df.select("store_id", "sku", "date", "moq", "unit_cost", "space_per_unit")


# ---------------------------------------------------------------- K1
@register("reorder_input_checks", with_views(
    "select sku, units_sold, price, on_hand from retail_sales", "retail_sales"))
def q_reorder_input_checks(spark, sf_dir):
    df = _rows(spark, sf_dir).select("sku", "units_sold", "price", "on_hand")
    return R.check_reorder_inputs(df, GLOBAL_CFG, horizon=30)


# ---------------------------------------------------------------- K2
@register("expected_shortage", with_views(
    "select store_id, sku, date, shortage_cost from lk",
    "retail_sales", "sku_params", ctes=[("lk", O_LOOKUP)]))
def q_expected_shortage(spark, sf_dir):
    df = R.expected_shortage(_rows(spark, sf_dir), R.ReorderConfig())
    return df.select("store_id", "sku", "date", "shortage_cost")


# ---------------------------------------------------------------- K3
@register("reorder_quantity", _oracle_plan_sql(
    "select store_id, sku, date, order_qty from terms"))
def q_reorder_quantity(spark, sf_dir):
    return _plan(spark, sf_dir, GLOBAL_CFG).select("store_id", "sku", "date", "order_qty")


# ---------------------------------------------------------------- K4 (one plan per store)
@register("budget_space_check", _oracle_plan_sql(
    O_SUMMARY_SELECT.format(sel="store_id, "), by="store_id", budget=5e7, space=1e10, summary=True))
def q_budget_space_check(spark, sf_dir):
    return summary_cols(_summary(spark, sf_dir, STORE_CFG, by=("store_id",)))


# ---------------------------------------------------------------- K4 infeasible
@register("budget_infeasible", _oracle_plan_sql(
    O_SUMMARY_SELECT.format(sel=""), budget=1e6, space=1e10, summary=True))
def q_budget_infeasible(spark, sf_dir):
    return summary_cols(_summary(spark, sf_dir, TIGHT_CFG))


# ---------------------------------------------------------------- K5
@register("discount_schedule", _oracle_plan_sql(
    "select distinct sku, discount from terms"))
def q_discount_schedule(spark, sf_dir):
    return _plan(spark, sf_dir, GLOBAL_CFG).select("sku", "discount").distinct()


# ---------------------------------------------------------------- K6
@register("plan_summary", _oracle_plan_sql(
    O_SUMMARY_SELECT.format(sel=""), summary=True))
def q_plan_summary(spark, sf_dir):
    return summary_cols(_summary(spark, sf_dir, GLOBAL_CFG))


# ---------------------------------------------------------------- K7
@register("plan_metrics", _oracle_plan_sql(
    """select store_id, sku, date, round(order_value, 6) as order_value, space_used,
              discount_value, round(service_level, 9) as service_level from terms"""))
def q_plan_metrics(spark, sf_dir):
    plan = _plan(spark, sf_dir, GLOBAL_CFG)
    return plan.select("store_id", "sku", "date", F.round("order_value", 6).alias("order_value"),
                       "space_used", "discount_value",
                       F.round("service_level", 9).alias("service_level"))


# ---------------------------------------------------------------- G2
@register("plan_actuals_lookup", _oracle_plan_sql(
    """select r.store_id, r.sku, r.date, coalesce(t.order_qty, 0) as order_qty,
              coalesce(t.discount, 0.0) as discount
       from retail_sales r left join (
            select t.store_id, t.sku, t.date, t.order_qty, t.discount from terms t
            join summ s on t.store_id = s.store_id where s.ok) t
         on r.store_id = t.store_id and r.sku = t.sku and r.date = t.date""",
    by="store_id", budget=5e7, space=1e10, summary=True))
def q_plan_actuals_lookup(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    plan, summary = R.sku_plan(rows, V.sku_params(spark, sf_dir), STORE_CFG, by=("store_id",))
    feasible = R.attach_status(plan, summary, by=("store_id",))
    return R.with_plan(rows.select("store_id", "sku", "date"), feasible, keys=("store_id", "sku"))


# ---------------------------------------------------------------- P6
@register("optimize", _oracle_plan_sql(
    """select t.store_id, t.sku, t.date, t.order_qty, t.discount, 'Optimal' as status
       from terms t, summ s where s.ok""", summary=True))
def q_optimize(spark, sf_dir):
    orders, _ = R.optimize(_rows(spark, sf_dir), V.sku_params(spark, sf_dir), GLOBAL_CFG)
    return orders.select("store_id", "sku", "date", "order_qty", "discount", "status")


# ---------------------------------------------------------------- P6 per SKU (one input pass)
@register("plan_by_sku", _oracle_plan_sql(
    """select q.sku, q.order_qty, cast(0.0 as double) as discount, 'Optimal' as status
       from qty q, summ s where s.ok""", summary=True))
def q_plan_by_sku(spark, sf_dir):
    orders, _ = R.plan_by_sku(_rows(spark, sf_dir), V.sku_params(spark, sf_dir), GLOBAL_CFG)
    return orders


@register("plan_by_sku_summary", _oracle_plan_sql(O_SUMMARY_SELECT.format(sel=""), summary=True))
def q_plan_by_sku_summary(spark, sf_dir):
    _, summary = R.plan_by_sku(_rows(spark, sf_dir), V.sku_params(spark, sf_dir), GLOBAL_CFG)
    return summary_cols(summary)
