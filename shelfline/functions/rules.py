"""Validation rules as boolean Columns, evaluated together in one aggregate.

A rule is true when a row passes.  As in the public defaults of the
validation libraries the reference uses, a null fails only the not-null
rule; every other check skips nulls.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfline.functions.columns import count_if


@dataclass(frozen=True)
class Rule:
    column: str
    check: str
    predicate: Column          # true = row passes (already null-skipping)

    @property
    def name(self) -> str:
        return f"{self.column}:{self.check}"


def _skip_null(column: str, cond: Column) -> Column:
    return F.col(column).isNull() | cond


def not_null(column: str) -> Rule:
    return Rule(column, "not_null", F.col(column).isNotNull())


def ge(column: str, v) -> Rule:
    return Rule(column, f"greater_than_or_equal_to({v})", _skip_null(column, F.col(column) >= F.lit(v)))


def gt(column: str, v) -> Rule:
    return Rule(column, f"greater_than({v})", _skip_null(column, F.col(column) > F.lit(v)))


def le(column: str, v) -> Rule:
    return Rule(column, f"less_than_or_equal_to({v})", _skip_null(column, F.col(column) <= F.lit(v)))


def lt(column: str, v) -> Rule:
    return Rule(column, f"less_than({v})", _skip_null(column, F.col(column) < F.lit(v)))


def str_length(column: str, lo: int, hi: int) -> Rule:
    n = F.length(F.col(column))
    return Rule(column, f"str_length({lo},{hi})", _skip_null(column, (n >= lo) & (n <= hi)))


def str_matches(column: str, pattern: str) -> Rule:
    return Rule(column, f"str_matches({pattern})", _skip_null(column, F.col(column).rlike(pattern)))


def isin(column: str, values: Sequence[str]) -> Rule:
    return Rule(column, "isin", _skip_null(column, F.col(column).isin(list(values))))


def two_decimals(column: str) -> Rule:
    c = F.col(column).cast("decimal(20,6)")
    return Rule(column, "two_decimals", _skip_null(column, c * 100 == F.floor(c * 100)))


def rule_aggs(rules: Sequence[Rule], prefix: str = "_r") -> list[Column]:
    """count_if(!rule) per rule, to be placed in a shared aggregate."""
    return [count_if(~r.predicate).alias(f"{prefix}{i}") for i, r in enumerate(rules)]


def rule_structs(rules: Sequence[Rule], prefix: str = "_r") -> list[Column]:
    """(rule_order, column, check, failures) structs over the aggregate row."""
    return [F.struct(F.lit(i).alias("rule_order"), F.lit(r.column).alias("column"),
                     F.lit(r.check).alias("check"), F.col(f"{prefix}{i}").alias("failures"))
            for i, r in enumerate(rules)]


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Evaluate every rule in one pass: a single global aggregate of
    count_if(!rule) (partial per task, one tiny final merge), then the wide
    row is stacked to (column, check, failures, passed, rule_order)."""
    if not rules:
        raise ValueError("no rules")
    wide = df.agg(*rule_aggs(rules))
    long = wide.select(F.inline(F.array(*rule_structs(rules))))
    return long.withColumn("passed", F.col("failures") == 0)


def failure_reasons(rules: Sequence[Rule]) -> Column:
    """Per-row array of the names of the rules the row breaks."""
    return F.array_compact(F.array(*[F.when(~r.predicate, F.lit(r.name)) for r in rules]))


# ---------------------------------------------------------------- fixed rule sets
# Fixed values of the validation schema of raw daily sales.
SALES_CATEGORIES = ["Electronics", "Clothing", "Food", "Home", "Beauty", "Sports"]
STORE_ID_PATTERN = r"^[A-Za-z0-9_-]+$"
MIN_SALES_DATE = dt.date(2020, 1, 1)


def raw_rules(as_of: dt.date) -> list[Rule]:
    """raw daily-sales schema checks; `as_of` replaces "now"."""
    rules = []
    for c in ("date", "sales", "items", "store_id", "product_category"):
        rules.append(not_null(c))
    rules += [
        ge("date", MIN_SALES_DATE), le("date", as_of),
        ge("sales", 0), lt("sales", 1000000),
        ge("items", 0), lt("items", 10000),
        str_length("store_id", 1, 50), str_matches("store_id", STORE_ID_PATTERN),
        str_length("product_category", 1, 100), isin("product_category", SALES_CATEGORIES),
    ]
    return rules


def contract_rules(as_of: dt.date) -> list[Rule]:
    """record contract of retail_sales; `as_of` replaces "today"."""
    rules = [not_null(c) for c in ("store_id", "sku", "date", "units_sold", "price", "on_hand")]
    rules += [
        gt("price", 0), le("price", 10000),
        ge("units_sold", 0), le("units_sold", 1000),
        ge("on_hand", 0), le("on_hand", 100000),
        le("date", as_of),
    ]
    return rules


# Fixed values of the documented (not enforced) contract.
STORE_CODE_PATTERN = r"^STORE_\d{3}$"
SKU_CODE_PATTERN = r"^SKU_[A-Z]{2,10}_\d{3}$"


def documented_rules() -> list[Rule]:
    """F5 per-row part: id formats, price >= 0.01 with two decimals."""
    return [
        str_matches("store_id", STORE_CODE_PATTERN),
        str_matches("sku", SKU_CODE_PATTERN),
        ge("price", 0.01),
        two_decimals("price"),
    ]
