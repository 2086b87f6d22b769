"""Data-quality metrics, rule checks, expectations, contract, drift.

Design rule: every metric and rule over the data is one column of ONE global
aggregate, so a validation is a single scan with map-side partial
aggregation and a one-row final merge; long (name, value) output is a
projection of that row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.columns import count_if
from shelfline.functions.rules import (
    SALES_CATEGORIES, STORE_ID_PATTERN, Rule, failure_reasons, run_rules,
)
from shelfline.schemas import type_family

# Pandas dtype names the reference's drift report compares.
PANDAS_DTYPE = {
    "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]",
    "double": "float64", "float": "float32", "bigint": "int64", "int": "int32",
    "smallint": "int16", "tinyint": "int8", "boolean": "bool", "string": "object",
}
DRIFT_REFERENCE_DTYPES = {
    "date": "datetime64[ns]", "sales": "float64", "items": "int64",
    "store_id": "object", "product_category": "object",
}
# Fixed default limits of the quality gate and of the expectations; every one
# is an argument, so a run of any size can set its own.
MAX_NULL_RATIO = 0.1
MAX_DUPLICATE_RATIO = 0.05
MIN_ROWS, MAX_ROWS = 1, 1_000_000
MAX_SALES, MAX_ITEMS = 1_000_000, 10_000
MAX_MEAN_SALES, MAX_STDEV_SALES = 50_000, 100_000
EXTREME_SALES, EXTREME_ITEMS = 100_000, 1_000


@dataclass(frozen=True)
class Limits:
    """Limits of the quality gate; `max_rows` None means no upper bound."""
    max_null_ratio: float = MAX_NULL_RATIO
    max_duplicate_ratio: float = MAX_DUPLICATE_RATIO
    min_rows: int = MIN_ROWS
    max_rows: int | None = MAX_ROWS

    def rows_ok(self, n: Column) -> Column:
        return (n >= self.min_rows) if self.max_rows is None else n.between(self.min_rows, self.max_rows)


def _long(row_df: DataFrame, names: Sequence[str], name_col: str = "metric",
          value_col: str = "value") -> DataFrame:
    """Stack the named columns of a one-row frame to (name, value double)."""
    return row_df.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias(name_col), F.col(n).cast("double").alias(value_col)) for n in names])))


# ---------------------------------------------------------------- E2
def batch_summary(df: DataFrame, threshold: int = 50) -> DataFrame:
    """Totals of a batch; an empty batch fails the job."""
    n = F.count(F.lit(1))
    return df.agg(
        F.when(n == 0, F.raise_error(F.lit("empty batch"))).otherwise(n).cast("bigint").alias("records"),
        F.sum(F.col("price") * F.col("units_sold")).cast("decimal(20,2)").alias("total_revenue"),
        F.sum("units_sold").cast("bigint").alias("total_units_sold"),
        F.count_distinct("store_id").alias("unique_stores"),
        F.count_distinct("sku").alias("unique_skus"),
        F.min("date").alias("min_date"), F.max("date").alias("max_date"),
        count_if(F.col("on_hand") < threshold).alias("low_stock_count"),
    )


# ---------------------------------------------------------------- E3
def range_profile(df: DataFrame, cols: Sequence[str] = ("date", "price", "units_sold", "on_hand")) -> DataFrame:
    """Min / max of the given columns and the total null count."""
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    nulls = sum((count_if(F.col(c).isNull()) for c in df.columns), F.lit(0).cast("bigint"))
    return df.agg(*aggs, nulls.alias("total_nulls"))


# ---------------------------------------------------------------- E4 / E5 / E6
FLAGS_IN_WORD = 62
PRINT = ["_h1", "_h2"]


def _row_flags(df: DataFrame) -> dict[str, Column]:
    """What is counted of a row besides its duplicates, by metric name."""
    return {**{f"{c}_null_count": F.col(c).isNull() for c in df.columns}, **_business_preds(df)}


def row_fingerprint(df: DataFrame) -> tuple[Column, Column]:
    """Two 64-bit hashes of all columns of a row, nulls and their places
    included; equal rows (as grouping sees them: 0.0 and -0.0 are one) agree."""
    def value(f) -> Column:
        c = F.col(f.name)
        return F.when(c == 0, F.lit(0).cast(f.dataType)).otherwise(c) if isinstance(
            f.dataType, (T.DoubleType, T.FloatType)) else c
    places = F.concat(*(F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns))
    values = [value(f) for f in df.schema.fields]
    return F.xxhash64(F.lit(1), places, *values), F.xxhash64(F.lit(2), *values[::-1], places)


def fingerprint_counts(df: DataFrame) -> DataFrame:
    """One row per distinct row of `df`: its 128-bit fingerprint (`_h1`,
    `_h2`), how often it occurs (`_n`) and its flags (`_f0`, ...).

    Rows with one fingerprint have the same flags, so a few words say for the
    whole group which columns are null and which business rules it breaks:
    what is shuffled does not widen with the row.  The counts of parts of a
    table add up (`merge_counts`).  Different rows share a fingerprint with a
    probability of rows**2 / 2**129: 1e-15 for 10**12 rows."""
    flags = list(_row_flags(df).values())
    words = [sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, f in enumerate(flags[i:i + FLAGS_IN_WORD])),
                 F.lit(0).cast("long")) for i in range(0, len(flags), FLAGS_IN_WORD)]
    h1, h2 = row_fingerprint(df)
    rows = df.select(h1.alias("_h1"), h2.alias("_h2"), *(w.alias(f"_f{i}") for i, w in enumerate(words)))
    return rows.groupBy(*PRINT).agg(F.count(F.lit(1)).alias("_n"), *(
        F.min(f"_f{i}").alias(f"_f{i}") for i in range(len(words))))


def merge_counts(counts: DataFrame) -> DataFrame:
    """The fingerprint counts of several parts as those of the whole."""
    return counts.groupBy(*PRINT).agg(F.sum("_n").alias("_n"), *(
        F.min(c).alias(c) for c in counts.columns if c.startswith("_f")))


def metrics_of_counts(counts: DataFrame, like: DataFrame, duplicates: DataFrame | None = None) -> DataFrame:
    """E4 + E5 + E6 in long form (metric, value) from the fingerprint counts of
    a frame with the columns of `like`; `duplicates`, one row
    (`duplicate_rows`), replaces the count by fingerprints."""
    cols, names = like.columns, list(_row_flags(like))
    sums = [F.sum("_n").alias("total_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows")]
    for k, name in enumerate(names):
        held = F.col(f"_f{k // FLAGS_IN_WORD}").bitwiseAND(F.lit(1 << k % FLAGS_IN_WORD)) != 0
        sums.append(F.sum(F.when(held, F.col("_n")).otherwise(0)).alias(name))
    row = counts.agg(*sums)
    if duplicates is not None:
        row = row.drop("duplicate_rows").withColumn(
            "duplicate_rows", F.lit(duplicates.first()["duplicate_rows"]).cast("long"))
    total = F.coalesce(F.col("total_rows"), F.lit(0))
    ncols = len(cols)
    derived = {"total_columns": F.lit(ncols)}
    for c in cols:
        derived[f"{c}_null_ratio"] = F.when(total > 0, F.col(f"{c}_null_count") / total).otherwise(0.0)
    all_nulls = sum((F.col(f"{c}_null_count") for c in cols), F.lit(0))
    derived["overall_null_ratio"] = F.when(total > 0, all_nulls / (total * ncols)).otherwise(0.0)
    derived["duplicate_ratio"] = F.when(total > 0, F.col("duplicate_rows") / total).otherwise(0.0)
    row = row.withColumns({"total_rows": total, "duplicate_rows": F.coalesce("duplicate_rows", F.lit(0)),
                           **derived})
    return _long(row, ["total_rows", "total_columns"]
                 + [x for c in cols for x in (f"{c}_null_count", f"{c}_null_ratio")]
                 + ["overall_null_ratio", "duplicate_rows", "duplicate_ratio"] + _business_names(like))


def quality_metrics(df: DataFrame, compare_rows: bool = False) -> DataFrame:
    """E4 + E5 + E6 in one scan and one shuffle: row / column counts,
    per-column null count and ratio, overall null ratio, duplicate rows and
    ratio, business-rule counts.  Long form (metric, value).

    Rows are counted by fingerprint (`fingerprint_counts`), so the shuffle
    holds a few words a row whatever its width, and copies of a row meet in
    the partial aggregate.  `compare_rows` counts the duplicates by the rows
    themselves, of those whose fingerprint repeats (a second scan)."""
    counts = fingerprint_counts(df)
    return metrics_of_counts(counts, df, _compared_duplicates(df, counts) if compare_rows else None)


def _compared_duplicates(df: DataFrame, counts: DataFrame) -> DataFrame:
    """Rows equal to an earlier one, counted among those whose fingerprint
    repeats; the rows of a common fingerprint fold into one per task."""
    h1, h2 = row_fingerprint(df)
    cols = df.columns
    again = counts.where("_n > 1").select(*PRINT)
    kept = df.withColumns({"_h1": h1, "_h2": h2}).join(again, PRINT, "left_semi")
    groups = kept.groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def moments(df: DataFrame, col: str = "sales") -> DataFrame:
    """One row (`n`, `mean`, `m2`: squared deviations from the mean) that
    `merge_moments` puts together with those of other parts."""
    return df.agg(F.count(col).alias("n"), F.coalesce(F.avg(col), F.lit(0.0)).alias("mean"),
                  F.coalesce(F.var_pop(col) * F.count(col), F.lit(0.0)).alias("m2"))


def merge_moments(parts: DataFrame, col: str = "sales") -> DataFrame:
    """E7 from the moments of disjoint parts.  Deviations are taken from the
    common mean, so nothing cancels."""
    n, mean = F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("mean")
    total = parts.agg(n, mean).select(F.col("n").alias("_total"), F.col("mean").alias("_mean"))
    off = F.col("mean") - F.col("_mean")
    row = parts.join(F.broadcast(total)).agg(F.max("_total").alias("n"), F.max("_mean").alias("mean"), F.sum(
        F.col("m2") + F.col("n") * off * off).alias("m2"))
    return row.select(F.col("mean").alias(f"{col}_mean"), F.when(F.col("n") > 1, F.sqrt(
        F.col("m2") / (F.col("n") - 1))).alias(f"{col}_stdev"))


def _business_names(df: DataFrame) -> list[str]:
    out = []
    if "sales" in df.columns:
        out += ["negative_sales_count", "zero_sales_count", "extreme_sales_count"]
    if "items" in df.columns:
        out += ["negative_items_count", "zero_items_count", "extreme_items_count"]
    return out


def _business_preds(df: DataFrame) -> dict[str, Column]:
    p = {}
    if "sales" in df.columns:
        s = F.col("sales")
        p.update(negative_sales_count=s < 0, zero_sales_count=s == 0, extreme_sales_count=s > EXTREME_SALES)
    if "items" in df.columns:
        i = F.col("items")
        p.update(negative_items_count=i < 0, zero_items_count=i == 0, extreme_items_count=i > EXTREME_ITEMS)
    return p


def _business_aggs(df: DataFrame) -> list[Column]:
    return [count_if(c).alias(n) for n, c in _business_preds(df).items()]


def duplicate_metrics(df: DataFrame, compare_rows: bool = False) -> DataFrame:
    """E5: rows equal to an earlier row in all columns, and their ratio;
    counted by fingerprint as in `quality_metrics`."""
    h1, h2 = row_fingerprint(df)
    g = df.select(h1.alias("_h1"), h2.alias("_h2")).groupBy(*PRINT).agg(F.count(F.lit(1)).alias("_n"))
    row = g.agg(F.sum("_n").alias("total_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"))
    if compare_rows:
        row = row.withColumn("duplicate_rows", F.lit(_compared_duplicates(df, g).first()["duplicate_rows"]))
    total = F.coalesce(F.col("total_rows"), F.lit(0))
    return row.select(
        F.coalesce(F.col("duplicate_rows"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.when(total > 0, F.col("duplicate_rows") / total).otherwise(0.0).alias("duplicate_ratio"))


def business_rule_counts(df: DataFrame) -> DataFrame:
    """Counts of negative / zero / extreme values (only for present columns)."""
    return df.agg(*_business_aggs(df))


# ---------------------------------------------------------------- E7
def series_distribution(df: DataFrame, col: str = "sales") -> DataFrame:
    """Mean and sample standard deviation."""
    return df.agg(F.avg(col).alias(f"{col}_mean"), F.stddev_samp(col).alias(f"{col}_stdev"))


# ---------------------------------------------------------------- F1 / F4 / F5
def schema_checks(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """every rule counted in one scan; all failures reported (lazy
    validation), not only the first."""
    return run_rules(df, rules)


def documented_contract_checks(df: DataFrame, rules: Sequence[Rule],
                               key: Sequence[str] = ("store_id", "sku", "date")) -> DataFrame:
    """per-row format rules plus key uniqueness (rows whose key occurs
    more than once), in one pass: the failures are counted per key with the
    rows of the key (a partial aggregate) and then added up."""
    from shelfline.functions.rules import rule_aggs, rule_structs
    per_key = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *rule_aggs(rules))
    sums = [F.coalesce(F.sum(f"_r{i}"), F.lit(0)).cast("bigint").alias(f"_r{i}") for i in range(len(rules))]
    twice = F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).cast("bigint")
    unique = F.struct(F.lit(len(rules)).alias("rule_order"), F.lit(",".join(key)).alias("column"),
                      F.lit("unique").alias("check"), F.col("_twice").alias("failures"))
    return (per_key.agg(*sums, twice.alias("_twice"))
            .select(F.inline(F.array(*rule_structs(rules), unique)))
            .withColumn("passed", F.col("failures") == 0))


# ---------------------------------------------------------------- F2
def processed_schema_checks(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """type family and not-null of each expected column (one scan for
    the null counts; types from the schema)."""
    present = [c for c in expected if c in df.columns]
    nulls = df.agg(*[count_if(F.col(c).isNull()).alias(c) for c in present]) if present else None
    actual = {f.name: type_family(f.dataType) for f in df.schema.fields}
    rows = []
    for c, fam in expected.items():
        got = actual.get(c)
        null_col = F.col(c) if c in present else F.lit(None).cast("bigint")
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(fam).alias("expected_type"),
                             F.lit(got).cast("string").alias("actual_type"),
                             F.lit(got == fam).alias("type_ok"),
                             null_col.cast("bigint").alias("null_count")))
    base = nulls if nulls is not None else df.limit(0).agg(F.count(F.lit(1)).alias("_c"))
    out = base.select(F.inline(F.array(*rows)))
    return out.withColumn("passed", F.col("type_ok") & (F.coalesce(F.col("null_count"), F.lit(1)) == 0))


# ---------------------------------------------------------------- F3
def expectation_parts(df: DataFrame, prefix: str = "_e", limits: Limits = Limits()) -> tuple[list[Column], list[Column]]:
    """The 18 expectations as (aggregate columns, result structs over the
    aggregate row), so they can share one aggregate with other checks."""
    cols = df.columns
    expected_cols = ["date", "sales", "items", "store_id", "product_category"]
    aggs = [F.count(F.lit(1)).alias(f"{prefix}n")]
    present = [c for c in expected_cols if c in cols]
    for c in present:
        aggs.append(count_if(F.col(c).isNull()).alias(f"{prefix}null_{c}"))
    checks: list[tuple[str, str, Column]] = []
    if "sales" in cols:
        checks.append(("expect_column_values_to_be_between", "sales",
                       F.col("sales").isNotNull() & ~F.col("sales").between(0, MAX_SALES)))
    if "items" in cols:
        checks.append(("expect_column_values_to_be_between", "items",
                       F.col("items").isNotNull() & ~F.col("items").between(0, MAX_ITEMS)))
    if "product_category" in cols:
        checks.append(("expect_column_values_to_be_in_set", "product_category",
                       F.col("product_category").isNotNull()
                       & ~F.col("product_category").isin(SALES_CATEGORIES)))
    if "store_id" in cols:
        checks.append(("expect_column_values_to_match_regex", "store_id",
                       F.col("store_id").isNotNull() & ~F.col("store_id").rlike(STORE_ID_PATTERN)))
    for i, (_, _, bad) in enumerate(checks):
        aggs.append(count_if(bad).alias(f"{prefix}bad_{i}"))
    if "sales" in cols:
        aggs += [F.avg("sales").alias(f"{prefix}mean_sales"), F.stddev_samp("sales").alias(f"{prefix}std_sales")]
    c = lambda name: F.col(f"{prefix}{name}")
    items = [
        ("expect_table_row_count_to_be_between", None, c("n").cast("double"), limits.rows_ok(c("n"))),
        ("expect_table_columns_to_match_ordered_list", None, F.lit(None).cast("double"),
         F.lit(cols == expected_cols)),
    ]
    for col in expected_cols:
        items.append(("expect_column_to_exist", col, F.lit(None).cast("double"), F.lit(col in cols)))
    for col in expected_cols:
        if col in present:
            items.append(("expect_column_values_to_not_be_null", col, c(f"null_{col}").cast("double"),
                          c(f"null_{col}") == 0))
        else:
            items.append(("expect_column_values_to_not_be_null", col, F.lit(None).cast("double"), F.lit(False)))
    for i, (name, col, _) in enumerate(checks):
        items.append((name, col, c(f"bad_{i}").cast("double"), c(f"bad_{i}") == 0))
    if "sales" in cols:
        items.append(("expect_column_mean_to_be_between", "sales", c("mean_sales"),
                      F.coalesce(c("mean_sales").between(0, MAX_MEAN_SALES), F.lit(False))))
        items.append(("expect_column_stdev_to_be_between", "sales", c("std_sales"),
                      F.coalesce(c("std_sales").between(0, MAX_STDEV_SALES), F.lit(False))))
    structs = [F.struct(F.lit(i).alias("expectation_order"), F.lit(name).alias("expectation"),
                        F.lit(col).cast("string").alias("column"), obs.alias("observed"), ok.alias("success"))
               for i, (name, col, obs, ok) in enumerate(items)]
    return aggs, structs


def expectation_suite(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """the 18 expectations of the retail suite.  Table-, column-map- and
    aggregate-expectations share one global aggregate; bounds are inclusive.
    Output (expectation, column, observed, success), observed being the
    unexpected-row count for row expectations."""
    aggs, structs = expectation_parts(df, limits=limits)
    return df.agg(*aggs).select(F.inline(F.array(*structs)))


# ---------------------------------------------------------------- F6
def quarantine_split(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows with the array of broken rule names).
    Both are filters of one projection; no shuffle."""
    tagged = df.withColumn("reasons", failure_reasons(rules))
    return (tagged.filter(F.size("reasons") == 0).drop("reasons"),
            tagged.filter(F.size("reasons") > 0))


def tag_quarantine(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """F6 in one frame: is_valid and the comma-joined reasons."""
    r = failure_reasons(rules)
    return df.withColumns({"is_valid": F.size(r) == 0, "reasons": F.concat_ws(",", r)})


# ---------------------------------------------------------------- F7 / F8
def _dtype_name(dt_: T.DataType) -> str:
    return PANDAS_DTYPE.get(dt_.simpleString(), dt_.simpleString())


def drift_parts(df: DataFrame, reference: dict[str, str], prefix: str = "_d") -> tuple[list[Column], list[Column]]:
    """The drift rows as (aggregate columns, result structs over the
    aggregate row): missing columns, extra columns and dtype changes against
    a reference schema, each with the rows that it touches (all rows for a
    missing column, else those with a value)."""
    actual = {f.name: _dtype_name(f.dataType) for f in df.schema.fields}
    found = [("missing_column", c, t, None) for c, t in reference.items() if c not in actual]
    found += [("extra_column", c, None, t) for c, t in actual.items() if c not in reference]
    found += [("dtype_change", c, t, actual[c]) for c, t in reference.items() if actual.get(c, t) != t]
    aggs, structs = [], []
    for i, (kind, c, expected, got) in enumerate(found):
        aggs.append(F.count(F.col(c) if c in actual else F.lit(1)).alias(f"{prefix}{i}"))
        structs.append(F.struct(
            F.lit(kind).alias("kind"), F.lit(c).alias("column"), F.lit(expected).cast("string").alias("expected"),
            F.lit(got).cast("string").alias("actual"), F.col(f"{prefix}{i}").alias("rows")))
    return aggs, structs


def schema_drift(df: DataFrame, reference: dict[str, str] = DRIFT_REFERENCE_DTYPES) -> DataFrame:
    """kind, column, expected, actual, rows (touched) and has_drift, in
    one aggregate over the data; no rows without drift."""
    aggs, structs = drift_parts(df, reference)
    if not structs:
        return df.sparkSession.createDataFrame(
            [], "kind string, column string, expected string, actual string, rows bigint, has_drift boolean")
    return df.agg(*aggs).select(F.inline(F.array(*structs))).withColumn("has_drift", F.lit(True))


def dtype_match(df: DataFrame, reference: dict[str, str] = DRIFT_REFERENCE_DTYPES) -> DataFrame:
    """F8: per present expected column 1 when its dtype is the expected one,
    else 0, and the number of values that this holds for."""
    actual = {f.name: _dtype_name(f.dataType) for f in df.schema.fields}
    present = [c for c in reference if c in actual]
    return df.agg(*[F.count(c).alias(c) for c in present]).select(F.inline(F.array(*[
        F.struct(F.lit(f"{c}_dtype_match").alias("metric"), F.lit(int(actual[c] == reference[c])).alias("value"),
                 F.col(c).alias("rows")) for c in present])))


# ---------------------------------------------------------------- F9
def threshold_gate(metrics: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """null ratio, duplicate ratio and row count against `limits`, from
    the long metrics of `quality_metrics`."""
    m = metrics.groupBy().pivot("metric", ["overall_null_ratio", "duplicate_ratio", "total_rows"]).agg(
        F.first("value"))

    def gate(name: str, observed: str, limit: float | None, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("gate"), F.col(observed).alias("observed"),
                        F.lit(limit).cast("double").alias("limit"), passed.alias("passed"))

    return m.select(F.inline(F.array(
        gate("null_ratio", "overall_null_ratio", limits.max_null_ratio,
             F.col("overall_null_ratio") <= limits.max_null_ratio),
        gate("duplicate_ratio", "duplicate_ratio", limits.max_duplicate_ratio,
             F.col("duplicate_ratio") <= limits.max_duplicate_ratio),
        gate("row_count", "total_rows", limits.max_rows, limits.rows_ok(F.col("total_rows"))))))


# ---------------------------------------------------------------- F10
def validate_all(df: DataFrame, rules: Sequence[Rule],
                 dataset: str = "retail_sales", limits: Limits = Limits(), check_drift: bool = True) -> DataFrame:
    """metrics + schema rules + expectation suite + drift stacked into
    one long frame (section, name, column, observed, success, dataset,
    overall_success).  A schema rule or expectation that fails fails the
    whole, and so does any drift row; metrics only inform.

    Two passes over the input: the metrics' group-by-all-columns aggregate
    (duplicates, null and business counts) and ONE global aggregate shared
    by every schema rule, expectation and drift row.
    The window for the overall result spans these few dozen result rows."""
    from shelfline.functions.rules import rule_aggs, rule_structs
    metrics = quality_metrics(df).select(
        F.lit("metrics").alias("section"), F.col("metric").alias("name"),
        F.lit(None).cast("string").alias("column"), F.col("value").alias("observed"),
        F.lit(None).cast("boolean").alias("success"))
    e_aggs, e_structs = expectation_parts(df, limits=limits)
    d_aggs, d_structs = drift_parts(df, DRIFT_REFERENCE_DTYPES) if check_drift else ([], [])
    wide = df.agg(*rule_aggs(rules), *e_aggs, *d_aggs)
    as_item = lambda section, name, column, observed, success: F.struct(
        F.lit(section).alias("section"), name.alias("name"), column.cast("string").alias("column"),
        observed.cast("double").alias("observed"), success.alias("success"))
    items = [as_item("schema", s_.getField("check"), s_.getField("column"), s_.getField("failures"),
                     s_.getField("failures") == 0) for s_ in rule_structs(rules)]
    items += [as_item("expectations", s_.getField("expectation"), s_.getField("column"),
                      s_.getField("observed"), s_.getField("success")) for s_ in e_structs]
    items += [as_item("drift", s_.getField("kind"), s_.getField("column"), s_.getField("rows"), F.lit(False))
              for s_ in d_structs]
    out = metrics.unionByName(wide.select(F.inline(F.array(*items))))
    overall = F.coalesce(F.min("success").over(Window.partitionBy()), F.lit(True))
    return out.withColumns({"dataset": F.lit(dataset), "overall_success": overall})


def overall_success(results: DataFrame) -> DataFrame:
    """One row: no schema rule, expectation or drift row failed."""
    return results.agg(F.coalesce(F.bool_and("success"), F.lit(True)).alias("overall_success"))


def fail_fast(results: DataFrame) -> None:
    """Gate: raise when the validation did not pass (one-row action)."""
    if not overall_success(results).first()["overall_success"]:
        raise ValueError("validation_failed")


# ---------------------------------------------------------------- B6
def metrics_long(metrics: DataFrame, dataset: str, unit_rule: str = "quality",
                 name_col: str = "metric", value_col: str = "value",
                 dims: dict[str, str] | None = None) -> DataFrame:
    """Metric rows with unit and dimensions (the dataset and any further
    `dims`, as a map).  quality: Count when the name contains "count" else
    Percent; etl: Count / Seconds (name contains "time") / None."""
    name = F.lower(F.col(name_col))
    if unit_rule == "quality":
        unit = F.when(name.contains("count"), "Count").otherwise("Percent")
    elif unit_rule == "etl":
        unit = (F.when(name.contains("count"), "Count")
                 .when(name.contains("time"), "Seconds").otherwise("None"))
    else:
        raise ValueError(unit_rule)
    out = metrics.select(F.col(name_col).alias("metric_name"), F.col(value_col).cast("double").alias("value"),
                         unit.alias("unit"), F.lit(dataset).alias("dataset"))
    if dims is None:
        return out
    pairs = [F.lit(x) for kv in {"dataset": dataset, **dims}.items() for x in kv]
    return out.withColumn("dimensions", F.create_map(*pairs))
