"""Small column-expression helpers (all JVM-side built-ins)."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null."""
    return F.when(den != 0, num / den)


def count_if(cond: Column) -> Column:
    """Number of rows where cond is true (null counts as not true)."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def one_row(agg_df: DataFrame) -> Row:
    """Fetch the single row of a global aggregate.

    Only for frames that are one row by construction (a `groupBy()`-less
    `agg`); the driver receives a handful of scalars, never data."""
    return agg_df.first()


def ntz_literal(value) -> Column:
    """A wall-clock timestamp literal (timestamp_ntz): independent of the
    session and the driver's time zones."""
    return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


_EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since the epoch of a timestamp column.  For a
    timestamp_ntz column the wall clock is read as UTC, so no session time
    zone (and no DST jump) enters the arithmetic."""
    dt_ = df.schema[name].dataType
    if isinstance(dt_, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), F.col(name))
    return F.unix_micros(F.col(name).cast("timestamp"))
