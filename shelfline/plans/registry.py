"""Registry of named queries (spark, sf_dir) -> DataFrame and their
independent DuckDB SQL, filled by the catalog_* modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLE[key] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalog module (each registers its queries)."""
    from shelfline.plans import (  # noqa: F401
        catalog_reorder, catalog_transform, catalog_quality, catalog_forecast,
        catalog_logs, catalog_io, catalog_stream, catalog_flows,
    )
