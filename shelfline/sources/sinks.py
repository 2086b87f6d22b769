"""Sinks (B1-B5): partitioned Parquet, write with statistics, zone layout,
configurable format, validation report."""

from __future__ import annotations

import datetime as dt
import os
from typing import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from shelfline.functions.columns import ntz_literal

ZONES = ("bronze", "silver", "gold")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str] = ("year", "month"),
                      files_per_partition: int = 4, mode: str = "overwrite") -> None:
    """B1: Parquet partitioned by `by`.

    Rows are hash-distributed on the partition columns plus a small salt,
    so each task writes into one directory (few open files) while a hot
    month is still spread over `files_per_partition` tasks instead of one."""
    by = list(by)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files_per_partition))
    (df.repartition(*[F.col(c) for c in by], salt)
       .write.mode(mode).partitionBy(*by).parquet(path))


def save_with_stats(spark: SparkSession, df: DataFrame, path: str, fmt: str = "parquet",
                    compression: str = "snappy") -> DataFrame:
    """B2: write and report rows_saved (counted during the write with an
    Observation, no second pass), columns_saved, file_size and success."""
    obs = Observation("save_stats")
    observed = df.observe(obs, F.count(F.lit(1)).alias("rows"))
    observed.write.mode("overwrite").format(fmt).option("compression", compression).save(path)
    rows = obs.get["rows"]
    size = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
                 .load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()["b"])
    return spark.createDataFrame(
        [(int(rows), len(df.columns), int(size), True, path)],
        "rows_saved bigint, columns_saved int, file_size bigint, success boolean, output_path string")


def write_zone(df: DataFrame, root: str, zone: str, by: Sequence[str] = ()) -> str:
    """Write a frame into a medallion zone (bronze = raw, silver =
    cleaned, gold = aggregates) below a root path."""
    if zone not in ZONES:
        raise ValueError(f"unknown zone {zone}")
    path = os.path.join(root, zone)
    if by:
        write_partitioned(df, path, by)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def write_as(df: DataFrame, path: str, fmt: str = "parquet", compression: str = "snappy",
             mode: str = "overwrite") -> None:
    """Format and compression chosen by configuration."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"unsupported output format {fmt}")
    w = df.write.mode(mode).format(fmt).option("compression", compression)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_report(results: DataFrame, path: str, dataset: str, as_of: dt.datetime) -> None:
    """Timestamped validation report as JSON lines (one object per
    result row with the report metadata), appended under dataset=<name>."""
    rep = results.withColumns({"dataset": F.lit(dataset),
                               "report_time": ntz_literal(as_of)})
    (rep.select("dataset", F.to_json(F.struct(*[c for c in rep.columns if c != "dataset"])).alias("value"))
        .write.mode("append").partitionBy("dataset").text(path))


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.text(path)
    return raw.select(F.from_json("value", schema).alias("r"), "dataset").select("r.*", "dataset")
