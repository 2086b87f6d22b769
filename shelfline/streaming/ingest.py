"""File-triggered ETL (A5) and per-batch quality metrics.

New files under an input folder are picked up by the file stream source;
`foreachBatch` runs the batch transform chain and writes each micro-batch
to its own `batch_id=<n>` directory with overwrite, so a batch replayed
after a failure (from the checkpoint) replaces its own output instead of
duplicating it.
"""

from __future__ import annotations

import datetime as dt
import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shelfline.functions import rules as RL
from shelfline.operators import quality as Q
from shelfline.operators import transform as X
from shelfline.schemas import DAILY_SALES


def clean_chain(df: DataFrame) -> DataFrame:
    """Per-batch part of the ETL chain (C2, C3, C5): everything that is
    row-local, so batch results equal the batch job on the same rows."""
    return X.calendar_features(X.drop_incomplete(X.coerce_types(df)))


def sales_stream(spark: SparkSession, in_dir: str, schema: T.StructType = DAILY_SALES,
                 fmt: str = "csv", max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(in_dir)


def stream_ingest(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                  process: Callable[[DataFrame], DataFrame] = clean_chain,
                  schema: T.StructType = DAILY_SALES, fmt: str = "csv",
                  max_files_per_trigger: int | None = None) -> StreamingQuery:
    """A5: every newly arrived file runs the ETL chain; progress lives in
    the checkpoint.  Runs until the files present at start are processed
    (availableNow); a scheduler re-runs it for new arrivals."""
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}"))

    stream = sales_stream(spark, in_dir, schema, fmt, max_files_per_trigger)
    return (stream.writeStream.foreachBatch(run_batch)
                  .option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def stream_quality(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                   as_of: dt.date, schema: T.StructType = DAILY_SALES, fmt: str = "csv",
                   max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Quality metrics (E4-E6) and raw rule failures (F1) of every
    arriving batch, appended as (batch_id, kind, name, value) rows."""
    rules = RL.raw_rules(as_of)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        metrics = Q.quality_metrics(batch).select(
            F.lit("metric").alias("kind"), F.col("metric").alias("name"), "value")
        checks = Q.schema_checks(batch, rules).select(
            F.lit("rule").alias("kind"), F.concat_ws(":", "column", "check").alias("name"),
            F.col("failures").cast("double").alias("value"))
        (metrics.unionByName(checks)
                .write.mode("overwrite").parquet(os.path.join(out_dir, f"batch_id={batch_id}")))

    stream = sales_stream(spark, in_dir, schema, fmt, max_files_per_trigger)
    return (stream.writeStream.foreachBatch(run_batch)
                  .option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def stream_quality_state(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str,
                         schema: T.StructType = DAILY_SALES, fmt: str = "csv",
                         max_files_per_trigger: int | None = None) -> StreamingQuery:
    """N3 over all batches: every batch leaves its part of a mergeable state,
    the fingerprint counts of its rows and the moments of its sales, in a
    directory of its own (overwritten by a replay).  `fold_quality` puts the
    parts together, so rows that repeat across batches are duplicates too."""
    def run_batch(batch: DataFrame, batch_id: int) -> None:
        for name, part in (("rows", Q.fingerprint_counts(batch)), ("moments", Q.moments(batch))):
            part.write.mode("overwrite").parquet(os.path.join(out_dir, name, f"batch_id={batch_id}"))

    stream = sales_stream(spark, in_dir, schema, fmt, max_files_per_trigger)
    return (stream.writeStream.foreachBatch(run_batch)
                  .option("checkpointLocation", checkpoint)
                  .trigger(availableNow=True).start())


def fold_quality(spark: SparkSession, out_dir: str, schema: T.StructType = DAILY_SALES) -> DataFrame:
    """E4-E7 of everything that has arrived, in long form (metric, value)."""
    like = spark.createDataFrame([], schema)
    counts = Q.merge_counts(spark.read.parquet(os.path.join(out_dir, "rows")).drop("batch_id"))
    spread = Q.merge_moments(spark.read.parquet(os.path.join(out_dir, "moments")))
    return Q.metrics_of_counts(counts, like).unionByName(spread.select(F.inline(F.array(
        *(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in spread.columns)))))


def compact_quality(spark: SparkSession, out_dir: str, into: str) -> None:
    """Write the folded state as one part of a new state folder, so that a
    long-running stream's parts stay few.  Point later batches there."""
    counts = Q.merge_counts(spark.read.parquet(os.path.join(out_dir, "rows")).drop("batch_id"))
    counts.write.mode("overwrite").parquet(os.path.join(into, "rows", "batch_id=-1"))
    parts = spark.read.parquet(os.path.join(out_dir, "moments")).drop("batch_id")
    parts.coalesce(1).write.mode("overwrite").parquet(os.path.join(into, "moments", "batch_id=-1"))
