"""Runs of a flow as written stages: retried, resumed, and published only
after they are checked.

Every stage of a run is a table below the run's folder with a record beside it
(`<stage>.json`, written last).  A run that is started again with the same id
reads the stages that have a record and goes on with the first that has none.
What readers see is replaced only by `publish`, so a failed run leaves the old
data in place.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _read_json(spark: SparkSession, path: str) -> dict | None:
    where, fs = _fs(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
    finally:
        stream.close()


def _write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replace a small file in one step: written beside it, then renamed."""
    where, fs = _fs(spark, path)
    beside, _ = _fs(spark, os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{time.time_ns()}"))
    fs.mkdirs(where.getParent())
    stream = fs.create(beside, True)
    stream.write(bytearray(json.dumps(value).encode()))
    stream.close()
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        beside.makeQualified(fs).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(beside.makeQualified(fs), where.makeQualified(fs), how)


def publish(spark: SparkSession, path: str, table: str) -> None:
    """Make a written Parquet table the content of `path`.

    It is copied beside `path` and takes its place by two renames, so readers
    find the old data or the new, never half of it; a publication that ended
    between the two is undone by `recover`, which the next one calls first.
    (Where renames copy, as in object stores, publish to a new path instead
    and keep its name in a file of your own.)"""
    recover(spark, path)
    new, old = f"{path}.next", f"{path}.previous"
    spark.read.parquet(table).write.mode("overwrite").parquet(new)
    (at, fs), (new_at, _), (old_at, _) = _fs(spark, path), _fs(spark, new), _fs(spark, old)
    fs.mkdirs(at.getParent())
    if fs.exists(at) and not fs.rename(at, old_at):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new_at, at):
        raise OSError(f"cannot move {new} to {path}")
    fs.delete(old_at, True)


def recover(spark: SparkSession, path: str) -> None:
    """Put the data of a publication that was cut off back in its place."""
    (at, fs), (old_at, _) = _fs(spark, path), _fs(spark, f"{path}.previous")
    if fs.exists(old_at):
        if fs.exists(at):
            fs.delete(old_at, True)
        else:
            fs.rename(old_at, at)


class StageRun:
    """The stages of one run.  `retries` is how often a stage that fails is
    tried again; errors of the plan or the data (AnalysisException,
    ValueError) are not tried again."""

    def __init__(self, spark: SparkSession, folder: str, retries: int = 0):
        self.spark, self.folder, self.retries = spark, folder, retries
        self.resumed: list[str] = []

    def path(self, name: str) -> str:
        return os.path.join(self.folder, name)

    def record(self, name: str) -> dict | None:
        return _read_json(self.spark, f"{self.path(name)}.json")

    def table(self, name: str, build: Callable[[], DataFrame],
              counts: dict[str, Observation] | None = None) -> DataFrame:
        """The stage's table, built and written unless an earlier run with
        this id has finished it.  `counts` are Observations (column `rows`)
        that the write fills; the record keeps them (`rows`)."""
        if self.record(name) is not None:
            self.resumed.append(name)
            return self.spark.read.parquet(self.path(name))
        for attempt in range(self.retries + 1):
            began = time.monotonic()
            try:
                build().write.mode("overwrite").parquet(self.path(name))
                break
            except (AnalysisException, ValueError):
                raise
            except Exception:
                if attempt == self.retries:
                    raise
        rows = {k: int(o.get["rows"]) for k, o in (counts or {}).items()}
        _write_json(self.spark, f"{self.path(name)}.json", {
            "rows": rows, "seconds": round(time.monotonic() - began, 3), "attempts": attempt + 1})
        return self.spark.read.parquet(self.path(name))
