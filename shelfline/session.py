"""Session settings and the shared scratch / checkpoint location."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Keyed streaming state (limiter, job state) lives in RocksDB with changelog
# checkpoints instead of executor heap.
STATE_STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Spark 4.1 and later; earlier versions ignore it.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Settings every job relies on: UTC day boundaries, AQE for runtime
# re-planning (partition coalescing, skew-join splitting, size-checked
# broadcast), no UI server.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    **STATE_STORE_CONF,
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              app_name: str = "shelfline", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def scale_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Settings for a cluster run over `input_bytes` of input.

    Scan splits of `target_partition_bytes`; an initial shuffle partition
    count that keeps every reduce partition near the target even before AQE
    coalesces (at least 2x the cores so a wave never idles); AQE's advisory
    size equal to the target, so coalescing and skew splitting aim at the
    same partition size; broadcast only under 64 MB of measured size."""
    parts = max(2 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared, durable folder and
    is used as is; a cluster session without it is refused, since a local
    folder would be invisible to the other machines.  Only on a local master
    (tests) a fresh folder under the system temp dir is created and set.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="shelfline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return spark.conf.get("spark.checkpoint.dir", d) or d


_FOLDERS: list[str] = []         # scratch folders of this application that still exist, oldest first


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the shared checkpoint location for written
    intermediate tables (never a machine-local path on a cluster).  It is
    deleted when the application ends."""
    root = ensure_checkpoint_dir(spark)
    path = os.path.join(root.rstrip("/"), "tables", f"{name}-{uuid.uuid4().hex[:12]}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    _FOLDERS.append(path)
    return path


def materialize(df, name: str):
    """Cut lineage by writing `df` as a Parquet table in the shared scratch
    folder and reading it back: one computation of the plan (a reliable
    `checkpoint()` computes it once more to write the files) and the result
    survives executor loss.

    The shuffle files of the plan are deleted as soon as the table is written.
    Spark otherwise keeps them until the driver collects its garbage, so that
    those of all earlier steps may lie on disk beside the current one."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FREE_SHUFFLES)
        else:
            spark.conf.set(FREE_SHUFFLES, before)
    written = spark.read.parquet(path)
    written._scratch = path
    return written


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _FOLDERS:
        _FOLDERS.remove(path)


def discard(table) -> None:
    """Delete a table that `materialize` wrote, once nothing will read it."""
    _delete(table.sparkSession, table._scratch)


def scratch_mark() -> int:
    """A place in the order of scratch folders, for `discard_since`."""
    return len(_FOLDERS)


def discard_since(mark: int, kept) -> None:
    """Delete the scratch folders made since `mark` but for the written table
    `kept`, which holds all that is still needed of them."""
    for path in [p for p in _FOLDERS[mark:] if p != kept._scratch]:
        _delete(kept.sparkSession, path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make `shelfline` importable in the Python workers (grouped-map and
    streaming state functions refer to its module-level helpers): zip the
    package once per application and register it with `addPyFile`, the
    same mechanism as `--py-files` on a cluster."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="shelfline-pyfiles-"), "shelfline.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)
