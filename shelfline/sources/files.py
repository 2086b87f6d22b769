"""File sources (A1-A4): typed reads by suffix, remote URIs, listings, typed conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.functions.rules import Rule, failure_reasons
from shelfline.schemas import DAILY_SALES
from shelfline.session import materialize

SUPPORTED_FORMATS = ("csv", "parquet", "json")


def format_of(path: str) -> str:
    """Format chosen by suffix (.csv, .parquet, .json); anything else is
    rejected, as the reference's upload endpoint does."""
    base = path.rstrip("/").lower()
    for fmt in SUPPORTED_FORMATS:
        if base.endswith("." + fmt):
            return fmt
    raise ValueError(f"Unsupported file type: {path}")


def read_sales(spark: SparkSession, path: str, fmt: str | None = None,
               schema: T.StructType = DAILY_SALES, corrupt_column: str | None = None) -> DataFrame:
    """A1: read with an explicit schema (never inferred).  CSV has a header;
    malformed CSV/JSON rows keep their text in `corrupt_column` when given
    (PERMISSIVE mode), else the bad fields become null."""
    fmt = fmt or format_of(path)
    if fmt not in SUPPORTED_FORMATS:
        raise ValueError(f"Unsupported file type: {fmt}")
    reader = spark.read.schema(schema)
    if fmt == "parquet":
        return reader.parquet(path)
    if corrupt_column:
        schema = T.StructType(schema.fields + [T.StructField(corrupt_column, T.StringType())])
        reader = spark.read.schema(schema).option("columnNameOfCorruptRecord", corrupt_column)
    # Records are judged by all their fields, whichever are selected later.
    reader = reader.option("mode", "PERMISSIVE").option("columnPruning", not corrupt_column)
    if fmt == "csv":
        return reader.option("header", True).csv(path)
    return reader.json(path)


RAW_RECORD = "_record"
MALFORMED = "malformed"


def read_tagged(spark: SparkSession, path: str, rules: Sequence[Rule], fmt: str | None = None,
                schema: T.StructType = DAILY_SALES) -> DataFrame:
    """A1 / A2 into F6: every CSV or JSON record under a path or URI with its
    fields, `is_valid`, `reasons`, `source_file` and `_record`.

    A record that does not parse (a field of the wrong type, too few or too
    many fields, broken JSON) has the reason "malformed" and its text in
    `_record`; no rule is applied to what could be read of it.  Any other
    record has the names of the rules that it breaks.  Every record is in
    exactly one group; blank lines and CSV headers are no records."""
    reader_fmt = fmt or format_of(path)
    if reader_fmt == "parquet":
        raise ValueError("Parquet files hold no malformed records")
    rows = read_sales(spark, path, fmt, schema, RAW_RECORD).withColumn("source_file", F.col("_metadata.file_path"))
    broken = F.col(RAW_RECORD).isNotNull()
    reasons = F.when(broken, F.array(F.lit(MALFORMED))).otherwise(failure_reasons(rules))
    return rows.withColumns({"is_valid": ~broken & (F.size(failure_reasons(rules)) == 0),
                             "reasons": F.concat_ws(",", reasons)})


def split_rejects(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejects) of `read_tagged`, which is written once, so the
    files are parsed once.  Rejects are (source_file, record, reasons): the
    record as it was read or, where only rules broke, its fields as JSON."""
    tagged = materialize(tagged, "tagged")
    fields = [c for c in tagged.columns if c not in ("is_valid", "reasons", "source_file", RAW_RECORD)]
    rejects = tagged.where(~F.col("is_valid")).select(
        "source_file", F.coalesce(F.col(RAW_RECORD), F.to_json(F.struct(*fields))).alias("record"), "reasons")
    return tagged.where("is_valid").select(*fields), rejects


def read_remote_sales(spark: SparkSession, uri: str, fmt: str | None = None,
                      schema: T.StructType = DAILY_SALES) -> DataFrame:
    """A2: read any Hadoop-compatible URI (s3a://, hdfs://, file://) with
    the format chosen by suffix and a given schema (never inferred); the
    per-row source file is kept."""
    fmt = fmt or format_of(uri)
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.format(fmt).load(uri)
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def list_source_files(spark: SparkSession, glob: str, limit: int | None = None) -> DataFrame:
    """A3: the files under a glob by path (the first `limit`, if given); the
    binaryFile source is used for its listing only (content is never
    selected, so no file is read)."""
    files = (spark.read.format("binaryFile").load(glob)
             .select("path", "length", "modificationTime").orderBy("path"))
    return files if limit is None else files.limit(limit)


def typed_convert(df: DataFrame) -> DataFrame:
    """A4: date -> timestamp (without time zone, like the reference's naive
    datetime64), ids -> string, counts -> int32, price -> double."""
    return df.select(
        F.col("store_id").cast("string").alias("store_id"),
        F.col("sku").cast("string").alias("sku"),
        F.col("date").cast("timestamp_ntz").alias("date"),
        F.col("units_sold").cast("int").alias("units_sold"),
        F.col("price").cast("double").alias("price"),
        F.col("on_hand").cast("int").alias("on_hand"),
    )


def write_typed_parquet(df: DataFrame, path: str) -> None:
    """A4 sink: snappy Parquet."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
