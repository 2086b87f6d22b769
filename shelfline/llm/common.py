"""Helpers shared by the operators: the word pattern, one-row bindings, row
identities, and running sums over a distributed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.session import materialize

# Fixed by the query contracts: white space and words.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with `value` evaluated once per row.  (Inside lambdas
    an expression is evaluated again for each element; a bound variable is
    not.)"""
    return F.transform(F.array(value), body).getItem(0)


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    while name in df.columns:
        name += "_"
    return name


def _scanned(df: DataFrame) -> bool:
    """Whether each row of `df` is one row of a Parquet scan: nothing but
    filters and projections stand above the scan."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    nodes = [line.lstrip(" :+-") for line in lines if line.strip()]
    return (all(n.startswith(("Project ", "Filter ")) for n in nodes[:-1])
            and nodes[-1].startswith("Relation ") and nodes[-1].endswith(" parquet"))


def stable(df: DataFrame) -> DataFrame:
    """`df` with rows that can be told apart by their place in the files they
    are read from: a plain Parquet scan is; anything else is written."""
    return df if _scanned(df) else materialize(df, "rows")


def with_row_id(df: DataFrame, name: str) -> DataFrame:
    """Add a row identity (a long from 0 up) that is unique even if ids repeat
    or are null.  It is made of the row's file and its place in that file, so
    every scan gives the same ids, however the files are cut into tasks and
    however many cores there are.

    The low bits hold the place, as many as the longest file needs, the others
    a hash of the file's path; a seed is sought under which no two files share
    one, so ids never collide.  Only the files' row counts are read for that.
    """
    df = stable(df)
    files = materialize(df.select(df.metadataColumn("_metadata")["file_path"].alias("path"),
                                  df.metadataColumn("_metadata")["row_index"].alias("place"))
                        .groupBy("path").agg(F.max("place").alias("last")), "row-files")
    n, last = files.agg(F.count("path"), F.max("last")).first()
    low = max(1, int(last or 0).bit_length())

    def number(path: Column, seed: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(path, F.lit(seed)), low + 1)

    seed = 0
    while n > 1 and files.select(number(F.col("path"), seed)).distinct().count() < n:
        seed += 1
    where = df.metadataColumn("_metadata")
    return df.withColumn(name, F.shiftleft(number(where["file_path"], seed), low).bitwiseOR(where["row_index"]))


def running_sum(df: DataFrame, order: list[str], value: str, out: str,
                key: str | None = None, name: str = "order") -> DataFrame:
    """Add `out`: the sum of `value` over all rows before this one, in the
    order of `order` (within each `key`, when given).

    Rows are range-partitioned by (key, order), so neither a hot key nor the
    global order meets in one task: each partition sums its own rows, and only
    the partition totals (one row per partition and key) are summed across.
    """
    keys = [key] if key else []
    part = materialize(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), name)
    totals = part.groupBy(*keys, "_part").agg(F.sum(value).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (part.withColumn("_in", F.coalesce(F.sum(value).over(within), F.lit(0)))
            .join(base, [*keys, "_part"])
            .withColumn(out, F.col("_base") + F.col("_in"))
            .drop("_part", "_in", "_base"))
