"""Exact dedup on an extendible-hash index kept in shared files.

Texts are equal when they are identical without white space.  Every row gets
a 64-bit key hash; the index directory is a prefix of that hash.  A bucket
that holds more than `capacity` keys is split by one more hash bit (doubling
the directory where needed) until it fits or `max_depth` bits are used; then
its keys simply chain.  Rows whose key is unique need no comparison.  For the
others the owner of the key's range compares the normalised bytes, so two
texts that share a hash become two links of that key's chain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import SPACE, with_row_id
from shelfline.session import materialize

SALTS = 8


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def directory(freq: DataFrame, capacity: int, max_depth: int) -> tuple[DataFrame, int]:
    """Directory of the index over distinct keys (column `h`), and its depth:
    one row per used slot (the key's first bits) with its bucket (the bucket's
    first slot) and the bucket's own depth.

    The directory starts at the depth that the number of keys asks for and is
    doubled while a bucket overflows.  Slots are counted a few bits deeper, so
    a doubling regroups those counts; hash bits are even, so one or two
    doublings do.  At `max_depth` (at most 2**max_depth slots) buckets may
    stay overfull.
    """
    keys = freq.count()
    start = min(max_depth, max(0, math.ceil(math.log2(max(1, keys) / capacity))))
    fine = min(max_depth, start + 6)
    slots = materialize(freq.groupBy(F.shiftrightunsigned("h", 64 - fine).alias("fine") if fine
                                     else F.lit(0).cast("long").alias("fine"))
                        .agg(F.count(F.lit(1)).alias("keys")), "dedup-slots")
    depth, leaves = start, None
    open_slots = slots
    while True:
        bucket = F.shiftright("fine", fine - depth)
        held = open_slots.groupBy(bucket.alias("prefix")).agg(F.sum("keys").alias("held"))
        fits = held.where(F.col("held") <= capacity) if depth < fine else held
        level = (open_slots.withColumn("prefix", bucket).join(fits, "prefix")
                 .select("fine", F.shiftleft("prefix", fine - depth).alias("bucket"), F.lit(depth).alias("depth")))
        leaves = level if leaves is None else leaves.unionByName(level)
        if depth == fine or not held.where(F.col("held") > capacity).head(1):
            return leaves.withColumnRenamed("fine", "slot"), fine
        open_slots = materialize(open_slots.join(leaves, "fine", "left_anti"), "dedup-split")
        depth += 1


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = 1 << 16, max_depth: int = 20) -> DataFrame:
    """One row per input row: `row_id`, the id, `keep_id` (id of the row that
    stays), `group_size`, `kept` and `text_sha256` of the normalised text.

    Of equal texts the row with the most code points in its original text
    stays, then the smallest id (null ids last), then the first row: exactly
    one row of each group.  Null texts count as empty, and all empty texts are
    one group.  Other columns of `docs` are not read.  An empty table gives an
    empty result.  `max_depth` (at most 24) bounds the directory and with it
    the broadcast (16 bytes a slot); it does not bound the number of keys.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "row_id")
    rows = (rows.withColumn("norm", normalized(F.col("text")))
            .withColumn("h", F.xxhash64("norm"))
            .withColumn("chars", F.length(F.coalesce("text", F.lit("")))))
    keys = materialize(rows.select("row_id", "doc_id", "h", F.sha2("norm", 256).alias("text_sha256")), "dedup-keys")
    freq = materialize(keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")), "dedup-frequencies")
    slots, depth = directory(freq, capacity, max_depth)
    slots = materialize(slots, "dedup-directory")
    shared = materialize(freq.where("n > 1").select("h"), "dedup-shared")

    # Owners compare bytes; copies meet in a partial aggregate before the shuffle.
    slot = F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    order = F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("z"),
                     F.col("doc_id").alias("doc_id"), F.col("row_id").alias("row_id"))
    # The semi join is salted: a hot key spreads over tasks even when it shuffles.
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chains = (rows.withColumn("salt", F.pmod("row_id", F.lit(SALTS)).cast("int"))
              .join(salted, ["h", "salt"], "left_semi")
              .groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best"))
              .withColumn("text_sha256", F.sha2("norm", 256))
              .withColumn("slot", slot)
              .withColumn("link", F.row_number().over(Window.partitionBy("h").orderBy("norm")))
              .join(F.broadcast(slots), "slot")
              .select("bucket", "depth", "h", "link", "text_sha256", "group_size",
                      F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row")))
    index = materialize(chains.repartitionByRange("bucket", "h"), "dedup-index")

    found = keys.join(index.drop("bucket", "depth", "link"), ["h", "text_sha256"], "left")
    alone = F.col("keep_row").isNull()
    return found.select(
        "row_id", "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep_row") == F.col("row_id"))).alias("kept"), "text_sha256")
