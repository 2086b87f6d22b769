"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled and queue for two rounds.  A document is
served over a span of virtual time: the words of its source before it, and
those up to its end, divided by the source's target.  All sources therefore
finish at virtual time 1.  Documents are range-sorted by virtual finish time
over all sources and the sorted stream is cut at the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfline.llm.common import count_words, running_sum, with_row_id
from shelfline.session import materialize


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_repeat: int) -> DataFrame:
    """One row per source: `source`, `rank`, `source_size` and `target`.

    Sources in code-point order (null last) get `weights` in turn and share
    `share` times all sizes by weight; a target stops at `max_repeat` times
    its source's size and the excess is shared among the rest by weight.  In
    the order of limit / weight the sources that reach their limit come first;
    a source does so if the budget left over by the limits before it, shared
    over the weights left, exceeds its own limit.  The frame has one row per
    source, so its windows sort sources, never documents.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1)
    every = Window.partitionBy(F.lit(0))
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = (sources.withColumn("rank", F.row_number().over(by_name))
              .withColumn("weight", weight)
              .withColumn("limit", max_repeat * F.col("source_size"))
              .withColumn("budget", F.lit(share) * F.sum("source_size").over(every))
              .withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0)))
                          / F.sum("weight").over(after))
              .withColumn("full", F.col("level") * F.col("weight") >= F.col("limit")))
    first = F.min(F.when(~F.col("full"), F.struct((F.col("limit") / F.col("weight")).alias("r"), "rank", "level")))
    return (ranked.withColumn("open", first.over(every))
            .withColumn("target", F.when(F.col("full"), F.col("limit").cast("double"))
                        .otherwise(F.col("open.level") * F.col("weight")))
            .select("source", "rank", "source_size", "target"))


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix_sources(docs: DataFrame, weights: list[int] = (5, 2, 1), share: float = 1.5, max_repeat: int = 2,
                seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source") -> DataFrame:
    """One row per input row: `row_id`, `doc_id`, `source`, `size` (words),
    `source_size`, `target` of its source and `taken`, the words of it that
    the mix takes (up to `max_repeat` times its size).

    The document that crosses its source's target is taken in part, so each
    source's taken words are its target rounded down.  A null text has size 0;
    a null source is a source of its own, after all others.  The order is a
    hash of id and `seed`, then id and size, so reruns agree; rows equal in
    all of these are interchangeable.  An empty table gives an empty result.
    Other columns are not read.
    """
    rows = with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                   count_words(F.col(text_col)).alias("size")), "row_id")
    sizes = materialize(rows, "mix-sizes")
    targets = materialize(source_targets(sizes, list(weights), share, max_repeat), "mix-targets")
    placed = sizes.join(targets, sizes["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    placed = placed.withColumn("_key", shuffle_key(F.col("doc_id"), seed))
    queue = running_sum(placed, ["_key", "doc_id", "size", "row_id"], "size", "_before", "rank", "mix-queue")
    packets = (queue.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
               .withColumn("_start", F.col("_before") + F.col("_round") * F.col("source_size"))
               .withColumn("served", F.greatest(F.lit(0), F.least(
                   F.col("size"), F.floor("target") - F.col("_start"))).cast("long"))
               .withColumn("finish", F.coalesce(
                   F.try_divide(F.col("_start") + F.col("served"), F.col("target")), F.lit(0.0))))
    stream = running_sum(packets, ["finish", "rank", "_round", "_key", "doc_id", "size", "row_id"],
                         "served", "_offset", None, "mix-stream")
    budget = F.lit(targets.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0])
    taken = F.greatest(F.lit(0), F.least(F.col("served"), F.ceil(budget - F.col("_offset")))).cast("long")
    per_row = stream.withColumn("taken", taken).groupBy("row_id").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "source", "size", "source_size", "target")),
        F.sum("taken").alias("taken"))
    return per_row
