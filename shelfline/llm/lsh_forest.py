"""Near duplicates by an LSH forest of MinHash signatures.

A document's signature has a row of minima for each tree of the forest.  The
trees are sorted orders of the signatures: documents whose longest common
prefix in a tree is long lie next to each other, in one region of that order.
Two documents share a minimum with a probability equal to their similarity, so
regions start at prefixes of a few minima, and a region that holds too many
documents is refined by one more minimum at a time, down to the depth of the
tree: sparse regions stay shallow, crowded ones get deep.  Documents that
share a region in any tree are candidates, and every candidate is confirmed on
the full sets.

Regions that are still crowded at full depth (groups of near copies) are not
cut off but joined exactly, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import with_row_id
from shelfline.llm.components import components
from shelfline.llm.jaccard_join import join_groups, shingles
from shelfline.llm.texthash import mix
from shelfline.session import materialize

TREES, SHALLOW, DEPTH = 24, 3, 6
LEAF = 256               # documents of a region that need no deeper prefix

SIGNED = "row_id long, doc_id long, n_shingles long, set_hash binary, signature binary"


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed hash functions: an offset and an odd factor each."""
    k = np.arange(1, n + 1, dtype=np.uint64)
    return mix(k * np.uint64(0x9E3779B97F4A7C15)), mix(k * np.uint64(0xBB67AE8584CAA73B)) | np.uint64(1)


def signature(found: np.ndarray, offsets: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least value of every hash function over a set of shingles, upper
    halves as big-endian 32-bit numbers."""
    least = np.full(len(offsets), np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(found), 4096):
        part = found[lo:lo + 4096, None]
        np.minimum(least, ((part ^ offsets) * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4")


def _signed(rows: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """Set size, hash of the set and signature of each row's shingles."""
    offsets, factors = _functions(trees * depth)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sets, signatures = [], [], []
            for text in batch.column("text"):
                found = shingles(text.as_buffer().to_pybytes() if text.is_valid else None, words)
                sizes.append(len(found))
                sets.append(xxhash.xxh3_128_digest(found.tobytes()))
                signatures.append(signature(found, offsets, factors).tobytes() if len(found) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(sets, pa.binary()), pa.array(signatures, pa.binary())],
                ["row_id", "doc_id", "n_shingles", "set_hash", "signature"])

    return rows.mapInArrow(sign, SIGNED)


def forest_regions(signed: DataFrame, trees: int, shallow: int, depth: int, leaf: int) -> DataFrame:
    """Candidates from (`row_id`, `signature`): distinct (`head`, `row_id`),
    the members of all regions with the least row id `head`."""
    width = 4 * depth
    members = signed.select("row_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.substring(F.col("signature"), t * width + 1, F.lit(width)))).alias("tree", "order"))
    out = None
    for d in range(shallow, depth + 1):
        members = members.withColumn("path", F.xxhash64("tree", F.substring("order", 1, 4 * d)))
        regions = members.groupBy("path").agg(F.count(F.lit(1)).alias("held"), F.min("row_id").alias("head"))
        regions = materialize(regions.where("held > 1"), f"forest-regions-{d}")
        placed = members.join(regions, "path")
        ready = placed if d == depth else placed.where(F.col("held") <= leaf)
        found = materialize(ready.where("row_id <> head").select("head", "row_id"), f"forest-members-{d}")
        out = found if out is None else out.unionByName(found)
        if d == depth or not regions.where(F.col("held") > leaf).head(1):
            break
        members = placed.where(F.col("held") > leaf).select("row_id", "tree", "order")
        members = materialize(members, f"forest-crowded-{d}")
    return materialize(out.union(out.select("head", F.col("head").alias("row_id"))).distinct(), "forest-groups")


def forest_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                      percent: int = 80, trees: int = TREES, shallow: int = SHALLOW, depth: int = DEPTH,
                      leaf: int = LEAF) -> DataFrame:
    """One row per input row: `row_id`, `doc_id`, `n_shingles`, `component_id`
    (the smallest id reachable by links) and `first`, true for one row of each
    component (that of the smallest id, null ids last, then the first row).

    Rows link when 100 * intersection >= percent * union of their sets of
    distinct runs of `words` words (A-Z in lower case); shorter texts have
    their whole sequence as one.  Null texts and texts without words have the
    empty set, link with nothing and are components of their own.  Rows with
    equal sets, copies among them, are represented by one.  Links are
    confirmed on full sets, so none is wrong.  A pair of similarity s in a
    sparse region is missed with probability (1 - s**shallow)**trees, 5e-9 for
    the defaults at 0.85; in a crowded one with (1 - s**depth)**trees, 1e-5.
    Other columns are not read; an empty table gives an empty result.  A text,
    however long, must fit one task.
    """
    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                       "row_id")
    signed = materialize(_signed(rows.select("row_id", "doc_id", "text"), words, trees, depth), "forest-signatures")
    reps = materialize(signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min("row_id").alias("rep")),
                       "forest-sets")
    chosen = signed.select("row_id", "signature").join(
        reps.select(F.col("rep").alias("row_id")).hint("merge"), "row_id", "left_semi")
    groups = forest_regions(chosen, trees, shallow, depth, leaf)

    # The same join at every size: sides that are small here grow with the input.
    texts = materialize(rows.select("row_id", "text").join(groups.hint("merge"), "row_id").select(
        F.col("head").alias("root"), "row_id", "text"), "forest-texts")
    links = join_groups(texts, words, percent)
    parts = materialize(components(links), "forest-components")

    placed = materialize(reps.join(parts, F.col("rep") == F.col("node"), "left").select(
        "set_hash", F.coalesce("root", "rep").alias("root")), "forest-placed")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("row_id"))
    # Copies meet in partial aggregates, by set and then by component.
    least = signed.where("n_shingles > 0").groupBy("set_hash").agg(F.min(order).alias("least")).join(placed, "set_hash")
    least = materialize(least.select("set_hash", "root", "least"), "forest-least")
    known = materialize(least.select("set_hash", "root").join(
        least.groupBy("root").agg(F.min("least").alias("least")), "root").select("set_hash", "least"), "forest-known")
    out = signed.select("row_id", "doc_id", "n_shingles", "set_hash").join(known, "set_hash", "left")
    empty = F.col("n_shingles") == 0
    return out.select("row_id", "doc_id", "n_shingles",
                      F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
                      (empty | (F.col("row_id") == F.col("least.row_id"))).alias("first"))
