"""Exact Jaccard join of documents on word shingles, as a metric-space join.

One minus Jaccard similarity is a metric.  The first pivots are the shingles
themselves, as one-element sets, in one global order (rare ones first): a
document belongs to the region of the first pivot that it holds.  A document
within the join's radius may lack some of these, but no more than the radius
allows, so by the triangle inequality it is enough to replicate a document to
the regions of its first n - ceil(t n) + 1 pivots; every linked pair meets in
the region of its first common pivot.  Size is the distance to the empty set
and gives a second window.  Regions with the same least document are joined
together, and no others: overlapping regions never chain.  Within them
documents serve as pivots, regions are split again by the nearest pivot with
windows of twice the radius, and what is left is compared exactly.  Groups too
large for a task are first cut down by pivots over all their blocks.

Documents taken as first pivots do not work on text: nearly all distances are
close to 1, so windows replicate every document everywhere.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import with_row_id
from shelfline.llm.components import components
from shelfline.llm.shared_hashes import REPORT, chunk_count, joined, report, shared_hashes
from shelfline.llm.texthash import run_hashes, split_words, word_hashes
from shelfline.session import materialize

SAMPLE = np.uint64(3)            # shingles whose low bits are 0 are counted; a quarter
LEAF = 512                       # documents of a region that are compared at once
MOST_DOCS, MOST_BYTES = 512, 32 << 20    # of a group, or of small groups together, that one task joins
PIVOTS = 32                      # expected documents of a larger group that serve as pivots


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `words` words of a text with A-Z
    in lower case; the whole sequence if it is shorter; nothing without words."""
    hashes = word_hashes(split_words(text.lower() if text else None))
    if not len(hashes):
        return hashes
    return np.unique(run_hashes(hashes, min(words, len(hashes)), 1))


def prefix(found: np.ndarray, known: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """A document's windowed pivots: the first of its shingles in the global
    order (counted ones by number of documents, then the others; ties by
    hash), without those that no other document holds."""
    n = len(found)
    if not n:
        return found
    number = np.full(n, 1 << 40, dtype=np.int64)
    counted = found & SAMPLE == 0
    number[counted] = 1
    if len(known):
        at = np.minimum(np.searchsorted(known, found), len(known) - 1)
        hit = known[at] == found
        number[hit] = counts[at[hit]]
    first = np.lexsort((found, number))[:n - -(-percent * n // 100) + 1]
    return found[first[number[first] > 1]]


class Region:
    """Documents of one group, as rows of terms that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        values, terms, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        number = np.cumsum(shared) - 1
        owner = np.repeat(np.arange(len(sets)), self.sizes)[shared[terms]]
        self.terms = number[terms[shared[terms]]]
        self.n_terms = int(shared.sum())
        self.edges = np.searchsorted(owner, np.arange(len(sets) + 1))
        self.root = np.arange(len(sets))

    def own(self, i: int) -> np.ndarray:
        return self.terms[self.edges[i]:self.edges[i + 1]]

    def overlap(self, docs: np.ndarray, pivot: int) -> np.ndarray:
        """Shared terms of each of `docs` with one document."""
        held = np.zeros(self.n_terms, dtype=np.int64)
        held[self.own(pivot)] = 1
        sums = np.concatenate([[0], np.cumsum(held[self.terms])])
        return sums[self.edges[docs + 1]] - sums[self.edges[docs]]

    def merge(self, docs: np.ndarray, linked: np.ndarray) -> None:
        """Give each of `docs` the least root of its part of a link matrix."""
        label = self.root[docs]
        while True:
            new = np.minimum(label, np.where(linked, label[None, :], len(self.root)).min(axis=1))
            if (new == label).all():
                break
            label = new
        for old, least in set(zip(self.root[docs].tolist(), label.tolist())):
            a, b = self.find(old), self.find(least)
            self.root[max(a, b)] = min(a, b)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = i = self.root[self.root[i]]
        return i

    def compare(self, docs: np.ndarray) -> None:
        """All pairs of `docs`, by products of 0/1 blocks."""
        both = np.zeros((len(docs), len(docs)), dtype=np.float32)
        rows = np.repeat(np.arange(len(docs)), self.edges[docs + 1] - self.edges[docs])
        terms = np.concatenate([self.own(i) for i in docs.tolist()])
        _, terms, counts = np.unique(terms, return_inverse=True, return_counts=True)
        shared = counts > 1
        rows, terms = rows[shared[terms]], (np.cumsum(shared) - 1)[terms[shared[terms]]]
        order = np.argsort(terms, kind="stable")
        rows, terms = rows[order], terms[order]
        width = 4096
        for lo in range(0, int(shared.sum()), width):
            a, b = np.searchsorted(terms, [lo, lo + width])
            block = np.zeros((len(docs), width), dtype=np.float32)
            block[rows[a:b], terms[a:b] - lo] = 1
            both += block @ block.T
        inter = both.astype(np.int64)
        size = self.sizes[docs]
        linked = 100 * inter >= self.percent * (size[:, None] + size[None, :] - inter)
        for i in docs.tolist():
            self.root[i] = self.find(i)
        self.merge(docs, linked)

    def join(self, docs: np.ndarray) -> None:
        """Split by nearest pivots and windows while that makes parts smaller."""
        if len(docs) > LEAF:
            pivots = docs[np.linspace(0, len(docs) - 1, 16).astype(int)]
            inter = np.stack([self.overlap(docs, p) for p in pivots.tolist()], axis=1)
            far = 1 - inter / (self.sizes[docs][:, None] + self.sizes[pivots][None, :] - inter)
            near = far.min(axis=1)
            radius = 1 - self.percent / 100
            inside = far <= near[:, None] + 2 * radius + 1e-9
            if inside.sum() <= 2 * len(docs) and inside.sum(axis=0).max() <= 0.8 * len(docs):
                for k in range(len(pivots)):
                    self.join(docs[inside[:, k]])
                return
        if len(docs) > 1:
            self.compare(docs)

    def links(self) -> list[tuple[int, int]]:
        """(document, root) for all documents that are not roots."""
        self.join(np.argsort(self.sizes, kind="stable"))
        return [(i, r) for i in range(len(self.sizes)) if (r := self.find(i)) != i]


FOUND = "row_id long, n_shingles long, text string, region long, size long"


def _large_groups(texts: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Join groups that are too large for a task: (links found, tasks left).

    A few documents of each group serve as pivots, and all others, in blocks,
    are compared with them.  Documents within the radius of connected pivots
    are connected, so of the links that are left only those with a document
    outside the group's main component matter: its blocks, bounded like the
    group's by documents and by bytes, are joined with each other and with
    every block that holds part of the main component.  A document may lie in
    several groups.  A group of copies of
    one text is thus done after one pass, whatever its size.  Pivots of one
    group stay within `MOST_BYTES` in expectation too.
    """
    texts = texts.withColumn("block", F.pmod(F.xxhash64("row_id"), F.col("blocks")))
    drawn = F.least(F.lit(PIVOTS), F.ceil(MOST_BYTES * F.col("n") / F.col("bytes")))
    pivots = (texts.where(F.pmod(F.xxhash64("row_id", F.lit(7)), F.col("n")) < drawn)
              .select("root", "row_id", "text", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
                      .alias("block")))
    pivots = materialize(pivots, "jaccard-large")

    def near(own: pa.Table, pivots: pa.Table) -> pa.Table:
        tables = [t.select(["row_id", "text"]).combine_chunks() for t in (pivots, own)]
        ids = sum((t["row_id"].to_pylist() for t in tables), [])
        sets = [shingles(t.as_buffer().to_pybytes(), words) for x in tables for t in x["text"]]
        u, v = [], []
        if sets:
            region, every = Region(sets, percent), np.arange(len(sets))
            for p in range(pivots.num_rows):
                inter = region.overlap(every, p)
                union = region.sizes + region.sizes[p] - inter
                for i in np.flatnonzero(100 * inter >= percent * union).tolist():
                    a, b = region.find(i), region.find(p)
                    region.root[max(a, b)] = min(a, b)
            # One link for each document that a pivot reaches connects them all.
            for i in range(len(sets)):
                if ids[i] != ids[region.find(i)]:
                    u.append(ids[i])
                    v.append(ids[region.find(i)])
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    found = materialize(texts.select("root", "block", "row_id", "text").groupBy("root", "block").cogroup(
        pivots.groupBy("root", "block")).applyInArrow(near, "u long, v long"), "jaccard-pivots")
    parts = components(found).withColumnRenamed("root", "part")
    placed = materialize(texts.select("row_id", "root", "block", F.octet_length("text").alias("bytes")).join(
        parts, F.col("row_id") == F.col("node"), "left").select(
        "row_id", "root", "block", "bytes", F.coalesce("part", "row_id").alias("part")), "jaccard-parts")
    main = placed.groupBy("root", "part").agg(F.count(F.lit(1)).alias("count"), F.sum("bytes").alias("bytes"))
    main = main.groupBy("root").agg(
        F.max_by("part", F.struct("count", "part")).alias("main"),
        (F.sum("count") - F.max("count")).alias("docs"),
        (F.sum("bytes") - F.max_by("bytes", F.struct("count", "part"))).alias("bytes"))
    main = materialize(main.select("root", "main", F.greatest(
        F.ceil(F.col("docs") / MOST_DOCS), F.ceil(F.col("bytes") / MOST_BYTES)).alias("rests")), "jaccard-main")
    cores = placed.join(main, "root").where("part = main").groupBy("root").agg(F.collect_set("block").alias("cores"))
    main = materialize(main.join(cores, "root"), "jaccard-cores")
    known = placed.join(main, "root").select("root", "row_id", "rests", "cores",
                                             (F.col("part") == F.col("main")).alias("core"))
    rows = texts.select("root", "row_id", "text", "block", "blocks").join(known, ["root", "row_id"]).where("rests > 0")
    rest = F.pmod(F.xxhash64("row_id"), F.col("rests"))
    rows = rows.withColumn("mine", F.when(F.col("core"), F.col("rests") + F.col("block")).otherwise(rest))
    # Blocks 0 to rests - 1 hold the rest, those from `rests` on the core.
    others = F.expr("case when core then sequence(0L, rests - 1) "
                    "else filter(concat(sequence(0L, rests - 1), transform(cores, x -> rests + x)), "
                    "x -> x <> mine) end")
    tasks = rows.withColumn("other", F.explode(others))
    return found, tasks.select("root", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"),
                               "row_id", "text")


def join_groups(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (`u`, `v`, connecting all that are linked) between the documents
    of each group, from rows (`root`, `row_id`, `text`) of a written table.

    Small groups are dealt to tasks together, where a document that is in
    several of them is cut into shingles once; large ones go block by block.
    """
    weights = texts.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    blocks = materialize(weights.withColumn("blocks", F.greatest(
        F.ceil(F.col("n") / MOST_DOCS), F.ceil(F.col("bytes") / MOST_BYTES))), "jaccard-blocks")
    small, large = blocks.where("blocks = 1"), blocks.where("blocks > 1")
    docs, size = small.agg(F.sum("n"), F.sum("bytes")).first()
    tasks = max(1, -(-(docs or 0) // (2 * MOST_DOCS)), -(-(size or 0) // (MOST_BYTES // 2)))

    def link(table: pa.Table) -> pa.Table:
        sets: dict[int, np.ndarray] = {}
        held: dict[int, list[int]] = {}
        roots = table["root"].to_pylist() if "root" in table.column_names else [0] * table.num_rows
        for root, i, text in zip(roots, table["row_id"].to_pylist(), table["text"]):
            if i not in sets:
                sets[i] = shingles(text.as_buffer().to_pybytes(), words)
            held.setdefault(root, []).append(i)
        u, v = [], []
        for ids in held.values():
            if len(ids) == 2:                            # most groups
                a, b = sets[ids[0]], sets[ids[1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                pairs = [(0, 1)] if 100 * both >= percent * (len(a) + len(b) - both) else []
            else:
                pairs = Region([sets[i] for i in ids], percent).links() if len(ids) > 1 else []
            u += [ids[i] for i, _ in pairs]
            v += [ids[r] for _, r in pairs]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    links = (texts.join(small.select("root"), "root", "left_semi")
             .select("root", "row_id", "text", F.pmod(F.xxhash64("root"), F.lit(tasks)).alias("task"))
             .groupBy("task").applyInArrow(link, "u long, v long"))
    if large.head(1):
        near, more = _large_groups(texts.join(large, "root"), words, percent)
        blockwise = more.select(F.struct("root", "a", "b").alias("pair"), "row_id", "text").groupBy("pair")
        links = links.unionByName(near).unionByName(blockwise.applyInArrow(link, "u long, v long"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3,
                    percent: int = 90) -> DataFrame:
    """One row per input row: `row_id`, `doc_id`, `n_shingles`, `component_id`
    (the smallest id reachable by links) and `first`, true for one row of each
    component (that of the smallest id, null ids last, then the first row).

    Rows link when 100 * intersection >= percent * union of their shingle
    sets.  Null texts and texts without words have the empty set, link with
    nothing and are components of their own.  Equal texts are represented by
    one row and repeated rows share its component.  Other columns are not
    read; an empty table gives an empty result.  A text must fit one task.
    """
    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                       "row_id")
    keys = materialize(rows.select("row_id", "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key")),
                       "jaccard-keys")
    order = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id"), F.col("row_id"))
    reps = materialize(keys.groupBy("key").agg(F.min(order).alias("rep"))
                       .select("key", F.col("rep.row_id").alias("rep"), F.col("rep.doc_id").alias("rep_doc")),
                       "jaccard-texts")

    chunks = chunk_count(docs, text_col)
    buckets = max(1, chunks // 2)

    def chunk_of(c):
        return F.pmod(F.xxhash64(c), F.lit(chunks))

    dealt = rows.select("row_id", "text", chunk_of("row_id").alias("chunk")).repartition("chunk")
    chosen = reps.select(chunk_of("rep").alias("chunk"), F.col("rep").alias("row_id"))

    def own_sets(table: pa.Table, wanted: pa.Table):
        wanted = set(wanted["row_id"].to_pylist())
        for i, row_id in enumerate(table["row_id"].to_pylist()):
            if row_id in wanted:
                text = table["text"][i]
                yield row_id, text, shingles(text.as_buffer().to_pybytes() if text.is_valid else None, words)

    def report_shingles(table: pa.Table, wanted: pa.Table) -> pa.Table:
        found = [s[s & SAMPLE == 0] for _, _, s in own_sets(table, wanted)]
        chunk = table["chunk"][0].as_py() if table.num_rows else 0
        return _table(report(chunk, buckets, np.concatenate(found) if found else np.zeros(0, np.uint64)), REPORT)

    def find_regions(table: pa.Table, known: pa.Table) -> pa.Table:
        hashes, counts = joined(known["hashes"], np.uint64), joined(known["counts"], np.uint32)
        by_hash = np.argsort(hashes)
        hashes, counts = hashes[by_hash], counts[by_hash]
        out: dict[str, list] = {n: [] for n in ("row_id", "n_shingles", "text", "region", "size")}
        for row_id, text, found in own_sets(table, known):
            pivots = prefix(found, hashes, counts, percent).view(np.int64).tolist()
            out["row_id"] += [row_id] * (1 + len(pivots))
            out["n_shingles"] += [len(found)] + [None] * len(pivots)
            out["text"] += [text.as_py() if pivots else None] + [None] * len(pivots)
            out["region"] += [None] + pivots
            out["size"] += [None] + [len(found)] * len(pivots)
        return _table(out, FOUND)

    reports = dealt.groupBy("chunk").cogroup(chosen.groupBy("chunk")).applyInArrow(report_shingles, REPORT)
    answers = shared_hashes(reports).select("chunk", F.lit(None).cast("long").alias("row_id"), "hashes", "counts")
    told = answers.unionByName(chosen, allowMissingColumns=True)
    found = materialize(dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(find_regions, FOUND),
                        "jaccard-regions")

    # Size windows: linked sizes differ by at most one band.
    band = F.floor(F.log(F.col("size")) / (1.0001 * math.log(100 / percent)))
    members = (found.where("region is not null")
               .select("row_id", "region", F.explode(F.array(band, band + 1)).alias("band")))
    regions = members.groupBy("region", "band").agg(F.min("row_id").alias("head"), F.count(F.lit(1)).alias("n"))
    regions = materialize(regions.where("n > 1").drop("n"), "jaccard-heads")
    groups = materialize(members.join(regions, ["region", "band"]).select(F.col("head").alias("root"), "row_id")
                         .distinct(), "jaccard-groups")
    texts = found.where("text is not null").select("row_id", "text").join(groups.hint("merge"), "row_id")
    texts = materialize(texts.select("root", "row_id", "text"), "jaccard-grouped")
    links = join_groups(texts, words, percent)
    parts = materialize(components(links), "jaccard-components")

    sizes = found.where("n_shingles is not null").select(F.col("row_id").alias("rep"), "n_shingles")
    placed = (reps.join(sizes, "rep").join(parts, F.col("rep") == F.col("node"), "left")
              .withColumn("root", F.coalesce("root", "rep")).drop("node"))
    placed = materialize(placed, "jaccard-placed")
    least = placed.groupBy("root").agg(F.min(F.struct(
        F.col("rep_doc").isNull().alias("z"), F.col("rep_doc").alias("doc"), F.col("rep").alias("row"))).alias("least"))
    known = materialize(placed.join(least, "root").select("key", "n_shingles", "least"), "jaccard-known")
    empty = F.col("n_shingles") == 0
    return keys.join(known, "key").select(
        "row_id", "doc_id", "n_shingles",
        F.when(empty, F.col("doc_id")).otherwise(F.col("least.doc")).alias("component_id"),
        (empty | (F.col("row_id") == F.col("least.row"))).alias("first"))


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _table(columns: dict[str, list], ddl: str) -> pa.Table:
    fields = [x.split() for x in ddl.split(", ")]
    return pa.table({n: pa.array(columns[n], _ARROW[t]) for n, t in fields})
