"""Which 64-bit (or 128-bit) hashes occur more than once in a corpus.

The corpus is dealt into chunks of bounded size.  A chunk reports each of its
distinct hashes once, with its count, packed into one binary row per bucket of
hash values; a bucket's owner adds the counts up and returns to every chunk
those of its hashes that occur twice or more in all.  A hash that fills a third
of the corpus is therefore one entry per chunk, and nothing passes through the
driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "bucket long, chunk long, hashes binary, seconds binary, counts binary"
ANSWER = "chunk long, hashes binary, seconds binary, counts binary"
LEAST_CHUNK, MOST_CHUNK, MANY_CHUNKS = 8 << 20, 128 << 20, 2000


def chunk_count(docs: DataFrame, text_col: str) -> int:
    """Number of chunks: about 8 MB of text each, growing to 128 MB on a large
    corpus so that reports stay few and long."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    size = min(MOST_CHUNK, max(LEAST_CHUNK, total // MANY_CHUNKS))
    return max(1, -(-total // size))


def _groups(a: np.ndarray, b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal values (or pairs) together, ascending in
    `a`, and the places in it where a new one starts."""
    order = np.argsort(a)
    new = np.concatenate([[True], a[order[1:]] != a[order[:-1]]]) if len(a) else np.zeros(0, dtype=bool)
    if b is not None and len(a) and (~new[1:] & (b[order[1:]] != b[order[:-1]])).any():
        order = np.lexsort((b, a))                   # some first halves collide
        new[1:] = (a[order[1:]] != a[order[:-1]]) | (b[order[1:]] != b[order[:-1]])
    return order, np.flatnonzero(new)


def distinct_counts(a: np.ndarray, b: np.ndarray | None = None):
    """Distinct values of `a` (or pairs of `a` and `b`), ascending, and how
    often each occurs."""
    order, at = _groups(a, b)
    n = np.diff(np.append(at, len(a)))
    return a[order[at]], None if b is None else b[order[at]], np.minimum(n, 0xFFFFFFFF).astype(np.uint32)


def find_pairs(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y) are among the pairs (a, b), `a` ascending."""
    hit = np.zeros(len(x), dtype=bool)
    at = np.searchsorted(a, x)
    open_ = np.flatnonzero(at < len(a))
    while len(open_):
        open_ = open_[a[at[open_]] == x[open_]]
        hit[open_] |= b[at[open_]] == y[open_]
        at[open_] += 1
        open_ = open_[(at[open_] < len(a)) & ~hit[open_]]
    return hit


def report(chunk: int, buckets: int, a: np.ndarray, b: np.ndarray | None = None) -> dict[str, list]:
    """Columns of the rows by which a chunk reports its hashes."""
    a, b, n = distinct_counts(a, b)
    # Buckets are ranges of the first hash, so each is a slice.
    step = (1 << 64) // buckets + 1
    edges = np.searchsorted(a, np.array([min(i * step, (1 << 64) - 1) for i in range(buckets)], dtype=np.uint64))
    edges = np.append(edges, len(a)).tolist()
    rows: dict[str, list] = {"bucket": [], "chunk": [], "hashes": [], "seconds": [], "counts": []}
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        if lo < hi:
            rows["bucket"].append(i)
            rows["chunk"].append(chunk)
            rows["hashes"].append(a[lo:hi].tobytes())
            rows["seconds"].append(None if b is None else b[lo:hi].tobytes())
            rows["counts"].append(n[lo:hi].tobytes())
    return rows


def joined(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The arrays packed into a binary column, end to end."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x is not None), dtype=dtype)


def _answer(table: pa.Table) -> pa.Table:
    a, n = joined(table["hashes"], np.uint64), joined(table["counts"], np.uint32)
    b = joined(table["seconds"], np.uint64) if table["seconds"].null_count == 0 else None
    order, at = _groups(a, b)
    sums = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
    total = np.empty(len(a), dtype=np.int64)
    total[order] = np.repeat(sums, np.diff(np.append(at, len(a))))
    out: dict[str, list] = {"chunk": [], "hashes": [], "seconds": [], "counts": []}
    start = 0
    for chunk, size in zip(table["chunk"].to_pylist(), pc.binary_length(table["hashes"]).to_pylist()):
        end = start + size // 8
        hit = start + np.flatnonzero(total[start:end] > 1)
        start = end
        if len(hit):
            out["chunk"].append(chunk)
            out["hashes"].append(a[hit].tobytes())
            out["seconds"].append(None if b is None else b[hit].tobytes())
            out["counts"].append(np.minimum(total[hit], 0xFFFFFFFF).astype(np.uint32).tobytes())
    return pa.table({"chunk": pa.array(out["chunk"], pa.int64()),
                     **{k: pa.array(out[k], pa.binary()) for k in ("hashes", "seconds", "counts")}})


def shared_hashes(reports: DataFrame) -> DataFrame:
    """From the chunks' reports (REPORT) the answers to them (ANSWER): the
    hashes with a total count of two or more, ascending within a row."""
    return reports.groupBy("bucket").applyInArrow(_answer, ANSWER)
