"""Packing token streams into fixed-length sequences, order preserved.

Documents are laid end to end in id order.  Cuts fall at document and sentence
boundaries or, at a higher penalty, one full sequence after such a boundary; a
dynamic program over the boundaries chooses the windows that minimise padding
plus a penalty for every cut inside a document (more inside a sentence).
The best predecessor of a boundary is the smallest `cost + position` in the
reach of one sequence, or of two with a cut inside between them, each kept in a
monotone queue, or a boundary at an exact power of two before it, where a
sequence needs no padding.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import with_row_id
from shelfline.llm.tokenize import append_end, encoder, text_batches

BLOCK_BYTES = 8 << 20            # text that one dynamic program spans
SPACED = ("Ġ", "Ċ")    # fixed by byte-level vocabularies: space, line end


@functools.lru_cache(maxsize=4)
def sentence_marks(tokenizer_path: str) -> tuple[np.ndarray, np.ndarray]:
    """By id: whether a token can end a sentence, whether one can follow."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    ends, opens = (np.zeros(max(vocabulary.values()) + 2, dtype=bool) for _ in range(2))
    for token, i in vocabulary.items():
        ends[i] = token.rstrip("\"')]").endswith((".", "!", "?")) or SPACED[1] in token
        opens[i] = token.startswith(SPACED)
    return ends, opens


def padded(length: int, most: int) -> int:
    """Length of a sequence in storage: `most`, or itself at a power of two."""
    return length if length & (length - 1) == 0 else most


def choose_cuts(at: np.ndarray, penalty: np.ndarray, most: int, truncation: float, least: int = 64) -> list[int]:
    """The cuts (first and last included) with the least padding plus
    penalties.  `at` holds the boundaries, ascending, with gaps of at most
    `most`; a window between two boundaries has at most `most` ids.  Two
    windows may also meet inside a sentence, for `truncation`: a full one and
    what is left of up to `most`.  Unpadded windows of a power of two count
    from `least` on."""
    n = len(at)
    exact: list[list[int] | None] = [None] * n
    size = least
    while size < most:                               # a full window has no padding anyway
        j = np.minimum(np.searchsorted(at, at - size), n - 1)
        for i, k in zip(hits := np.flatnonzero(at[j] == at - size).tolist(), j[hits].tolist()):
            if exact[i] is None:
                exact[i] = [k]
            else:
                exact[i].append(k)
        size *= 2
    places, costs = at.tolist(), penalty.tolist()
    cost, back = [0.0] * n, [0] * n
    near = deque([(places[0], places[0], 0)])        # (cost + position, position, index), rising
    far: deque = deque()                             # the same, for predecessors beyond one window
    waiting = deque(near)                            # not yet that far
    for i in range(1, n):
        p = places[i]
        low = p - most
        while near[0][1] < low:
            near.popleft()
        best, _, prior = near[0]
        best += most - p
        if exact[i] is not None:
            for j in exact[i]:
                if cost[j] < best:
                    best, prior = cost[j], j
        while waiting and waiting[0][1] < low:
            x = waiting.popleft()
            while far and far[-1][0] >= x[0]:
                far.pop()
            far.append(x)
        while far and far[0][1] < low - most:
            far.popleft()
        if far:
            two = far[0][0] + 2 * most - p + truncation
            if two < best:
                best, prior = two, -far[0][2] - 1    # by way of a cut inside
        best += costs[i]
        cost[i], back[i] = best, prior
        x = (best + p, p, i)
        while near and near[-1][0] >= x[0]:
            near.pop()
        near.append(x)
        waiting.append(x)
    cuts, i = [places[-1]], n - 1
    while i:
        i = back[i]
        if i < 0:
            i = -i - 1
            cuts.append(places[i] + most)
        cuts.append(places[i])
    return cuts[::-1]


def boundaries(ids: np.ndarray, doc_ends: np.ndarray, marks, most: int, penalty: float, truncation: float):
    """Boundaries and the penalties of a cut there: document ends (free),
    sentence ends (`penalty`), and, where these lie more than `most` apart,
    places in between (`truncation`)."""
    ends, opens = marks
    here = np.minimum(ids, len(ends) - 1)
    inside = np.flatnonzero(ends[here[:-1]] & opens[here[1:]]) + 1
    mark = np.zeros(len(ids) + 1, dtype=bool)
    mark[0] = mark[inside] = mark[doc_ends] = True
    at = np.flatnonzero(mark)
    gaps = np.flatnonzero(np.diff(at) > most)
    if len(gaps):
        at = np.sort(np.concatenate([at, *(np.arange(at[g] + most, at[g + 1], most) for g in gaps)]))
    price = np.full(len(at), truncation)
    price[np.searchsorted(at, inside)] = penalty
    price[np.searchsorted(at, doc_ends)] = 0
    return at, price


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, most: int = 1024, penalty: float = 2.0,
                   truncation: float = 8.0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece (the part of a document in one sequence): `doc_id`,
    `start` and `length` within its document, `ids_crc32`, `doc_tokens`,
    `sequence_id`, `offset` in the sequence, and with `with_ids` the ids.

    Every document is its ids and `end_id`; each id lies in exactly one piece.
    Null and empty texts are the end id alone; repeated ids and rows are
    packed like any others; null ids come last.  An empty table gives no
    pieces.  Each range of documents is packed in blocks of about `BLOCK_BYTES`
    of text whose last window stays open for the next block, so memory is bounded
    and only the last sequence of a range is cut short.  `sequence_id` is the
    range's number (high bits) and a counter.
    """
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
              ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
    fields += [("ids", pa.binary())] * with_ids
    schema = ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n, _ in fields)

    def task(batches):
        encode, marks = encoder(tokenizer_path, True).encode, sentence_marks(tokenizer_path)
        sequence = TaskContext.get().partitionId() << 32

        def close(ids, docs, last: bool):
            """Pieces of the ids held, and what stays open: unless `last`, the
            last window.  `docs` has, by document or what is left of one, its
            id, the ids before, those here, and all of them."""
            nonlocal sequence
            names, before, here, total = docs
            ends = np.cumsum(here)
            firsts = ends - here
            cuts = np.array(choose_cuts(*boundaries(ids, ends, marks, most, penalty, truncation), most, truncation))
            if not last:
                cuts = cuts[:-1]
            edges = np.unique(np.concatenate([cuts, ends[ends < cuts[-1]]]))
            lows, sizes = edges[:-1], np.diff(edges)
            owner = np.searchsorted(ends, lows, side="right")
            window = np.searchsorted(cuts, lows, side="right") - 1
            view = memoryview(ids.astype("<u4").tobytes())
            pieces = [view[4 * a:4 * (a + n)] for a, n in zip(lows.tolist(), sizes.tolist())]
            columns = [names.take(pa.array(owner)), before[owner] + lows - firsts[owner], sizes,
                       [zlib.crc32(p) for p in pieces], total[owner], window + sequence, lows - cuts[window]]
            columns += [[bytes(p) for p in pieces]] * with_ids
            out = pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c
                                              for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))
            sequence += len(cuts) - 1
            cut = cuts[-1]
            first = int(np.searchsorted(ends, cut, side="right"))
            skip = np.maximum(0, cut - firsts[first:])
            return out, ids[cut:], (names.slice(first), before[first:] + skip, here[first:] - skip, total[first:])

        ids, docs = np.zeros(0, "<u4"), (pa.array([], pa.int64()), *([np.zeros(0, np.int64)] * 3))
        for batch in batches:
            for some in text_batches(batch, 1, BLOCK_BYTES):
                flat, sizes = append_end(*encode(some.column(1)), end_id)
                ids = np.concatenate([ids, flat])
                docs = (pa.concat_arrays([docs[0], some.column(0)]), np.append(docs[1], np.zeros_like(sizes)),
                        np.append(docs[2], sizes), np.append(docs[3], sizes))
                if len(ids) > 4 * most:
                    out, ids, docs = close(ids, docs, False)
                    yield out
        if len(ids):
            yield close(ids, docs, True)[0]

    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                   F.col(text_col).alias("text")), "row_id")
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    return (rows.repartitionByRange(*order).sortWithinPartitions(*order)
            .select("doc_id", "text").mapInArrow(task, schema))
