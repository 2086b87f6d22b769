"""Substring dedup: words covered by long repeated word windows are removed.

Windows of `LENGTH` words are compared without hashing all of them at once.
Anchors, shorter runs of words, are hashed only at positions whose remainder
modulo a period lies in a difference cover: for any two positions some shift
below the period brings both onto the cover, so two equal windows always share
an aligned anchor.  Only windows around an anchor that occurs twice are
hashed in full (128 bits), counted over the corpus, and extended to the words
they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfline.llm.common import with_row_id
from shelfline.llm.shared_hashes import REPORT, chunk_count, find_pairs, joined, report, shared_hashes
from shelfline.llm.texthash import run_hashes, split_words, word_hashes
from shelfline.session import materialize

LENGTH = 35                      # words of a window
PERIOD = 21
COVER = (0, 1, 4, 14, 16)        # every remainder modulo 21 is a difference of two of these


def cover_positions(n: int, period: int, cover) -> np.ndarray:
    at = (np.arange(0, n + period, period)[:, None] + np.array(cover)).ravel()
    return at[at < n]


def anchors(hashes: np.ndarray, length: int, period: int, cover) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a document's anchors: runs short enough to lie
    in a window at any shift below the period."""
    runs = run_hashes(hashes, length - period + 1)
    at = cover_positions(len(runs), period, cover)
    return at, runs[at]


def candidate_windows(n_words: int, hit: np.ndarray, length: int, period: int) -> np.ndarray:
    """Starts of the windows that hold a repeated anchor within the shifts
    that the cover uses."""
    n = n_words - length + 1
    if n <= 0 or not len(hit):
        return np.zeros(0, dtype=np.int64)
    mark = np.zeros(n + 1, dtype=np.int32)
    np.add.at(mark, np.clip(hit - period + 1, 0, n), 1)
    np.add.at(mark, np.clip(hit + 1, 0, n), -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _contains(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), dtype=bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def _sha256(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


RESULT = [("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()),
          ("kept_sha256", pa.string())]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   period: int = PERIOD, cover=COVER, with_text: bool = False) -> DataFrame:
    """One row per input row: `row_id`, `doc_id`, `n_words`, `n_removed`,
    `kept_sha256` of the kept words joined by one space, and with `with_text`
    those words as `kept_text`.

    A word is removed when a window of `length` words over it occurs at two or
    more places of the input, in the same document or another.  Windows are
    judged on the input.  Null and empty texts have no words; texts shorter
    than a window lose nothing; repeated rows and copies lose all windows they
    share.  Rows with null or repeated ids are rows of their own.  An empty
    table gives an empty result.  Every text is one row and must fit a task.
    """
    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                       "row_id")
    chunks = chunk_count(docs, text_col)
    buckets = max(1, chunks // 2)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(chunks))).repartition("chunk")
    fields = RESULT + [("kept_text", pa.string())] * with_text
    ddl = "row_id long, doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def texts(table):
        return [split_words(x.as_buffer().to_pybytes() if x.is_valid else None) for x in table["text"]]

    def report_anchors(table: pa.Table) -> pa.Table:
        found = [anchors(word_hashes(w), length, period, cover)[1] for w in texts(table)]
        return pa.table(report(table["chunk"][0].as_py(), buckets, np.concatenate(found)), schema=_schema(REPORT))

    def results(rows_out: list[tuple]) -> dict[str, pa.Array]:
        columns = zip(*rows_out) if rows_out else [[] for _ in fields]
        return {n: pa.array(c, t) for (n, t), c in zip(fields, columns)}

    def kept(row_id, doc_id, words, mask) -> tuple:
        left = words if mask is None else [w for w, m in zip(words, mask.tolist()) if not m]
        out = (row_id, doc_id, len(words), len(words) - len(left), _sha256(left))
        return out + ((b" ".join(left).decode(),) if with_text else ())

    def find_windows(own: pa.Table, repeated: pa.Table) -> pa.Table:
        """Finished documents; and for the others their text and reports."""
        known = np.sort(joined(repeated["hashes"], np.uint64))
        done, open_rows, firsts, seconds = [], [], [], []
        for i, words in enumerate(texts(own)):
            row_id, doc_id = own["row_id"][i].as_py(), own["doc_id"][i].as_py()
            hashes = word_hashes(words)
            at, anchor = anchors(hashes, length, period, cover)
            starts = candidate_windows(len(words), at[_contains(known, anchor)], length, period)
            if not len(starts):
                done.append(kept(row_id, doc_id, words, None))
                continue
            open_rows.append((row_id, doc_id, own["text"][i].as_py()))
            firsts.append(run_hashes(hashes, length, 1)[starts])
            seconds.append(run_hashes(hashes, length, 2)[starts])
        out = [pa.table(results(done))]
        if open_rows:
            ids, docs_, texts_ = zip(*open_rows)
            chunk = own["chunk"][0].as_py()
            out.append(pa.table({"row_id": pa.array(ids, pa.int64()), "doc_id": pa.array(docs_, pa.int64()),
                                 "text": pa.array(texts_, pa.string()),
                                 "chunk": pa.array([chunk] * len(ids), pa.int64())}))
            out.append(pa.table(report(chunk, buckets, np.concatenate(firsts), np.concatenate(seconds)),
                                schema=_schema(REPORT)))
        return _aligned(out, found_schema)

    found_ddl = f"{ddl}, text string, {REPORT}"
    found_schema = _schema(found_ddl)

    def remove(own: pa.Table, repeated: pa.Table) -> pa.Table:
        a, b = joined(repeated["hashes"], np.uint64), joined(repeated["seconds"], np.uint64)
        order = np.argsort(a)
        a, b = a[order], b[order]
        out = []
        for i, words in enumerate(texts(own)):
            hashes = word_hashes(words)
            one = run_hashes(hashes, length, 1)
            at = np.flatnonzero(_contains(a, one))
            two = run_hashes(hashes, length, 2)[at]
            hit = at[find_pairs(a, b, one[at], two)] if len(at) else at
            mark = np.zeros(len(words) + 1, dtype=np.int32)
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + length, -1)
            out.append(kept(own["row_id"][i].as_py(), own["doc_id"][i].as_py(), words, np.cumsum(mark[:-1]) > 0))
        return pa.table(results(out))

    first_reports = dealt.groupBy("chunk").applyInArrow(report_anchors, REPORT)
    answers = shared_hashes(first_reports)
    found = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(find_windows, found_ddl)
    found = materialize(found, "substring-windows")
    repeats = shared_hashes(found.where("bucket is not null").select(*(x.split()[0] for x in REPORT.split(", "))))
    open_docs = found.where("text is not null").select("row_id", "doc_id", "text", "chunk")
    removed = open_docs.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(remove, ddl)
    finished = found.where("n_words is not null").select(*(n for n, _ in fields))
    return finished.unionByName(removed)


_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _aligned(tables: list[pa.Table], schema: pa.Schema) -> pa.Table:
    """Tables stacked on one schema, with nulls for the columns they lack."""
    def fill(t):
        return pa.table([t[f.name] if f.name in t.column_names else pa.nulls(t.num_rows, f.type) for f in schema],
                        schema=schema)
    return pa.concat_tables([fill(t) for t in tables])
