"""Vector codes: each vector as one codebook entry per part, by active-entry
Lloyd rounds.

Vectors are cut into equal consecutive parts, and each part position has a
codebook.  A round assigns every part to its nearest entry and moves the
entries to the means of their parts.  A part remembers its entry and the exact
distance to it.  If that entry stayed where it was, the distance still holds
and no other resting entry can have come closer, so the part is compared with
the moved entries only; all other parts are compared with every entry.

Only the codebooks (parts x entries) and their sums pass through the driver.
A round reads the table that the round before wrote and writes its own, so a
lost executor costs part of one round and vectors are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfline.session import discard, materialize

LARGEST = 1 << 26        # whole numbers saturate here, so that distances fit 64 bits
EXACT = 1 << 53          # below, products of doubles are exact
SALTS = 16


@dataclass
class Codebooks:
    """`entries[part, entry, position]`, whole numbers."""
    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return vector.isNotNull() & finite


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, at most `LARGEST` either way."""
    most = float(LARGEST // scale)
    return F.transform(vector, lambda x: F.floor(
        F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double"))) * scale).cast("int"))


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to entries."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * x.shape[1] * most * most < EXACT:
        a, b = x.astype(np.float64), entries.astype(np.float64)
        far = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
        return far.astype(np.int64)
    return np.stack([((x - e) ** 2).sum(axis=1) for e in entries], axis=1)


def assign(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray | None,
           far: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower index on ties) and exact distance of each row
    of `x`, given those before the entries in `moved` changed."""
    if code is None:
        full = np.ones(len(x), dtype=bool)
        code, far = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    else:
        full = moved[code]
        code, far = code.copy(), far.copy()
    rest = np.flatnonzero(~full)
    full = np.flatnonzero(full)
    if len(full):
        d = squared(x[full], entries)
        code[full] = d.argmin(axis=1)
        far[full] = d[np.arange(len(full)), code[full]]
    active = np.flatnonzero(moved)
    if len(rest) and len(active):
        d = squared(x[rest], entries[active])
        at = d.argmin(axis=1)
        d, at = d[np.arange(len(rest)), at], active[at]
        better = (d < far[rest]) | ((d == far[rest]) & (at < code[rest]))
        code[rest[better]], far[rest[better]] = at[better], d[better]
    return code, far


def part_sums(x: np.ndarray, code: np.ndarray, n_entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and componentwise sum of the rows of each entry."""
    sums = np.zeros((n_entries, x.shape[1]), dtype=np.int64)
    order = np.argsort(code, kind="stable")
    held, at = np.unique(code[order], return_index=True)
    if len(held):
        sums[held] = np.add.reduceat(x[order], at, axis=0)
    return np.bincount(code, minlength=n_entries), sums


def _round(state: DataFrame, entries: np.ndarray, moved: np.ndarray, last: bool) -> DataFrame:
    """One assignment of all vectors: state rows (`part` null) with codes and
    distances and, unless it is the last round, one row per task, part and
    entry with the sums of its parts."""
    n_parts, n_entries, width = entries.shape
    own = [f for f in state.schema if f.name in ("vec_id", "label")]
    schema = T.StructType([*own, *T._parse_datatype_string(
        "numbers array<int>, codes binary, distances array<long>, part int, entry int, n long, sums array<long>")])

    def assign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((n_parts, n_entries), dtype=np.int64)
        totals = np.zeros(entries.shape, dtype=np.int64)
        arrow = None
        for batch in batches:
            arrow = [batch.schema.field(f.name).type for f in own]
            n = batch.num_rows
            numbers = batch.column("numbers")
            x = numbers.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, n_parts, width)
            known = "codes" in batch.schema.names
            if known:
                old = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).reshape(n, n_parts)
                far = batch.column("distances").flatten().to_numpy(zero_copy_only=False).reshape(n, n_parts)
            codes, distances = np.empty((n, n_parts), np.int64), np.empty((n, n_parts), np.int64)
            for p in range(n_parts):
                codes[:, p], distances[:, p] = assign(
                    x[:, p], entries[p], moved[p], old[:, p].astype(np.int64) if known else None,
                    far[:, p].astype(np.int64) if known else None)
                if not last:
                    held, sums = part_sums(x[:, p], codes[:, p], n_entries)
                    counts[p] += held
                    totals[p] += sums
            packed = codes.astype(np.uint8).tobytes()
            ends = np.arange(n + 1, dtype=np.int32) * n_parts
            yield _batch(own, arrow, n, {
                **{f.name: batch.column(f.name) for f in own},
                "numbers": None if last else numbers,
                "codes": pa.array([packed[i:i + n_parts] for i in range(0, n * n_parts, n_parts)], pa.binary()),
                "distances": pa.ListArray.from_arrays(pa.array(ends), pa.array(distances.reshape(-1)))})
        used = np.argwhere(counts > 0)
        if len(used):
            sums = totals[used[:, 0], used[:, 1]].reshape(-1)
            ends = np.arange(len(used) + 1, dtype=np.int32) * width
            yield _batch(own, arrow, len(used), {
                "part": pa.array(used[:, 0], pa.int32()), "entry": pa.array(used[:, 1], pa.int32()),
                "n": pa.array(counts[used[:, 0], used[:, 1]]),
                "sums": pa.ListArray.from_arrays(pa.array(ends), pa.array(sums))})

    return state.mapInArrow(assign_batches, schema)


def _batch(own, arrow, n: int, columns: dict) -> pa.RecordBatch:
    kinds = {f.name: t for f, t in zip(own, arrow)} | {
        "numbers": pa.list_(pa.int32()), "codes": pa.binary(), "distances": pa.list_(pa.int64()),
        "part": pa.int32(), "entry": pa.int32(), "n": pa.int64(), "sums": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays(
        [c.cast(t) if (c := columns.get(k)) is not None else pa.nulls(n, t) for k, t in kinds.items()], list(kinds))


def _moved_entries(sums: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The entries at the floored means of their parts; unused ones stay."""
    totals = sums.groupBy("part", "entry").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(entries.shape[2]))).alias("sums"))
    new = entries.copy()
    for r in totals.collect():              # at most one row for each entry
        new[r["part"], r["entry"]] = np.asarray(r["sums"], dtype=np.int64) // r["n"]
    return new


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, Codebooks]:
    """Codes of all usable vectors and the codebooks behind them.

    The frame has one row per kept input row: `vec_id`, `label`, `code` (two
    hex digits a part), `error` (squared distance to the coded vector, in
    whole numbers) and `label_error` (its sum over equal labels, null being a
    label of its own).

    Rows whose vector is null or holds a null or non-finite component are
    dropped.  Components become floor(scale * x), at most 2**26 either way.
    Vectors that are shorter than the longest one, or whose length is no
    multiple of `parts`, count as filled up with zeros.  The codebooks start
    at the vectors of the smallest ids (null ids last; equal ids by their
    components); fewer kept vectors than `entries` give smaller codebooks, none
    give an empty result.  Repeated rows stay and get equal codes; an entry
    that holds no part stays where it is; on ties the lower entry wins.  Other
    columns are not read.  `entries` is at most 256, so the codebooks stay
    within parts x 256 rows.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                          F.col(vector_col).alias("vector")).where(usable(F.col("vector")))
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = max(1, -(-longest // parts)) * parts
    numbers = F.concat(whole_numbers(F.col("vector"), scale),
                       F.array_repeat(F.lit(0), F.lit(width) - F.size("vector")))
    state = rows.select("vec_id", "label", numbers.alias("numbers"))
    first = state.select("vec_id", "numbers").orderBy(F.col("vec_id").asc_nulls_last(), "numbers").limit(entries)
    books = np.array([r["numbers"] for r in first.collect()], dtype=np.int64)
    books = books.reshape(-1, parts, width // parts).transpose(1, 0, 2)
    if not books.shape[1]:
        empty = rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"),
                                     F.lit(0).cast("long").alias("label_error"))
        return empty, Codebooks(books)
    moved, before = np.ones(books.shape[:2], dtype=bool), None
    for k in range(rounds + 1):
        done = materialize(_round(state, books, moved, k == rounds), f"codes-{k}")
        if before is not None:
            discard(before)
        if k < rounds:
            new = _moved_entries(done.where("part is not null"), books)
            moved, books = (new != books).any(axis=2), new
        state, before = done.where("part is null").select("vec_id", "label", "numbers", "codes", "distances"), done
    coded = state.select("vec_id", "label", F.lower(F.hex("codes")).alias("code"),
                         F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    # One row per label; both sides are salted, so that a common label spreads.
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    left = coded.withColumn("_salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    found = left.join(sums, left["label"].eqNullSafe(sums["label"]) & (left["_salt"] == sums["_salt"]))
    return found.select("vec_id", left["label"], "code", "error", "label_error"), Codebooks(books)
