"""Token-id files: Simple-8b segments written in id order and read back.

A file holds the segments of one range of documents; each segment is
self-contained: header, per-document token counts, ids, block offsets, words.
The manifest (a Parquet table beside the files) has one row per segment with
its file, byte range and counts, so readers split the work by segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfline.llm import simple8b
from shelfline.llm.common import running_sum, with_row_id
from shelfline.llm.tokenize import append_end, encoder, text_batches

# Fixed by the file format: magic, documents, ids, blocks, words.
HEADER = struct.Struct("<8sQQQQ")
MAGIC = b"S8BSEG01"
SEGMENT_IDS = 1 << 21            # ids after which a segment is closed

MANIFEST = "part long, segment long, path string, first_byte long, n_bytes long, n_docs long, n_ids long"


def pack_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, blocks = simple8b.encode(ids)
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    names = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    return b"".join([HEADER.pack(MAGIC, len(doc_ids), len(ids), len(blocks) - 1, len(words)),
                     counts.astype("<u8").tobytes(), names.tobytes(), known.tobytes(),
                     blocks.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(document ids, token counts, token ids)."""
    magic, n_docs, n_ids, n_blocks, n_words = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = HEADER.size
    counts = np.frombuffer(data, "<u8", n_docs, at).astype(np.int64)
    names = np.frombuffer(data, "<i8", n_docs, at := at + 8 * n_docs)
    known = np.frombuffer(data, "u1", n_docs, at := at + 8 * n_docs)
    at += n_docs + 8 * (n_blocks + 1)
    ids = simple8b.decode(np.frombuffer(data, "<u8", n_words, at))
    if len(ids) != n_ids:
        raise ValueError("token segment is damaged")
    return [int(x) if k else None for x, k in zip(names, known)], counts, ids


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path)


def write_tokens(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int, spaced: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every text, append `end_id`, write the ids in ascending id order
    (null ids last) below `out_dir`, a folder that all executors share; return
    the manifest.

    A null text counts as empty: only the end id.  Repeated ids and rows are
    all written.  A task writes its file under a name of its attempt and
    renames it at the end, so retried and speculative tasks are harmless.
    `tokenizer_path` must exist on every executor.
    """
    def task(batches):
        context = TaskContext.get()
        part = context.partitionId()
        target, rows = f"{out_dir}/part-{part:06d}.s8b", []
        fs, path = _filesystem(target)
        draft = f"{path}.attempt-{context.taskAttemptId()}"
        encode, out, first_byte = encoder(tokenizer_path, spaced).encode, None, 0
        names, counts, ids = [], [], []

        def close_segment():
            nonlocal out, first_byte
            flat, sizes = np.concatenate(ids), np.concatenate(counts)
            data = pack_segment(names, sizes, flat)
            if out is None:
                out = fs.open_output_stream(draft)
            out.write(data)
            rows.append((part, len(rows), target, first_byte, len(data), len(names), len(flat)))
            first_byte += len(data)
            for x in (names, counts, ids):
                x.clear()

        for batch in batches:
            for some in text_batches(batch, 1):
                flat, sizes = append_end(*encode(some.column(1)), end_id)
                names += some.column(0).to_pylist()
                counts.append(sizes)
                ids.append(flat)
                if sum(map(len, ids)) >= SEGMENT_IDS:
                    close_segment()
        if names:
            close_segment()
        if out is not None:
            out.close()
            fs.move(draft, path)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(zip(*rows))],
                ["part", "segment", "path", "first_byte", "n_bytes", "n_docs", "n_ids"])

    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"),
                                   F.col(text_col).alias("text")), "row_id")
    order = [F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(out_dir)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    manifest = (rows.repartitionByRange(*order).sortWithinPartitions(*order)
                .select("doc_id", "text").mapInArrow(task, MANIFEST))
    manifest.write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def read_tokens(spark: SparkSession, out_dir: str, with_ids: bool = False) -> DataFrame:
    """One row per document of the files in `out_dir`: `doc_id`, `start` (ids
    of all documents before it), `n_tokens`, `ids_crc32` of its ids as
    little-endian unsigned 32-bit integers, and with `with_ids` those bytes."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{out_dir}/manifest")
    segments = running_sum(manifest, ["part", "segment"], "n_ids", "first_id", name="token-segments")
    tasks = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def task(batches):
        for batch in batches:
            for path, first_byte, n_bytes, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as f:
                    f.seek(first_byte)
                    names, counts, ids = unpack_segment(f.read(n_bytes))
                data = memoryview(ids.astype("<u4").tobytes())
                ends = np.cumsum(counts)
                pieces = [data[4 * (e - c):4 * e] for e, c in zip(ends.tolist(), counts.tolist())]
                columns = [pa.array(names, pa.int64()), pa.array(start + ends - counts), pa.array(counts),
                           pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                if with_ids:
                    columns.append(pa.array([bytes(p) for p in pieces], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(
                    [(x.split()[0], c.type) for x, c in zip(schema.split(", "), columns)]))

    return (segments.repartition(tasks, "part", "segment")
            .select("path", "first_byte", "n_bytes", "first_id").mapInArrow(task, schema))
