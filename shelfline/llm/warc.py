"""WARC archives: written by Spark's text writer, read by verified chains.

Writing: a record's head and payload are one string and records end in the
blank lines that WARC asks for, so the text writer's line separator makes a
valid archive.  Of equal payloads one record is the response, the others are
revisits that refer to it.

Reading: archives are split at every occurrence of the version line, in byte
ranges that need not match records.  Each occurrence is a candidate record
with an offset and, from its head, the offset of its successor.  An occurrence
inside a payload is not a record: only candidates on the chain from the start
of the file are.  Each task follows its candidates' chains to the end of its
byte range; the ranges' entry points are then resolved by pointer jumping, in
as many rounds as the logarithm of the ranges of a file.
"""

from __future__ import annotations

import math

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfline.session import materialize

# Fixed by the format.
MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 100              # bytes; smaller payloads are always stored


def _line(name: str, value: Column) -> Column:
    """A head line, or nothing when `value` is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, out_dir: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Write one record per row below `out_dir`; every task writes one file.

    Of rows with equal payloads of at least `LEAST_REVISIT` bytes the smallest
    id is the response (rows that repeat that id with that payload are
    responses as well), the others revisit it.  A null payload is empty, a
    null url has no target line, a null id none in its record id and comes
    after all other ids.  An empty table writes no record.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload")).withColumn("digest", F.sha2("payload", 256))
    large = F.col("n_bytes") >= LEAST_REVISIT
    first = (rows.where(large).groupBy("digest")
             .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
             .where("copies > 1").select("digest", "first_id"))
    first = materialize(first, "warc-responses")
    placed = rows.join(first, "digest", "left")
    revisit = large & F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def record_id(c: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))

    # No head line may break, or end like a version line.
    target = F.regexp_replace(F.regexp_replace("url", r"[\x00-\x20]+", "%20"), r"WARC/1\.1$", "%57ARC/1.1")
    stored = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", record_id("page_id")),
        _line("WARC-Target-URI", target),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Refers-To", F.when(revisit, record_id("first_id"))),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("X-Payload-Length", F.col("n_bytes").cast("string")),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        F.lit("Content-Length: "), F.octet_length(stored).cast("string"), F.lit(BREAK))
    (placed.select(F.concat(head, stored).alias("value"))
     .write.mode("overwrite").option("lineSep", BREAK).text(out_dir))


def _field(name: str, pattern: str) -> Column:
    found = F.regexp_extract(F.concat(F.lit("\r\n"), F.col("head")), rf"(?i)\r\n{name}:[ \t]*{pattern}", 1)
    return F.when(found != "", found)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What lies between occurrences of the version line, with its byte range
    (`path`, `block`) and its place within it."""
    text = spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("path"),
                       F.col("_metadata.file_block_start").alias("block"),
                       F.monotonically_increasing_id().alias("seq"))


def _offsets(segments: DataFrame) -> DataFrame:
    """Add `off`, the byte offset of the version line before each segment.
    Sums run within a byte range, then over the ranges of a file."""
    within = Window.partitionBy("path", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    blocks = segments.groupBy("path", "block").agg(F.sum("n_bytes").alias("block_bytes"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = blocks.select("path", "block", F.coalesce(F.sum("block_bytes").over(before), F.lit(0)).alias("base"))
    return (segments.withColumn("before", F.coalesce(F.sum("n_bytes").over(within), F.lit(0)))
            .join(base, ["path", "block"])
            .withColumn("off", F.col("base") + F.col("before") - len(MAGIC))
            .drop("base", "before").where("off >= 0"))


def _exits(table: pa.Table) -> pa.Table:
    """For each candidate of a byte range: the first place on its chain that
    lies beyond the range's candidates, or -1 where the chain breaks."""
    table = table.sort_by([("off", "descending")])
    offs, succs = table["off"].to_pylist(), table["succ"].to_pylist()
    last, exits = (offs[0] if offs else 0), {}
    for o, s in zip(offs, succs):
        exits[o] = -1 if s is None else s if s > last else exits.get(s, -1)
    return pa.table({"path": table["path"], "block": table["block"], "off": table["off"], "succ": table["succ"],
                     "exit": pa.array([exits[o] for o in offs], pa.int64())})


def _follow(table: pa.Table) -> pa.Table:
    """The candidates of a byte range on the chain from its entry."""
    succ = dict(zip(table["off"].to_pylist(), table["succ"].to_pylist()))
    held = []
    for entry in table.filter(table["entry"])["off"].to_pylist():
        while entry in succ:
            held.append(entry)
            entry = succ[entry]
    return table.filter(pc.is_in(table["off"], pa.array(held, pa.int64()))).select(["path", "off"])


def verified_offsets(candidates: DataFrame) -> DataFrame:
    """Of `candidates` (`path`, `block`, `off`, `succ`) the (`path`, `off`) on
    the chain from the start of each file."""
    schema = "path string, block long, off long, succ long, exit long"
    ranges = materialize(candidates.select("path", "block", "off", "succ").groupBy("path", "block")
                         .applyInArrow(_exits, schema), "warc-chains")
    starts = ranges.select("path").distinct().select("path", F.lit(0).cast("long").alias("off"))
    gates = ranges.where("exit >= 0").select("path", F.col("exit").alias("off")).union(starts).distinct()
    jumps = materialize(gates.join(ranges, ["path", "off"]).select("path", "off", F.col("exit").alias("to")),
                        "warc-jumps")
    most = ranges.groupBy("path").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 1
    reached = starts
    for _ in range(math.ceil(math.log2(most)) if most > 1 else 0):
        further = reached.join(jumps, ["path", "off"]).select("path", F.col("to").alias("off"))
        reached = materialize(reached.union(further).distinct(), "warc-reached")
        twice = jumps.withColumnRenamed("to", "via").join(
            jumps.select("path", F.col("off").alias("via"), "to"), ["path", "via"]).select("path", "off", "to")
        jumps = materialize(twice, "warc-jumps")
    entry = reached.withColumn("entry", F.lit(True))
    flagged = ranges.join(entry, ["path", "off"], "left").select(
        "path", "block", "off", "succ", F.coalesce("entry", F.lit(False)).alias("entry"))
    return flagged.groupBy("path", "block").applyInArrow(_follow, "path string, off long")


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives below `path`: `path`, `off`,
    `record_type`, `page_id`, `url`, `refers_to`, `payload_bytes` and
    `payload_digest` (taken from the payload read, or for a revisit from its
    head), and with `with_payload` the stored payload (binary).

    A file that does not start with a record, and what follows a damaged
    record (or a head with a line that ends like a version line), is not on a
    chain from the start and yields nothing.
    """
    raw = _segments(spark, path)
    head = F.substring_index("value", BREAK, 1)
    parsed = (raw.withColumn("head", head)
              .withColumn("n_bytes", F.octet_length("value").cast("long") + len(MAGIC))
              .withColumn("head_bytes", F.octet_length("head").cast("long"))
              .withColumn("stored", _field("Content-Length", r"(\d{1,15})").cast("long"))
              .withColumn("size", len(MAGIC) + F.col("head_bytes") + F.col("stored") + 2 * len(BREAK)))
    body = F.substring(F.col("value").cast("binary"), (F.col("head_bytes") + 1 + len(BREAK)).cast("int"),
                       F.col("stored").cast("int"))
    whole = F.col("size") == F.col("n_bytes")
    fields = [F.lower(_field("WARC-Type", r"(\S+)")).alias("record_type"),
              _field("WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
              _field("WARC-Target-URI", r"([^\r]*)").alias("url"),
              _field("WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
              _field("X-Payload-Length", r"(\d{1,15})").cast("long").alias("said_bytes"),
              _field("WARC-Payload-Digest", r"sha256:([0-9a-f]{64})").alias("said_digest")]
    keep = ["path", "block", "seq", "n_bytes", "head_bytes", "stored", "size"]
    table = materialize(parsed.select(*keep, *fields, whole.alias("whole"),
                                      F.when(whole, F.sha2(body, 256)).alias("read_digest"),
                                      *([F.when(whole, body).alias("payload")] if with_payload else [])),
                        "warc-segments")
    located = materialize(_offsets(table), "warc-offsets")
    real = materialize(verified_offsets(located.withColumn("succ", F.col("off") + F.col("size"))), "warc-records")
    records = located.join(real, ["path", "off"])
    if records.where(~F.col("whole")).head(1):
        # Payloads that hold version lines: join their segments again.
        order = Window.partitionBy("path").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
        owner = F.last(F.when(F.col("real"), F.struct(F.col("off").alias("at"), "whole", "size", "head_bytes",
                                                      "stored")), ignorenulls=True).over(order)
        split = (located.join(real.withColumn("real", F.lit(True)), ["path", "off"], "left")
                 .withColumn("owner", owner).where("not owner.whole and off < owner.at + owner.size")
                 .select("path", "block", "seq", "off", "owner"))
        joined = (raw.join(split, ["path", "block", "seq"]).groupBy("path", F.col("owner.at").alias("off"))
                  .agg(F.sort_array(F.collect_list(F.struct("off", F.concat(
                      F.lit(MAGIC).cast("binary"), F.col("value").cast("binary")).alias("v")))).alias("parts"),
                      F.first("owner").alias("o")))
        full = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["v"]))
        joined = joined.withColumn("joined", F.substring(
            full, (F.col("o.head_bytes") + 1 + len(MAGIC) + len(BREAK)).cast("int"), F.col("o.stored").cast("int")))
        records = records.join(joined.select("path", "off", "joined"), ["path", "off"], "left")
        records = records.withColumn("read_digest", F.coalesce("read_digest", F.sha2("joined", 256)))
        if with_payload:
            records = records.withColumn("payload", F.coalesce("payload", "joined"))
    revisit = F.col("record_type") == "revisit"
    return records.select(
        "path", "off", "record_type", "page_id", "url", "refers_to",
        F.when(revisit, F.col("said_bytes")).otherwise(F.col("stored")).alias("payload_bytes"),
        F.when(revisit, F.col("said_digest")).otherwise(F.col("read_digest")).alias("payload_digest"),
        *(["payload"] if with_payload else []))
