import hashlib
import random
import tempfile

import pytest

from shelfline.llm.warc import MAGIC, read_warc, write_warc

SCHEMA = "page_id long, url string, html string, path string, off long"


def fake_record(body: str) -> str:
    return (f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\n"
            f"Content-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n")


def expected(rows):
    first = {}
    for i, html in rows:
        if len((html or "").encode()) >= 100 and i is not None:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, html in rows:
        data = (html or "").encode()
        ref = first.get(html) if len(data) >= 100 else None
        ref = None if ref == i else ref
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=str)


def round_trip(spark, rows, files=2, split=None, **kw):
    out = tempfile.mkdtemp(prefix="warc-") + "/a"
    pages = spark.createDataFrame([(i, "http://x/\r\nWARC/1.1", h, "clash", 5) for i, h in rows], SCHEMA)
    write_warc(pages.repartition(files), out)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        return [r.asDict() for r in read_warc(spark, out, **kw).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def found(rows):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                   for r in rows), key=str)


@pytest.mark.parametrize("split", [None, 700, 97])
def test_magic_inside_payloads_is_rejected_in_any_split(spark, split):
    rng = random.Random(4)
    rows = []
    for i in range(60):
        body = "".join(rng.choice("abcé\r\n<> ") for _ in range(rng.randint(0, 400)))
        if i % 3 == 0:
            body += fake_record("inner " * rng.randint(0, 30)) + MAGIC + "tail"
        if i % 7 == 0:
            body = MAGIC + body + "\r\n\r\nWARC/1.1"
        rows.append((i, body))
    rows += [(100 + i, rows[3 * i][1]) for i in range(15)]
    assert found(round_trip(spark, rows, split=split)) == expected(rows)


def test_payloads_come_back(spark):
    rows = [(1, "é" * 80), (2, None), (3, MAGIC + fake_record("x" * 200)), (4, "")]
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in round_trip(spark, rows, with_payload=True, split=120)}
    assert back == {i: h or "" for i, h in rows}


def test_null_ids_small_copies_and_repeated_rows(spark):
    big = "z" * 100
    rows = [(5, big), (5, big), (None, big), (7, big), (8, "small"), (9, "small"), (None, None)]
    assert found(round_trip(spark, rows)) == expected(rows)


def test_empty_table(spark):
    assert round_trip(spark, []) == []
