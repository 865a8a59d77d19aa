"""Archives: exact round trips, and payloads that look like records."""

import base64
import gzip
import hashlib
import os
import random
import re
import time

from pyspark.sql import functions as F

from evalloom.llm import warc
from evalloom.llm.shared import new_path

SCHEMA = "page_id long, url string, html string, payload string, digest int"
FALSE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def want(rows):
    by = {}
    for i, _, html in rows:
        by.setdefault(html or "", []).append(i)
    found = []
    for i, _, html in rows:
        data = (html or "").encode()
        ids = [x for x in by[html or ""] if x is not None]
        kept = max(ids, default=None)
        revisit = kept is not None and i != kept
        found.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", kept if revisit else None))
    return sorted(found, key=str)


def test_round_trip(spark):
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\ny", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", FALSE), (6, "u", f"{FALSE}{FALSE}tail"), (7, "u", "é\n日本\r\n\r\nWARC/1.1\r\n"), (8, "u", "x" * 100_000)]
    frame = spark.createDataFrame([(*r, "p", 0) for r in rows], SCHEMA)
    records = warc.archive_and_read(frame, payloads=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=str) == want(rows)
    for r in records:
        if r.record_type == "response":
            assert bytes(r.payload).decode() == ({i: h for i, _, h in rows}[r.page_id] or "")


def test_magic_in_payloads_is_a_candidate_but_not_reached(spark):
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: {len(FALSE) + 4}\r\n\r\n\r\n\r\n"
    data = f"{head}{FALSE}\r\n\r\n".encode()
    # The payload's record is over where the outer one is, but begins within it.
    assert [x[:2] for x in warc.candidates(data, True)] == [(0, len(data)), (len(head), len(head) + len(FALSE))]
    links = [("f", *x[:2]) for x in warc.candidates(data, True)]
    assert [r.at for r in warc.reached(spark.createDataFrame(links, "file string, at long, next long")).collect()] == [0]


def record(kind, block, name="urn:uuid:1"):
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\nContent-Length: {len(block.encode())}\r\n\r\n{block}\r\n\r\n"


def test_records_of_all_types_are_links(spark):
    http = "HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\n"
    parts = [("warcinfo", "software: x", "urn:a"), ("response", http + "hi", "urn:page:1"), ("request", "GET / HTTP/1.1\r\n\r\n", "urn:b"), ("metadata", "", "urn:c"), ("response", http + "ho", "urn:page:2")]
    whole = "".join(record(*p) for p in parts)
    path = new_path(spark, "mixed")
    spark.createDataFrame([(whole,)], "value string").coalesce(1).write.option("lineSep", "\x00").text(path)
    found = warc.read(spark, path).orderBy("at").collect()
    assert [(r.page_id, r.record_type, bytes(r.payload)) for r in found] == [(1, "response", b"hi"), (2, "response", b"ho")]
    every = warc.read(spark, path, types=("warcinfo", "request", "metadata")).orderBy("at").collect()
    assert [(r.record_id, r.payload_bytes) for r in every] == [("<urn:a>", 11), ("<urn:b>", 18), ("<urn:c>", 0)]


def test_compressed_archives(spark, tmp_path):
    import gzip

    members = [record("warcinfo", "x"), record("response", "HTTP/1.1 200 OK\r\n\r\nhi", "urn:page:4")]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(m.encode()) for m in members))
    assert [(r.page_id, bytes(r.payload)) for r in warc.read(spark, f"file://{tmp_path}").collect()] == [(4, b"hi")]


def test_one_very_long_page(spark):
    found = warc.archive_and_read(spark.createDataFrame([(1, "u", "é" * 3_000_000, "", 0), (2, "u", "x", "", 0)], SCHEMA)).collect()
    assert sorted((r.page_id, r.payload_bytes) for r in found) == [(1, 6_000_000), (2, 1)]


def test_pointer_jumping(spark):
    links = [("f", 0, 10), ("f", 10, 25), ("f", 12, 25), ("f", 25, 40), ("f", 30, 35), ("f", 40, 41), ("g", 0, 5), ("g", 7, 9), ("h", 3, 4)]
    found = warc.reached(spark.createDataFrame(links, "file string, at long, next long")).collect()
    assert sorted((r.file, r.at) for r in found) == [("f", 0), ("f", 10), ("f", 25), ("f", 40), ("g", 0)]


def test_a_long_chain_takes_few_rounds(spark):
    links = spark.range(3000).select(F.lit("f").alias("file"), (F.col("id") * 3).alias("at"), (F.col("id") * 3 + 3).alias("next"))
    assert warc.reached(links).count() == 3000


def test_a_broken_file_ends_at_its_last_whole_record(spark):
    path = new_path(spark, "broken")
    whole = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{0}>\r\nContent-Length: 4\r\n\r\n\r\n\r\n\r\n\r\n"
    spark.createDataFrame([(whole.format(1) + whole.format(2)[:-9],)], "value string").coalesce(1).write.option("lineSep", "\x00").text(path)
    assert [r.page_id for r in warc.read(spark, path).collect()] == [1]


def test_empty_table_and_null_ids(spark):
    assert warc.archive_and_read(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "u", "x"), (None, "u", "x"), (None, "u", "y"), (3, "u", "y"), (3, "u", "y")]
    found = warc.archive_and_read(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()
    assert sorted(str((r.page_id, r.record_type, r.refers_to)) for r in found) == ["(3, 'response', None)", "(3, 'response', None)", "(None, 'response', None)", "(None, 'response', None)", "(None, 'revisit', 3)"]


def plain_heads(data):
    """By one pattern: a version, header lines, an empty line."""
    found = []
    for at in (m.start() for m in re.finditer(rb"WARC/1\.", data)):
        m = re.compile(rb"WARC/1\.[01]\r\n((?:[^\r\n]+\r\n)*)\r\n").match(data, at)
        if m:
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in m[1].split(b"\r\n")) if v}
            found.append((at, m.end(), fields))
    return found


def test_heads_are_those_of_the_pattern():
    rng = random.Random(8)
    parts = [b"WARC/1.1", b"WARC/1.0", b"WARC/1.2", b"WARC/1.", b"\r\n", b"\r\n", b"\r\n\r\n", b"\r", b"\n", b"Content-Length: 3", b"content-length:5", b"A:", b"x", b": ", b"Warc-Type: response"]
    for _ in range(4000):
        data = b"".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        found = [(at, start, {k: v for k, (place, v) in fields.items() if place >= at}) for at, start, fields in warc.heads(data)]
        assert found == plain_heads(data)


def test_many_versions_in_a_payload_take_linear_time():
    data = b"WARC/1.1\r\n" * 200_000  # 2 MB without an empty line, and with one at the end
    begun = time.perf_counter()
    assert list(warc.candidates(data, False)) == [] and list(warc.candidates(data + b"\r\n", False)) == []
    assert time.perf_counter() - begun < 5


def test_broken_and_padded_compressed_files(spark):
    """Each ends at its last whole record."""
    folder = new_path(spark, "gz").removeprefix("file://")
    records = [f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{k}>\r\nContent-Length: 3\r\n\r\nab{k}\r\n\r\n".encode() for k in range(3)]
    members = [gzip.compress(r) for r in records]
    rng = random.Random(1)
    noise = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 60000\r\n\r\n{rng.randbytes(30_000).hex()}\r\n\r\n".encode()
    damaged = bytearray(gzip.compress(records[0] + noise))
    damaged[-20_000] ^= 0xFF
    os.makedirs(folder)
    files = {"whole": b"".join(members), "cut": b"".join(members)[:-15], "padded": b"".join(members) + b"\0" * 50, "prose": b"".join(members) + b"no member", "damaged": members[0] + bytes(damaged), "half": members[0] + b"\x1f\x8b", "empty": b""}
    for name, data in files.items():
        with open(f"{folder}/{name}.gz", "wb") as f:
            f.write(data)
    found = {}
    for r in warc.read(spark, f"file://{folder}").collect():
        found.setdefault(r.file.rsplit("/", 1)[1][:-3], []).append(r.page_id)
    assert {k: sorted(v) for k, v in found.items()} == {"whole": [0, 1, 2], "cut": [0, 1], "padded": [0, 1, 2], "prose": [0, 1, 2], "damaged": [0, 0], "half": [0]}
