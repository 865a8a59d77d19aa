"""WARC archives: writing pages as records, and reading records back with boundary-chain verification.

A reading task takes every place with a record's magic for a record, even in payloads, and emits where its length says that the
next one begins, whatever the record's type. From the start of each file these links are followed by pointer jumping: in each round links
double their reach and the reached set takes in what its links lead to, so that the rounds are the logarithm of a file's records. Only
reached records of the wanted types are returned; the others (warcinfo, request, metadata) are links of the chain, too.

Of records with equal payloads of at least `least` bytes the one with the largest page_id is a response and the others are
revisits, which carry the response's headers but no payload.

Defined results: a null page is an empty payload; a null page_id is never referred to unless all of its payload's are null,
and then its rows are all responses; rows that share the largest page_id are all responses; a null url has no target line, and line ends in
urls become spaces; other columns play no part; an empty table gives no archive and no records. Files are read whole, so a file must be below 2 GB;
the writer keeps them near FILE_BYTES, or at one record. A file that breaks off ends at its last whole record, and so does a compressed one whose
members break off, are damaged or are followed by other bytes. Compressed files are read as one stream, and their places are those of the plain bytes.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, new_path, stored

FILE_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
END = "\r\n"
#: Fixed by the format.
MAGIC = "WARC/1.1"
TYPES = ("response", "revisit")
GZIP = b"\x1f\x8b"
#: Names of archives; the writer's own end in .txt.
FILES = "*.{txt,warc,gz}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1."
#: Bytes of a damaged member that are unpacked at once.
PIECE = 1 << 12
RECORDS = "file string, at long, next long, record_type string, record_id string, page_id long, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"


def sha1_base32(payload: Column) -> Column:
    """The SHA-1 of a string's bytes in upper-case base32: four times 40 bits as eight digits."""
    digits, letters = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    hexed = F.sha1(payload.cast("binary"))
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(hexed, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31))), digits, letters)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Archives (page_id, url, html) in files below path."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", sha1_base32(F.col("payload"))).withColumn("n", F.octet_length("payload"))
    equal = rows.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"), F.sum(F.col("n").cast("long")).alias("total"))
    equal = stored(equal, "digests")
    size = equal.agg(F.sum("copies").alias("rows"), F.sum("total").alias("total")).first()
    copied = equal.where("copies > 1").select("digest", "kept")
    rows = rows.join(stored(copied, "copied"), "digest", "left")
    revisit = (F.col("n") >= least) & F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))

    def name(column: str) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))

    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html;charset=utf-8{END}Content-Length: "), F.col("n"), F.lit(END + END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit(MAGIC),
        F.when(revisit, F.lit(f"WARC-Type: {TYPES[1]}")).otherwise(F.lit(f"WARC-Type: {TYPES[0]}")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", "[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {PROFILE}{END}WARC-Refers-To: "), name("kept"))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
    ]
    records = rows.withColumn("block", block).select(F.concat(F.concat_ws(END, *lines), F.lit(END + END), F.col("block")).alias("value"))
    average = (size["total"] or 0) // max(1, size["rows"] or 1) + 500
    records.write.option("lineSep", END + END).option("maxRecordsPerFile", max(1, FILE_BYTES // average)).text(path)


def _headers(lines: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines.decode("utf-8", "replace").split(END)) if v}


def _number(name: str) -> int | None:
    found = re.search(r"<urn:page:(-?\d+)>", name)
    return int(found[1]) if found else None


def unpacked(data: bytes) -> bytes:
    """What a compressed file's members hold, one after the other. It ends where a member breaks off or is damaged, with what came out of it, and before anything that is no member; a file that isn't compressed is as it is."""
    if data[:2] != GZIP:
        return data
    parts: list[bytes] = []
    while data[:2] == GZIP:
        member = zlib.decompressobj(31)
        try:
            parts.append(member.decompress(data))
        except zlib.error:
            # Piece by piece, so that what is before the damage isn't lost.
            again = zlib.decompressobj(31)
            with contextlib.suppress(zlib.error):
                for at in range(0, len(data), PIECE):
                    parts.append(again.decompress(data[at : at + PIECE]))
            break
        if not member.eof:
            break
        data = member.unused_data
    return b"".join(parts)


def heads(data: bytes) -> Iterator[tuple[int, int, dict[bytes, tuple[int, bytes]]]]:
    """(at, start, fields) of each line of the format's version that is followed by header lines up to an empty one: where it is, where its block starts, and each field's last place and value among the lines before that; those that are
    placed before `at` are not its own. Lines are read once, however many versions are among them."""
    at, end, start, whole, fields = data.find(VERSION), -1, 0, 0, {}
    while at >= 0:
        if data[at + len(VERSION) : at + len(VERSION) + 3] in (b"0\r\n", b"1\r\n"):
            if end < at + len(VERSION) + 1:
                end = data.find(b"\r\n\r\n", at + len(VERSION) + 1)
                if end < 0:
                    return
                start, whole, fields, place = end + 4, at, {}, at
                for line in data[at:end].split(b"\r\n"):
                    if b"\r" in line or b"\n" in line:
                        whole = place + max(line.rfind(b"\r"), line.rfind(b"\n")) + 1  # no header lines before this
                    name, colon, value = line.partition(b":")
                    if value:
                        fields[name.strip().lower()] = place, value.strip()
                    place += len(line) + 2
            if at >= whole:
                yield at, start, fields
        at = data.find(VERSION, at + 1)


def candidates(data: bytes, payloads: bool) -> Iterator[tuple]:
    """Every place of a file that looks like a record: where it is, where the next one begins, and what it holds."""
    for at, start, fields in heads(data):

        def said(name: bytes, at: int = at, fields: dict = fields) -> str | None:
            place, value = fields.get(name, (-1, b""))
            return value.decode("utf-8", "replace") if place >= at else None

        length, kind = said(b"content-length") or "", said(b"warc-type") or ""
        if not re.fullmatch("[0-9]{1,18}", length):
            continue
        end = start + int(length)
        if data[end : end + 4] != b"\r\n\r\n":
            continue
        block = data[start:end]
        http, empty_line, payload = block.partition(b"\r\n\r\n")
        if kind == TYPES[1]:
            of_page, payload = _headers(http.partition(b"\r\n")[2]).get("content-length", ""), None
            size, digest = int(of_page) if of_page.isdecimal() else None, (said(b"warc-payload-digest") or "").removeprefix("sha1:")
        else:
            payload = payload if kind == TYPES[0] and empty_line else block
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        name = said(b"warc-record-id") or ""
        yield at, end + 4, kind, name, _number(name), _number(said(b"warc-refers-to") or ""), size, digest, said(b"warc-target-uri"), payload if payloads else None


def read(spark: SparkSession, path: str, payloads: bool = True, types: tuple[str, ...] = TYPES, files: str = FILES) -> DataFrame:
    """The records of these types in all files below path whose names fit; payload is null for revisits, or throughout if payloads is false. Only this library's archives have page ids."""
    kind = pa.schema([("file", pa.string()), *((n, pa.int64()) for n in ("at", "next")), ("record_type", pa.string()), ("record_id", pa.string()), *((n, pa.int64()) for n in ("page_id", "refers_to", "payload_bytes")), ("payload_digest", pa.string()), ("url", pa.string()), ("payload", pa.binary())])

    def scan(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), kind, strict=True)], schema=kind)

        for batch in rows:
            for file, content in zip(batch.column(0), batch.column(1), strict=True):
                found, size = [], 0
                data = content.as_py()
                for x in candidates(unpacked(data), payloads):
                    found.append((file.as_py(), *x))
                    size += 300 + len(x[-1] or b"")
                    if size > BATCH_BYTES:
                        yield packed(found)
                        found, size = [], 0
                if found:
                    yield packed(found)

    found = spark.read.format("binaryFile").option("pathGlobFilter", files).option("recursiveFileLookup", True).load(path)
    records = stored(found.select("path", "content").mapInArrow(scan, RECORDS), "records")
    return records.join(reached(records.select("file", "at", "next")), ["file", "at"], "left_semi").where(F.col("record_type").isin(*types))


def reached(links: DataFrame) -> DataFrame:
    """(file, at) of the records on the chain from the start of each file, by pointer jumping over (file, at, next)."""
    links = links.select("file", "at", F.col("next").alias("to"), (F.col("at") == 0).alias("on"))
    count = -1
    while True:
        # One row a link: where it leads by now, and whether it is on the chain.
        leads = links.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        led = links.where("on").select("file", F.col("to").alias("at"), F.lit(True).alias("led")).distinct()
        before = links
        links = links.join(led, ["file", "at"], "left").join(leads, ["file", "to"], "left")
        links = stored(links.select("file", "at", F.coalesce("further", "to").alias("to"), (F.col("on") | F.coalesce("led", F.lit(False))).alias("on")), "links")
        if count >= 0:
            dropped(before)
        now = links.where("on").count()
        if now == count:
            return links.where("on").select("file", "at")
        count = now


def archive_and_read(pages: DataFrame, least: int = 0, payloads: bool = False) -> DataFrame:
    """Writes the pages to a new folder among the shared ones, and returns the records read back from it."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path, least)
    return read(spark, path, payloads)
