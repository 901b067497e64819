"""WARC archives: a writer on Spark's text sink and a salvage reader.

Writer: one row is one record, deflated to a gzip member of its own. Spark's text sink writes the members byte for byte, with
an empty gzip member as line separator, so each part file is a valid multi-member ``.warc.gz`` stream on any file system that
Spark reaches.

Reader: Spark reads each archive as bytes and a task walks through it member by member. A record that fails a check (header,
length, block digest, truncated or damaged member) is not the end: the reader searches for the next gzip member or, in plain
archives, the next version line, goes on there, and reports the bytes in between as a gap row with its reason. A task holds
one archive and one record at a time; the archives written here are as large as one task's share of the table.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, new_path

VERSION = b"WARC/1.1"
# Fixed values of the formats: start of a gzip member with deflate, an empty member, the start of a version line.
MEMBER = b"\x1f\x8b\x08"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r?\n")
RECORDS = ("archive string, offset long, length long, kind string, reason string, record_id string, record_type string, target string, "
           "refers_to string, payload_digest string, payload_bytes long, payload binary")


def record_bytes(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record. A revisit has no block: its payload is that of the record it refers to."""
    block = b"" if revisit else payload
    head = [VERSION.decode(), f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>",
            f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '', url or '')}", f"WARC-Payload-Digest: sha256:{digest}",
            f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def planned(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, digest, refers_to, revisit. Payloads of ``least`` bytes and more that occur again revisit the one with
    the smallest page_id; smallest ids are found by a partial aggregation, so a payload with many copies is one row per task."""
    own = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    first = durable(own.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
                    .where("n > 1").drop("n"), "first-pages")
    out = own.join(first, "digest", "left")
    return out.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to")).withColumn(
        "revisit", F.col("refers_to").isNotNull())


def write_archives(pages: DataFrame, path: str, least: int = 100) -> None:
    """pages (page_id, url, html) as archives below ``path``. A null html is an empty payload, a null page_id an empty id."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([member(record_bytes(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"],
                                                                                r["revisit"])) for r in rows], pa.binary())], ["value"])

    packed = planned(pages, least).mapInArrow(pack, "value binary")
    # The sink writes a string's bytes as they are; as Latin-1 the separator's bytes stay as they are too.
    (packed.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1"))
     .option("encoding", "ISO-8859-1").text(path))


def _inflate(data: memoryview, at: int) -> tuple[bytes | None, int, str]:
    """The member at ``at``: its content, the place after it, and why it failed."""
    unpack, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            if pos >= len(data):
                return None, at, "truncated member"
            part = data[pos:pos + (1 << 16)]
            out.append(unpack.decompress(part))
            pos += len(part)
    except zlib.error as wrong:
        return None, at, f"damaged member: {str(wrong)[:80]}"
    return b"".join(out), pos - len(unpack.unused_data), ""


def parse_record(data: bytes, at: int) -> tuple[dict | None, int, str]:
    """The record whose version line starts at ``at``: headers and block, the place after it, and why it failed."""
    line = VERSION_LINE.match(data, at)
    if not line:
        return None, at, "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None, at, "headers without end"
    heads: dict[str, str] = {}
    for raw in bytes(data[line.end():end]).decode("utf-8", "replace").split("\r\n"):
        name, colon, value = raw.partition(":")
        if not colon or not name or VERSION_LINE.match(raw.encode() + b"\n"):
            return None, at, "damaged header line"
        heads[name.strip().lower()] = value.strip()
    size = heads.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size):
        return None, at, "no valid length"
    stop = end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return None, at, "record does not end where its length says"
    block = bytes(data[end + 4:stop])
    kind, _, value = heads.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != value:
        return None, at, "block digest differs"
    return heads | {"": block}, stop + 4, ""


def _next_start(data: bytes, view: memoryview, at: int) -> int:
    """The next place, ``at`` included, where a member inflates or a record holds its checks; else the end."""
    while True:
        line, pack = VERSION_LINE.search(data, at), data.find(MEMBER, at)
        stops = [x for x in (pack, line.start() if line else -1) if x >= 0]
        if not stops:
            return len(data)
        at = min(stops)
        if (_inflate(view, at)[0] if at == pack else parse_record(data, at)[0]) is not None:
            return at
        at += 1


def salvage(data: bytes) -> Iterator[tuple]:
    """(offset, length, record or None, reason) of every record and gap, in order. Offsets are those of the archive's bytes;
    records and gaps inside one member share its range."""
    view, at = memoryview(data), 0
    while at < len(data):
        packed = data.startswith(MEMBER, at)
        text, after, reason = _inflate(view, at) if packed else (None, at, "")
        if text is not None:
            inner = 0
            while inner < len(text):
                found, stop, reason = parse_record(text, inner)
                if found is None:
                    line = VERSION_LINE.search(text, inner + 1)
                    stop = line.start() if line else len(text)
                yield at, after - at, found, reason
                inner = stop
        else:
            found = None
            if not packed:
                found, after, reason = parse_record(data, at)
            if found is None:
                after = _next_start(data, view, at + 1)
            yield at, after - at, found, reason
        at = after


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record (kind ``record``) and per quarantined byte range (kind ``gap``, with its reason) of all files below
    ``path``. payload_bytes and payload_digest of a revisit are those its record refers to: the digest is in its header, the
    length is null here. An empty file gives no row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        schema = pa.schema([(n, pa.int64() if n in ("offset", "length", "payload_bytes") else pa.binary() if n == "payload" else pa.string()) for n in names])
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch["path"][i].as_py(), batch["content"][i].as_py()
                out, held = [], 0
                for offset, length, found, reason in salvage(data):
                    row = dict.fromkeys(names) | {"archive": name, "offset": offset, "length": length, "kind": "record" if found else "gap", "reason": reason or None}
                    if found:
                        block, kind = found[""], found.get("warc-type")
                        digest = found.get("warc-payload-digest", "").removeprefix("sha256:")
                        row |= {"record_id": found.get("warc-record-id"), "record_type": kind, "target": found.get("warc-target-uri"), "refers_to": found.get("warc-refers-to"),
                                "payload_digest": digest if kind == "revisit" else hashlib.sha256(block).hexdigest(),
                                "payload_bytes": None if kind == "revisit" else len(block), "payload": block if with_payload else None}
                        held += len(block) * with_payload
                    out.append(row)
                    if len(out) >= 1000 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(rows, RECORDS)


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Writes ``pages`` as archives, reads them back and resolves revisits. One row per row of ``pages``."""
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(pages, path, least)
    records = durable(read_archives(spark, path, with_payload=False).where("kind = 'record'"), "records")
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    records = records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "archive", "offset")
    # Of the answered records only those that something refers to; a payload of many copies is one row.
    sizes = durable(records.where("record_type = 'response'").groupBy("payload_digest").agg(F.max("payload_bytes").alias("full")), "payload-sizes")
    again = records.where("record_type = 'revisit'").drop("payload_bytes").join(sizes, "payload_digest", "left").withColumnRenamed("full", "payload_bytes")
    return records.where("record_type = 'response'").unionByName(again).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "offset")
