"""WARC archives: a writer with revisit records and a reader that salvages damage.

Writer: one record per page, one gzip member per record (or plain records).
Spark's text writer stores the bytes: a record is one "line", and the line
separator is an empty gzip member (plain: the record's closing CRLF CRLF), so
files are valid archives, written under Spark's commit protocol by any number
of tasks, with a bounded number of records per file.

Reader: archives come as (path, content). Members are checked (gzip trailer,
version line, content length, closing CRLF CRLF, payload digest). After a
failed check the reader searches for the next valid gzip member or, in plain
bytes, the next version line that starts a sound record, goes on there, and
logs the byte gap between as quarantined. Inside a member, whole or inflated up
to its damage, it searches version lines the same way; such a gap has the
member's place in the file, and the inflated bytes in its reason. Memory: one
archive file and one inflated member.

Equal payloads of at least ``min_revisit`` bytes are stored once: the record of
the largest id is the response, the others are revisits that name it.

Defined results: a null payload is empty; a null id is written as an empty id
and read back as null (it is the response of its payload only if all ids of it
are null); rows with equal id and payload are stored once each and are all
responses if they have the largest id; an empty table gives no records; other
columns do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import small, stored

MIN_REVISIT = 1000
RECORDS_PER_FILE = 2000
BYTES_PER_FILE = 32 << 20
CHUNK = 1 << 15

# Fixed values of the formats.
VERSION = b"WARC/1.1"
GZIP_MAGIC = b"\x1f\x8b\x08"
EMPTY_MEMBER = "\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03\x03\x00\x00\x00\x00\x00\x00\x00\x00\x00"
REVISIT_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = b"urn:page:"
DATE = b"2000-01-01T00:00:00Z"
HTTP_TYPE = b"application/http"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

RECORDS = ("path string, offset bigint, length bigint, kind string, page_id bigint, url string, "
           "refers_to bigint, payload_digest string, payload binary")
GAPS = "path string, offset bigint, length bigint, reason string"

_START = re.compile(rb"WARC/1\.[01]\r\n")
_CONTROL = re.compile(rb"[\x00-\x08\x0a-\x1f\x7f]")
_PAGE = re.compile(rb"<?" + ID_PREFIX + rb"(-?[0-9]+)>?")


def record(page_id, url, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    """Bytes of one record, without the closing CRLF CRLF."""
    def urn(x):
        return ID_PREFIX + (b"" if x is None else str(x).encode())

    # a header value holds no line breaks: control characters and % are percent-escaped
    uri = re.sub(rb"[\x00-\x20%\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "").encode())
    head = [VERSION, b"WARC-Type: " + (b"revisit" if revisit else b"response"),
            b"WARC-Record-ID: <" + urn(page_id) + b">", b"WARC-Date: " + DATE,
            b"WARC-Payload-Digest: sha1:" + digest.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + uri)
    if revisit:
        head += [b"WARC-Profile: " + REVISIT_PROFILE, b"WARC-Refers-To: <" + urn(refers_to) + b">"]
        block = b""
    else:
        head.append(b"Content-Type: " + HTTP_TYPE + b"; msgtype=response")
        block = HTTP_HEAD + payload
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def mark_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url",
                  payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, payload, digest, revisit, refers_to), one row per page.

    Only groups of two or more equal payloads meet the pages again: broadcast if
    they are few, else by a join on the digest.
    """
    body = F.coalesce(F.col(f"`{payload}`").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"),
                        F.col(f"`{url}`").cast("string").alias("url"), body.alias("payload"),
                        F.sha1(body).alias("digest"))
    groups = stored(rows.filter(F.octet_length("payload") >= min_revisit)
                    .groupBy("digest").agg(F.max("page_id").alias("first_id"),
                                           F.count(F.lit(1)).alias("n"))
                    .filter("n > 1").select("digest", "first_id"))
    later = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(small(groups), "digest", "left").select(
        "page_id", "url", "payload", "digest", later.alias("revisit"),
        F.when(later, F.col("first_id")).alias("refers_to"))


def write_archives(marked: DataFrame, path: str, gzip: bool = True,
                   records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the rows of :func:`mark_revisits` as archive files below ``path``."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit")]
            out, held = [], 0
            for i in range(b.num_rows):
                r = record(*[c[i].as_py() for c in cols])
                out.append(_member(r + b"\r\n\r\n") if gzip else r)
                held += len(out[-1])
                if held > BYTES_PER_FILE:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = marked.mapInArrow(encode, "value binary").select(F.col("value").cast("string"))
    (lines.write.mode("overwrite").option("encoding", "ISO-8859-1")
     .option("lineSep", EMPTY_MEMBER if gzip else "\r\n\r\n")
     .option("maxRecordsPerFile", records_per_file).text(path))


def _parse(data: bytes, at: int):
    """(fields, payload, end) of the sound plain record at ``at``, or the reason why it is none."""
    if not _START.match(data, at):
        return "no version line"
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return "header without end"
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, sep, value = line.partition(b":")
        if not sep or _CONTROL.search(line):
            return "malformed header"
        fields[name.strip().lower()] = value.strip()
    size = fields.get(b"content-length", b"")
    if not size.isdigit():
        return "no content length"
    start, stop = end + 4, end + 4 + int(size)
    if data[stop:stop + 4] != b"\r\n\r\n":
        return "content length does not fit"
    payload = data[start:stop]
    if fields.get(b"content-type", b"").startswith(HTTP_TYPE):
        payload = payload.partition(b"\r\n\r\n")[2]
    kind, digest = fields.get(b"warc-type", b""), fields.get(b"warc-payload-digest", b"")
    if kind != b"revisit" and digest.startswith(b"sha1:"):
        made, said = hashlib.sha1(payload), digest[5:]
        if said.lower() != made.hexdigest().encode() and said != base64.b32encode(made.digest()):
            return "payload digest does not fit"
    return fields, payload, stop + 4


def _member_at(data: bytes, at: int):
    """(content, end, reason) of the gzip member at ``at``; the reason is None if it is sound,
    otherwise the content is what was inflated up to ``end``."""
    z, parts, view = zlib.decompressobj(31), [], memoryview(data)
    step = CHUNK
    while not z.eof and at < len(data):
        before = z.copy() if step > 1 else None
        try:
            parts.append(z.decompress(view[at:at + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(parts), at, f"gzip: {e}"
            z, step = before, 1  # byte by byte, for all that comes before the damage
            continue
        at += len(view[at:at + step])
    if not z.eof:
        return b"".join(parts), at, "gzip member without end"
    return b"".join(parts), at - len(z.unused_data), None


def _inside(content: bytes):
    """Yield (start, end, fields and payload, None) of the sound records of plain bytes, and
    (start, end, None, reason) of the gaps between."""
    at, bad, reason = 0, None, ""
    while at < len(content):
        got = _parse(content, at)
        if isinstance(got, str):
            if bad is None:
                bad, reason = at, got
            line = _START.search(content, at + 1)
            at = line.start() if line else len(content)
            continue
        if bad is not None:
            yield bad, at, None, reason
            bad = None
        yield at, got[2], got[:2], None
        at = got[2]
    if bad is not None:
        yield bad, len(content), None, reason


def _row(fields, payload, path, at, length):
    def page(v):
        m = _PAGE.fullmatch(v)
        return int(m[1]) if m else None

    uri = fields.get(b"warc-target-uri")
    if uri is not None:
        uri = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), uri).decode("utf-8", "replace")
    digest = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace")
    return (path, at, length, fields.get(b"warc-type", b"").decode("ascii", "replace"),
            page(fields.get(b"warc-record-id", b"")), uri, page(fields.get(b"warc-refers-to", b"")),
            digest.removeprefix("sha1:").lower(), payload)


def salvage(path: str, data: bytes):
    """Yield ('record', row) and ('gap', row) for the bytes of one archive, in order.

    gzip members and plain records may follow each other in any order.
    """
    at, bad, reason = 0, None, ""
    seen, upto = [], 0  # records of a damaged member, and how far it was inflated
    while at < len(data):
        rows, end = [], None
        if data.startswith(GZIP_MAGIC, at):
            content, stop, got = _member_at(data, at)
            found = list(_inside(content))
            sound = [x[2] for x in found if x[2]]
            for a, z, one, why in found if sound else ():
                if one and at < upto and one in seen:  # the damaged member ran over it
                    continue
                rows.append(("record", _row(*one, path, at, stop - at)) if one else
                            ("gap", (path, at, stop - at, f"{why}: bytes {a} to {z} of the inflated member")))
            if got is None and (sound or not content):
                end = stop
            elif got is None:  # a sound member, but not of sound records
                if bad is None:
                    bad, reason = at, found[0][3]
                at = stop
                continue
            elif sound:
                seen, upto = seen + sound if at < upto else sound, max(stop, upto)
        else:
            got = _parse(data, at)
            if not isinstance(got, str):
                end = got[2]
                if at >= upto or got[:2] not in seen:  # else inflated with the damaged member already
                    rows.append(("record", _row(got[0], got[1], path, at, end - at)))
        if end is None:
            yield from rows
            if bad is None:
                bad, reason = at, got
            line = _START.search(data, at + 1)
            starts = (data.find(GZIP_MAGIC, at + 1), line.start() if line else -1)
            at = min((x for x in starts if x > 0), default=len(data))
            continue
        if bad is not None:
            yield "gap", (path, bad, at - bad, reason)
            bad = None
        yield from rows
        at = end
    if bad is not None:
        yield "gap", (path, bad, len(data) - bad, reason)


def _read(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [f.split()[0] for f in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        kinds = [types[f.split()[1]] for f in schema.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            for i in range(b.num_rows):
                rows, held = [], 0
                data = b.column("content")[i].as_py()
                for what, row in salvage(b.column("path")[i].as_py(), data):
                    if what == kind:
                        rows.append(row)
                        held += len(row[-1])
                        if held > BYTES_PER_FILE:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return files.mapInArrow(parse, schema)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All sound records of the archives below ``path`` (:data:`RECORDS`)."""
    return _read(spark, path, "record", RECORDS)


def read_gaps(spark: SparkSession, path: str) -> DataFrame:
    """The quarantined byte ranges of the archives below ``path`` (:data:`GAPS`)."""
    return _read(spark, path, "gap", GAPS)


def resolve(records: DataFrame) -> DataFrame:
    """One row per record with the size and digest of its full payload.

    A revisit has them from the response it names, found by id and digest.
    """
    # the rows are kept without payloads: they are read once and joined with themselves
    rows = stored(records.select(
        "page_id", "url", "kind", "refers_to", "payload_digest",
        F.octet_length("payload").cast("long").alias("bytes"),
        F.sha1("payload").alias("sha1")))
    first = rows.filter("kind = 'response'").groupBy("page_id", "payload_digest").agg(
        F.max("bytes").alias("first_bytes"), F.max("sha1").alias("first_sha1"))
    again = rows.filter("kind = 'revisit'").select(
        F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    named = small(stored(first.join(again, ["page_id", "payload_digest"], "left_semi").select(
        F.col("page_id").alias("refers_to"), "payload_digest", "first_bytes", "first_sha1")))
    own = F.col("kind") == "response"
    return rows.join(named, ["refers_to", "payload_digest"], "left").select(
        "page_id", "url", F.when(own, F.col("bytes")).otherwise(F.col("first_bytes"))
        .alias("payload_bytes"),
        F.when(own, F.col("sha1")).otherwise(F.col("first_sha1")).alias("payload_digest"),
        F.col("kind").alias("record_type"), "refers_to")
