"""Legacy ARC archives to WARC: write, read and convert, without a file handle.

Archives are written by Spark's text writer and read whole by its binary reader,
so any store that Spark knows will do.  An ARC file ends behind the record that
takes it over ``FILE_BYTES``, a WARC file before it; a single record may be of any
length.

An ARC file begins with a version block whose lines name the version and the
fields of the header lines: five in version 1, ten in version 2.  Records are
taken by their declared lengths, never by searching for a separator.  A record
whose header line or length does not fit its file ends the reading of that file
with a row that has ``problem`` set; the records before it stand.

The conversion synthesises what an ARC record does not have: the WARC record id
(a UUID from archive name, offset and content), the date in ISO form, the type
and the payload digest.  Of records with equal payloads of at least
``MIN_REVISIT`` bytes the one with the largest page id is the response and the
others revisit it; among equal ids the last in the order of record ids wins.

A null page id stays null, a null url is ``unknown:``, a null payload is empty.
Blanks and control characters in a url are percent-encoded, as a header line is
cut at blanks.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from songsift.llm.batches import PIECE
from songsift.session import scratch_path, settle

# Fixed values of the two ARC versions.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: [
        "URL", "IP-address", "Archive-date", "Content-type", "Result-code",
        "Checksum", "Location", "Offset", "Filename", "Archive-length",
    ],
}
MIN_REVISIT = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of content that an archive file should have.
FILE_BYTES = 16 << 20

_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_STAMP = "20200101000000"
_RECORD = "record_id string, page_id bigint, url string, date string, mime string, payload binary, problem string"


def _escaped(url: str | None) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "") or "unknown:"


def header_line(version: int, url: str, length: int, offset: int, name: str, checksum: str) -> str:
    values = {
        "URL": url, "IP-address": "0.0.0.0", "Archive-date": _STAMP, "Content-type": "text/html",
        "Result-code": "200", "Checksum": checksum, "Location": "-", "Offset": str(offset),
        "Filename": name, "Archive-length": str(length),
    }
    return " ".join(values[f] for f in FIELDS[version])


def version_block(version: int, name: str) -> str:
    body = f"{version} 0 songsift\n{' '.join(FIELDS[version])}\n"
    return f"filedesc://{name} 0.0.0.0 {_STAMP} text/plain {len(body)}\n{body}"


def parse_arc(data: bytes, name: str) -> Iterator[tuple[dict[str, str], int, bytes]]:
    """(header fields, offset, content) of each record; ``ValueError`` where the file is broken."""
    at, fields = 0, FIELDS[1]
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        values = line.split(" ")
        block = line.startswith("filedesc://")
        names = FIELDS[1] if block and len(values) == len(FIELDS[1]) else FIELDS[2] if block else fields
        if end < 0 or len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"{name} at {at}: no header line of {len(names)} fields")
        length = int(values[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"{name} at {at}: {len(content)} of {length} bytes")
        if block:
            lines = content.decode("utf-8", "replace").split("\n")
            version = int(lines[0].split(" ")[0]) if lines[0].split(" ")[0].isdigit() else 0
            # Behind the first block a page may have such a url; its content tells.
            if version in FIELDS and len(lines) > 1 and lines[1].split(" ") == FIELDS[version]:
                fields = FIELDS[version]
            elif at and names == fields:
                block = False
            else:
                raise ValueError(f"{name} at {at}: unknown version block {lines[:2]}")
        if not block:
            yield dict(zip(names, values)), at, content
        at = end + 1 + length


def write_arc(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Pages as ARC files of about ``file_bytes``, those of odd tasks in version 2.

    The content of a record is an HTTP response, whose headers carry the page id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        version = 1 + task % 2
        name, parts, size = "", [], 0
        for batch in batches:
            for page, link, body in zip(*(batch.column(c).to_pylist() for c in ("page", "link", "body"))):
                if not parts:
                    name = f"pages-{task:05d}-{number:05d}.arc"
                    parts = [version_block(version, name)]
                    size = len(parts[0])
                own = "" if page is None else f"X-Page-Id: {page}\r\n"
                content = f"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n{own}\r\n{body or ''}".encode()
                line = header_line(
                    version, _escaped(link), len(content), size + 1, name, hashlib.sha1(content).hexdigest()
                )
                parts.append(f"{line}\n{content.decode()}")
                size += len(line.encode()) + len(content) + 2
                if size >= file_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(["\n".join(parts)])], ["value"])
                    number, parts = number + 1, []
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(["\n".join(parts)])], ["value"])

    slim = pages.select(F.col(page_id).cast("bigint").alias("page"), F.col(url).alias("link"), F.col(html).alias("body"))
    archives = slim.mapInArrow(run, "value string")
    archives.write.option("compression", "gzip").option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _inflated(data: bytes) -> bytes:
    """A file as written, of one or more gzip members or plain."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(31)
        out += [member.decompress(data), member.flush()]
        data = member.unused_data
    return b"".join(out)


def split_http(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers in lower case and payload of an HTTP response; all is payload if it is none."""
    if not content.startswith(b"HTTP/"):
        return {}, content
    head, _, payload = content.partition(b"\r\n\r\n")
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}, payload


def read_arc(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """A row for each record of the ARC files below ``path``; if ``strict``, a broken file is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                name, rows = file.rsplit("/", 1)[-1], []
                try:
                    for fields, offset, content in parse_arc(_inflated(data), name):
                        headers, payload = split_http(content)
                        key = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}:{offset}:{hashlib.sha1(content).hexdigest()}")
                        page = headers.get("x-page-id", "")
                        stamp = fields["Archive-date"].ljust(14, "0")
                        date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
                        number = int(page) if re.fullmatch(r"-?\d+", page) else None
                        rows.append((key.urn, number, fields["URL"], date, fields["Content-type"], payload, None))
                except ValueError as error:
                    if strict:
                        raise
                    rows.append((None, None, None, None, None, None, str(error)))
                for at in range(0, len(rows), 256):
                    columns = zip(*rows[at : at + 256])
                    types = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
                    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                    yield pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in _RECORD.split(", ")])

    return _archives(spark, path).mapInArrow(run, _RECORD)


def convert(records: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """ARC records with the WARC digest, type and, for a revisit, the record it refers to."""
    known = records.filter("problem is null").withColumn("digest", F.sha1("payload"))
    latest = (
        known.filter(F.octet_length("payload") >= min_revisit)
        .groupBy("digest")
        .agg(
            F.max(F.struct(F.col("page_id").isNotNull(), "page_id", "record_id")).alias("to"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .select("digest", F.col("to.record_id").alias("to_record"), F.col("to.page_id").alias("to_page"))
    )
    # Written, so that Spark knows its size, and can split a digest that very many records share.
    latest = settle(latest, "latest")
    revisit = F.col("to_record").isNotNull() & (F.col("to_record") != F.col("record_id"))
    return known.join(latest, "digest", "left").select(
        *known.columns,
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("to_record")).alias("refers_to_record"),
        F.when(revisit, F.col("to_page")).alias("refers_to_page"),
    )


def write_warc(records: DataFrame, path: str) -> None:
    """Records as WARC 1.1.  The writer ends each with the two line breaks that the format asks for."""
    line = "\r\n"
    payload = F.when(F.col("type") == "response", F.col("payload").cast("string")).otherwise("")
    page = F.when(F.col("page_id").isNotNull(), F.concat(F.lit("X-Page-Id: "), F.col("page_id"), F.lit(line)))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{line}Content-Type: "), "mime", F.lit(line),
        F.coalesce(page, F.lit("")), F.lit(line),
    )
    refers = F.concat(
        F.lit("WARC-Refers-To: <"), "refers_to_record", F.lit(f">{line}WARC-Profile: {REVISIT_PROFILE}{line}"),
        F.coalesce(F.concat(F.lit("X-Refers-To-Page: "), "refers_to_page", F.lit(line)), F.lit("")),
    )
    head = F.concat(
        F.lit(f"WARC/1.1{line}WARC-Type: "), "type",
        F.lit(f"{line}WARC-Record-ID: <"), "record_id",
        F.lit(f">{line}WARC-Date: "), "date",
        F.lit(f"{line}WARC-Target-URI: "), "url",
        F.lit(f"{line}WARC-Payload-Digest: sha1:"), "digest",
        F.lit(f"{line}X-Payload-Length: "), F.octet_length("payload"),
        F.lit(line), F.coalesce(refers, F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{line}Content-Length: "),
        F.octet_length(http) + F.octet_length(payload), F.lit(line + line),
    )
    value = F.concat(head, http, payload).alias("value")
    # A row is all of a file.
    files = records.select(value).mapInArrow(_in_files, "value string").write.option("maxRecordsPerFile", 1)
    files.option("compression", "gzip").option("lineSep", line + line).text(path)


def _in_files(batches: Iterator[pa.RecordBatch], size: int = FILE_BYTES) -> Iterator[pa.RecordBatch]:
    """Records joined to texts of about ``size`` bytes; one that is larger is a text of its own."""
    held: list[str] = []
    total = 0

    def joined() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(["\r\n\r\n".join(held)])], ["value"])

    for batch in batches:
        for value in batch.column("value"):
            record = value.as_py()
            if held and total + len(record) > size:
                yield joined()
                held, total = [], 0
            held.append(record)
            total += len(record)
    if held:
        yield joined()


def parse_warc(data: bytes, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n") if end >= 0 else [""]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        if not lines[0].startswith("WARC/1.") or not length.isdigit():
            raise ValueError(f"{name} at {at}: no WARC header")
        at = end + 4 + int(length)
        block = data[end + 4 : at]
        if len(block) < int(length) or data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"{name}: the record at {end + 4 - len(data[at:end])} is cut off")
        at += 4
        yield headers, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the WARC files below ``path``.

    The length and digest of a response are taken from its payload, which must
    agree with the digest in its header; those of a revisit are in its header.
    """
    schema = (
        "record_id string, page_id bigint, url string, date string, record_type string, payload_bytes bigint, "
        "payload_digest string, refers_to_record string, refers_to bigint, payload binary"
    )

    def number(text: str | None) -> int | None:
        return int(text) if text is not None else None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64()] + [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), [*types, pa.int64(), pa.binary()])]
        return pa.RecordBatch.from_arrays(arrays, [f.split(" ")[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(*(batch.column(c).to_pylist() for c in ("path", "content"))):
                rows, held = [], 0
                for head, block in parse_warc(_inflated(data), file):
                    http, payload = split_http(block)
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    size, kind = len(payload), head["warc-type"]
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{file}: {head['warc-record-id']} does not have its digest")
                    if kind == "revisit":
                        size, payload = int(head["x-payload-length"]), None
                    rows.append(
                        (head["warc-record-id"].strip("<>"), number(http.get("x-page-id")), head["warc-target-uri"])
                        + (head["warc-date"], kind, size, digest, head.get("warc-refers-to", "").strip("<>") or None)
                        + (number(head.get("x-refers-to-page")), payload)
                    )
                    held += len(block)
                    if len(rows) == 256 or held > PIECE:
                        yield table(rows)
                        rows, held = [], 0
                if rows:
                    yield table(rows)

    return _archives(spark, path).mapInArrow(run, schema)


def convert_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages through ARC files, converted to WARC files and read back.

    Both sets of files stay below the shared folder.  A record that cannot be
    read, or another number of records than pages, is an error.
    """
    spark = pages.sparkSession
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    n, given, made = F.count(F.lit(1)).alias("n"), Observation(), Observation()
    write_arc(pages.observe(given, n), arc, page_id, url, html)
    write_warc(convert(read_arc(spark, arc, strict=True)).observe(made, n), warc)
    if given.get["n"] != made.get["n"]:
        raise ValueError(f"{made.get['n']} records of {given.get['n']} pages")
    return read_warc(spark, warc)
