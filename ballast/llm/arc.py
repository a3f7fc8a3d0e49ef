"""Converter from legacy ARC archives to WARC.

An ARC file is a row of records, each a header line and as many bytes as that
line declares.  The first record, ``filedesc://``, names the version of the
header lines: version 1 has five fields (URL, IP address, date, content type,
length), version 2 ten (with result code, checksum, location, offset and file
name).  For each record an equivalent WARC record is made up: its identifier
from archive name, offset, URL and date, so that converting again gives the
same; its date from the 14 digits; its type from scheme and content; SHA-1
digests of block and payload.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ballast.llm.common import fresh_path, small_batches, task

#: Fields of a header line by version.
FIELDS = {1: 5, 2: 10}
END = "\r\n\r\n"
#: Records of a WARC file at most, and about how many bytes of payload.
FILE_RECORDS, FILE_BYTES = 4000, 64 << 20
#: Records of an ARC file at most, and at about how many bytes of payload it ends.
ARC_RECORDS, ARC_BYTES = 100, 4 << 20
#: Rows of a broadcast table of digests, about 60 bytes each; beyond it the join shuffles.
MAX_BROADCAST_ROWS = 200_000
_blank = re.compile(r"[\s\x00-\x20\x7f]")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    offset: int
    body: bytes
    result_code: str = "-"
    location: str = "-"


def url_field(url: str | None) -> str:
    """A URL as a header field, without white space or control characters; ``about:blank`` for none."""
    return _blank.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else "about:blank"


def arc_start(name: str, version: int = 1, date: str = "20260101000000") -> bytes:
    """The record that begins an ARC file."""
    names = "URL IP-address Archive-date Content-type " + ("" if version == 1 else "Result-code Checksum Location Offset Filename ") + "Archive-length"
    body = f"{version} 0 ballast\n{names}\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str | None, body: bytes, version: int = 1, name: str = "-", offset: int = 0, date: str = "20260101000000", mime: str = "text/html", ip: str = "0.0.0.0") -> bytes:
    middle = "" if version == 1 else f" 200 - - {offset} {name}"
    return f"{url_field(url)} {ip} {date} {mime}{middle} {len(body)}\n".encode() + body + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records of an ARC file after its first, found by their declared lengths; gzip data is unpacked."""
    data = unpacked(data)
    at, version = 0, None
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError(f"no end of the header line at byte {at}")
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        begin = end + 1
        if version is None:
            if not line.startswith("filedesc:"):
                raise ValueError("an ARC file begins with a filedesc record")
            size = int(line.rsplit(" ", 1)[1])
            version = int(data[begin : begin + size].split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"ARC version {version}")
        else:
            fields = line.rsplit(" ", FIELDS[version] - 1)
            if len(fields) != FIELDS[version] or not fields[-1].isdigit():
                raise ValueError(f"not a header line of version {version}: {line[:200]!r}")
            size = int(fields[-1])
            more = {"result_code": fields[4], "location": fields[6]} if version == 2 else {}
            yield ArcRecord(fields[0], fields[1], fields[2], fields[3], at, data[begin : begin + size], **more)
        if begin + size > len(data):
            raise ValueError(f"the record at byte {at} ends before its declared length")
        at = begin + size


def warc_date(date: str) -> str:
    """``YYYYMMDDhhmmss``, of which later parts may lack, as WARC writes it; the epoch if it isn't a date."""
    digits = (date if re.fullmatch(r"[0-9]{4,14}", date) else "1970")
    full = digits + "00000101000000"[len(digits) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """The head of an HTTP message, with the blank line, and its payload; without a blank line all is payload."""
    at = block.find(b"\r\n\r\n")
    return (block[: at + 4], block[at + 4 :]) if at >= 0 else (b"", block)


def warc_record(record: ArcRecord, archive: str, extra: dict[str, str] | None = None, revisit_of: str | None = None) -> tuple[str, bytes]:
    """The WARC header and block of an ARC record; a revisit keeps the HTTP head alone."""
    is_http = record.url.lower().startswith(("http:", "https:")) and record.body[:5] == b"HTTP/"
    head, payload = split_http(record.body) if is_http or record.body[:5] == b"HTTP/" else (b"", record.body)
    kind = "response" if head else "resource"
    block = record.body
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}:{record.offset}:{record.url}:{record.date}')}>",
        "WARC-Date": warc_date(record.date),
        "WARC-Target-URI": record.url,
        "WARC-IP-Address": record.ip,
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "Content-Type": "application/http;msgtype=response" if head else record.mime,
    }
    if revisit_of is not None:
        block = head
        fields |= {
            "WARC-Type": "revisit",
            "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            "WARC-Refers-To-Target-URI": revisit_of,
        }
    fields |= extra or {}
    fields |= {"WARC-Block-Digest": f"sha1:{digest(block)}", "Content-Length": str(len(block))}
    return "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n", block


def unpacked(data: bytes) -> bytes:
    """The data as it is, or if it is gzip all of its members unpacked."""
    out = []
    while data[:2] == b"\x1f\x8b":
        unzip = zlib.decompressobj(31)
        out.append(unzip.decompress(data))
        data = unzip.unused_data
        if not data:
            return b"".join(out)
    return b"".join([*out, data])


def _pieces(data: bytes, size: int = 1 << 18) -> Iterator[bytes]:
    """The data in pieces, those of gzip members unpacked."""
    left = memoryview(data)
    while len(left):
        if left[:2] != b"\x1f\x8b":
            yield bytes(left[:size])
            left = left[size:]
            continue
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            if not len(left):
                raise ValueError("a gzip member ends too early")
            piece, left = left[:size], left[size:]
            while len(piece) or unzip.unconsumed_tail:
                yield unzip.decompress(unzip.unconsumed_tail or piece, size)
                piece = b""
                if unzip.eof:
                    break
        left = memoryview(data)[len(data) - len(left) - len(unzip.unused_data) :]


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of every record of a WARC file, gzip or not, a record in memory at a time."""
    held, pieces, at = bytearray(), _pieces(data), 0
    while True:
        while (end := held.find(END.encode())) < 0 and (piece := next(pieces, None)) is not None:
            held += piece
        if not held:
            return
        lines = held[:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        begin, size = end + len(END), int(fields["content-length"])
        whole = begin + size + len(END)
        while len(held) < whole and (piece := next(pieces, None)) is not None:
            held += piece
        if len(held) < begin + size:
            raise ValueError(f"the record at byte {at} ends before its declared length")
        yield fields, bytes(held[begin : begin + size])
        del held[:whole]
        at += whole


def convert(archive: bytes, name: str) -> bytes:
    """A whole ARC file as a WARC file."""
    return b"".join(head.encode() + block + END.encode() for head, block in (warc_record(r, name) for r in read_arc(archive)))


@task("arc")
def _converted(batches):
    """Pages as the records of ARC files, of version 1 or 2 by the first page's id, and these as WARC records without their end."""
    for batch in batches:
        pages = batch.column("page_id").to_pylist()
        urls, bodies, targets = (batch.column(c).to_pylist() for c in ("url", "html", "refers_to"))
        first = 0
        while first < len(pages):
            version, name = 1 + crc32(str(pages[first]).encode()) % 2, f"pages-{pages[first]}.arc"
            archive, end = bytearray(arc_start(name, version)), first
            while end < len(pages) and end - first < ARC_RECORDS and len(archive) < ARC_BYTES:
                payload = (bodies[end] or "").encode("utf-8", "surrogatepass")
                bodies[end] = None
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                archive += arc_record(urls[end], http, version, name, len(archive))
                end += 1
            out = []
            for k, record in zip(range(first, end), read_arc(bytes(archive)), strict=True):
                extra = {"X-Page-Id": "" if pages[k] is None else str(pages[k])}
                target = targets[k]
                if target is not None:
                    extra["X-Refers-To-Page"] = str(target)
                head, block = warc_record(record, name, extra, None if target is None else f"urn:page:{target}")
                out.append(head + block.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])
            first = end


@task("arc")
def _read_back(batches):
    for batch in batches:
        for content in batch.column("content"):
            ids, sizes, digests, kinds, targets = [], [], [], [], []
            for fields, block in read_warc(content.as_buffer().to_pybytes()):
                head, payload = split_http(block)
                declared = int(re.search(rb"(?im)^content-length: *([0-9]+)", head)[1])
                said = fields["warc-payload-digest"].removeprefix("sha1:")
                if fields["warc-type"] == "response" and (len(payload) != declared or digest(payload) != said):
                    raise ValueError(f"the payload of {fields['warc-record-id']} is not what its record says")
                ids.append(int(fields["x-page-id"]) if fields["x-page-id"] else None)
                sizes.append(declared)
                digests.append(said)
                kinds.append(fields["warc-type"])
                targets.append(int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(targets, pa.int64())],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Writes a WARC record for every row of ``pages(page_id, url, html)`` to gzip files in ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the
    largest page_id is a response (rows that share that page_id too), the others
    are revisits of it; if all their page_ids are null all are responses.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    groups = (
        rows.filter(F.octet_length("html") >= least_bytes).groupBy("sha")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("kept")).filter("n > 1 and kept is not null").select("sha", "kept")
    )
    if groups.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:
        groups = F.broadcast(groups)
    target = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("kept")), F.col("kept"))
    marked = rows.join(groups, "sha", "left").select("page_id", "url", "html", target.alias("refers_to"))
    records = marked.mapInArrow(_converted, "value string")
    mean = rows.agg(F.avg(F.octet_length("html"))).first()[0] or 0
    (
        records.write.option("lineSep", END).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED")
        .option("maxRecordsPerFile", max(1, min(FILE_RECORDS, int(FILE_BYTES / (mean + 1000))))).text(path)
    )


def read_pages(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record in the WARC files of a folder; payloads are checked."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(_read_back, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages as ``write_pages`` does, and what ``read_pages`` reads back.

    One row per input row.  A null html is an empty payload, a null URL
    ``about:blank``, a null page_id stays null; an empty table gives no rows;
    further columns are ignored.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_pages(pages, path, least_bytes)
    return read_pages(spark, path)
