"""Legacy archives (ARC 1 and 2) converted to WARC 1.1, written and read back.

An ARC record is a header line of space-separated fields, whose number depends on the version that the
archive's first record declares, and as many bytes as the line's last field says. The converter reads
lines and lengths, never searches for separators, and makes the WARC headers up from them: record
identifiers, timestamps, types and digests. Records with equal payloads refer to one of them.

Each WARC record is a gzip member of its own. Members are written by Spark's text writer with an empty member as
the line separator, which every reader of gzip passes over, and read back, split at it, by the text reader; so files
may have any size and a task never holds one.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselwatch.llm.common import bounded_batches, group_join, materialize, small_enough
from vesselwatch.session import shared_dir

#: The fields of a header line in either version of the format.
FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "code", "checksum", "location", "offset", "file", "length"],
}
#: Their names in the legend of an archive.
LEGEND = {
    "url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "code": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset",
    "file": "Filename", "length": "Archive-length",
}
#: Payloads below this many bytes are always stored in full.
LEAST_SHARED = 100
#: Pages and payload bytes of an ARC archive, about.
BLOB, BLOB_BYTES = 64, 4 << 20
#: Records of a WARC file, at most.
FILE_RECORDS = 20_000
#: The date of pages that come without one.
NO_DATE = "19700101000000"
#: The header that carries a page's number through an archive of pages.
NUMBER = "X-Page-Id"
#: An empty gzip member.
SEPARATOR = bytes.fromhex("1f8b08000000000000ff03000000000000000000")
RECORDS = "number long, url string, ip string, date string, kind string, block binary, digest binary, payload_bytes long"


def arc_header(version: int, url: str, date: str, kind: str, length: int) -> bytes:
    """A record's header line; spaces and controls of the url are percent-encoded."""
    url = "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url) or "-"
    values = {"url": url, "ip": "0.0.0.0", "date": date, "type": kind, "code": "200", "checksum": "-", "location": "-", "offset": "0", "file": "-", "length": str(length)}
    return (" ".join(values[f] for f in FIELDS[version]) + "\n").encode()


def write_arc(version: int, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An archive of (url, 14-digit date, type, block)."""
    about = f"{version} 0 pages\n{' '.join(LEGEND[f] for f in FIELDS[version])}\n".encode()
    # the first record's line has the fields of version 1 in either version
    out = [arc_header(1, "filedesc://pages.arc", NO_DATE, "text/plain", len(about)), about, b"\n"]
    for url, date, kind, block in records:
        out += [arc_header(version, url, date, kind, len(block)), block, b"\n"]
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[dict]:
    """The records of an archive, plain or gzipped: the header's fields, ``block`` and ``at``, its place in the plain archive.

    A url may hold spaces: fields are counted from the line's end. Raises ValueError on a broken archive.
    """
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("the archive ends within a header line")
        line = data[at:end].rstrip(b"\r").decode("utf-8", "replace")
        first = line.startswith("filedesc:")
        names = FIELDS[1 if first else version]
        values = line.rsplit(" ", len(names) - 1)
        if len(values) != len(names) or not values[-1].isdigit():
            raise ValueError(f"not a header line of version {version}: {values[:4]}")
        record = dict(zip(names, values, strict=True))
        size = int(record["length"])
        block = data[end + 1 : end + 1 + size]
        if len(block) != size:
            raise ValueError(f"the archive ends within a record of {size} bytes")
        if first:
            version = int(block.split(b" ", 1)[0])
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        else:
            yield record | {"block": block, "at": at}
        at = end + 1 + size
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1


def record_uuid(number: int | None) -> str:
    """A version 8 identifier that carries a 64-bit number (or none)."""
    bits = 0 if number is None else (number & (2**64 - 1)) | 1 << 64
    value = (bits >> 62 & 0xFFF) << 64 | bits & (2**62 - 1)
    return f"<urn:uuid:{uuid.UUID(int=value | 8 << 76 | 2 << 62)}>"


def uuid_number(record_id: str) -> int | None:
    value = uuid.UUID(record_id.strip("<>").removeprefix("urn:uuid:")).int
    bits = (value >> 64 & 0xFFF) << 62 | value & (2**62 - 1)
    if not bits >> 64:
        return None
    bits &= 2**64 - 1
    return bits - 2**64 if bits >> 63 else bits


def _head(block: bytes) -> tuple[bytes, bytes] | None:
    """(HTTP head with its end, payload) of a block, None if it isn't an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    head, end, payload = block.partition(b"\r\n\r\n")
    if not end:
        head, end, payload = block.partition(b"\n\n")
    return head + end, payload


def _header(head: bytes, name: str) -> str | None:
    for line in head.splitlines()[1:]:
        key, _, value = line.decode("utf-8", "replace").partition(":")
        if key.strip().lower() == name.lower():
            return value.strip()
    return None


def _date(text: str) -> str:
    """An ISO time from the 14 digits of an archive (12 in old ones)."""
    d = text.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(record: dict, refers_to: int | None) -> bytes:
    """A WARC record: a response or resource, or a revisit of ``refers_to``; ``record``: the fields of RECORDS."""
    http = _head(record["block"])
    kind = "revisit" if refers_to is not None else "response" if http or record["url"].startswith("dns:") else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_uuid(record['number'])}", f"WARC-Date: {_date(record['date'])}", f"WARC-Target-URI: {record['url']}",
        f"WARC-IP-Address: {record['ip']}", f"WARC-Payload-Digest: sha256:{record['digest'].hex()}", f"Content-Type: {'application/http; msgtype=response' if http else record['kind']}",
    ]
    block = record["block"]
    if refers_to is not None:
        block = http[0] if http else b""
        lines += [f"WARC-Refers-To: {record_uuid(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A gzip member that doesn't hold the separator.

    If compression keeps it, as of bytes that can't be compressed, the record is stored in parts: each separator in it is cut behind its first byte, where a
    flush puts five bytes in between that no separator holds.
    """
    data = gzip.compress(record, 6, mtime=0)
    if SEPARATOR not in data:
        return data
    parts = record.split(SEPARATOR)
    pieces = [parts[0]]
    for part in parts[1:]:
        pieces[-1] += SEPARATOR[:1]
        pieces.append(SEPARATOR[1:] + part)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    out = [packer.compress(piece) + packer.flush(zlib.Z_FULL_FLUSH) for piece in pieces]
    data = b"".join(out) + packer.flush()
    if SEPARATOR in data:  # made by two blocks' borders: 20 bytes by chance
        raise ValueError("a record whose stored form holds an empty gzip member")
    return data


def read_warc(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """(headers, block) of the records of an archive."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("the archive ends within a record")
        yield headers, block


def _to_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made, records, held = 0, [], 0
    part = TaskContext.get().partitionId()

    def archive() -> pa.RecordBatch:
        nonlocal made, records, held
        made += 1
        data = write_arc(1 + made % 2, records)
        records, held = [], 0
        return pa.record_batch([pa.array([f"pages-{part:06d}-{made:06d}.arc"]), pa.array([data], pa.binary())], names=["name", "archive"])

    for batch in batches:
        for number, url, html, date in zip(*(batch.column(k) for k in range(4)), strict=True):
            payload = (html.as_py() or "").encode()
            mine = f"{NUMBER}: {number}\r\n" if number.is_valid else ""
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{mine}Content-Length: {len(payload)}\r\n\r\n"
            records.append((url.as_py() or "", date.as_py() or NO_DATE, "text/html", head.encode() + payload))
            held += len(payload)
            if len(records) == BLOB or held > BLOB_BYTES:
                yield archive()
    if records:
        yield archive()


def _parsed(number_header: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), *[pa.string()] * 4, pa.binary(), pa.binary(), pa.int64()]
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r in read_arc(data.as_py()):
                    http = _head(r["block"])
                    payload = http[1] if http else r["block"]
                    if number_header is None:  # made up from the record's place
                        number = int.from_bytes(hashlib.sha256(f"{name} {r['at']}".encode()).digest()[:8], "big", signed=True)
                    else:
                        known = _header(http[0], number_header) if http else None
                        number = int(known) if known is not None else None
                    rows.append((number, r["url"], r["ip"], r["date"], r["type"], r["block"], hashlib.sha256(payload).digest(), len(payload)))
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in RECORDS.split(", ")])

    return run


def _through_arc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages to ARC archives and these to their records, archive by archive in one worker."""
    yield from _parsed(NUMBER)(_to_arc(batches))


def _to_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            rows = batch.slice(at, 256).to_pylist()
            yield pa.record_batch([pa.array([_member(warc_record(r, r["refers"])) for r in rows], pa.binary())], names=["member"])


def _from_warc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["number", "target_uri", "date", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for at in range(0, len(batch), 1024):
            rows: list[list] = []
            for member in batch.column(0)[at : at + 1024]:
                if not (data := member.as_py()):
                    continue
                try:
                    (headers, block) = next(read_warc(io.BytesIO(gzip.decompress(data))))
                except (OSError, EOFError, zlib.error, StopIteration) as e:
                    raise ValueError("damaged member of an archive") from e
                revisit = headers["warc-type"] == "revisit"
                digest = headers["warc-payload-digest"].removeprefix("sha256:")
                http = _head(block)
                payload = http[1] if http else block
                size = len(payload)
                if revisit:  # the payload is elsewhere; its length is what the server said
                    said = _header(http[0], "Content-Length") if http else None
                    size = int(said) if said and said.isdigit() else None
                elif hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"damaged payload in {headers['warc-record-id']}")
                rows.append([uuid_number(headers["warc-record-id"]), headers["warc-target-uri"], headers["warc-date"], size, digest, headers["warc-type"], uuid_number(headers["warc-refers-to"]) if revisit else None])
            cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """(name, archive): ARC archives of a few dozen pages (id, url, html, date) each, versions 1 and 2 in turn."""
    return pages.select("id", "url", "html", "date").mapInArrow(_to_arc, "name string, archive binary")


def arc_records(archives: DataFrame, number_header: str | None = None) -> DataFrame:
    """The records of ARC archives (name, archive), with a number each, the payload's SHA-256 and length.

    A record's number, of which its WARC identifier is made, comes from the archive's name and its place in it, or
    from an HTTP header of its own (null without it).
    """
    return archives.select("name", "archive").mapInArrow(_parsed(number_header), RECORDS)


def shared_payloads(records: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(digest, first, copies): of each payload of at least ``least`` bytes that several numbers share, the smallest number."""
    return (
        records.where((F.col("payload_bytes") >= least) & F.col("number").isNotNull())
        .groupBy("digest").agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count("*").alias("copies"))
        .where("first < last").select("digest", "first", "copies")
    )


def to_warc(records: DataFrame, shared: DataFrame) -> DataFrame:
    """(member): a gzipped WARC record for each of ``records``; those in ``shared`` but its first ones are revisits."""
    shared = materialize(shared, "shared")
    if small_enough(shared, 200_000):  # some 60 bytes each: payloads needn't move
        linked = records.join(F.broadcast(shared.drop("copies")), "digest", "left")
    else:
        linked = group_join(records, shared, "digest", "copies", 10_000, nulls=False)
    refers = F.when(F.col("number") != F.col("first"), F.col("first"))
    return linked.select(*(c.split()[0] for c in RECORDS.split(", ")), refers.alias("refers")).mapInArrow(_to_warc, "member binary")


def arc_to_warc(archives: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Converts ARC archives (name, archive), of whatever origin, to WARC files at ``path``."""
    bounded_batches(archives.sparkSession)
    records = arc_records(archives)
    write_warc(to_warc(records, shared_payloads(records, least)), path)


def write_warc(members: DataFrame, path: str) -> None:
    """WARC files of a gzip member a record, at most FILE_RECORDS each, through Spark's text writer, so on any file system."""
    text = members.select(F.col("member").cast("string").alias("value"))  # bytes as they are
    text.write.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """(number, target_uri, date, payload_bytes, payload_digest, record_type, refers_to) of all records that ``write_warc`` wrote to ``path``."""
    members = spark.read.option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1").text(path).select(F.col("value").cast("binary").alias("member"))
    return members.mapInArrow(_from_warc, "number long, target_uri string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(
    pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, least: int = LEAST_SHARED
) -> DataFrame:
    """Writes ``pages`` as WARC archives to ``path`` and returns what reading them back gives, one row per page.

    Pages become ARC archives, which are converted. Of the records with equal payloads of at least ``least``
    bytes, that with the smallest id is a response, the others are revisits of it (``refers_to``); smaller
    payloads are always responses. ``date_col``: 14-digit times; without it all records have the date NO_DATE.

    Defined cases: a null html is the empty payload, a null url the target ``-``; repeated rows of the
    smallest id are responses all; rows with a null id are responses and never referred to; texts
    of any length are stored whole; an empty table gives an empty result; other columns are ignored.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    path = path or f"{shared_dir(spark)}/llm-warc-{uuid.uuid4().hex}"
    date = F.col(date_col) if date_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), date.alias("date"))
    # digests straight from the pages: the archives' bytes are made once
    html = F.coalesce(F.col("html"), F.lit(""))
    shared = shared_payloads(rows.select(F.col("id").alias("number"), F.unhex(F.sha2(html, 256)).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes")), least)
    write_warc(to_warc(rows.mapInArrow(_through_arc, RECORDS), shared), path)
    return read_warc_files(spark, path).withColumnRenamed("number", id_col)
