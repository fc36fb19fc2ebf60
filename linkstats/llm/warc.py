"""WARC archives: distributed writer and a reader that salvages damaged files.

The writer makes one record per page. Of pages with equal payloads the one with the largest id is a
response, the others are revisits that refer to it. Every record is a gzip member of its own, and a
file is a plain sequence of members, so archives can be read by any WARC tool. Spark's text sink writes
them, so that any file system works and lost tasks are committed once: a member of less than 16 MiB ends
with a zero byte (the top byte of its size), which is left out of the row and put back as the sink's
line separator. Longer members are followed by an empty member, which ends with a zero byte too.

The reader takes whole archives, whether of gzip members, plain records or both. A record must have a
version line, a block of the stated length that two line ends follow, and digests that match. When a
check fails it looks for the next gzip member or version line from which a valid record can be read,
goes on there, and reports the bytes between as a gap with the reason. The same holds inside a gzip member of
several records: those before and after a bad one are read, and so are those that a damaged or cut member
gives before its error. Offset and length of a gap inside a member are the member's, and the reason names
the unpacked bytes. A record that is all there is of a member fails with the member's own checks.

Defined results: a null payload is empty; a null url is left out; a null page id counts as smallest and
is written as ``null``; rows repeated with the same id and payload are all responses. A file is read in
one task, so ``max_records`` bounds what the writer puts into one. An empty table writes no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats.llm.common import arrow_batches, schema_of

# Fixed values of the format.
VERSION = b"WARC/1.1\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP_MAGIC = b"\x1f\x8b\x08"

_CANDIDATE = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d")
_VERSION_LINE = re.compile(rb"WARC/\d\.\d\r\n")
_ID = "urn:x-page:"

RECORDS = ("file string, offset long, length long, warc_type string, record_id string, url string, "
           "refers_to string, payload_bytes long, payload_digest string, payload binary, gap_reason string")


def digest(data: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page: int | None, url: str | None, payload: bytes, holder: int | None, date: str) -> bytes:
    """One record; ``holder`` is the id of the response of this payload."""
    revisit = holder is not None and page != holder
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
             % len(payload)) + (b"" if revisit else payload)
    name = "null" if page is None else page
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{name}>",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest(payload)}",
            f"WARC-Block-Digest: sha1:{digest(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{holder}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member whose last byte is zero (see the module's notes)."""
    def member(part: bytes) -> bytes:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        return packer.compress(part) + packer.flush()
    packed = member(data)
    return packed if packed[-1] == 0 else packed + member(b"")


def write_warc(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", max_records: int = 20_000,
               min_payload: int = 0) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``. Payloads under ``min_payload`` bytes
    are all written as responses."""
    keyed = pages.select("page_id", "url", "html").withColumn(
        "sum", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    holders = keyed.groupBy("sum").agg(F.max("page_id").alias("holder"))
    rows = keyed.join(holders, "sum").select("page_id", "url", "html", "holder")
    schema = schema_of("member binary")

    def members(batches: Iterator) -> Iterator:
        def rows():
            for batch in batches:
                for page, url, html, holder in zip(*(c.to_pylist() for c in batch.columns)):
                    payload = (html or "").encode()
                    own = holder if len(payload) >= min_payload else page
                    yield (gzip_member(record_bytes(page, url, payload, own, date))[:-1],)
        yield from arrow_batches(schema, rows(), size=256)

    (rows.mapInArrow(members, schema).select(F.col("member").cast("string").alias("value"))
     .write.option("lineSep", "\0").option("maxRecordsPerFile", max_records).text(path))


class _Bad(ValueError):
    pass


def _unpack(data: memoryview, start: int) -> tuple[bytes, int, str | None]:
    """Content and end of the gzip member at ``start``; if it is cut off or damaged, what it gave before
    that, where reading stopped, and the reason."""
    unpacker, parts, at, step = zlib.decompressobj(31), [], start, 1 << 14
    try:
        while not unpacker.eof:
            if at >= len(data):
                return b"".join(parts), at, "gzip member is cut off"
            parts.append(unpacker.decompress(data[at:at + step]))
            at += min(step, len(data) - at)
            step = min(step * 2, 1 << 20)
    except zlib.error as error:
        reason = f"gzip member is damaged: {error}"
    else:
        return b"".join(parts), at - len(unpacker.unused_data), None
    unpacker = zlib.decompressobj(31)  # a call that fails gives nothing, so go to the error byte by byte
    unpacker.decompress(data[start:at])
    try:
        while at < len(data):
            parts.append(unpacker.decompress(data[at:at + 1]))
            at += 1
    except zlib.error:
        pass
    return b"".join(parts), at, reason


def _record(data, start: int) -> tuple[dict, bytes, int]:
    """Headers, block and end of the plain record at ``start``."""
    head_end = data.find(b"\r\n\r\n", start)
    if not _VERSION_LINE.match(data, start):
        raise _Bad("no version line")
    if head_end < 0:
        raise _Bad("headers do not end")
    headers: dict[str, str] = {}
    for line in data[start:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header without a colon")
        headers[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isascii() or not headers.get("content-length", "").isdigit():
        raise _Bad("no content length")
    begin = head_end + 4
    end = begin + int(headers["content-length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise _Bad("block is not followed by two line ends")
    block = bytes(data[begin:end])
    _check(headers.get("warc-block-digest"), block, "block")
    return headers, block, end + 4


def _check(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != digest(data):
        raise _Bad(f"{what} digest differs")


def _fields(headers: dict, block: bytes) -> tuple:
    """Type, id, url, refers-to, payload size, payload digest and payload."""
    kind = headers.get("warc-type", "")
    http = headers.get("content-type", "").startswith("application/http")
    split = block.find(b"\r\n\r\n") if http else -1
    payload = block[split + 4:] if split >= 0 else block
    size, sha = len(payload), digest(payload)
    if kind == "revisit":  # size and digest of the payload that it refers to
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", block[:split + 2] if split >= 0 else b"")
        size = int(length[1]) if length else None
        sha = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        payload = None
    else:
        _check(headers.get("warc-payload-digest") if kind == "response" else None, payload, "payload")
    return (kind, headers.get("warc-record-id"), headers.get("warc-target-uri"), headers.get("warc-refers-to"),
            size, sha, payload)


def _inside(inner: bytes) -> Iterator[tuple[int, int, tuple | None, str | None]]:
    """(begin, end, fields or None, reason or None) for the records and gaps of a member's content."""
    at, gap, reason = 0, None, None
    while at < len(inner):
        try:
            headers, block, end = _record(inner, at)
            fields = _fields(headers, block)
        except _Bad as bad:
            if gap is None:
                gap, reason = at, str(bad)
            line = _VERSION_LINE.search(inner, at + 1)
            at = line.start() if line else len(inner)
            continue
        if gap is not None:
            yield gap, at, None, reason
            gap = None
        yield at, end, fields, None
        at = end
    if gap is not None:
        yield gap, len(inner), None, reason


def _at(data: bytes, view: memoryview, start: int) -> tuple[list[tuple], int | None]:
    """(fields, None) of records and (None, reason) of gaps of the gzip member or the one plain record at
    ``start``, and where it ends, or None if that is not known."""
    if data.startswith(GZIP_MAGIC, start):
        inner, end, broken = _unpack(view, start)
        found = list(_inside(inner))
        whole = len(found) == 1 and found[0][1] == len(inner)
        if broken and (whole or not any(fields for _, _, fields, _ in found)):
            raise _Bad(broken)
        if found and not any(fields for _, _, fields, _ in found):
            raise _Bad(found[0][3])
        out = [(fields, reason and f"{reason} (unpacked bytes {a} to {b})") for a, b, fields, reason in found]
        return out + [(None, broken)] * (broken is not None), None if broken else end
    headers, block, end = _record(data, start)
    return [(_fields(headers, block), None)], end


def _next(data: bytes, view: memoryview, at: int) -> int:
    """The next start, from ``at`` on, from which a valid record can be read."""
    while candidate := _CANDIDATE.search(data, at):
        try:
            if _at(data, view, candidate.start())[0]:
                return candidate.start()
        except _Bad:
            pass
        at = candidate.start() + 1
    return len(data)


def salvage(data: bytes) -> Iterator[tuple]:
    """(offset, length, fields or None, reason or None) for records and gaps, in order."""
    view, at = memoryview(data), 0
    while at < len(data):
        try:
            found, end = _at(data, view, at)
        except _Bad as bad:
            found, end = [(None, str(bad))], None
        if end is None:
            end = _next(data, view, at + 1)
        for fields, reason in found:
            yield at, end - at, fields, reason
        at = end


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``: a gap has a reason and no type."""
    schema = schema_of(RECORDS)

    def rows(batches: Iterator) -> Iterator:
        def each():
            for batch in batches:
                for i in range(batch.num_rows):
                    file, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                    for offset, length, fields, reason in salvage(data):
                        fields = fields or (None,) * 7
                        yield (file, offset, length, *fields[:6], fields[6] if payloads else None, reason)
        yield from arrow_batches(schema, each())

    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
             .filter(~F.col("path").rlike(r"/[_.][^/]*$")).select("path", "content"))
    return files.mapInArrow(rows, schema)


def records(read: DataFrame) -> DataFrame:
    return read.filter("gap_reason is null").drop("gap_reason")


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined byte ranges."""
    return read.filter("gap_reason is not null").select("file", "offset", "length", "gap_reason")


def page_of(name):
    """Page id of a record id that the writer made."""
    return F.regexp_extract(name, _ID + r"(-?\d+)>", 1).try_cast("long")
