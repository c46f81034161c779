"""ARC files, versions 1 and 2, as WARC records.

An ARC file is a version block and URL records, each a header line of space-separated fields that ends in the length
of what follows. The version block says which fields there are. Every record becomes a WARC/1.0 record with a
synthesised identifier, ISO timestamp, type and digests.
"""

from __future__ import annotations

import base64
import bisect
import calendar
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.arrow_text import mapped

V1 = ("url", "ip", "date", "type", "length")
V2 = ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "filename", "length")
#: A header line is a URL, then an address or "-", a date of 8 to 14 digits, and fields to a length; used to find the next record when a length was wrong.
_HEADER = re.compile(rb"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]* +(?:[0-9A-Fa-f.:]+|-) +\d{8,14} [^\r\n]* \d+\r?$", re.MULTILINE)
FIELDS = [
    ("offset", pa.int64()), ("arc_version", pa.int32()), ("warc_type", pa.string()), ("warc_record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("ip_address", pa.string()),
    ("content_type", pa.string()), ("content_length", pa.int64()), ("block_digest", pa.string()), ("payload_digest", pa.string()), ("http_status", pa.int32()), ("problem", pa.string()), ("block", pa.binary()),
]


def unzipped(content: bytes) -> tuple[bytes, list[tuple[int, bytes]], set[int]]:
    """The bytes of all gzip members one after another, what could not be inflated with the places where it is missing, and where members begin.

    Content that isn't gzip stays as it is. Of a damaged member what inflates is kept (its last bytes may be wrong), a
    line feed ends it, and reading goes on at the next member that inflates; so it does past bytes between members.
    """
    if content[:2] != b"\x1f\x8b":
        return content, [], set()
    out, size, damaged, begun, at = [], 0, [], set(), 0
    while at < len(content):
        begun.add(size)
        part, end, whole = _member(content, at) if content[at : at + 2] == b"\x1f\x8b" else (b"", at, False)
        out.append(part)
        size += len(part)
        if not whole:
            end = at + 1
            while (end := content.find(b"\x1f\x8b\x08", end)) >= 0 and not _begins(content, end):
                end += 1
            end = end if end >= 0 else len(content)
            damaged.append((size, content[at:end]))
            out.append(b"\n")
            size += 1
        at = end
        while content[at : at + 1] == b"\0":
            at += 1
    return b"".join(out), damaged, begun


def _begins(content: bytes, at: int) -> bool:
    """Whether a gzip member begins here, by its first bytes."""
    try:
        return bool(zlib.decompressobj(31).decompress(content[at : at + 4096], 64))
    except zlib.error:
        return False


def _member(content: bytes, at: int) -> tuple[bytes, int, bool]:
    """What a member's bytes inflate to, where it ends, and whether it is whole. Nothing past a member's end is copied but a step."""
    member, out, step = zlib.decompressobj(31), [], 1 << 14
    while not member.eof and at < len(content):
        before = member.copy()
        try:
            out.append(member.decompress(content[at : at + step]))
            at = min(len(content), at + step)
        except zlib.error:
            if step == 1:
                return b"".join(out), at, False
            member, step = before, 1
    return b"".join(out), at - len(member.unused_data), member.eof


def iso_date(date: str) -> str | None:
    """14 digits, or fewer with the rest of the time at zero, as WARC wants them; None for anything else, such as days that no calendar has."""
    if not re.fullmatch(r"[0-9]{8}([0-9]{2}){0,3}", date):
        return None
    d = date.ljust(14, "0")
    year, month, day, hour, minute, second = (int(d[a:b]) for a, b in ((0, 4), (4, 6), (6, 8), (8, 10), (10, 12), (12, 14)))
    if not (year and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1] and hour < 24 and minute < 60 and second < 61):
        return None
    return f"{year:04}-{month:02}-{day:02}T{hour:02}:{minute:02}:{second:02}Z"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(source: str, offset: int, url: str, date: str) -> str:
    """The same record of the same file gets the same identifier in every run."""
    name = hashlib.sha1(f"{source}\n{offset}\n{url}\n{date}".encode()).hexdigest()[:32]
    return f"<urn:uuid:{uuid.UUID(name)}>"


def records(source: str, content: bytes) -> Iterator[tuple]:
    """The records of one ARC file in the order of :data:`FIELDS`.

    ``problem`` is null for a sound record. Otherwise it says what is wrong: ``truncated`` (the file ends before the
    declared length), ``length`` (after the declared length no record begins; reading goes on at the next line that
    looks like a header, and the block extends to it), ``date`` (no timestamp could be made: the
    record has that of the file's opening, or none), ``no header`` (bytes
    that belong to no record, with a null type), or ``gzip`` (bytes of the file that did not inflate, with a null type
    and the place where they are missing; these rows come last). A record that such bytes cut short is ``truncated``.
    """
    data, damaged, begun = unzipped(content)
    yield from _records(source, data, [place for place, _ in damaged], begun)
    for place, lost in damaged:
        yield (place, None, None, None, None, None, None, None, len(lost), digest(lost), None, None, "gzip", lost)


def _records(source: str, data: bytes, cuts: list[int], begun: set[int]) -> Iterator[tuple]:
    at, version, fields, opened = 0, None, None, None
    while True:
        while at < len(data) and data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        parts = line.decode("utf-8", "replace").split(" ")
        first = line.startswith(b"filedesc://")
        body = len(line) + at + (2 if data[at + len(line) : at + len(line) + 1] == b"\r" else 1)
        if first:
            # Its own body names the version and the fields of the records that follow.
            version = 2 if data[body : body + 2] in (b"2 ", b"2\n", b"2\r") else 1
            fields = V2 if version == 2 else V1
        names = (V2 if len(parts) >= len(V2) else V1) if first or fields is None else fields
        sound = len(parts) >= len(names) and re.fullmatch(r"[0-9]{1,18}", parts[-1]) and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", parts[0])
        if not sound:
            nxt = _HEADER.search(data, body)
            stop = nxt.start() if nxt else len(data)
            yield (at, version, None, None, None, None, None, None, stop - at, digest(data[at:stop]), None, None, "no header", data[at:stop])
            at = stop
            continue
        # Only the type may hold blanks: the fields before it are counted from the left and those after from the right.
        k, after = names.index("type"), len(names) - names.index("type") - 1
        said = dict(zip(names, [*parts[:k], " ".join(parts[k : len(parts) - after]), *parts[len(parts) - after :]], strict=True))
        length, problem = int(said["length"]), None
        stop = body + length
        nth = bisect.bisect_left(cuts, body)
        cut_short = nth < len(cuts) and cuts[nth] < stop
        if cut_short:
            stop, problem = cuts[nth], "truncated"
        elif stop > len(data):
            stop, problem = len(data), "truncated"
        tail = data[stop : stop + 2].lstrip(b"\r\n")
        # Where a gzip member ends a record may end, whatever follows.
        ends = not begun.isdisjoint(range(stop, stop + 3 - len(tail)))
        if not cut_short and (problem or (tail and not ends and not _HEADER.match(data, stop + (len(data[stop : stop + 2]) - len(tail))))):
            nxt = _HEADER.search(data, body)
            if nxt and problem:
                stop, problem = nxt.start() - 1, "length"
            elif not problem:
                stop, problem = (nxt.start() - 1 if nxt else len(data) - data.endswith(b"\n")), "length"
        block = data[body : max(body, stop)]
        date = iso_date(said["date"])
        problem = problem or (None if date else "date")
        if first:
            opened = date
        date = date or opened
        url, status, payload = said["url"], None, None
        if first:
            kind, mime = "warcinfo", said["type"] if said["type"] not in ("", "-", "no-type") else "text/plain"  # the block keeps ARC's own syntax
        elif block.startswith(b"HTTP/") and re.match("https?:", url, re.IGNORECASE):
            kind, mime = "response", "application/http; msgtype=response"
            head = re.match(rb"HTTP/\S+ +(\d{3})", block)
            status = int(head[1]) if head else None
            cut = re.search(rb"\r?\n\r?\n", block)
            payload = digest(block[cut.end() :] if cut else b"")
        else:
            kind, mime = "resource", said["type"] if said["type"] not in ("", "-", "no-type") else "application/octet-stream"
            payload = digest(block)
        ip = said["ip"] if said["ip"] not in ("-", "0.0.0.0", "") else None
        uri = None if first else url
        yield (at, version or 1, kind, record_id(source, at, url, said["date"]), date, uri, None if first else ip, mime, len(block), digest(block), payload, status, problem, block)
        at = max(body, stop)


def warc_bytes(record: dict) -> bytes:
    """The record as it stands in a WARC file, from a row of :func:`convert`; a row without a type gives nothing, and one without a date no date."""
    if record["warc_type"] is None:
        return b""
    lines = ["WARC/1.0", f"WARC-Type: {record['warc_type']}", f"WARC-Record-ID: {record['warc_record_id']}"]
    for name, key in (("WARC-Date", "warc_date"), ("WARC-Target-URI", "target_uri"), ("WARC-IP-Address", "ip_address"), ("WARC-Block-Digest", "block_digest"), ("WARC-Payload-Digest", "payload_digest"), ("Content-Type", "content_type")):
        if record[key] is not None:
            lines.append(f"{name}: {record[key]}")
    lines.append(f"Content-Length: {record['content_length']}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + record["block"] + b"\r\n\r\n"


def convert(files: DataFrame, source_col: str = "path", content_col: str = "content", blocks: bool = True) -> DataFrame:
    """One row for each record of each ARC file: ``source_col`` and the columns of :data:`FIELDS`.

    ``files`` holds whole files, gzipped by record, as a whole or not at all, as ``spark.read.format("binaryFile")``
    reads them; a file is one task's work, and its records stream out. With ``blocks=False`` the block column is null.
    A null or empty file has no records. A null source is kept, and counts as an empty name in identifiers. Repeated
    files are converted each, to equal identifiers. Other columns are not read. An empty table gives an empty one.
    """
    taken = files.select(F.col(source_col).alias("source"), F.col(content_col).cast("binary").alias("content")).where("content IS NOT NULL")
    kind = taken.schema["source"].dataType
    schema = f"source {kind.simpleString()}, offset bigint, arc_version int, warc_type string, warc_record_id string, warc_date string, target_uri string, ip_address string, content_type string, content_length bigint, block_digest string, payload_digest string, http_status int, problem string, block binary"
    names = ["source", *[n for n, _ in FIELDS]]

    def run(batches):
        for batch in batches:
            rows, held, kinds = [], 0, batch.schema.field("source").type
            for source, content in zip(batch.column(0), batch.column(1), strict=True):
                for record in records(str(source.as_py() if source.is_valid else ""), content.as_py()):
                    rows.append((source.as_py(), *(record if blocks else (*record[:-1], None))))
                    held += len(record[-1])
                    if held > 8 << 20 or len(rows) >= 4096:
                        yield made(rows, kinds)
                        rows, held = [], 0
            yield made(rows, kinds)

    def made(rows, kinds):
        types = [kinds, *[t for _, t in FIELDS]]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return mapped(taken, run, schema).withColumnRenamed("source", source_col)
