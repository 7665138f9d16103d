"""WARC archives: write pages as segmented, chunked records; read, reassemble, verify and decode them.

Writing: equal payloads are stored once. The page with the smallest id holds them as a response, the
others are revisits that refer to it. Payloads travel in HTTP messages with chunked transfer framing;
long messages are cut into segments, a first record and continuation records.

Reading: records of any archive files, in one pass. Continuations are grouped by their origin, ordered by
segment number and checked against the total length; then the chunks are decoded and digests verified.
What is damaged becomes a row that says so, and reading goes on at the next record.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, shared_dir, sized, slices, stage

#: Bytes of a record's block at most, and of a chunk of the transfer framing.
SEGMENT, CHUNK = 1 << 16, 1 << 14
#: Records per archive file at most, so that a file fits in memory however large the input is.
RECORDS = 4000
_END = "\r\n\r\n"
_WHOLE = re.compile(r"-?0{0,99}[0-9]{1,19}", re.A)
_HEX = re.compile(rb"0*[0-9a-fA-F]{1,15}")
_DATE = "1970-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, key)}>"


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    out = []
    for at in range(0, len(body), size):
        part = body[at : at + size]
        out += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunk(data: bytes) -> bytes:
    """The body of chunked transfer framing; chunk extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.index(b"\r\n", at)  # none is a ValueError too
        size = data[at:end].split(b";")[0].strip()
        if not _HEX.fullmatch(size):
            raise ValueError("a chunk has no size")
        size = int(size, 16)
        if not size:
            return b"".join(out)
        part = data[end + 2 : end + 2 + size]
        if len(part) != size or data[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(part)
        at = end + 4 + size


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block


def records(page_id: int | None, url: str | None, payload: bytes, first: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page, without the two line ends that follow each. ``first`` is the page it revisits."""
    own = digest(payload)
    rid = record_id(f"{page_id} {own}")
    base = [("WARC-Record-ID", rid), ("WARC-Target-URI", re.sub(r"[\r\n]", "", url or "urn:none")), ("WARC-Date", _DATE)]
    base += [("WARC-Payload-Digest", f"sha1:{own}"), *([] if page_id is None else [("X-Page-Id", page_id)])]
    if first is not None:
        profile = ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        yield _record([("WARC-Type", "revisit"), *base, profile, ("WARC-Refers-To", record_id(f"{first} {own}")), ("X-Refers-To-Page-Id", first)], b"")
        return
    message = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = [("WARC-Type", "response"), *base, ("Content-Type", "application/http; msgtype=response")]
    if len(message) <= segment:
        yield _record(kind, message)
        return
    yield _record([*kind, ("WARC-Segment-Number", 1)], message[:segment])
    for n, at in enumerate(range(segment, len(message), segment), 2):
        last = [("WARC-Segment-Total-Length", len(message))] if at + segment >= len(message) else []
        ids = [("WARC-Record-ID", record_id(f"{rid} {n}")), ("WARC-Date", _DATE), ("WARC-Segment-Origin-ID", rid), ("WARC-Segment-Number", n)]
        yield _record([("WARC-Type", "continuation"), *ids, *last], message[at : at + segment])


def inflate(data: bytes) -> bytes:
    """An archive's bytes: plain, or of one or more gzip members up to the first damage."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            for at in range(0, len(data), 1 << 16):
                out.append(member.decompress(data[at : at + (1 << 16)]))
                if member.eof:
                    data = member.unused_data + data[at + (1 << 16) :]
                    break
            else:
                return b"".join(out)
        except zlib.error:
            return b"".join(out)
        if not data:
            return b"".join(out)
    return b"".join(out) or data


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and block of each record of an archive.

    The block is None where a record is damaged: no version line, no length or one that reaches over the
    end or does not end at a record's end. Reading goes on at the next version line.
    """
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end, headers, size = data.find(b"\r\n\r\n", at), {}, -1
        if data.startswith(b"WARC/", at) and end > 0:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")
            headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
            size = _int(headers.get("content-length")) if "content-length" in headers else -1
        after = end + 4 + size if size is not None and size >= 0 else -1
        if 0 < after <= len(data) and (after == len(data) or data[after : after + 2] == b"\r\n"):
            yield headers, data[end + 4 : after]
            at = after
            continue
        yield headers, None
        following = data.find(b"\r\nWARC/", at + 1)
        at = following + 2 if following >= 0 else len(data)


def payload_of(message: bytes) -> bytes:
    """The body of an HTTP message, its transfer codings undone, the last first. A coding that is unknown or broken is a ValueError."""
    head, _, body = message.partition(b"\r\n\r\n")
    fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    codings = [c.strip().lower() for name, _, value in fields if name.strip().lower() == b"transfer-encoding" for c in value.split(b",")]
    for coding in reversed([c for c in codings if c]):
        if coding == b"chunked":
            body = unchunk(body)
        elif coding in (b"gzip", b"x-gzip", b"deflate"):
            try:
                body = zlib.decompress(body, wbits=15 if coding == b"deflate" else 31)
            except zlib.error as e:
                raise ValueError("a coding is broken") from e
        elif coding != b"identity":
            raise ValueError("a coding is unknown")
    return body


def _write(segment: int):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 2, 2 << 20):
            out = []
            for page_id, url, page, first in zip(*(c.to_pylist() for c in part.columns), strict=True):
                out += records(page_id, url, (page or "").encode(), None if first == page_id else first, segment)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return per_batch(run)


def write(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT) -> None:
    """Write ``pages`` (page_id, url, html, any others) as compressed WARC files in the folder ``path``.

    Payloads of at least ``least`` bytes that several rows have are stored with the smallest page_id, and
    revisited by rows of other ids. A null page has an empty payload. Rows that repeat in full are
    written again. A row without a page_id revisits a page of equal payload, else it is a response.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("hash", F.sha1("html"))
    long = pages.where(F.octet_length("html") >= least)
    groups = long.groupBy("hash").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    groups = stage(groups.select("hash", "first"), "repeated-payloads")
    rows = pages.join(sized(groups), "hash", "left").select("page_id", "url", "html", "first")
    lines = rows.mapInArrow(_write(segment), "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS).text(path)


_ROW = "record_id string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, refers_record string, verified boolean"
_NAMES_OF = [c.split()[0] for c in _ROW.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]


def _int(value: str | None, bits: int = 63) -> int | None:
    """A whole number of a header; None if it is none, or one that ``bits`` and a sign do not hold."""
    if not value or not _WHOLE.fullmatch(value):
        return None
    number = int(value)
    return number if -(1 << bits) <= number < 1 << bits else None


def _row(headers: dict[str, str], message: bytes | None, kind: str = "response") -> tuple:
    """A result row of a record: of a response from its whole message, of others from their headers."""
    claimed = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    head = (headers.get("warc-record-id"), _int(headers.get("x-page-id")))
    if kind == "revisit":
        return (*head, None, claimed, kind, _int(headers.get("x-refers-to-page-id")), headers.get("warc-refers-to"), None)
    try:
        payload = payload_of(message or b"") if kind == "response" else None
    except ValueError:
        payload = None
    if payload is None:
        return (*head, None, claimed or None, "damaged", None, None, False)
    own = digest(payload)
    return (*head, len(payload), own, "response", None, None, own == claimed)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_PART = "origin string, number int, total long, headers string, block binary"
_PART_NAMES = ["origin", "number", "total", "headers", "block"]
_PART_KINDS = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary()]


def _found(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Result rows of whole records; of segmented ones the segments, with nulls in the other columns."""
    for data in batch.column(0):
        rows, none = [], (None,) * len(_PART_KINDS)
        for headers, block in parse(inflate(data.as_py())):
            kind, origin = headers.get("warc-type"), headers.get("warc-segment-origin-id")
            number = _int(headers.get("warc-segment-number"), 31)
            first = number is not None and kind != "continuation"
            origin = headers.get("warc-record-id") if first else origin
            if block is None:
                rows.append((*_row(headers, None, "damaged"), *none))
            elif number is not None and origin is not None:
                total = _int(headers.get("warc-segment-total-length"))
                rows.append((*(None,) * len(_KINDS), origin, number, total, json.dumps(headers) if first else None, block))
            elif kind in ("revisit", "response"):
                rows.append((*_row(headers, block, kind), *none))
        yield _batch(rows, _NAMES_OF + _PART_NAMES, _KINDS + _PART_KINDS)


def _assemble(parts: pa.Table) -> pa.Table:
    """One origin's segments, in order, as a result row for each copy of its first record.

    If segments are missing or their length is not the total, the row is that of a damaged record.
    """
    rows = sorted(parts.to_pylist(), key=lambda r: r["number"])
    firsts = [json.loads(r["headers"]) for r in rows if r["headers"]]
    by_number = {r["number"]: r for r in rows}  # copies of a segment are equal
    message = b"".join(r["block"] for r in by_number.values())
    whole = bool(firsts) and list(by_number) == list(range(1, len(by_number) + 1)) and rows[-1]["total"] == len(message)
    out = [_row(h, message, "response" if whole else "damaged") for h in firsts or [{"warc-record-id": rows[0]["origin"]}]]
    return pa.Table.from_batches([_batch(out, _NAMES_OF, _KINDS)])


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and verified of each page in the archives.

    A response is decoded from its record, or from its first record and continuations. verified tells
    whether the payload has the digest its record claims. A revisit has the length of the payload it
    refers to, null if no archive holds that. A record that is cut short, has a broken header, framing
    or segments that are missing or of a wrong total length, gives a row of record_type ``damaged`` with
    what its header tells, no length, and verified false. Archives without records give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parts = stage(files.mapInArrow(per_batch(_found), f"{_ROW}, {_PART}"), "archive-parts")
    joined = parts.where("origin IS NOT NULL").select(*_PART_NAMES).groupBy("origin").applyInArrow(_assemble, _ROW)
    found = stage(parts.where("origin IS NULL").select(*_NAMES_OF).union(joined), "archive-records")
    sizes = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_record"), F.col("payload_bytes").alias("size"), F.col("verified").alias("sound"))
    sizes = sizes.dropDuplicates(["refers_record"])
    out = ["page_id", F.coalesce("payload_bytes", "size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", F.coalesce("verified", "sound").alias("verified")]
    again = found.where("record_type = 'revisit'").join(sizes, "refers_record", "left").select(*out)
    kept = found.where("record_type <> 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")
    return kept.union(again)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write ``pages`` into the shared folder and read the archives back, see ``write`` and ``read``.

    There is a row per row of ``pages``, so rows that repeat come back as often; an empty table gives none.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/archives/{uuid.uuid4().hex}"
    write(pages, path, least)
    return read(spark, path)
