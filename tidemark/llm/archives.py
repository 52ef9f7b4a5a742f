"""Legacy archives (ARC) to WARC.

An ARC file is a version block and then records: a header line whose fields the version fixes (five in version 1, ten in
version 2), a body of the declared length, a line feed.  The converter parses either, and synthesises what WARC wants beside
it: a record identifier, an ISO timestamp, the record's type, and digests of block and payload.  A repeated payload becomes
a revisit that refers to one response, and keeps the HTTP header alone.  Every WARC record is a gzip member of its own.

Edge cases: a null url is written as about:blank, white space in a url as %20 and so on; a null payload is empty; rows that
repeat a page_id are records of their own (equal payloads whose id is the largest are all responses); rows without an id
revisit like others, or are responses where no equal payload has an id; a body shorter than declared is marked truncated; a
malformed date falls back to the archive's; a very long payload is one record, written and hashed whole, in an archive of
its own; an empty table gives no archive and no row; other columns play no part, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import scratch, ship, table, written

FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "file", "length")}
#: Bytes of records after which an archive is closed: what a task holds at once.
ARCHIVE_BYTES = 32 << 20
EPOCH = "19700101000000"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_HEADER_END = re.compile(rb"\r?\n\r?\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class ArcRecord:
    version: int
    offset: int
    fields: dict[str, str]
    body: bytes
    truncated: bool = False


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of a file, or the file itself if it isn't compressed."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while at < len(data):
        one, out = zlib.decompressobj(31), []
        while not one.eof and at < len(data):
            piece = data[at : at + (1 << 16)]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Parse a whole ARC file, compressed or not.  The version block sets how many fields a header line has."""
    data = b"".join(members(data))
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        start = (end if end >= 0 else len(data)) + 1
        if not line.strip():
            at = start
            continue
        block = line.startswith("filedesc://")
        names = FIELDS[1] if block and len(line.split(" ")) < 10 else FIELDS[2] if block else FIELDS[version]
        parts = line.rsplit(" ", len(names) - 1)  # a url may hold spaces, no other field does
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"header line at byte {at} is not of version {version}: {line[:200]!r}")
        length = int(parts[-1])
        body = data[start : start + length]
        if block:
            found = re.match(rb"(\d+) ", body)
            version = int(found[1]) if found else 1
            if version not in FIELDS:
                raise ValueError(f"unknown version {version}")
        yield ArcRecord(version, at, dict(zip(names, parts)), body, len(body) < length)
        at = start + length


def timestamp(date: str, fallback: str = EPOCH) -> str:
    """14 digits, or as many as an old tool wrote, as an ISO timestamp."""
    digits = date if date.isdigit() and 4 <= len(date) <= 14 and len(date) % 2 == 0 else fallback
    d = digits + "00000101000000"[len(digits) :]
    year, month, day, hour, minute, second = d[:4], d[4:6], d[6:8], d[8:10], d[10:12], d[12:14]
    if not ("01" <= month <= "12" and "01" <= day <= "31" and hour < "24" and minute < "60" and second < "61"):
        return timestamp(fallback, EPOCH)
    return f"{year}-{month}-{day}T{hour}:{minute}:{second}Z"


@dataclass
class WarcRecord:
    kind: str
    headers: list[tuple[str, str]] = field(default_factory=list)
    block: bytes = b""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.headers if k.lower() == name.lower()), None)

    def to_bytes(self, level: int = 3) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", self.kind), *self.headers, ("Content-Length", str(len(self.block)))])
        pack = zlib.compressobj(level, wbits=31)
        return pack.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + self.block + b"\r\n\r\n") + pack.flush()


def http_parts(block: bytes) -> tuple[bytes, bytes] | None:
    """Header with its end, and payload, of an HTTP response."""
    if not block.startswith(b"HTTP/"):
        return None
    end = _HEADER_END.search(block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, '/'.join(map(str, parts)))}>"


def convert(record: ArcRecord, name: str, default_date: str = EPOCH, own_id: str | None = None, revisits: str | None = None, extra: tuple[tuple[str, str], ...] = ()) -> WarcRecord:
    """One record of an ARC file of that name.  revisits: identifier of the response that has the same payload."""
    f, http = record.fields, http_parts(record.body)
    url = f["url"]
    payload = http[1] if http else record.body
    digest = base32_sha1(payload)
    base = [("WARC-Record-ID", own_id or record_id(name, record.offset, url, f["date"], digest)), ("WARC-Date", timestamp(f["date"], default_date))]
    if url.startswith("filedesc://"):
        return WarcRecord("warcinfo", [*base, ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "text/plain")], record.body)
    base.append(("WARC-Target-URI", url))
    if f["ip"] not in ("", "-", "0.0.0.0"):
        base.append(("WARC-IP-Address", f["ip"]))
    base += [("WARC-Payload-Digest", f"sha1:{digest}"), *extra]
    if record.truncated:
        base.append(("WARC-Truncated", "length"))
    if http and revisits:
        base += [("WARC-Refers-To", revisits), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return WarcRecord("revisit", [*base, ("WARC-Block-Digest", f"sha1:{base32_sha1(http[0])}"), ("Content-Type", "application/http; msgtype=response")], http[0])
    kind, mime = ("response", "application/http; msgtype=response") if http else ("response", "text/dns") if url.startswith("dns:") else ("resource", f["type"])
    return WarcRecord(kind, [*base, ("WARC-Block-Digest", f"sha1:{base32_sha1(record.body)}"), ("Content-Type", mime)], record.body)


def read_warc(data: bytes) -> Iterator[WarcRecord]:
    """Parse records and hold digests against their bytes."""
    for one in members(data):
        at = 0
        while at < len(one):
            end = one.index(b"\r\n\r\n", at)
            version, *lines = one[at:end].decode("utf-8", "replace").split("\r\n")
            if not version.startswith("WARC/"):
                raise ValueError(f"not a WARC record: {version[:60]!r}")
            pairs = [(k, v.strip()) for k, _, v in (line.partition(":") for line in lines)]
            length = int(next(v for k, v in pairs if k.lower() == "content-length"))
            record = WarcRecord(next(v for k, v in pairs if k.lower() == "warc-type"), [p for p in pairs if p[0].lower() not in ("warc-type", "content-length")], one[end + 4 : end + 4 + length])
            told = record.get("WARC-Block-Digest")
            if len(record.block) != length or told and told != f"sha1:{base32_sha1(record.block)}":
                raise ValueError(f"damaged record {record.get('WARC-Record-ID')}")
            yield record
            at = end + 4 + length + 4


def arc_bytes(rows: list[tuple[str | None, bytes]], name: str, version: int = 1, date: str = EPOCH) -> bytes:
    """An ARC file of HTTP responses; rows: url, payload."""
    names = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
    block = f"{version} 0 tidemark\n{names[version]}\n\n".encode()
    out = [f"filedesc://{name} 0.0.0.0 {date} text/plain {f'200 - - 0 {name} ' if version == 2 else ''}{len(block)}\n".encode(), block, b"\n"]
    at = sum(map(len, out))
    for url, payload in rows:
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
        shown = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "about:blank")
        middle = f"200 {hashlib.md5(body).hexdigest()} - {at} {name} " if version == 2 else ""
        head = f"{shown} 0.0.0.0 {date} text/html {middle}{len(body)}\n".encode("utf-8", "replace")
        out += (head, body, b"\n")
        at += len(head) + len(body) + 1
    return b"".join(out)


def arc_to_warc(arcs: DataFrame, to: str) -> DataFrame:
    """arcs: path, content (as Spark's binaryFile source gives them).  Writes a WARC file for each; returns path, warc, n_records."""
    ship(arcs.sparkSession)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name, date = path.rsplit("/", 1)[-1], EPOCH
                out = []
                for r in read_arc(content.as_py()):
                    date = r.fields["date"] if r.fields["url"].startswith("filedesc://") else date
                    out.append(convert(r, name, date).to_bytes())
                yield pa.RecordBatch.from_pydict({"path": [path], "warc": [files.put(f"{to}/{name}.warc.gz", b"".join(out))], "n_records": [len(out)]})

    return written(arcs.select("path", "content").mapInArrow(run, "path string, warc string, n_records long"), "warcs")


def write_pages(pages: DataFrame, to: str, least_bytes: int = 0) -> DataFrame:
    """pages: page_id, url, html.  Legacy archives of the pages, converted to WARC.  Returns the manifest: path, n_records.

    Only digests and ids are counted for repeats; each page then travels once, to the join that tells it what it revisits.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha1(payload.cast("binary")).alias("digest"))
    shared = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("chief"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("digest").alias("same"), "chief")
    told = rows.join(shared, F.col("digest") == F.col("same"), "left").select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("chief")), F.col("chief")).alias("chief"))

    def write(batches):
        out, n, size = [], 0, 0
        for batch in batches:
            rows, held = [], 0
            columns = [batch.column(k).to_pylist() for k in (0, 1, 3)]
            for k, (page, url, chief) in enumerate(zip(*columns)):
                html = batch.column(2)[k].as_py().encode("utf-8", "surrogatepass")
                rows.append((page, url, chief, html))
                held += len(html)
                if held < 4 << 20 and k + 1 < batch.num_rows:
                    continue
                version = 1 + (n // 64) % 2
                arc = iter(read_arc(arc_bytes([(u, h) for _, u, _, h in rows], "pages.arc", version)))
                next(arc)  # the version block
                for r, (p, _, c, _) in zip(arc, rows, strict=True):
                    extra = () if p is None else (("X-Page-ID", str(p)),)
                    own = record_id("page", p) if p is not None else None
                    if c is not None:
                        extra += (("X-Refers-To-Page-ID", str(c)),)
                    out.append(convert(r, "pages.arc", own_id=own, revisits=None if c is None else record_id("page", c), extra=extra).to_bytes())
                    size, n = size + len(out[-1]), n + 1
                rows, held = [], 0
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_pydict({"path": [files.put(f"{to}/pages.warc.gz", b"".join(out))], "n_records": [n]})
                    out, n, size = [], 0, 0
        if out:
            yield pa.RecordBatch.from_pydict({"path": [files.put(f"{to}/pages.warc.gz", b"".join(out))], "n_records": [n]})

    ship(pages.sparkSession)
    return written(told.mapInArrow(write, "path string, n_records long"), "archives")


def read_records(manifest: DataFrame) -> DataFrame:
    """Read WARC files back: page_id, url, date, record_type, record_id, payload_bytes, payload_digest, refers_to (page_id), payload (null for revisits)."""

    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for r in read_warc(files.get(path)):
                    if r.kind == "warcinfo":
                        continue
                    http = http_parts(r.block)
                    payload = None if r.kind == "revisit" else http[1] if http else r.block
                    digest = (r.get("WARC-Payload-Digest") or "").removeprefix("sha1:")
                    if payload is None:
                        length = int(re.search(rb"(?im)^content-length:\s*(\d+)", r.block)[1])
                    else:
                        length = len(payload)
                        if base32_sha1(payload) != digest:
                            raise ValueError(f"payload of {r.get('WARC-Record-ID')} doesn't have its digest")
                    page, to = r.get("X-Page-ID"), r.get("X-Refers-To-Page-ID")
                    rows.append((None if page is None else int(page), r.get("WARC-Target-URI"), r.get("WARC-Date"), r.kind, r.get("WARC-Record-ID"), length, digest, None if to is None else int(to), payload))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)] if rows else [pa.array([], t) for t in _TYPES], names=list(_NAMES))

    schema = "page_id long, url string, date string, record_type string, record_id string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    return manifest.select("path").repartition(max(1, min(manifest.count(), 20_000))).mapInArrow(read, schema)


_NAMES = ("page_id", "url", "date", "record_type", "record_id", "payload_bytes", "payload_digest", "refers_to", "payload")
_TYPES = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def op1_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_records(write_pages(table(spark, sf_dir, "pages"), scratch(spark, "warc")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
