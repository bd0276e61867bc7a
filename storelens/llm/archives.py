"""Legacy ARC archives, their conversion to WARC, and reading WARC back.

An ARC file opens with a `filedesc:` record whose block names the file's version and the fields of
the header lines that follow, one line a record, ending in the length of the record's bytes. The
converter reads header lines by the fields the file declares (version 1: five, version 2: ten) and
records by their declared lengths, never by looking for line ends, and synthesises what WARC asks for
and ARC lacks: record ids (name-based, so reruns agree), W3C timestamps, record types, and block and payload
digests. Records whose payload another record holds become revisits.

Files are read whole per task but inflated and parsed as a stream; Spark's text writer lays them
down, a record a value, with the record separator of the format as its line separator. What to write as a revisit
is decided on an index of digests and goes back to each file as a list of its record numbers: broadcast where these
lists were counted and found few, so that payloads stay where they are read; beyond that whole files are shuffled
by their path. Damaged archives do not end the job: what could be read before the damage is kept, and the record
it cut is marked as truncated.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storelens.functions.skew import left_join
from storelens.session import materialize

# Fixed values of the two formats.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename"
       " Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_SEPARATOR, WARC_SEPARATOR = "\n", "\r\n\r\n"

PAGE_HEADER = "X-Page-Id"
LENGTH_HEADER = "X-Payload-Length"  # of a revisit: the length of the payload that it leaves out
BATCH_BYTES = 4 * 1024**2
_ROWS = 2000


def sha1(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Stream:
    """Lines and counted bytes of plain or gzip data, inflated piece by piece, member after member."""

    def __init__(self, data: bytes, piece: int = 1 << 18):
        self.data, self.at, self.piece = memoryview(data), 0, piece
        self.gzip = data[:2] == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31) if self.gzip else None
        self.buffer, self.start = bytearray(), 0

    def _more(self) -> bool:
        if self.start > self.piece:
            del self.buffer[: self.start]
            self.start = 0
        if self.at >= len(self.data):
            return False
        raw = bytes(self.data[self.at: self.at + self.piece])
        self.at += len(raw)
        while self.gzip and raw:
            try:
                self.buffer += self.inflate.decompress(raw)
            except zlib.error:  # a damaged member, or padding after the last one: nothing behind it can be told
                self.at = len(self.data)
                return True  # with what came before the damage
            raw = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        self.buffer += raw
        return True

    def line(self) -> bytes | None:
        """Up to and without the next line feed; None at the end."""
        seen = self.start
        while (end := self.buffer.find(b"\n", seen)) < 0:
            left = len(self.buffer) - self.start
            more = self._more()
            seen = self.start + left
            if not more:
                rest = bytes(self.buffer[self.start:])
                self.start = len(self.buffer)
                return rest or None
        found = bytes(self.buffer[self.start: end])
        self.start = end + 1
        return found

    def take(self, n: int) -> bytes:
        """The next n bytes, or what is left."""
        while len(self.buffer) - self.start < n and self._more():
            pass
        found = bytes(self.buffer[self.start: self.start + n])
        self.start += len(found)
        return found


# ARC


def arc_records(data: bytes) -> Iterator[dict]:
    """Every record of one ARC file, the version block included.

    Each has its header fields by lower-case name, `block`, and `truncated` if the file ended early. A
    line that is no header of the declared fields is skipped. Spaces inside a URL are kept: the other
    fields are counted from the right.
    """
    stream, fields = Stream(data), ARC_FIELDS[1].lower().split()
    while (line := stream.line()) is not None:
        text = line.rstrip(b"\r").decode("utf-8", "replace")
        names = ARC_FIELDS[1].lower().split() if text.startswith("filedesc:") else fields
        parts = text.rsplit(" ", len(names) - 1)
        if text.startswith("filedesc:") and len(parts) < len(names):
            continue
        if len(parts) != len(names) or not parts[-1].isascii() or not parts[-1].isdigit():
            continue
        length = int(parts[-1])
        block = stream.take(length)
        record = dict(zip(names, parts)) | {"block": block, "truncated": len(block) < length}
        if text.startswith("filedesc:"):
            lines = block.decode("utf-8", "replace").split("\n")
            if len(lines) > 1 and lines[1].strip():
                fields = lines[1].strip().lower().split()
        yield record


def _version_block(version: int, name: str, date: str) -> bytes:
    block = f"{version} 0 storelens\n{ARC_FIELDS[version]}\n".encode()
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n".encode() + block


def _safe(url: str | None) -> str:
    """The URL as one header field: white space and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "-"


def write_arc(
    pages: DataFrame,
    path: str,
    version: int = 1,
    date: str = "20000101000000",
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
) -> None:
    """One gzip ARC file for each partition of pages, one record for each row.

    A record is the HTTP answer that carries the body in UTF-8; a null body is empty, a null URL
    is "-", a null id leaves its HTTP header out. Other columns are ignored.
    """
    from pyspark import TaskContext

    def run(batches):
        part = TaskContext.get().partitionId()
        opened = False
        for batch in batches:
            out = [] if opened else [_version_block(version, f"part-{part:05}.arc", date)]
            opened = True
            for key, url, body in zip(*(c.to_pylist() for c in batch.columns)):
                body = (body or "").encode("utf-8", "surrogatepass")
                page = f"{PAGE_HEADER}: {key}\r\n" if key is not None else ""
                block = (
                    f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{page}"
                    f"Content-Length: {len(body)}\r\n\r\n"
                ).encode() + body
                more = [] if version == 1 else ["200", sha1(block), "-", "0", f"part-{part:05}.arc"]
                fields = [_safe(url), "0.0.0.0", date, "text/html", *more, str(len(block))]
                out.append(" ".join(fields).encode("utf-8", "surrogatepass") + b"\n" + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.col(body_col).cast("string").alias("body"),
    ).mapInArrow(run, "value binary")
    _write(rows, path, ARC_SEPARATOR)


def _write(rows: DataFrame, path: str, separator: str) -> None:
    rows.select(F.col("value").cast("string")).write.option("lineSep", separator).option(
        "zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _per_file(
    files: DataFrame, parse: Callable[[dict], Iterator[tuple]], schema: str, fields: pa.Schema
) -> DataFrame:
    """The rows that `parse` makes of each file, in batches of bounded size."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for row in parse(batch.slice(i, 1).to_pylist()[0]):
                    rows.append(row)
                    size += sum(len(v) for v in row if isinstance(v, bytes))
                    if len(rows) >= _ROWS or size > BATCH_BYTES:
                        yield _to_batch(rows, fields)
                        rows, size = [], 0
                if rows:
                    yield _to_batch(rows, fields)

    return files.mapInArrow(run, schema)


def _to_batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Head (with its empty line), body and headers by lower-case name of an HTTP answer.

    What does not begin with HTTP/ is all body.
    """
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    for end in (b"\r\n\r\n", b"\n\n"):
        at = block.find(end)
        if at >= 0:
            head, body = block[: at + len(end)], block[at + len(end):]
            break
    else:
        head, body = block, b""
    headers = {}
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        name, colon, value = line.partition(":")
        if colon:
            headers[name.strip().lower()] = value.strip()
    return head, body, headers


_INDEX = pa.schema([
    ("path", pa.string()), ("record", pa.int64()), ("page", pa.int64()), ("digest", pa.string()),
    ("length", pa.int64()),
])


def arc_index(spark: SparkSession, path: str) -> DataFrame:
    """path, record, page, digest and length of the payload of every HTTP record of the ARC files."""

    def parse(file: dict) -> Iterator[tuple]:
        for number, record in enumerate(arc_records(file["content"])):
            head, body, headers = split_http(record["block"])
            if head:
                yield file["path"], number, _number(headers), sha1(body), len(body)

    return _per_file(
        _files(spark, path), parse, "path string, record long, page long, digest string, length long",
        _INDEX,
    )


def _number(headers: dict[str, str]) -> int | None:
    value = headers.get(PAGE_HEADER.lower(), "")
    return int(value) if re.fullmatch(r"-?[0-9]{1,18}", value) else None


# WARC


def record_id(page: int | None, digest: str, path: str, number: int) -> str:
    """The id of a response, from what it holds; without a page id, from where it lay."""
    name = f"{page}/{digest}" if page is not None else f"{path.rsplit('/', 1)[-1]}/{number}/{digest}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def w3c_date(arc_date: str) -> str:
    """14-digit ARC dates (12 or 8 digits in the oldest files) as W3C timestamps; the epoch for what is no date."""
    digits = arc_date if arc_date.isascii() and arc_date.isdigit() else "0"
    d = (digits + "19700101000000"[len(digits):])[:14] if len(digits) >= 8 else "19700101000000"
    try:
        datetime.datetime.strptime(d, "%Y%m%d%H%M%S")
    except ValueError:  # digits that are no date
        d = "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record without its separator. The block digest and length are synthesised here."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers),
             f"WARC-Block-Digest: sha1:{sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def _converted(path: str, number: int, record: dict, revisit: dict | None) -> bytes:
    block, date, url = record["block"], w3c_date(record["archive-date"]), record["url"]
    cut = [("WARC-Truncated", "length")] if record["truncated"] else []
    if url.startswith("filedesc:"):
        return warc_record("warcinfo", [
            ("WARC-Record-ID", record_id(None, "warcinfo", path, number)), ("WARC-Date", date),
            ("WARC-Filename", url.removeprefix("filedesc://")), ("Content-Type", "text/plain"),
        ], block)
    head, body, http = split_http(block)
    digest, page = sha1(body), _number(http)
    own = record_id(page if revisit is None else None, digest, path, number)
    common = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", url),
              ("WARC-IP-Address", record["ip-address"]),
              ("WARC-Payload-Digest", f"sha1:{digest}"), *cut]
    if not head:
        return warc_record("resource", [*common, ("Content-Type", record["content-type"])], block)
    common.append(("Content-Type", "application/http;msgtype=response"))
    if revisit is None:
        return warc_record("response", common, block)
    kept = record_id(revisit["page"], digest, revisit["path"], revisit["record"])
    return warc_record("revisit", [
        *common, ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", kept),
        (LENGTH_HEADER, str(len(body)))], head)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 0) -> None:
    """Writes one gzip WARC file for each ARC file.

    Of records with equal payloads of at least least_bytes bytes the one with the largest page id (null
    ids before all others, ties to the later file and record) is a response and the others are revisits
    of it, which keep their HTTP head and leave the payload out. A version block becomes
    warcinfo, a record that is no HTTP answer a resource.
    """
    index = arc_index(spark, arc_path).where(F.col("length") >= least_bytes)
    place = F.struct("page", "path", "record")
    kept = (
        index.groupBy("digest", "length")
        .agg(F.max(place).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
        .select("digest", "length", "kept")
    )
    again = index.join(kept, ["digest", "length"]).where(place != F.col("kept"))
    by_file = materialize(
        again.groupBy("path").agg(  # as many entries as the file has records
            F.collect_list(F.struct("record", "kept")).alias("revisits")), "archive-revisits")

    def parse(file: dict) -> Iterator[tuple]:
        kept = {r["record"]: r["kept"] for r in file["revisits"] or ()}
        for number, record in enumerate(arc_records(file["content"])):
            yield (_converted(file["path"], number, record, kept.get(number)),)

    files = left_join(_files(spark, arc_path), by_file, "path")
    rows = _per_file(files, parse, "value binary", pa.schema([("value", pa.binary())]))
    _write(rows, warc_path, WARC_SEPARATOR)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers by lower-case name, and block, of every record of one WARC file."""
    stream = Stream(data)
    while (line := stream.line()) is not None:
        if not line.startswith(b"WARC/"):
            continue
        headers = {}
        while (line := stream.line()) not in (None, b"", b"\r"):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        # without a length the block is taken as empty, and the next line that opens a record goes on
        yield headers, stream.take(_length(headers.get("content-length")) or 0)


def _length(value: str | None) -> int | None:
    """A declared length; None for what is none."""
    return int(value) if value and value.isascii() and value.isdigit() and len(value) < 19 else None


_READ = pa.schema([
    ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()),
    ("page", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
    ("refers_to", pa.string()), ("intact", pa.bool_()), ("payload", pa.binary()),
])


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row for each response, resource and revisit of the WARC files.

    payload_bytes and payload_digest are those of the full payload: computed from the block where it
    holds one, else what the revisit's headers say. `intact`: block and payload have the
    digests that the record declares. payload is null for revisits and when not asked for.
    """

    def parse(file: dict) -> Iterator[tuple]:
        for headers, block in warc_records(file["content"]):
            kind = headers.get("warc-type")
            if kind not in ("response", "resource", "revisit"):
                continue
            _, body, http = split_http(block)
            said = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            intact = headers.get("warc-block-digest") == f"sha1:{sha1(block)}"
            if kind == "revisit":
                # the HTTP head may lack the length or lie about it; it is asked only if the record has none
                size = _length(headers.get(LENGTH_HEADER.lower()))
                size = _length(http.get("content-length")) if size is None else size
                digest, body = said, None
            else:
                digest, size = sha1(body), len(body)
                intact = intact and digest == said
            yield (
                headers.get("warc-record-id"), kind, headers.get("warc-target-uri"),
                headers.get("warc-date"), _number(http), digest, size,
                headers.get("warc-refers-to"), intact, body if with_payload else None,
            )

    return _per_file(
        _files(spark, path), parse,
        "record_id string, type string, uri string, date string, page long, payload_digest string,"
        " payload_bytes long, refers_to string, intact boolean, payload binary", _READ,
    )


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to (a page id) of WARC rows."""
    kept = records.where("type = 'response'").select(
        F.col("record_id").alias("refers_to"), F.col("page").alias("kept"))
    # repeated rows share an id, and one of them is enough
    kept = kept.groupBy("refers_to").agg(F.max("kept").alias("kept"))
    named: Column = F.when(F.col("type") == "revisit", F.col("kept"))
    return records.where("type != 'resource'").join(kept, "refers_to", "left").select(
        F.col("page").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("type").alias("record_type"), named.alias("refers_to"),
    )
