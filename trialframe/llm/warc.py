"""WARC archives: writing with revisits, segments and chunked framing; reading and reassembly.

Reading goes record by record within an archive; whole records are decoded where they are
read.  Only segmented ones are grouped: by origin record, in order of the segment number, with
the total length verified, after which the chunked transfer framing is decoded.
"""

from __future__ import annotations

import base64
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.llm.common import shared_folder

CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32_digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked framing."""
    out = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size])
           for i in range(0, len(payload), size)]
    return b"".join(out) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, with extensions and trailers; None if it is broken."""
    out, at = [], 0
    while True:
        end = body.find(CRLF, at)
        if end < 0:
            return None
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            return None
        at = end + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or len(body) < at + n + 2 or body[at + n:at + n + 2] != CRLF:
            return None
        out.append(body[at:at + n])
        at += n + 2


def decode_http(block: bytes) -> bytes | None:
    """The payload of an HTTP response block."""
    head, sep, body = block.partition(b"\r\n\r\n")
    if not sep:
        return None
    fields = dict(
        (k.strip().lower(), v.strip()) for k, _, v in
        (line.partition(b":") for line in head.split(CRLF)[1:])
    )
    if b"chunked" in fields.get(b"transfer-encoding", b"").lower():
        return dechunked(body)
    return body


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _records(batches: Iterator[pa.RecordBatch], segment: int, chunk: int):
    """Archive records, without the two line ends that close each."""
    for batch in batches:
        for row in batch.to_pylist():
            page = "" if row["page_id"] is None else str(row["page_id"])
            target = urllib.parse.quote(row["url"] or "urn:none", safe=":/?#[]@!$&'()*+,;=%-._~")
            own = f"<urn:uuid:{uuid.uuid4()}>"
            data = (row["html"] or "").encode("utf-8", "surrogatepass")
            digest = base64.b32encode(bytes.fromhex(row["digest"])).decode()
            base = [("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", target),
                    ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", page)]
            if row["refers_to"] is not None:
                fields = [("WARC-Type", "revisit"), *base, (
                    "WARC-Profile",
                    "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                    ("X-Refers-To-Page-Id", str(row["refers_to"])),
                    ("X-Payload-Length", str(row["payload_bytes"]))]
                yield pa.RecordBatch.from_pydict({"value": [_record(fields, b"")]})
                continue
            block = HTTP + chunked(data, chunk)
            kind = [("WARC-Type", "response"), *base,
                    ("Content-Type", "application/http; msgtype=response")]
            if len(block) <= segment:
                yield pa.RecordBatch.from_pydict({"value": [_record(kind, block)]})
                continue
            last = (len(block) - 1) // segment + 1
            for k in range(1, last + 1):
                if k == 1:
                    fields = [*kind, ("WARC-Segment-Number", "1")]
                else:
                    fields = [
                        ("WARC-Type", "continuation"),
                        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                        ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", own),
                        ("WARC-Segment-Number", str(k))]
                    if k == last:
                        fields.append(("WARC-Segment-Total-Length", str(len(block))))
                part = block[(k - 1) * segment:k * segment]
                yield pa.RecordBatch.from_pydict({"value": [_record(fields, part)]})


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, digest (hex), refers_to (null: a response).

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest
    page_id is the response (all of them, where that id is repeated, or where all ids are
    null); the others refer to it.  The largest id is found on digests alone, summed before
    the shuffle; payloads are shuffled once.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", "html", F.length(payload).cast("long").alias("payload_bytes"),
                     F.sha1(payload).alias("digest"))
    last = p.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")) \
        .where("copies > 1 and last is not null").select(F.col("digest").alias("of"), "last")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("last").isNotNull() \
        & ~F.col("page_id").eqNullSafe(F.col("last"))
    return p.join(last, F.col("digest") == F.col("of"), "left").select(
        "page_id", "url", "html", "payload_bytes", "digest",
        F.when(revisit, F.col("last")).alias("refers_to"))


def write_archives(
    pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = 1 << 20,
    chunk_bytes: int = 1 << 16, records_per_file: int = 4096,
) -> str:
    """Write gzipped archives with Spark's text writer, so that each file is committed as a whole.

    ``pages``: page_id, url, html; other columns are not written.  A null html is an empty
    payload, a null url the target ``urn:none``.  A block beyond ``segment_bytes`` is cut into a
    first record and continuations.  ``records_per_file`` times ``segment_bytes`` bounds a file.
    """
    def records(batches):
        return _records(batches, segment_bytes, chunk_bytes)

    (
        plan_records(pages.select("page_id", "url", "html"), min_bytes)
        .mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file)
        .option("compression", "gzip").text(path)
    )
    return path


class _Stream:
    """Reads on from gzipped (any number of members) or plain content in bounded pieces."""

    def __init__(self, content: bytes, piece: int = 1 << 18):
        self.raw, self.piece, self.buffer = io.BytesIO(content), piece, bytearray()
        self.packed = content[:2] == b"\x1f\x8b"
        self.unzip = zlib.decompressobj(31)

    def more(self) -> bool:
        data = self.raw.read(self.piece)
        if not data:
            return False
        while self.packed and data:
            self.buffer += self.unzip.decompress(data)
            data = self.unzip.unused_data if self.unzip.eof else b""
            if self.unzip.eof:
                self.unzip = zlib.decompressobj(31)
        if not self.packed:
            self.buffer += data
        return True

    def until(self, mark: bytes) -> bytes | None:
        at = 0
        while (found := self.buffer.find(mark, at)) < 0:
            at = max(0, len(self.buffer) - len(mark))
            if not self.more():
                return None
        return self.take(found + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.buffer) < n and self.more():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record, by Content-Length."""
    stream = _Stream(content)
    while True:
        head = stream.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "replace").strip("\r\n").split("\r\n")
        if not lines[0].startswith("WARC/"):
            continue
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields.get("content-length", "0"))
        block = stream.take(n)
        if len(block) < n:
            fields["truncated"] = "true"
        yield fields, block


RECORD = pa.schema([
    ("record_id", pa.string()), ("warc_type", pa.string()), ("origin_id", pa.string()),
    ("segment", pa.int64()), ("total_length", pa.int64()), ("target_uri", pa.string()),
    ("page_id", pa.int64()), ("refers_to", pa.int64()), ("declared_digest", pa.string()),
    ("declared_bytes", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary()),
])
RECORD_DDL = ("record_id string, warc_type string, origin_id string, segment long, "
              "total_length long, target_uri string, page_id long, refers_to long, "
              "declared_digest string, declared_bytes long, intact boolean, payload binary")


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text else None
    except ValueError:
        return None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Single records come out decoded (segment null), segmented ones as raw blocks."""
    rows, size = [], 0
    for batch in batches:
        for content in batch.column("content"):
            for f, block in parse_archive(content.as_py()):
                kind, segment = f.get("warc-type"), _number(f.get("warc-segment-number"))
                if kind not in ("response", "continuation", "revisit"):
                    continue
                intact, payload = "truncated" not in f, block
                if kind == "revisit":
                    payload = None
                elif segment is None:
                    payload = decode_http(block)
                    intact = intact and payload is not None
                own = f.get("warc-record-id")
                rows.append({
                    "record_id": own, "warc_type": kind,
                    "origin_id": f.get("warc-segment-origin-id", own), "segment": segment,
                    "total_length": _number(f.get("warc-segment-total-length")),
                    "target_uri": f.get("warc-target-uri"), "page_id": _number(f.get("x-page-id")),
                    "refers_to": _number(f.get("x-refers-to-page-id")),
                    "declared_digest": (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
                    "declared_bytes": _number(f.get("x-payload-length")), "intact": intact,
                    "payload": payload,
                })
                size += len(block) + 500
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(rows, RECORD)
                    rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, RECORD)


def _join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            parts = row.pop("parts")
            numbers = [p["segment"] for p in parts]
            block = b"".join(p["payload"] or b"" for p in parts)
            whole = numbers == list(range(1, len(parts) + 1)) and row["total_length"] == len(block)
            payload = decode_http(block) if whole else None
            row |= {"segment": len(parts), "payload": payload,
                    "intact": bool(row["intact"] and whole and payload is not None)}
            yield pa.RecordBatch.from_pylist([row], RECORD)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per response or revisit: ids, page_id, refers_to, declared digest, payload, intact.

    Segments are grouped by origin; an origin whose numbers are not 1..n, whose length differs
    from the declared total, or whose framing is broken has a null payload and intact = false.
    ``segment`` is the number of joined segments (null: never segmented).  A group holds the
    segments of one record only.  An archive is read as one binary value: keep files below the
    memory of a task (the writer's ``records_per_file``).
    """
    records = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path) \
        .select("content").mapInArrow(_parse, RECORD_DDL)
    single = records.where("segment is null")
    first = F.col("segment") == 1
    parts = records.where("segment is not null").groupBy("origin_id").agg(
        F.max(F.when(first, F.col("warc_type"))).alias("warc_type"),
        F.max("total_length").alias("total_length"),
        F.max(F.when(first, F.col("target_uri"))).alias("target_uri"),
        F.max(F.when(first, F.col("page_id"))).alias("page_id"),
        F.max(F.when(first, F.col("refers_to"))).alias("refers_to"),
        F.max(F.when(first, F.col("declared_digest"))).alias("declared_digest"),
        F.max(F.when(first, F.col("declared_bytes"))).alias("declared_bytes"),
        F.min("intact").alias("intact"),
        F.array_sort(F.collect_list(F.struct("segment", "payload"))).alias("parts"),
    ).withColumn("record_id", F.col("origin_id"))
    return single.unionByName(parts.mapInArrow(_join_segments, RECORD_DDL))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(None, None) if p is None else (len(p), base32_digest(p))
               for p in batch.column("payload").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("page_id", "warc_type", "refers_to", "declared_digest",
                                         "declared_bytes", "intact")),
             pa.array([n for n, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())],
            names=["page_id", "warc_type", "refers_to", "declared_digest", "declared_bytes",
                   "intact", "payload_bytes", "payload_digest"])


def archive_report(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, verified per record.

    Length and digest of a response are those of the payload read back, and ``verified`` says
    that they equal what its header declares; a revisit has the declared ones.
    """
    d = records.mapInArrow(
        _digests, "page_id long, warc_type string, refers_to long, declared_digest string, "
        "declared_bytes long, intact boolean, payload_bytes long, payload_digest string")
    revisit = F.col("warc_type") == "revisit"
    return d.select(
        "page_id", F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes"))
        .alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("payload_digest"))
        .alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "refers_to",
        (F.col("intact") & (revisit | F.col("payload_digest").eqNullSafe(F.col("declared_digest"))))
        .alias("verified"))


def new_archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
