"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

An archive is a run of gzip members with one record each (or, uncompressed, a run of
records). The reader checks every record: the member's own checksum, the record's
length, its block digest. After a failed check it searches for the next member or
version line from which a whole record can be read, goes on there, and logs the bytes
between as a quarantined gap. Within an inflated member it searches the next version
line there; the gap is then the member's, and its reason names the inflated bytes. Of a
damaged or cut member, what could be inflated is read in the same way; where the
inflating failed, only records with a block digest count.

Equal payloads are stored once: of rows with equal payloads the one with the largest
page_id is the response, the others are revisits that refer to it. Null html counts as
empty; rows equal in payload and page_id are all responses if theirs is the largest
page_id; where all ids of a payload are null, all are responses, and a null id besides
others is a revisit. A null url is written as an empty target. An empty table gives no
archive and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm.binary import write_whole
from assayline.llm.shared import short_batches, stored, work_path
from assayline.sources.tables import ship, table

VERSION = b"WARC/1.1\r\n"
MEMBER = b"\x1f\x8b\x08"
END = b"\r\n\r\n"
#: Compressed bytes inflated at once.
PIECE = 1 << 16
#: A record's date where the row has none; archives must not depend on when they are written.
DATE = "1970-01-01T00:00:00Z"


@dataclass(frozen=True)
class WarcConfig:
    """min_dedup_bytes: payloads below are never revisits. file_bytes: size after which a new file starts.
    compressed: one gzip member a record, else plain records."""

    min_dedup_bytes: int = 0
    file_bytes: int = 16 << 20
    compressed: bool = True


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes
    start: int


@dataclass(frozen=True)
class Gap:
    start: int
    end: int
    reason: str


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# --- records ---------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record: an HTTP response with its payload, or its headers alone in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    target = "".join(c if c.isprintable() and c not in "<>" else "%20" for c in url or "")
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return VERSION + "\r\n".join(lines).encode() + END + block + END


def _parse(data: bytes, at: int, need_digest: bool = False) -> tuple[Record, int]:
    """The record that starts at a version line, and where it ends. ValueError says which check failed."""
    if data[at : at + 5] != b"WARC/":
        raise ValueError("no version line")
    headers: dict[str, str] = {}
    begin = data.find(b"\r\n", at) + 2
    while begin > 1:
        line_end = data.find(b"\r\n", begin)
        if line_end < 0:
            begin = 0
            break
        line, begin = data[begin:line_end], line_end + 2
        if not line:
            break
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        if not colon:
            raise ValueError("malformed header")
        headers[name.strip().lower()] = value.strip()
    if begin < 2:
        raise ValueError("headers do not end")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no content length")
    end = begin + int(headers["content-length"])
    if data[end : end + 4] != END:
        raise ValueError("block is not as long as declared")
    block = data[begin:end]
    declared = headers.get("warc-block-digest", "")
    if declared.startswith("sha1:") and declared[5:] != sha1_base32(block):
        raise ValueError("block digest differs")
    if need_digest and not declared.startswith("sha1:"):
        raise ValueError("no block digest in a damaged member")
    return Record(headers, block, at), end + 4


def _run(data: bytes, need_digest: bool = False) -> Iterator[tuple[Record | Gap, int]]:
    """The records of an inflated member and the gaps between them, each with its end."""
    at = 0
    while at < len(data):
        probe, reason = at, ""
        while True:  # the next version line from which a record can be read whole
            try:
                r, end = _parse(data, probe, need_digest)
                break
            except ValueError as e:
                reason = reason or str(e)
            probe = data.find(b"WARC/1.", probe + 1)
            if probe < 0:
                yield Gap(at, len(data), reason), len(data)
                return
        if probe > at:
            yield Gap(at, probe, reason), probe
        yield r, end
        at = end


def _inflated(data: bytes, at: int) -> bytes:
    """What comes out of a damaged member before inflating fails."""
    d, out, step = zlib.decompressobj(31), [], 4096
    while at < len(data):
        before = d.copy() if step > 1 else None  # a single byte that fails ends it
        try:
            out.append(d.decompress(data[at : at + step]))
        except zlib.error:
            if before is None:
                break
            d, step = before, 1
            continue
        at += step
    return b"".join(out)


def _unit(data: bytes, at: int) -> tuple[list[Record | Gap], int, str]:
    """What the next unit (a member, or one plain record) holds, where what was read of it ends, and what is wrong with the rest."""
    if data[at : at + 3] != MEMBER:
        try:
            r, end = _parse(data, at)
        except ValueError as e:
            return [], at, str(e)
        return [r], end, ""
    d, wrong, corrupt, out, stop = zlib.decompressobj(31), "", False, [], at
    try:
        while stop < len(data) and not d.eof:  # piece by piece, as what follows the member is copied each time
            out.append(d.decompress(data[stop : stop + PIECE]))
            stop = min(stop + PIECE, len(data))
        inner = b"".join(out)
        if not d.eof:
            wrong = "member: cut short"
    except zlib.error as e:
        wrong, corrupt, inner = f"member: {e}", True, _inflated(data, at)
    stop -= len(d.unused_data)
    parts = list(_run(inner, corrupt))
    if not any(isinstance(p, Record) for p, _ in parts):
        if wrong or parts:
            return [], at, wrong or parts[0][0].reason
        return [], stop, ""
    if wrong:
        while isinstance(parts[-1][0], Gap):
            parts.pop()  # it is part of the rest
        d = zlib.decompressobj(31)
        d.decompress(memoryview(data)[at:], parts[-1][1] - 1)  # with its last byte, the member's checksum might fail
        end = len(data) - len(d.unconsumed_tail)
    else:
        end = stop
    return [Record(p.headers, p.block, at) if isinstance(p, Record) else Gap(at, end, f"{p.reason}; inflated bytes {p.start} to {p.end}") for p, _ in parts], end, wrong


def read_archive(data: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks, in order, and the gaps between them."""
    at = 0
    ahead = {MEMBER: -1, b"WARC/1.": -1}  # the next place of each, as far as it is known
    while at < len(data):
        found, end, wrong = _unit(data, at)
        yield from found
        if wrong:
            probe = max(end - 1, at)
            while True:  # the next place from which a record can be read whole
                for mark, place in ahead.items():
                    if place <= probe:
                        place = data.find(mark, probe + 1)
                        ahead[mark] = place if place >= 0 else len(data)
                probe = min(ahead.values())
                if probe == len(data):
                    yield Gap(end, len(data), wrong)
                    return
                found, _, more = _unit(data, probe)
                if found or not more:
                    break
            if probe > end:
                yield Gap(end, probe, wrong)
            end = probe
        at = end


# --- tables ----------------------------------------------------------------------------


def with_revisits(pages: DataFrame, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """(page_id, url, html, refers_to): refers_to is the response's page_id for revisits, else null."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("html")))
    # One row a payload, made from partial maxima, so a payload of very many pages is no burden.
    shared = rows.where(F.octet_length("html") >= cfg.min_dedup_bytes).groupBy("digest").agg(F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = F.when(F.col("last_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last_id")), F.col("last_id"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, cfg: WarcConfig = WarcConfig()) -> DataFrame:
    """Writes pages into folder as .warc or .warc.gz files; returns (file, n_records, n_bytes) of each."""
    short_batches(pages.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def file() -> pa.RecordBatch:
            nonlocal number
            name = f"part-{part:06d}-{number:04d}.warc" + ".gz" * cfg.compressed
            n_bytes = write_whole(folder, name, held)
            number += 1
            return pa.record_batch([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([n_bytes], pa.int64())], ["file", "n_records", "n_bytes"])

        for b in batches:
            for page_id, url, html, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                payload = html.encode()
                raw = record(page_id, url, payload, sha1_base32(payload), "response" if refers_to is None else "revisit", refers_to)
                if cfg.compressed:
                    c = zlib.compressobj(6, zlib.DEFLATED, 31)
                    raw = c.compress(raw) + c.flush()
                held.append(raw)
                size += len(raw)
                if size >= cfg.file_bytes:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    rows = with_revisits(pages, cfg).sortWithinPartitions("page_id", "url", "html")
    return stored(rows.mapInArrow(write, "file string, n_records long, n_bytes long"), "warc-manifest")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("path", "content")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, html (null in revisits)."""

    def number(uri: str | None) -> int | None:
        tail = (uri or "").strip("<>").rpartition(":")[2]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])
        for b in batches:
            for content in b.column("content"):
                rows: list[tuple] = []
                for r in read_archive(content.as_py()):
                    if isinstance(r, Gap) or r.headers.get("warc-type") not in ("response", "revisit"):
                        continue
                    http, _, payload = r.block.partition(END)
                    lengths = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
                    kind = r.headers["warc-type"]
                    digest = r.headers.get("warc-payload-digest", "").removeprefix("sha1:")
                    if kind == "response":
                        size, digest = len(payload), sha1_base32(payload)
                    else:
                        size = int(lengths[0]) if lengths else None
                    text = payload.decode("utf-8", "replace") if kind == "response" else None
                    rows.append((number(r.headers.get("warc-record-id")), r.headers.get("warc-target-uri"), size, digest, kind, number(r.headers.get("warc-refers-to")), text))
                    if len(rows) == 1024:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _files(spark, folder).mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string")


def read_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """The quarantine log: (file, start, end, reason) of each run of bytes that no record was read from."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                gaps = [g for g in read_archive(content.as_py()) if isinstance(g, Gap)]
                yield pa.record_batch(
                    [pa.array([path.rsplit("/", 1)[-1]] * len(gaps), pa.string()), pa.array([g.start for g in gaps], pa.int64()), pa.array([g.end for g in gaps], pa.int64()), pa.array([g.reason for g in gaps], pa.string())],
                    ["file", "start", "end", "reason"],
                )

    return _files(spark, folder).mapInArrow(read, "file string, start long, end long, reason string")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from the archives."""
    pages = table(spark, sf_dir, "pages")
    folder = work_path(spark, "warc")
    if not write_archives(pages, folder).take(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
