"""WARC archives as seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each holding whole records, and last a skippable
frame with the seek table of the public seekable format: for each frame its compressed and plain
size, then the number of frames, a descriptor byte and a closing magic number.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, fresh, saved, table

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 64 << 20
LEAST_REVISIT = 100
BROADCAST_ROWS = 200_000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, place: str = "") -> str:
    """By page_id; where that is on several rows, by the record's place too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{place}')}>"


def one_line(uri: str) -> str:
    """Control characters, which would end a header line, as percent signs and hex digits."""
    return re.sub(r"[\x00-\x1f\x7f-\x9f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), uri)


def record(kind: str, own_id: str, page_id: int | None, uri: str, payload: bytes, digest: str, refers_to: int | None, names_it: bool = True) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head alone, and the size of what it stands for. It names the identifier of the
    record that it refers to where only one row has that page_id."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own_id}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {one_line(uri)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
        if names_it:
            head.append(f"WARC-Refers-To: {record_id(refers_to)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at that offset, and where the next begins."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no record at {at}")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    stop = end + 4 + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut off")
    return headers, data[end + 4 : stop], stop + 4


class BundleWriter:
    """Adds records to frames of about `frame_bytes`; add() gives a record's frame and its offset in there."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        self.out, self.most, self.zstd = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frame, self.table, self.size = bytearray(), [], 0

    def add(self, data: bytes) -> tuple[int, int]:
        if self.frame and len(self.frame) + len(data) > self.most:
            self._flush()
        place = len(self.table), len(self.frame)
        self.frame += data
        return place

    def _flush(self) -> None:
        packed = self.zstd.compress(bytes(self.frame))
        self.out.write(packed)
        self.table.append((len(packed), len(self.frame)))
        self.size += len(packed)
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.table)
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), 0, SEEKABLE))


class BundleReader:
    """Reads any frame of a bundle by its seek table, without the frames before it."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        file.seek(size - 9)
        n, kind, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or kind & 0x7F:
            raise ValueError("not a seekable bundle")
        file.seek(size - 9 - 8 * n)
        raw, self.frames, at = file.read(8 * n), [], 0
        for i in range(n):
            packed, plain = struct.unpack_from("<II", raw, 8 * i)
            self.frames.append((at, packed, plain))
            at += packed

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return parse(self.frame(frame), offset)[:2]


def _small(df: DataFrame) -> DataFrame:
    """For a broadcast where its counted rows are within the bound; otherwise the join shuffles."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, original (the smallest page_id with an equal payload of LEAST_REVISIT bytes or more, else null),
    and whether several rows have the page_id, or the original's.

    Of repeated digests and page_ids alone tables are made; while these are small no payload is
    moved. Beyond that payloads are dealt by digest, and a hot digest's rows may be dealt anew. Null html is an empty payload.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    many = saved(pages.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("page_id"), "repeated-pages")
    first = (
        pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= LEAST_REVISIT).select("page_id", F.sha2("payload", 256).alias("digest"))
        .groupBy("digest").agg(F.min("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    marked = lambda df, key, name: df.join(_small(many.select(F.col("page_id").alias("_m"), F.lit(True).alias(name))), F.col(key).eqNullSafe(F.col("_m")), "left").drop("_m").withColumn(name, F.coalesce(name, F.lit(False)))
    first = saved(marked(first, "original", "original_many"), "repeated-digests")
    return marked(rows.join(_small(first), "digest", "left"), "page_id", "many")


INDEX = "file string, page_id long, frame int, offset long, record_id string"


def write_archives(pages: DataFrame, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """Writes bundles into `folder` and returns the index: file, page_id, frame, offset, record_id.

    A file's name holds a fresh identifier and the index names the files of the task attempts that
    ended well, so what a lost executor left is never read. Rows of equal payloads that share the
    smallest page_id are all responses; a null page_id counts as the largest. Every record has an identifier of its
    own, also where a page_id is on several rows. An empty table gives an empty index and no file.
    """
    fs, root = file_system(folder)
    fs.create_dir(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        out, writer, name, rows = None, None, "", []

        def done() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], ["file", "page_id", "frame", "offset", "record_id"])

        for b in batches:
            for page, url, payload, digest, original, many, vague in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if writer is None:
                    name = f"{uuid.uuid4().hex}.warc.zst"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    writer, rows = BundleWriter(out, frame_bytes), []
                again = original is not None and page != original
                own = record_id(page, f"{name}:{len(rows)}" if many else "")
                frame, offset = writer.add(record("revisit" if again else "response", own, page, url, payload, digest, original if again else None, not vague))
                rows.append((name, page, frame, offset, own))
                if writer.size >= bundle_bytes:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return saved(with_originals(pages).select("page_id", "url", "payload", "digest", "original", "many", "original_many").mapInArrow(run, INDEX), "warc-index")


RECORDS = "file string, frame int, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the indexed bundles, from the files alone: size and digest of a response are
    taken from its payload and held against its header; a revisit has them in its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for b in batches:
            for name, first, last in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                with fs.open_input_file(f"{root}/{name}") as file:
                    bundle = BundleReader(file)
                    for k in range(first, last + 1):
                        data, at, rows = bundle.frame(k), 0, []
                        while at < len(data):
                            headers, block, after = parse(data, at)
                            http, _, payload = block.partition(b"\r\n\r\n")
                            digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                            size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
                            if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                                raise ValueError(f"{name}: the payload of {headers['WARC-Record-ID']} does not match its digest")
                            number = lambda key, h=headers: int(h[key]) if key in h else None
                            rows.append((name, k, at, number("X-Page-Id"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page-Id"), headers["WARC-Target-URI"], headers["WARC-Record-ID"]))
                            at = after
                        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [c.split()[0] for c in RECORDS.split(", ")])

    spans = index.groupBy("file", F.floor(F.col("frame") / 16).alias("part")).agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    return spans.select("file", "first", "last").repartition("file", "first").mapInArrow(run, RECORDS)


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS o FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> o THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_REVISIT} AND page_id <> o THEN o END AS refers_to
FROM w
"""
