"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each a group of whole records, and a closing skippable frame: the
seek table of the Zstandard seekable format, with the compressed and the plain size of every frame. Any record is read by
its frame and its offset in the plain frame, which the index keeps. Plain Zstandard tools read a bundle from end to end.

Of records with equal payloads the one with the largest page_id is the response; the others are revisits without payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import file_by_file, fresh_path, open_file, split_join, staged, write_bytes

FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 64 << 20
LEVEL = 3
#: Fixed values of the seekable format and of the WARC revisit profile.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Digests of repeated payloads that go to every task, and bytes of their urls; more of them are joined by shuffle.
MOST_BROADCAST, MOST_BROADCAST_BYTES = 200_000, 32 << 20
#: A date for records of pages that carry none.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 40 bits, so 8 digits, at a time."""
    hexed = F.sha1(text)
    digits = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    entries = b"".join(struct.pack("<II", packed, plain) for packed, plain in frames)
    return struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)


class Bundle:
    """Random access to the frames of one bundle."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table = self._at(size - 9 - 8 * n, 8 * n)
        self.frames, at = [], 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def frame(self, i: int) -> bytes:
        at, packed, plain = self.frames[i]
        return zstandard.ZstdDecompressor().decompress(self._at(at, packed), max_output_size=plain)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes]:
        return next(parse(self.frame(frame)[offset:]))

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


def _uri(url: str) -> str:
    """A header value: control characters of the url percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 0x20 or ord(c) == 0x7F else c for c in url)


def record_id(page_id: int | None, url: str | None, digest: str, row: int | None = None) -> str:
    """Name of a record: by its page; of one that may have its like, by its row too."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, chr(10).join(map(str, (page_id, url, digest, row))))}>"


def record(name: str, page_id: int | None, url: str | None, payload: bytes, digest: str, response: dict | None = None) -> bytes:
    """A response, or a revisit of a response (page_id, url, and its name where it is the only one of that page)."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if response else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
        if _uri(url) != url:
            head.append(f"X-Target-Base64: {base64.b64encode(url.encode('utf-8', 'surrogatepass')).decode()}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if response:
        head.append(f"WARC-Profile: {PROFILE}")
        head += [f"WARC-Refers-To: {response['name']}"] * (response["name"] is not None)
        if response["url"] is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(response['url'])}")
        head += [f"WARC-Refers-To-Date: {DATE}"] + [f"X-Refers-To-Page: {response['page_id']}"] * (response["page_id"] is not None)
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, content) of the records of a plain frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        head = dict(line.split(": ", 1) for line in lines[1:])
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class Archive(NamedTuple):
    """index: record_id, page_id, uri, frame, offset of every record written."""

    index: DataFrame


INDEX = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("frame", pa.int64()), ("offset", pa.int64())])


def _write(path: str, frame_bytes: int, bundle_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, nth, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=LEVEL)
        frames: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        pending, index, held, packed = [], [], 0, 0

        def close_frame():
            nonlocal pending, held, packed
            if pending:
                plain = b"".join(pending)
                frames.append(packer.compress(plain))
                sizes.append((len(frames[-1]), len(plain)))
                packed += len(frames[-1])
                pending, held = [], 0

        def close_bundle():
            nonlocal nth, frames, sizes, index, packed
            close_frame()
            if not frames:
                return None
            uri = f"{path}/part-{part:06d}-{nth:05d}-{uuid.uuid4().hex[:12]}.warc.zst"
            write_bytes(uri, [*frames, seek_table(sizes)])
            rows = pa.Table.from_pylist([{"record_id": r, "page_id": p, "uri": uri, "frame": f, "offset": o} for r, p, f, o in index], INDEX)
            nth, frames, sizes, index, packed = nth + 1, [], [], [], 0
            return rows

        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "html", "digest", "row", "response", "revisit"))
            for each in zip(*columns, strict=True):
                page_id, url, html, digest, row, response, revisit = (x.as_py() for x in each)
                name = record_id(page_id, url, digest, row if response and (revisit or response["n"] > 1) else None)
                if revisit:
                    response["name"] = record_id(response["page_id"], response["url"], digest) if response["n"] == 1 else None
                one = record(name, page_id, url, html.encode("utf-8", "surrogatepass"), digest, response if revisit else None)
                index.append((name[1:-1], page_id, len(frames), held))
                pending.append(one)
                held += len(one)
                if held >= frame_bytes:
                    close_frame()
                if packed >= bundle_bytes and (rows := close_bundle()):
                    yield from rows.to_batches()
        if rows := close_bundle():
            yield from rows.to_batches()

    return write


def write_warc(pages: DataFrame, path: str | None = None, least_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, most_broadcast: int = MOST_BROADCAST) -> Archive:
    """Write a record for each page and return the index.

    Payloads of at least least_bytes are compared by digest: that with the largest page_id (null counts as smallest) is the
    response; rows that repeat it are responses too. Revisits name the response's record where it is the only one of its
    page, and its whole url where it has one. Record names are unique but for repeated rows of payloads below least_bytes.
    The digests that several pages have come from a partial aggregate without the payloads. Up to most_broadcast of them,
    with urls of MOST_BROADCAST_BYTES in all, are sent to the tasks, so that pages are written where they are read; more are joined by
    digest, hot ones apart.
    Bundle names are unique to the attempt; only bundles of finished tasks are in the index. Null urls and html stay apart
    from empty ones for urls; a null html is written as empty.
    """
    path = path or fresh_path(pages.sparkSession, "warc")
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.select("*", base32_sha1(F.col("html")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    large = F.octet_length("html") >= least_bytes
    by_page = rows.where(large).groupBy("digest", "page_id").agg(F.count("*").alias("n_rows"), F.min("url").alias("url"))
    chosen = F.max(F.struct("page_id", F.col("n_rows").alias("n"), "url")).alias("response")
    shared = staged(by_page.groupBy("digest").agg(chosen, F.sum("n_rows").alias("n_rows")).where("n_rows > 1"), "repeated-payloads")
    n, size = shared.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("response.url")), F.lit(0))).first()
    if n <= most_broadcast and size <= MOST_BROADCAST_BYTES:
        marked = rows.join(F.broadcast(shared.drop("n_rows")), "digest", "left")
    else:
        alone = rows.join(shared.select("digest"), "digest", "left_anti").withColumn("response", F.lit(None).cast(shared.schema["response"].dataType))
        marked = split_join(rows, shared, "digest", "n_rows", shared.agg(F.sum("n_rows")).first()[0]).unionByName(alone)
    marked = marked.withColumn("response", F.when(large, F.col("response")))
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response.page_id"))
    marked = marked.select("page_id", "url", "html", "digest", "row", "response", revisit.alias("revisit"))
    index = marked.mapInArrow(_write(path, frame_bytes, bundle_bytes), "record_id string, page_id bigint, uri string, frame bigint, offset bigint")
    return Archive(staged(index, "warc-index"))


def read_warc(archive: Archive, with_payload: bool = True) -> DataFrame:
    """Records of the archive's bundles, frame by frame through the seek tables.

    page_id, url, payload_bytes, payload_digest (recomputed from the payload of responses), record_type, refers_to and,
    with_payload, payload. A response whose payload does not have the digest of its header is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("uri").to_pylist():
                with Bundle(uri) as bundle:
                    for i in range(len(bundle.frames)):
                        yield pa.RecordBatch.from_pylist([_fields(*r, with_payload) for r in parse(bundle.frame(i))], READ if with_payload else READ.remove(6))

    files = file_by_file(archive.index.select("uri").distinct())
    shape = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return files.mapInArrow(read, shape + ", payload binary" * with_payload)


READ = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
     ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
)


def _fields(head: dict[str, str], content: bytes, with_payload: bool) -> dict:
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    if kind == "response" and base64.b32encode(hashlib.sha1(content).digest()).decode() != digest:
        raise ValueError(f"{head['WARC-Record-ID']}: the payload does not have its digest")
    number = lambda name: int(head[name]) if name in head else None
    url = base64.b64decode(head["X-Target-Base64"]).decode("utf-8", "surrogatepass") if "X-Target-Base64" in head else head.get("WARC-Target-URI")
    out = {
        "page_id": number("X-Page-Id"), "url": url, "payload_digest": digest, "record_type": kind,
        "payload_bytes": len(content) if kind == "response" else number("X-Payload-Length"), "refers_to": number("X-Refers-To-Page"),
    }
    return out | {"payload": content} if with_payload else out
