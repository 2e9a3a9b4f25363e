"""MCAP containers: JSON-encoded topics as rows, other encodings listed as not decodable.

A table of chunks is made first, by a task a file: from the summary, or by walking the records' lengths without reading chunks. A
data source deals the chunks over tasks and leaves out those that cannot hold the topics and times asked for. A file whose
channels stand only inside chunks is read from end to end by one task, chunk by chunk. The record layout follows the public MCAP
specification; chunks may be plain, or compressed by Zstandard or LZ4.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from ..storage import exists, fresh_path, written
from . import envelope
from .files import open_file, read_rows

#: Opcodes and magic of the specification (fixed values).
MAGIC = b"\x89MCAP0\r\n"
FOOTER, CHANNEL, MESSAGE, CHUNK, MESSAGE_INDEX, CHUNK_INDEX, DATA_END = 0x02, 0x04, 0x05, 0x06, 0x07, 0x08, 0x0F
#: Bytes of neighbouring chunks that are read together.
READ_BYTES = 16 << 20
MOST_TASKS = 10_000
#: Messages of an array, on average.
ARRAY = 10_000

COLUMNS = "path string, topic string, encoding string, mcap_log_time_ns bigint, mcap_publish_time_ns bigint, mcap_sequence bigint, mcap_place bigint, data string"


def _text(body: memoryview, at: int) -> tuple[str, int]:
    size = struct.unpack_from("<I", body, at)[0]
    return bytes(body[at + 4 : at + 4 + size]).decode(), at + 4 + size


def _records(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    at = 0
    while at + 9 <= len(data):
        op, size = struct.unpack_from("<BQ", data, at)
        if at + 9 + size > len(data):  # cut off: what came before is still good
            return
        yield op, data[at + 9 : at + 9 + size]
        at += 9 + size


def _channel(body: memoryview) -> tuple[int, tuple[str, str]]:
    topic, at = _text(body, 4)
    return struct.unpack_from("<H", body)[0], (topic, _text(body, at)[0])


def _inside(body: memoryview) -> memoryview:
    """The records of a chunk."""
    size, (compression, at) = struct.unpack_from("<Q", body, 16)[0], _text(body, 28)
    inner = body[at + 8 :]
    if compression not in ("", "zstd", "lz4"):
        raise ValueError(f"chunk compression {compression!r} is not supported")
    return memoryview(pa.decompress(pa.py_buffer(inner), size, compression)) if compression else inner


def _messages(data: memoryview, channels: dict[int, tuple[str, str]]) -> Iterator[tuple[str, str, int, int, int, bytes]]:
    """(topic, encoding, log time, publish time, sequence, payload) of the messages of records; channels met are noted."""
    for op, body in _records(data):
        if op == CHANNEL:
            number, names = _channel(body)
            channels[number] = names
        elif op == MESSAGE:
            number, sequence, logged, published = struct.unpack_from("<HIQQ", body)
            yield *channels.get(number, ("", "")), logged, published, sequence, bytes(body[22:])
        elif op == CHUNK:
            yield from _messages(_inside(body), channels)


def decode(content: bytes) -> Iterator[tuple[str, str, int, int, int, bytes]]:
    """(topic, encoding, log time, publish time, sequence, payload) of every message of a container."""
    if not content.startswith(MAGIC):
        raise ValueError("not an MCAP container")
    yield from _messages(memoryview(content)[len(MAGIC) :], {})


class Entry(NamedTuple):
    """A stretch of a container's records: a chunk, a message outside of chunks, or a whole file of unknown channels."""

    at: int
    size: int
    first_ns: int | None  # times of its messages, where the container tells them
    last_ns: int | None
    channels: list[int] | None  # numbers of the channels that it has messages of, where the container tells them


def _summary(f, end: int) -> tuple[list[tuple[Entry, int]], dict[int, tuple[str, str]], int] | None:
    """Chunks (each with where its message indexes end), channels and the end of the data, from the summary section."""
    tail = 9 + 20 + len(MAGIC)
    if end < len(MAGIC) + tail:
        return None
    f.seek(end - tail)
    op, size, start = struct.unpack("<BQQ", f.read(17))
    if op != FOOTER or size != 20 or not 0 < start < end - tail:
        return None
    f.seek(start)
    found, channels = [], {}
    for op, body in _records(memoryview(f.read(end - tail - start))):
        if op == CHANNEL:
            number, names = _channel(body)
            channels[number] = names
        elif op == CHUNK_INDEX:
            first, last, at, length, offsets = struct.unpack_from("<QQQQI", body)
            own = [struct.unpack_from("<H", body, 36 + i)[0] for i in range(0, offsets, 10)]
            indexes = struct.unpack_from("<Q", body, 36 + offsets)[0]
            found.append((Entry(at, length, first, last, own if indexes else None), at + length + indexes))
    return (sorted(found), channels, start) if found and channels else None


def _walk(f, at: int, end: int, channels: dict[int, tuple[str, str]]) -> tuple[list[Entry], bool]:
    """Chunks and messages between two places by the lengths of records, and whether the file is cut off there."""
    entries: list[Entry] = []
    while at + 9 <= end:
        f.seek(at)
        op, size = struct.unpack("<BQ", f.read(9))
        if at + 9 + size > end:  # cut off: what came before is still good
            return entries, True
        if op == CHANNEL:
            number, names = _channel(memoryview(f.read(size)))
            channels[number] = names
        elif op == CHUNK:
            entries.append(Entry(at, 9 + size, *struct.unpack("<QQ", f.read(16)), None))
        elif op == MESSAGE:
            number, _, logged = struct.unpack("<HIQ", f.read(14))
            entries.append(Entry(at, 9 + size, logged, logged, [number]))
        elif op == MESSAGE_INDEX and entries:
            entries[-1] = entries[-1]._replace(channels=[*(entries[-1].channels or []), struct.unpack("<H", f.read(2))[0]])
        elif op in (DATA_END, FOOTER):
            break
        at += 9 + size
    return entries, False


def entries_of(uri: str) -> tuple[list[Entry], dict[int, tuple[str, str]]]:
    """The stretches of a container in file order, and its channels.

    A summary tells all chunks in two reads, and only what lies between them is walked; without one all records are walked. A file
    whose channels stand only inside chunks is one stretch.
    """
    with open_file(uri) as f:
        end = f.size()
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} is not an MCAP container")
        told = _summary(f, end)
        if told is None:
            channels: dict[int, tuple[str, str]] = {}
            entries, _ = _walk(f, len(MAGIC), end, channels)
            if entries and not channels:
                return [Entry(len(MAGIC), end - len(MAGIC), None, None, None)], {}
            return entries, channels
        chunks, channels, start = told
        entries, at = [], len(MAGIC)
        for entry, behind in chunks:
            entries += [*_walk(f, at, entry.at, channels)[0], entry]
            at = behind
        return entries + _walk(f, at, start, channels)[0], channels


INDEX = pa.schema([
    ("path", pa.string()), ("nth", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), ("first_ns", pa.int64()), ("last_ns", pa.int64()),
    ("topics", pa.list_(pa.string())), ("channels", pa.string()),
])
_INDEXES: dict[tuple, str] = {}


def chunk_index(spark: SparkSession, path: str) -> str:
    """Where the table of stretches of the containers at a path stands: path, nth, at, size, times, topics (null where they are not
    told) and channels (JSON, in a file's first row).

    Tasks list the files side by side. An index is kept for files of equal names, sizes and times of change.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").cast("double").alias("changed"))
    known = (spark.sparkContext.applicationId, *map(tuple, files.orderBy("path").collect()))  # a row for each container
    uri = _INDEXES.get(known)
    if uri is not None and exists(spark, uri):
        return uri

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                entries, channels = entries_of(uri)
                rows = []
                for nth, e in enumerate(entries):
                    topics = None if e.channels is None else sorted({channels.get(c, ("", ""))[0] for c in e.channels})
                    rows.append({"path": uri, "nth": nth, **e._asdict(), "topics": topics, "channels": json.dumps(channels) if not nth else None})
                yield from pa.Table.from_pylist(rows, INDEX).to_batches()

    shape = "path string, nth bigint, at bigint, size bigint, first_ns bigint, last_ns bigint, topics array<string>, channels string"
    uri = fresh_path(spark, "chunk-index")
    written(files.select("path").mapInArrow(run, shape), uri)
    while len(_INDEXES) >= 64:
        _INDEXES.pop(next(iter(_INDEXES)))
    _INDEXES[known] = uri
    return uri


class Stretch(InputPartition):
    """Neighbouring entries of one container that a task reads: (nth, at, size) each."""

    def __init__(self, path: str, channels: str, entries: list[tuple[int, int, int]]):
        self.path, self.channels, self.entries = path, channels, entries


class MessageSource(DataSource):
    """Messages of containers as rows. Options: index (of chunk_index), stretch_bytes, times_only, trace (a folder for names of chunks read)."""

    @classmethod
    def name(cls) -> str:
        return "mcap_messages"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> MessageReader:
        return MessageReader(dict(self.options))


class MessageReader(DataSourceReader):
    """Topics and times of filters decide which stretches are read at all; Spark applies the filters to the rows again."""

    def __init__(self, options: dict):
        self.index, self.times_only, self.trace = options["index"], options.get("times_only") == "true", options.get("trace")
        self.each, self.most = int(options["stretch_bytes"]), MOST_TASKS
        self.topics: set[str] | None = None
        self.low, self.high = 0, 1 << 64

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe) and f.attribute == ("topic",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("topic",):
                self._only(set(f.value))
            elif getattr(f, "attribute", None) == ("mcap_log_time_ns",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, GreaterThan | GreaterThanOrEqual | EqualTo):
                    self.low = max(self.low, f.value)
                if isinstance(f, LessThan | LessThanOrEqual | EqualTo):
                    self.high = min(self.high, f.value)
            yield f

    def _only(self, topics: set[str]) -> None:
        self.topics = topics if self.topics is None else self.topics & topics

    def partitions(self) -> list[Stretch]:
        rows = read_rows(self.index, [f.name for f in INDEX])
        channels = {r["path"]: r["channels"] for r in rows if r["channels"] is not None}
        size = max(self.each, sum(r["size"] for r in rows) // self.most)
        out: list[Stretch] = []
        held = 0
        for r in sorted(rows, key=lambda r: (r["path"], r["nth"])):
            elsewhere = r["first_ns"] is not None and not (r["first_ns"] <= self.high and r["last_ns"] >= self.low)
            if elsewhere or (self.topics is not None and r["topics"] is not None and not self.topics & set(r["topics"])):
                continue
            if not out or out[-1].path != r["path"] or held + r["size"] > size:
                out.append(Stretch(r["path"], channels[r["path"]], []))
                held = 0
            out[-1].entries.append((r["nth"], r["at"], r["size"]))
            held += r["size"]
        return out or [Stretch("", "{}", [])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.entries:
            return
        known = {int(k): tuple(v) for k, v in json.loads(partition.channels).items()}
        rows, seen = [], []
        with open_file(partition.path) as f:
            for nth, at, size in partition.entries:
                for n, (own, encoding, logged, published, sequence, payload) in enumerate(_range(f, at, size, known, seen)):
                    if self.topics is not None and own not in self.topics:
                        continue
                    data = payload.decode("utf-8", "replace") if encoding == "json" and not self.times_only else None
                    rows.append((partition.path, own, encoding, logged, published, sequence, nth << 32 | n, data))
                    if len(rows) >= 5_000:
                        yield _batch(rows)
                        rows = []
        if rows:
            yield _batch(rows)
        if self.trace:
            with open(f"{self.trace}/{uuid.uuid4().hex}", "w") as out:
                out.write("".join(f"{partition.path}:{at}\n" for at in seen))


def read_messages(spark: SparkSession, path: str, topic: str | None = None, times_only: bool = False) -> DataFrame:
    """Rows of all messages (of one topic): path, topic, encoding, times, sequence, place in the file, and data, JSON text or null.

    Filters on topic and mcap_log_time_ns that follow leave chunks unread that cannot hold such messages. times_only leaves the
    payloads where they are, which is all that alignment needs. spark.sensorline.mcap.trace names a folder where tasks note the chunks
    that they decompress.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(MessageSource)
    source = spark.read.format(MessageSource.name()).option("index", chunk_index(spark, path)).options(times_only=str(times_only).lower(), stretch_bytes=READ_BYTES)
    trace = spark.conf.get("spark.sensorline.mcap.trace", None)
    rows = (source.option("trace", trace) if trace else source).load()
    return rows if topic is None else rows.where(F.col("topic") == topic)


def _range(f, at: int, size: int, channels: dict[int, tuple[str, str]], seen: list[int]) -> Iterator[tuple[str, str, int, int, int, bytes]]:
    """Messages of a stretch of records, one record in memory at a time; places of chunks are noted."""
    end = at + size
    while at + 9 <= end:
        f.seek(at)
        op, length = struct.unpack("<BQ", f.read(9))
        if at + 9 + length > end:
            return
        if op == CHUNK:
            seen.append(at)
        if op in (CHANNEL, MESSAGE, CHUNK):
            f.seek(at)
            yield from _messages(memoryview(f.read(9 + length)), channels)
        at += 9 + length


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def topics(spark: SparkSession, path: str, with_fields: bool = False) -> DataFrame:
    """path, topic, encoding, n, first and last time, decodable, and with_fields fields (the schema of all JSON objects of a topic,
    null without any): one pass over the containers for all topics."""
    figures = [F.count("*").alias("n"), F.min("mcap_log_time_ns").alias("first_ns"), F.max("mcap_log_time_ns").alias("last_ns")]
    if with_fields:
        value = envelope.json_object(F.col("data"))
        figures.append(F.when(F.count(value) > 0, F.schema_of_variant_agg(value)).alias("fields"))
    found = read_messages(spark, path, times_only=not with_fields).groupBy("path", "topic", "encoding").agg(*figures)
    return found.withColumn("decodable", F.col("encoding") == "json")


def read_topic(spark: SparkSession, path: str, topic: str, fields: str | None = None) -> DataFrame:
    """One topic's messages; with its fields (of topics) data is a struct of them."""
    rows = read_messages(spark, path, topic)
    return envelope.parsed(rows, {"data": envelope.schema_of(fields)}) if fields else rows


def unpack(spark: SparkSession, path: str, out: str, names: list[str] | None = None, fmt: str = "jsonl", most: int | None = None) -> None:
    """Write topics as folders topic=…; most is the number of first messages of each topic, if given.

    jsonl and csv have a message a line, in files by ranges of time; json has arrays of at most ARRAY messages, one a file.
    """
    rows = read_messages(spark, path).where("data is not null")
    if names:
        rows = rows.where(F.col("topic").isin(*names))
    if most is not None:
        nth = F.row_number().over(Window.partitionBy("topic").orderBy("mcap_log_time_ns", "mcap_sequence"))
        rows = rows.withColumn("_n", nth).where(F.col("_n") <= most)
    rows = rows.select("topic", "mcap_log_time_ns", "mcap_publish_time_ns", "mcap_sequence", "data")
    if fmt == "json":
        one = F.struct("mcap_log_time_ns", "mcap_sequence", "mcap_publish_time_ns", "data")
        # arrays are equal stretches of a topic's time
        sizes = rows.groupBy("topic").agg(F.count("*").alias("_all"), F.min("mcap_log_time_ns").alias("_lo"), F.max("mcap_log_time_ns").alias("_hi"))
        part = F.floor((F.col("mcap_log_time_ns") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * F.ceil(F.col("_all") / ARRAY))
        packed = rows.join(F.broadcast(sizes), "topic").groupBy("topic", part.alias("_part")).agg(F.to_json(F.array_sort(F.collect_list(one))).alias("value"))  # a row for each topic
        packed.select("topic", "value").repartitionByRange("topic").write.option("maxRecordsPerFile", 1).partitionBy("topic").text(out)
        return
    writer = rows.repartitionByRange("topic", "mcap_log_time_ns", "mcap_sequence").sortWithinPartitions("topic", "mcap_log_time_ns", "mcap_sequence").write.partitionBy("topic")
    writer.json(out) if fmt == "jsonl" else writer.csv(out, header=True)


def write_example(messages: list[tuple[str, str, int, object]], compress: str | bool = "", each: int | None = None, channels_first: bool = False, summary: bool = False) -> bytes:
    """A small container of (topic, encoding, time, value) messages, for tests and samples: chunks of ``each`` messages (one
    chunk if not given), with the channels inside the first or, with channels_first, outside in front of all. With summary each chunk is
    followed by message indexes, and channels and chunk indexes stand at the end."""
    def text(s: str) -> bytes:
        return struct.pack("<I", len(s.encode())) + s.encode()

    def record(op: int, body: bytes) -> bytes:
        return struct.pack("<BQ", op, len(body)) + body

    names = list(dict.fromkeys((t, e) for t, e, _, _ in messages))
    numbers = {n: i for i, n in enumerate(names)}
    heads = b"".join(record(CHANNEL, struct.pack("<HH", i, 0) + text(t) + text(e) + struct.pack("<I", 0)) for i, (t, e) in enumerate(names))
    kind = {True: "zstd", False: ""}.get(compress, compress)
    out, closing = [MAGIC, record(0x01, text("") + text("sensorline"))] + [heads] * channels_first, []
    for begin in range(0, max(1, len(messages)), each or max(1, len(messages))):
        some = messages[begin : begin + (each or len(messages))]
        parts = [b"" if channels_first or begin else heads]
        for n, (topic, encoding, time, value) in enumerate(some, begin):
            payload = json.dumps(value).encode() if encoding == "json" else bytes(value)
            parts.append(record(MESSAGE, struct.pack("<HIQQ", numbers[topic, encoding], n, time, time) + payload))
        body = b"".join(parts)
        times = [m[2] for m in some] or [0]
        packed = pa.compress(body, kind, asbytes=True) if kind else body
        chunk = record(CHUNK, struct.pack("<QQQI", min(times), max(times), len(body), 0) + text(kind) + struct.pack("<Q", len(packed)) + packed)
        at = sum(map(len, out))
        out.append(chunk)
        if summary:
            own = sorted({numbers[m[:2]] for m in some})
            indexes = [record(MESSAGE_INDEX, struct.pack("<HI", i, 0)) for i in own]
            offsets = b"".join(struct.pack("<HQ", i, 0) for i in own)
            out += indexes
            sizes = struct.pack("<Q", sum(map(len, indexes))) + text(kind) + struct.pack("<QQ", len(packed), len(body))
            closing.append(record(CHUNK_INDEX, struct.pack("<QQQQI", min(times), max(times), at, len(chunk), len(offsets)) + offsets + sizes))
    out += [record(DATA_END, b"\0" * 4)] * summary
    start = sum(map(len, out)) if summary else 0
    return b"".join([*out, *[heads] * summary, *closing, record(FOOTER, struct.pack("<QQI", start, 0, 0)), MAGIC])
