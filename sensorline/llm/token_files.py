"""Token ids in bit-packed files with random access.

A file holds whole documents in order. Layout, little-endian: ``magic``, payload, document table, block table, footer.
Every id takes the bits that the vocabulary's largest id needs, the lowest bit first; a block holds BLOCK ids and begins
on a byte, so any block can be read and unpacked alone with numpy. The footer gives the places of the tables.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_by_file, fresh_path, open_file, staged, write_bytes
from .tokens import encoder

MAGIC = b"TOKBITS1"
FOOTER = struct.Struct("<QQQQIB")
BLOCK = 1 << 16
#: Ids after which a task begins its next file.
FILE_IDS = 1 << 24


def bits_for(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    ids = ids.astype("<u4")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :bits] = each
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


def encode_file(doc_ids: list[int | None], texts: list[np.ndarray], bits: int, block: int = BLOCK) -> list[bytes]:
    ids = np.concatenate(texts) if texts else np.zeros(0, "<u4")
    blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    offsets = len(MAGIC) + np.cumsum([0, *map(len, blocks)])
    ends = np.cumsum([len(t) for t in texts]).astype("<i8")
    known = np.array([d is not None for d in doc_ids], np.uint8)
    table = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + known.tobytes() + ends.tobytes()
    places = offsets.astype("<u8").tobytes()
    at = int(offsets[-1])
    return [MAGIC, *blocks, table, places, FOOTER.pack(at, at + len(table), len(doc_ids), len(ids), block, bits)]


class TokenFile:
    """Reads document tables at once and ids on demand, block by block."""

    def __init__(self, uri: str):
        self.file = open_file(uri)
        size = self.file.size()
        if self._at(0, len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} holds no packed token ids")
        table, places, n, self.n_ids, self.block, self.bits = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        raw = self._at(table, places - table)
        ids, known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known, strict=True)]
        self.ends = np.frombuffer(raw, "<i8", n, 9 * n)
        self.offsets = np.frombuffer(self._at(places, size - FOOTER.size - places), "<u8")

    def _at(self, place: int, size: int) -> bytes:
        self.file.seek(place)
        return self.file.read(size)

    def ids(self, begin: int, end: int) -> np.ndarray:
        """Ids begin to end of the file."""
        if begin >= end:
            return np.zeros(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block
        low, high = int(self.offsets[first]), int(self.offsets[last + 1])
        data, out = self._at(low, high - low), []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            out.append(unpack(data[int(self.offsets[b]) - low : int(self.offsets[b + 1]) - low], self.bits, n))
        return np.concatenate(out)[begin - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids) in order; a block is unpacked once."""
        begin, held_from, held = 0, 0, np.zeros(0, "<u4")
        for doc_id, end in zip(self.doc_ids, self.ends.tolist(), strict=True):
            if end > held_from + len(held):
                upto = min(self.n_ids, -(-max(end, begin + 16 * self.block) // self.block) * self.block)
                held_from = begin // self.block * self.block
                held = self.ids(held_from, upto)
            yield doc_id, begin, held[begin - held_from : end - held_from]
            begin = end

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.file.close()


class TokenFiles(NamedTuple):
    """Where the files are: uri, part, nth, n_docs, n_ids, start (ids in the files before)."""

    manifest: DataFrame


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None, file_ids: int = FILE_IDS) -> TokenFiles:
    """Encode every text, append end_id and write files in ascending doc_id order (nulls first, ties as read).

    Texts are dealt by ranges of (doc_id, place in the input), so equal doc_ids spread over tasks; a file's name is
    unique to the attempt that wrote it and only files of finished tasks are in the manifest.
    A null text has just the end id. The manifest has a row for each file.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, rows = encoder(tokenizer), TaskContext.get().partitionId(), []
        bits = bits_for(max(enc.size, end_id + 1))
        doc_ids, texts, size = [], [], 0

        def flush():
            nonlocal doc_ids, texts, size
            uri = f"{path}/part-{part:06d}-{len(rows):05d}-{uuid.uuid4().hex[:12]}.tokens"
            write_bytes(uri, encode_file(doc_ids, texts, bits))
            rows.append({"uri": uri, "part": part, "nth": len(rows), "n_docs": len(doc_ids), "n_ids": size})
            doc_ids, texts, size = [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(enc.encode(text.as_py()), np.uint32(end_id))
                doc_ids.append(doc_id)
                texts.append(ids)
                size += len(ids)
                if size >= file_ids:
                    flush()
        if doc_ids:
            flush()
        yield from pa.Table.from_pylist(rows, SCHEMA).to_batches()

    ordered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.monotonically_increasing_id().alias("nth"))
    ordered = ordered.repartitionByRange("doc_id", "nth").sortWithinPartitions("doc_id", "nth").select("doc_id", "text")
    manifest = staged(ordered.mapInArrow(write, "uri string, part bigint, nth bigint, n_docs bigint, n_ids bigint"), "token-manifest")
    before = Window.orderBy("part", "nth").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return TokenFiles(manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))


SCHEMA = pa.schema([("uri", pa.string()), ("part", pa.int64()), ("nth", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def read_tokens(files: TokenFiles, with_ids: bool = True) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 and, with_ids, ids as an array."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with TokenFile(uri) as file:
                    rows = []
                    for doc_id, begin, ids in file.documents():
                        rows.append((doc_id, start + begin, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *[ids] * with_ids))
                        if len(rows) >= (256 if with_ids else 8_192):
                            yield _batch(rows, with_ids)
                            rows = []
                    if rows:
                        yield _batch(rows, with_ids)

    spread = file_by_file(files.manifest.select("uri", "start"))
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]]
    if with_ids:
        arrays.append(pa.array([c.astype(np.int64) for c in columns[4]], pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])
