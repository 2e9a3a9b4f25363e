"""Shared helpers: word splitting, intermediate tables and files in the shared folder.

Words are found on UTF-8 bytes. Every byte of a non-ASCII character is 0x80 or above, so a table over the 256 byte values
lower-cases A-Z and blanks what separates words; ``bytes.split`` then cuts at exactly space and 0x09-0x0D.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import fresh_path, remove, run, shared_dir, staged, written  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORD_BYTES = bytes(
    ord(chr(b).lower()) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20
    for b in range(256)
)
WORD_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def alnum_words(text: str | None) -> list[bytes]:
    """Words of ASCII letters (lower-cased), digits and non-ASCII characters; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def spaced_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split() if text else []


def ascii_lower(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hash_sample(frame: DataFrame, columns: list[str], n: int) -> DataFrame:
    """At most n rows, the first in the order of a hash of columns.

    A task would send n candidates of its own to the driver; of large tables only about 4 n rows enter the sort.
    """
    order, total = F.xxhash64(*columns), frame.count()
    if total > 8 * n:
        frame = frame.where(F.pmod(order, F.lit(1 << 30)) < int(4 * n / total * (1 << 30)))
    return frame.orderBy(order, *columns).limit(n)


def file_by_file(files: DataFrame, most_tasks: int = 2_000, by: list[str] | None = None) -> DataFrame:
    """Deal a small table of file names (column uri, or the columns by, each once) so that files are read side by side.

    Ranges of names, not hashes: a hash of uri may equal a shuffle before it, which Spark then keeps alone and merges into
    one task by the few bytes of the names.
    """
    return files.repartitionByRange(max(1, min(files.count(), most_tasks)), *(by or ["uri"]))


def split_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, share: int = 1_000, floor: int = 0) -> DataFrame:
    """Inner join with a right side that has each key once and, in column n, how many rows of left have it.

    Keys with more than a thousandth of left's rows (total, or more) and than floor would each fill a task: they go by
    broadcast, and there are fewer than ``share`` of them whatever the size. All others are shuffled. Null keys match nothing.
    """
    if total <= floor:
        return left.join(right.drop(n), key)
    limit = max(floor, total // share)
    hot, cold = right.where(F.col(n) > limit).drop(n), right.where(F.col(n) <= limit).drop(n)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def whole_rows(docs: DataFrame) -> tuple[Column, dict[str, Column]]:
    """All columns of a row as one struct (without a name), and each of them by name: whatever a caller's columns are
    called, they cannot clash with columns that an operator adds."""
    quoted = {c: F.col(f"`{c}`") for c in docs.columns}
    return F.struct(*[c.alias(name) for name, c in quoted.items()]), quoted


def filtered(docs: DataFrame, decide: Callable[[list[str | None]], list[bool]], chunk_bytes: int = 8 << 20) -> DataFrame:
    """The documents that decide(texts) keeps, with all their columns, decided batch by batch where they are read."""
    text = f"c{docs.columns.index('text')}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots would not resolve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, text, chunk_bytes):
            yield batch.filter(pa.array(decide(batch.column(text).to_pylist()), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def unpacked(rows: DataFrame, packed: str, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of a struct as a table again, some of them changed."""
    return rows.select(*[changed.get(c, F.col(packed)[c]).alias(c) for c in columns])


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; local paths and file:// need no further library."""
    from pyarrow import fs

    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_bytes(uri: str, chunks: Iterable[bytes]) -> int:
    """Write a file under a hidden name, then rename it: readers never see part of it. Returns its size."""
    files, path = filesystem(uri)
    folder, name = os.path.split(path)
    files.create_dir(folder, recursive=True)
    hidden, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with files.open_output_stream(hidden) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(hidden, path)
    return size


def open_file(uri: str):
    files, path = filesystem(uri)
    return files.open_input_file(path)


def chunks_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each piece stays near a bound; a longer single row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > most_bytes:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        yield batch.slice(begin)
