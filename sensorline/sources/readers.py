"""Readers by file format, with a registry for more: each returns a lazy DataFrame of a path or path::sub.

What only a look at the bytes can tell (delimiter, encoding) is read from the first kilobytes of one file through Spark, so
any store that Spark reads will do.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import open_file

#: Encodings in the order they are tried (fixed values).
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
DELIMITERS = ",;\t|"
#: Keys of JSON objects that hold their rows (fixed values).
ROW_KEYS = ("frames", "data")
SNIFF_BYTES = 8192
#: Mark of a row_index that counts a source's rows.
PLACE = "sensorline.place"

_READERS: dict[str, Callable[[SparkSession, str, str | None], DataFrame]] = {}


def register_reader(*extensions: str):
    """Register a reader (spark, path, sub) for file extensions."""
    def add(read: Callable[[SparkSession, str, str | None], DataFrame]):
        for e in extensions:
            _READERS[e.lower().lstrip(".")] = read
        return read

    return add


def supported_formats() -> list[str]:
    return sorted(_READERS)


def split_path(path: str) -> tuple[str, str | None]:
    """(file, sub) of file::sub."""
    head, mark, sub = path.partition("::")
    return head, sub if mark else None


def clean_path(text: str) -> str:
    """A path as users paste it: without quotes, zero-width signs and a file:// in front; drive paths with slashes."""
    out = "".join(c for c in text if c not in "​‌‍﻿").strip().strip("\"'").strip()
    out = out.removeprefix("file://") if out.startswith("file:///") else out
    return re.sub(r"^/?([A-Za-z]):[\\/]", r"/\1:/", out).replace("\\", "/") if re.match(r"/?[A-Za-z]:[\\/]", out) else out


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    file, sub = split_path(clean_path(path))
    kind = (fmt or file.rsplit(".", 1)[-1]).lower()
    if kind not in _READERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(supported_formats())}")
    return _READERS[kind](spark, file, sub)


def with_row_index(frame: DataFrame) -> DataFrame:
    """Add row_index, from 0 in file order: files by name, rows by their place in them.

    Parquet files tell the places of their rows; of other files the splits are put into order by where they begin, and rows
    counted within a split; of what comes from no file directly, partitions are. Only a row for each file, split or
    partition is gathered. A row_index that was made here stays; another column of that name gives way.
    """
    if any(f.name == "row_index" and f.metadata.get(PLACE) for f in frame.schema):
        return frame
    def columns(**named: Column) -> DataFrame | None:
        try:
            return frame.select("*", *[c.alias(n) for n, c in named.items()])
        except AnalysisException:
            return None

    meta = lambda name: F.col(f"_metadata.{name}")
    rows = columns(_f=meta("file_path"), _s=F.lit(0).cast("bigint"), _i=meta("row_index"))
    first = F.lit(0).cast("bigint")
    if rows is None:
        rows, first = columns(_f=meta("file_path"), _s=meta("file_block_start"), _i=F.monotonically_increasing_id()), F.min("_i")
    if rows is None:
        rows = columns(_f=F.lit(""), _s=F.spark_partition_id().cast("bigint"), _i=F.monotonically_increasing_id())
    pieces = rows.groupBy("_f", "_s").agg(first.alias("_first"), F.count("*").alias("_n"))
    before = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece
    pieces = pieces.select("_f", "_s", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(pieces, ["_f", "_s"]).select(
        *[f"`{c}`" for c in frame.columns if c != "row_index"], (F.col("_before") + F.col("_i") - F.col("_first")).alias("row_index", metadata={PLACE: True})
    )


def _head(spark: SparkSession, path: str) -> bytes:
    """The first bytes of a file (of the first of several), read as a range: files of any size will do."""
    def run(batches):
        for batch in batches:
            heads = []
            for uri in batch.column("path").to_pylist():
                with open_file(uri) as f:
                    heads.append(f.read(SNIFF_BYTES))
            yield pa.RecordBatch.from_arrays([pa.array(heads, pa.binary())], names=["head"])

    row = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).mapInArrow(run, "head binary").first()
    return bytes(row[0]) if row else b""


def sniff_csv(head: bytes) -> tuple[str, str]:
    """(encoding, delimiter) of the beginning of a CSV file."""
    encoding = "latin-1"
    for name in ENCODINGS:
        try:
            head.decode(name)
            encoding = name
            break
        except UnicodeDecodeError as e:
            if e.start >= len(head) - 3 and name.startswith("utf-8"):  # a character cut at the end
                encoding = name
                break
    if head.startswith(b"\xef\xbb\xbf"):
        encoding = "utf-8-sig"
    text = head.decode("utf-8" if encoding == "utf-8-sig" else encoding, "replace").lstrip("﻿")
    try:
        return encoding, csv.Sniffer().sniff(text, DELIMITERS).delimiter
    except csv.Error:
        first = text.split("\n", 1)[0]
        return encoding, max(DELIMITERS, key=first.count) if any(d in first for d in DELIMITERS) else ","


@register_reader("csv", "tsv")
def read_csv(spark: SparkSession, path: str | list[str], sub: str | None = None, sniffed: tuple[str, str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """CSV with a header; encoding and delimiter are found out (or given, as sniff_csv tells them), types inferred over all rows unless
    a schema is known, malformed rows dropped.

    Spark reads no cp1252: its bytes come in as ISO-8859-1, and those that differ are put right in names and texts.
    """
    encoding, delimiter = sniffed or sniff_csv(_head(spark, path))
    charset = "UTF-8" if encoding.startswith("utf-8") else "ISO-8859-1"
    source = spark.read if schema is None else spark.read.schema(schema)
    frame = source.csv(path, header=True, inferSchema=schema is None, sep=delimiter, encoding=charset, mode="DROPMALFORMED")
    if encoding != "cp1252":
        return frame
    wrong = "".join(chr(b) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore"))
    right = wrong.encode("latin-1").decode("cp1252")
    texts = {f.name for f in frame.schema if isinstance(f.dataType, T.StringType)}
    mend = lambda c: F.translate(F.col(f"`{c}`"), wrong, right) if c in texts else F.col(f"`{c}`")
    return frame.select(*[mend(c).alias(c.translate(str.maketrans(wrong, right))) for c in frame.columns])


@register_reader("parquet")
def read_parquet(spark: SparkSession, path: str, sub: str | None = None) -> DataFrame:
    return spark.read.parquet(path)


@register_reader("jsonl", "ndjson")
def read_jsonl(spark: SparkSession, path: str, sub: str | None = None) -> DataFrame:
    """One object a line; lines that are none are dropped."""
    return spark.read.json(path, mode="DROPMALFORMED")


@register_reader("json")
def read_json(spark: SparkSession, path: str, sub: str | None = None) -> DataFrame:
    """A list of rows, an object with its rows under a usual key, or one object as one row."""
    frame = spark.read.json(path, multiLine=True)
    for key in ROW_KEYS:
        field = next((f for f in frame.schema if f.name.lower() == key), None)
        if field and isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
            return frame.select(F.explode(F.col(f"`{field.name}`")).alias("_r")).select("_r.*")
    return frame


@register_reader("txt")
def read_txt(spark: SparkSession, path: str, sub: str | None = None) -> DataFrame:
    """A list of timestamps as columns."""
    from .text import parse_timestamps, read_lines

    return parse_timestamps(read_lines(spark, path))


@register_reader("log", "info")
def read_log(spark: SparkSession, path: str, sub: str | None = None) -> DataFrame:
    from .text import parse_log, read_lines

    return parse_log(read_lines(spark, path))


@register_reader("mcap")
def read_mcap(spark: SparkSession, path: str, sub: str | None = None) -> DataFrame:
    """Messages of a container, of one topic if path::topic names it."""
    from . import mcap

    return mcap.read_messages(spark, path, sub)


@register_reader("h5", "hdf5")
def read_hdf5(spark: SparkSession, path: str, sub: str | None = None) -> DataFrame:
    from . import hdf5

    return hdf5.read_node(spark, path, sub)
