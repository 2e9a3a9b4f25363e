"""SimHash near-duplicates by tiled exact comparison.

Distinct 64-bit fingerprints are laid out by population count and dealt into tiles. Only tiles whose population counts
come within the radius meet; inside such a pair numpy exclusive-or and bit counts compare classes of fingerprints whose
two halves have population counts that together differ by no more than the radius (a difference in bits is at least the
difference in population counts, for the whole and for the halves). Nothing else is skipped, so the comparison is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spaced_words, split_join, staged, unpacked, whole_rows
from .components import components

WORDS = 4
RADIUS = 4
SEED = 42
TILE = 16_384
#: Fingerprints compared at once: rows by columns.
ROWS, COLUMNS = 128, 4_096


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the word shingles, repeats included: a bit is set if more than half of the hashes have it."""
    found = spaced_words(text)
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[b:e], SEED) for b, e in zip(begins[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], np.uint64).astype(">u8")
        ones += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = WORDS, with_text_hash: bool = False) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Null and empty texts have fingerprint 0. On request text_hash too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(t, words) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(got)], names=[*others, "fp"])

    extra = [text_hash().alias("text_hash")] * with_text_hash
    shape = "doc_id bigint, " + "text_hash bigint, " * with_text_hash + "fp bigint"
    return docs.select(F.col("doc_id").cast("bigint"), *extra, F.col("text").cast("string")).mapInArrow(run, shape)


class Forest:
    """Groups of nodes 0..n-1: links come in arrays, group names stay in one array."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while (up := self.root[self.root]).tobytes() != self.root.tobytes():
                self.root = up


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int) -> Forest:
    """Groups of the fingerprints of a (then of b) linked within the radius; without b inside a. Both sorted by half counts."""
    other = a if b is None else b
    forest, base = Forest(len(a) + (0 if b is None else len(b))), 0 if b is None else len(a)
    key_a, key_b = half_counts(a), half_counts(other)
    kinds, begins = np.unique(key_a, return_index=True)
    for kind, begin, end in zip(kinds.tolist(), begins.tolist(), [*begins[1:].tolist(), len(a)], strict=True):
        high, low = divmod(kind, 64)
        for h in range(max(0, high - radius), min(32, high + radius) + 1):
            room = radius - abs(h - high)
            left = int(np.searchsorted(key_b, h * 64 + max(0, low - room)))
            right = int(np.searchsorted(key_b, h * 64 + min(32, low + room), "right"))
            if b is None:
                left = max(left, begin)
            for i in range(begin, end, ROWS):
                rows = a[i : min(end, i + ROWS), None]
                for j in range(left, right, COLUMNS):
                    x, y = np.nonzero(np.bitwise_count(rows ^ other[None, j : min(right, j + COLUMNS)]) <= radius)
                    x, y = x + i, y + j + base
                    if b is None:
                        x, y = x[x < y], y[x < y]
                    if len(x):
                        forest.link(x, y)
    return forest


def half_counts(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp >> np.uint64(32)).astype(np.int64) * 64 + np.bitwise_count(fp & np.uint64(0xFFFFFFFF))


def _pack_tile(table: pa.Table) -> pa.Table:
    """One row for a tile: its fingerprints, sorted by half counts, as bytes."""
    fp = table.column("fp").to_numpy().view(np.uint64)
    return pa.table({"tile": table.column("tile")[:1], "fps": [fp[np.argsort(half_counts(fp), kind="stable")].tobytes()]})


def _compare(radius: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.sort_by("tile").column("fps").to_pylist()]
        forest = close_pairs(parts[0], parts[1] if len(parts) > 1 else None, radius)
        nodes = np.concatenate(parts).view(np.int64)
        moved = np.flatnonzero(forest.root != np.arange(len(forest.root)))
        return pa.table({"u": nodes[moved], "v": nodes[forest.root[moved]]})

    return run


def _layout(classes: list[tuple[int, int, int]], size: int, radius: int):
    """Where each class of half counts begins in the order of population counts, and which tiles each tile meets."""
    at, places = 0, []
    spans: dict[int, list[int]] = {}
    for high, low, n in sorted(classes, key=lambda x: (x[0] + x[1], x[0])):
        places.append((high, low, at, n))
        for t in range(at // size, (at + n - 1) // size + 1):
            spans.setdefault(t, []).append(high + low)
        at += n
    tiles = sorted(spans)
    least, most = [min(spans[t]) for t in tiles], [max(spans[t]) for t in tiles]
    last = np.searchsorted(least, np.array(most) + radius, "right") - 1
    first = np.searchsorted(most, np.array(least) - radius, "left")
    return places, [(t, int(first[t]), int(last[t])) for t in tiles]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints (column fp) just as all links within the radius do.

    A tile is one row of bytes and goes to every tile it meets. Each tile pair returns a spanning forest of its links, never
    all pairs of a group. The driver holds the sizes of 33 x 33 classes and two numbers a tile.
    """
    spark = distinct.sparkSession
    halves = distinct.select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("high"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low")
    )
    classes = [tuple(r) for r in halves.groupBy("high", "low").count().collect()]
    if not classes:
        return spark.createDataFrame([], "u bigint, v bigint")
    places, meets = _layout(classes, tile, radius)
    places = spark.createDataFrame(places, "high int, low int, at bigint, n bigint")
    meets = spark.createDataFrame(meets, "tile bigint, first bigint, last bigint")
    dealt = halves.join(F.broadcast(places), ["high", "low"]).select(
        "fp", F.floor((F.col("at") + F.pmod(F.xxhash64("fp"), "n")) / tile).alias("tile")
    )
    tiles = dealt.groupBy("tile").applyInArrow(_pack_tile, "tile bigint, fps binary")
    paired = tiles.join(meets, "tile").select("fps", "tile", F.explode(F.sequence("first", "last")).alias("j"))
    paired = paired.select("fps", "tile", F.least("tile", "j").alias("a"), F.greatest("tile", "j").alias("b"))
    return paired.groupBy("a", "b").applyInArrow(_compare(radius), "u bigint, v bigint")


def _rooted(prints: DataFrame, least: Column, radius: int, tile: int) -> DataFrame:
    """(fp, n, least, root): of each distinct fingerprint its number of rows, the least of them and the root of its component."""
    distinct = staged(prints.groupBy("fp").agg(least.alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(links(distinct, radius, tile))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    return staged(rooted, "rooted")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row for each document: doc_id, fp, fingerprint (hex), component_id (the smallest doc_id it reaches by links).

    Documents without words have fingerprint 0 and link like any other. Repeated rows stay; a null doc_id is never the
    smallest while its component has another. Equal fingerprints are compared once, so a group of any number of copies
    costs one comparison; large components and large groups of copies are joined apart, never in one task.
    """
    prints = staged(fingerprints(docs, words), "fingerprints")
    rooted = _rooted(prints, F.min("doc_id"), radius, tile)
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = split_join(rooted, smallest, "root", "members", rooted.count()).select("fp", "n", "component_id")
    return split_join(prints, named, "fp", "n", prints.count()).select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def text_hash(text: Column | None = None) -> Column:
    return F.xxhash64(F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit("")))


def least_row() -> Column:
    """What stands for a group of rows: the smallest doc_id, nulls last, then the smallest text_hash."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash"))


def one_of_each(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each root: the least_row of the column least.

    Rows of one doc_id and one text are repeats: of those the least by its other columns' hash stays. Repeats are merged
    before the texts are shuffled, once, by doc_id and text.
    """

    def key(doc_id: Column, hashed: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")), hashed.cast("string")).alias("key")

    kept = rooted.groupBy("root").agg(F.min("least").alias("k")).select(key(F.col("k.doc_id"), F.col("k.text_hash")))
    whole, column = whole_rows(docs)
    plain = [column[f.name] for f in docs.schema if not re.search("map<|variant", f.dataType.simpleString())]  # what can be hashed
    rows = docs.select(key(column["doc_id"], text_hash(column["text"])), F.xxhash64(*plain).alias("hash"), whole.alias("doc"))
    once = rows.groupBy("key").agg(F.min_by("doc", "hash").alias("doc"))
    return unpacked(once.join(kept, "key", "left_semi"), "doc", docs.columns)


def without_near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The document of the smallest doc_id of each component, with all its columns; of repeated rows of it, one.

    Where all doc_ids of a component are null, one of its rows stays. Different texts under one doc_id, or without one,
    count by their own components.
    """
    prints = staged(fingerprints(docs, words, with_text_hash=True), "fingerprints")
    return one_of_each(docs, _rooted(prints, least_row(), radius, TILE))
