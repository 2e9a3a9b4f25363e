"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound the overlap, exact intersection of sorted arrays.

A document's set is that of its distinct word shingles, as sorted 64-bit hashes in files of the shared folder. Its bitmap holds for
each bit the parity of the hashes that fall on it: an element of one set alone changes one bit, so two sets have at least as many
elements apart as their bitmaps have bits apart, and their overlap is at most (a + b - bits apart) / 2. Bitmaps grow with
their sets, by powers of two; the wider of two is folded (halves exclusive-or'ed), after which the bound still holds.

Distinct sets are laid out by size and written as tiles, a file each. A tile meets only tiles whose sizes admit the similarity; a task
gets the names of two tiles, compares their bitmaps, and intersects the sets of pairs that the bound leaves and that it has not linked
yet. A pair of tiles returns a spanning forest of its links, never all pairs of a group. No pair within the similarity is lost.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import file_by_file, filesystem, fresh_path, open_file, remove, split_join, staged, write_bytes, written
from .components import components
from .near_copies import Sets, shingles

WORDS = 4
#: Least similarity in hundredths.
LEAST = 85
#: Sets of a tile, and bytes of its bitmaps.
TILE, TILE_BYTES = 4_096, 8 << 20
#: Sizes are laid out by classes of a 64th of their logarithm.
CLASSES = 64
#: Sets compared at once: rows by columns.
ROWS, COLUMNS = 64, 2_048


def lanes(size: int) -> int:
    """64-bit words of the bitmap of a set: a bit for each element up to 256, for every two beyond, rounded up to a power of two."""
    bits = max(64, size if size <= 256 else max(256, size / 2))
    return 1 << int(np.ceil(np.log2(bits / 64)))


def bitmap(own: np.ndarray) -> np.ndarray:
    """Parities of the hashes of a set by their lowest bits, as lanes(size) words."""
    width = 64 * lanes(len(own))
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(bits: np.ndarray, to: int) -> np.ndarray:
    """Bitmaps (lanes, rows) as narrower ones."""
    while len(bits) > to:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def most_apart(sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """The most elements that may stand in one of two sets alone if they reach the similarity, by the sum of their sizes."""
    return sizes - 2 * -(-least * sizes // (100 + least))


def linked(a: np.ndarray, b: np.ndarray, least: int = LEAST) -> bool:
    """Whether two sorted arrays of distinct hashes reach the similarity, exactly."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= least * (len(both) - common)


def candidates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, inside: bool, least: int = LEAST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b (lanes, rows; rows by size, equal lanes) of the pairs that sizes and bitmaps admit.

    Words of the bitmaps are counted for all pairs of a block until unrelated ones should be out, then for the rest alone.
    """
    words = len(a)
    for i in range(0, len(size_a), ROWS):
        rows = slice(i, min(i + ROWS, len(size_a)))
        left = int(np.searchsorted(size_b, -(-least * size_a[rows.start] // 100)))
        right = int(np.searchsorted(size_b, 100 * size_a[rows.stop - 1] // least, "right"))
        for j in range(max(left, i) if inside else left, right, COLUMNS):
            columns = slice(j, min(right, j + COLUMNS))
            most = (100 - least) * int(size_a[rows.stop - 1] + size_b[columns.stop - 1]) // (100 + least)  # of any pair of the block
            dense = next((d for d in range(1, words) if 32 * d - 14 * d**0.5 > most), words)
            apart = np.bitwise_count(a[0, rows, None] ^ b[0, None, columns]).astype(np.uint8 if dense < 4 else np.uint32, copy=False)
            for lane in range(1, dense):
                apart += np.bitwise_count(a[lane, rows, None] ^ b[lane, None, columns])
            x, y = np.divmod(np.flatnonzero(apart <= most), columns.stop - j)
            if not len(x):
                continue
            bits = apart[x, y].astype(np.int64)
            x, y = x + i, y + j
            for lane in range(dense, words):
                bits += np.bitwise_count(a[lane, x] ^ b[lane, y])
            low, high = np.minimum(size_a[x], size_b[y]), np.maximum(size_a[x], size_b[y])
            near = (bits <= most_apart(low + high, least)) & (100 * low >= least * high)
            if inside:
                near &= x < y
            if near.any():
                yield x[near], y[near]


def prints(docs: DataFrame, folder: str, words: int = WORDS) -> DataFrame:
    """One row for each document: doc_id, node (its set's hash), size, bits, and file and place of its set in the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        name, at = uuid.uuid4().hex, 0  # of this attempt: rows of a failed one are not kept
        with files.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                rows = []
                for text in batch.column("text"):
                    own = shingles(text.as_py(), words)
                    held = own.astype("<u8").tobytes()
                    out.write(held)
                    node = xxhash.xxh64_intdigest(held, simhash.SEED)
                    rows.append((node - (node >> 63 << 64), len(own), bitmap(own).tobytes(), name, at))
                    at += len(held)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", "node", "size", "bits", "file", "at"])

    shape = "doc_id bigint, node bigint, size bigint, bits binary, file string, at bigint"
    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, shape)


def _write_tile(folder: str):
    """Writes a tile's file: its sets by size, with their bitmaps lane by lane. Returns its last class."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "ascending"), ("node", "ascending")]).combine_chunks()
        tile, out = table.column("tile")[0].as_py(), io.BytesIO()
        bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(len(table), -1)
        names = np.array(table.column("file").to_pylist(), "S32")
        np.savez(out, bits=np.ascontiguousarray(bits.T), name=names, **{c: table.column(c).to_numpy() for c in ("node", "size", "at")})
        write_bytes(f"{folder}/tile-{tile}", [out.getvalue()])
        return pa.table({"tile": [tile], "kind": [max(table.column("kind").to_pylist())]}, schema=pa.schema([("tile", pa.int64()), ("kind", pa.int32())]))

    return run


def _compare(folder: str, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(4)
        def tile(n: int) -> dict[str, np.ndarray]:
            with open_file(f"{folder}/tile-{n}") as f, np.load(io.BytesIO(f.read())) as held:
                return {k: held[k] for k in held.files}

        sets = Sets(folder)
        try:
            for batch in batches:
                for a, b in zip(batch.column("tile").to_pylist(), batch.column("other").to_pylist(), strict=True):
                    u, v = _links([tile(a)] if a == b else [tile(a), tile(b)], sets, least)
                    if u:
                        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
        finally:
            sets.close()

    return run


def _links(parts: list[dict[str, np.ndarray]], sets: Sets, least: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links of one tile, or between two."""
    one, two = parts[0], parts[-1]
    node, size, name, at = (np.concatenate([p[c] for p in parts]) for c in ("node", "size", "name", "at"))
    base = len(one["node"]) if len(parts) > 1 else 0
    width = min(len(p["bits"]) for p in parts)
    group, u, v = np.arange(len(node)), [], []

    def own(k: int) -> np.ndarray:
        return sets.read(name[k].decode(), int(at[k]), int(size[k]))

    for x, y in candidates(folded(one["bits"], width), folded(two["bits"], width), one["size"], two["size"], len(parts) == 1, least):
        y = y + base
        apart = group[x] != group[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            if (gi := group[i]) != (gj := group[j]) and linked(own(i), own(j), least):
                group[group == gj] = gi
                u.append(int(node[i]))
                v.append(int(node[j]))
    return u, v


def links(distinct: DataFrame, folder: str, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """Edges (u, v) that connect distinct, not empty sets just as all links do: a forest for each pair of tiles.

    The driver holds the number of sets of each class of sizes, of which there are some hundreds whatever the table.
    """
    spark = distinct.sparkSession
    apart = int(np.ceil(-np.log(least / 100) * CLASSES)) + 1
    sized = distinct.select(
        "node", "size", "bits", "file", "at", (F.length("bits") / 8).cast("int").alias("lanes"), F.floor(F.log("size") * CLASSES).cast("int").alias("kind")
    )
    places, last_of, following, width_now = [], {}, 0, None
    for width, kind, n in sorted(map(tuple, sized.groupBy("lanes", "kind").count().collect())):
        if width != width_now:  # tiles of one width, numbered on
            width_now, first, slot, each = width, following, 0, max(1, min(tile, TILE_BYTES // (8 * width)))
        places.append((width, kind, slot, n, each, first))
        slot += n
        last_of[kind] = first + (slot - 1) // each
        following = last_of[kind] + 1
    if not places:
        return spark.createDataFrame([], "u bigint, v bigint")
    reach = [(k, max(last for x, last in last_of.items() if x <= k + apart)) for k in last_of]
    where = spark.createDataFrame(places, "lanes int, kind int, slot bigint, n bigint, each bigint, first bigint")
    dealt = sized.join(F.broadcast(where), ["lanes", "kind"]).select(  # a row for each class of sizes
        "node", "size", "bits", "file", "at", "kind", (F.col("first") + F.floor((F.col("slot") + F.pmod(F.xxhash64("node"), "n")) / F.col("each"))).cast("bigint").alias("tile")
    )
    tiles = staged(dealt.groupBy("tile").applyInArrow(_write_tile(folder), "tile bigint, kind int"), "tiles")
    # of a pair, the tile of the smaller sets names the other: sizes grow with the numbers of tiles
    furthest = spark.createDataFrame(reach, "kind int, furthest bigint")
    pairs = tiles.join(F.broadcast(furthest), "kind").select("tile", F.explode(F.sequence("tile", "furthest")).alias("other"))
    pairs = pairs.join(tiles.select(F.col("tile").alias("other")), "other", "left_semi").select("tile", "other")  # hashes may leave a tile empty
    return file_by_file(pairs, by=["tile", "other"], most_tasks=20_000).mapInArrow(_compare(folder, least), "u bigint, v bigint")


def jaccard_classes(docs: DataFrame, words: int = WORDS, least: int = LEAST, tile: int = TILE) -> DataFrame:
    """One row for each document: doc_id, n_shingles (its set's size) and component_id, the smallest doc_id it reaches by links.

    Two documents link when 100 * intersection >= least * union of their sets. A text of fewer words is one shingle as a whole. Empty
    sets (null, empty and blank texts) link with nothing: each such row keeps its own doc_id. Repeated rows stay; a null doc_id is never the
    smallest while its component has another. Equal sets are compared once, so a group of copies costs one comparison.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "ngram-sets")
    rows = written(prints(docs, folder, words), fresh_path(spark, "ngram-prints"))
    distinct = rows.where("size > 0").groupBy("node").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("n"), F.min(F.struct("file", "at", "bits", "size")).alias("place")
    )
    distinct = staged(distinct.select("node", "least", "n", "place.file", "place.at", "place.bits", "place.size"), "ngram-distinct")
    roots = components(links(distinct, folder, least, tile)).withColumnRenamed("node", "of")
    remove(spark, folder)  # the links are written
    rooted = staged(distinct.join(roots, distinct.node == roots.of, "left").select("node", "n", "least", F.coalesce("root", "node").alias("root")), "ngram-rooted")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    named = split_join(rooted, smallest, "root", "members", rooted.count()).select("node", "n", "component_id")
    filled = split_join(rows.where("size > 0").select("doc_id", "node", "size"), named, "node", "n", rows.count())
    return filled.select("doc_id", F.col("size").alias("n_shingles"), "component_id").unionByName(
        rows.where("size = 0").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    )
