"""Documents whose five-word shingles agree to 0.8 or more (Jaccard), by wide SimHash in tiles and exact verification.

Distinct sets of shingles get a 256-bit SimHash. Two sets of Jaccard 0.8 have a cosine of at least 8/9 (equal sizes are the
worst case), so their bits differ in 39 of 256 on average, with a deviation of 6; the radius of 64 leaves four of them, and
unrelated texts lie eight deviations beyond it. Tiles are laid out by the size of the sets: only sizes whose ratio is 0.8
or more can reach the similarity, so other tiles and rows never meet. A pair within the radius that its tile pair has not
linked yet is verified on its exact sets, which tasks read by range from files in the shared folder.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import filesystem, fresh_path, open_file, remove, spaced_words, staged, written
from .components import components

WORDS, SIMILARITY = 5, 0.8
LANES, RADIUS = 4, 64
TILE = 16_384
#: Sizes are laid out by classes of a 64th of their logarithm; that many classes apart the ratio is below SIMILARITY.
CLASSES = 64
APART = int(np.ceil(-np.log(SIMILARITY) * CLASSES)) + 1
#: Bytes of shingle sets, and open files, that a task keeps.
HELD, OPEN = 64 << 20, 32


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; a shorter text is one shingle, a text without words has none."""
    found = spaced_words(text)
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([digest(joined, simhash.SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
    return np.unique(np.array([digest(joined[b:e], simhash.SEED) for b, e in zip(begins.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64))


def fingerprint(own: np.ndarray) -> np.ndarray:
    """LANES words of SimHash over a set of hashes: each hash is mixed anew for each word."""
    ones = np.zeros(64 * LANES, np.int64)
    lanes = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(own), 255):
        x = own[i : i + 255, None] + lanes
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.add.reduce(np.unpackbits(x.view(np.uint8)).reshape(len(x), -1), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(own)).view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least so much; two empty sets are equal."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common >= least * (len(both) - common)


SHAPE = "doc_id bigint, text_hash bigint, node bigint, size bigint, fp binary, file string, at bigint"


def prints(docs: DataFrame, folder: str) -> DataFrame:
    """One row for each document: its set's hash (node), size, fingerprint and where in the folder's files it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        name, at = uuid.uuid4().hex, 0  # of this attempt: rows of a failed one are not kept
        with files.open_output_stream(f"{path}/{name}") as out:
            for batch in batches:
                rows = []
                for text in batch.column("text"):
                    own = shingles(text.as_py())
                    held = own.astype("<u8").tobytes()
                    out.write(held)
                    node = xxhash.xxh64_intdigest(held, simhash.SEED)
                    rows.append((node - (node >> 63 << 64), len(own), fingerprint(own).tobytes(), name, at))
                    at += len(held)
                if rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64()), strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], names=["doc_id", "text_hash", "node", "size", "fp", "file", "at"])

    return docs.select(F.col("doc_id").cast("bigint"), simhash.text_hash().alias("text_hash"), F.col("text").cast("string")).mapInArrow(run, SHAPE)


class Sets:
    """Shingle sets by range reads from the shared folder; some of them and some open files are kept."""

    def __init__(self, folder: str):
        self.folder, self.files, self.sets, self.bytes = folder, OrderedDict(), OrderedDict(), 0

    def read(self, file: str, at: int, size: int) -> np.ndarray:
        if (file, at) in self.sets:
            self.sets.move_to_end((file, at))
            return self.sets[file, at]
        if file not in self.files:
            if len(self.files) >= OPEN:
                self.files.popitem(last=False)[1].close()
            self.files[file] = open_file(f"{self.folder}/{file}")
        self.files.move_to_end(file)
        got = np.frombuffer(self.files[file].read_at(8 * size, at), "<u8")
        self.sets[file, at], self.bytes = got, self.bytes + got.nbytes
        while self.bytes > HELD and len(self.sets) > 2:
            self.bytes -= self.sets.popitem(last=False)[1].nbytes
        return got

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def _candidates(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, inside: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a and b (LANES, rows; rows by size) of the pairs within RADIUS whose sizes admit the similarity."""
    rows, columns = simhash.ROWS, simhash.COLUMNS
    for i in range(0, len(size_a), rows):
        some = slice(i, min(i + rows, len(size_a)))
        left = int(np.searchsorted(size_b, np.floor(SIMILARITY * size_a[some.start])))
        right = int(np.searchsorted(size_b, np.ceil(size_a[some.stop - 1] / SIMILARITY), "right"))
        for j in range(max(left, i) if inside else left, right, columns):
            other = slice(j, min(right, j + columns))
            bits = np.bitwise_count(a[0, some, None] ^ b[0, None, other])
            for lane in range(1, LANES - 1):
                bits += np.bitwise_count(a[lane, some, None] ^ b[lane, None, other])
            x, y = np.divmod(np.flatnonzero(bits <= RADIUS), other.stop - j)  # what all but the last word leave
            last = np.bitwise_count(a[-1, x + i] ^ b[-1, y + j])
            near = bits[x, y].astype(np.int64) + last <= RADIUS
            x, y = x[near] + i, y[near] + j
            if inside:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield x, y


def _pack_tile(table: pa.Table) -> pa.Table:
    """One row for a tile: its sets by size, as bytes and lists."""
    table = table.sort_by([("size", "ascending"), ("node", "ascending")]).combine_chunks()
    held = {c: [table.column(c).to_pylist()] for c in ("node", "size", "file", "at")}
    return pa.table({"tile": table.column("tile")[:1], "fps": [b"".join(table.column("fp").to_pylist())], **held}, schema=TILES)


TILES = pa.schema([
    ("tile", pa.int64()), ("fps", pa.binary()), ("node", pa.list_(pa.int64())), ("size", pa.list_(pa.int64())),
    ("file", pa.list_(pa.string())), ("at", pa.list_(pa.int64())),
])


def _compare(folder: str):
    def run(table: pa.Table) -> pa.Table:
        parts = table.sort_by("tile").to_pylist()
        fps = [np.ascontiguousarray(np.frombuffer(p["fps"], np.uint64).reshape(-1, LANES).T) for p in parts]
        sizes = [np.array(p["size"], np.int64) for p in parts]
        node, file, at = (np.concatenate([np.array(p[c], object if c == "file" else np.int64) for p in parts]) for c in ("node", "file", "at"))
        size, base = np.concatenate(sizes), len(sizes[0]) if len(parts) > 1 else 0
        root, sets, u, v = np.arange(len(node)), Sets(folder), [], []
        for x, y in _candidates(fps[0], fps[-1], sizes[0], sizes[-1], len(parts) == 1):
            y = y + base
            apart = root[x] != root[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
                if (one := root[i]) != (two := root[j]) and similar(*(sets.read(file[k], int(at[k]), int(size[k])) for k in (i, j))):
                    root[root == two] = one
                    u.append(node[i])
                    v.append(node[j])
        sets.close()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def links(distinct: DataFrame, folder: str, tile: int = TILE) -> DataFrame:
    """Verified edges (u, v) that connect distinct sets just as all verified pairs within the radius do: a forest for each tile pair."""
    spark = distinct.sparkSession
    sized = distinct.select("node", "size", "fp", "file", "at", F.floor(F.log(F.greatest("size", F.lit(1))) * CLASSES).cast("int").alias("kind"))
    classes = [(kind, 0, n) for kind, n in sized.groupBy("kind").count().collect()]
    if not classes:
        return spark.createDataFrame([], "u bigint, v bigint")
    places, meets = simhash._layout(classes, tile, APART)
    places = spark.createDataFrame([(kind, at, n) for kind, _, at, n in places], "kind int, first bigint, n bigint")
    meets = spark.createDataFrame(meets, "tile bigint, first bigint, last bigint")
    dealt = sized.join(F.broadcast(places), "kind").select(
        "node", "size", "fp", "file", "at", F.floor((F.col("first") + F.pmod(F.xxhash64("node"), "n")) / tile).alias("tile")
    )
    own = "tile bigint, fps binary, node array<bigint>, size array<bigint>, file array<string>, at array<bigint>"
    tiles = dealt.groupBy("tile").applyInArrow(_pack_tile, own)
    paired = tiles.join(meets, "tile").select(*tiles.columns, F.explode(F.sequence("first", "last")).alias("j"))
    paired = paired.select(*tiles.columns, F.least("tile", "j").alias("a"), F.greatest("tile", "j").alias("b"))
    return paired.groupBy("a", "b").applyInArrow(_compare(folder), "u bigint, v bigint")


def without_near_copies(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """One row for each component of documents linked by a similarity of 0.8 or more: that of the smallest doc_id, nulls last.

    The shingle sets, longer than the texts, are deleted as soon as the links are known.
    """
    spark = docs.sparkSession
    folder, table = fresh_path(spark, "shingles"), fresh_path(spark, "shingle-prints")
    rows = written(prints(docs, folder), table)
    distinct = rows.groupBy("node").agg(
        simhash.least_row().alias("least"), F.min(F.struct("file", "at")).alias("place"), F.first("size").alias("size"), F.first("fp").alias("fp")
    )
    distinct = staged(distinct.select("node", "least", "size", "fp", "place.file", "place.at"), "shingle-sets")
    roots = components(links(distinct, folder, tile)).withColumnRenamed("node", "of")  # from staged edges: the sets are done with
    remove(spark, folder)
    remove(spark, table)
    rooted = distinct.join(roots, distinct.node == roots.of, "left").select("least", F.coalesce("root", "node").alias("root"))
    return simhash.one_of_each(docs, rooted)
