"""Approximate search for the largest inner product: score-aware quantisation, four-bit table scans, exact reranking.

Vectors are cut into pairs of numbers; each pair is one of 16 centres, so a vector is four bits a pair. Codes and centres
minimise a loss that weighs the residual parallel to the vector ETA times as much as the rest, since only that part moves
large inner products. A query turns into one table of 16 partial products a pair, quantised to bytes; a scan adds up table
entries of many queries at once over the distinct codes of a tile of rows. Rows are scored exactly in double precision
wherever the sum, with an allowance for the residual of that code, reaches the exact k-th score so far: there is no cap on
them, so near copies that share a code or differ by less than the quantisation all get their exact scores.

Tiles of rows and of queries are files in the shared folder. A unit of work is a tile of queries and a group of tiles of
rows; it holds one tile of each and the k best so far, so memory does not grow, and the driver sees no vector but the
training sample.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_by_file, fresh_path, hash_sample, open_file, staged, write_bytes

PAIR, CENTRES = 2, 16
#: Vectors that the centres are trained on, at most.
SAMPLE = 8_192
TRAIN_ROUNDS, ENCODE_SWEEPS = 6, 3
THRESHOLD = 0.2
#: Codes of the first tile whose rows give a unit its first k-th score.
DEPTH = 64
#: Allowance for a residual, in deviations of its product with a query of random direction.
DEVIATIONS = 2.5
#: Queries of a tile, rows of a tile, tiles of rows in a group.
QUERY_BLOCK, ROW_BLOCK, GROUP = 512, 32_768, 64
#: Queries and codes that are scanned at once.
QUERIES_AT_ONCE, CODES_AT_ONCE = 64, 2_048


def weight(dim: int, threshold: float = THRESHOLD) -> float:
    """How much more the parallel residual counts, for scores above threshold times the norm."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


class Quantiser:
    def __init__(self, centres: np.ndarray, dim: int, eta: float):
        self.centres, self.dim, self.eta = centres, dim, eta  # centres: pairs, 16, 2

    def _pairs(self, x: np.ndarray) -> np.ndarray:
        padded = np.zeros((len(x), len(self.centres) * PAIR), np.float32)
        padded[:, : self.dim] = x
        return padded.reshape(len(x), -1, PAIR)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Centre numbers (rows, pairs) by coordinate descent on the score-aware loss."""
        pairs, norm = self._pairs(x), np.maximum((x.astype(np.float32) ** 2).sum(1), 1e-30)
        codes = np.empty(pairs.shape[:2], np.uint8)
        along = np.empty((len(x), len(self.centres)), np.float32)
        errors, turns = [], []
        for m, centres in enumerate(self.centres):
            gap = pairs[:, m, None, :] - centres[None]
            errors.append((gap**2).sum(2))
            turns.append((gap * pairs[:, m, None, :]).sum(2))
            codes[:, m] = errors[m].argmin(1)
            along[:, m] = np.take_along_axis(turns[m], codes[:, m, None].astype(np.int64), 1)[:, 0]
        total = along.sum(1)
        for _ in range(ENCODE_SWEEPS):
            for m in range(len(self.centres)):
                rest = total - along[:, m]
                loss = errors[m] + (self.eta - 1) * (rest[:, None] + turns[m]) ** 2 / norm[:, None]
                codes[:, m] = loss.argmin(1)
                along[:, m] = np.take_along_axis(turns[m], codes[:, m, None].astype(np.int64), 1)[:, 0]
                total = rest + along[:, m]
        return codes

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(len(self.centres))[None], codes].reshape(len(codes), -1)[:, : self.dim]

    def refit(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Centres that minimise the loss for given codes, pair after pair: a small linear system for each centre."""
        pairs = self._pairs(x).astype(np.float64)
        pull = (self.eta - 1) / np.maximum((x.astype(np.float64) ** 2).sum(1), 1e-30)
        made = self.centres[np.arange(len(self.centres))[None], codes]
        along = ((pairs - made) * pairs).sum(2)
        total = along.sum(1)
        for m in range(len(self.centres)):
            p, own = pairs[:, m], codes[:, m]
            rest = total - along[:, m]
            full = lambda w: np.bincount(own, w, CENTRES)  # noqa: B023, E731
            a, b, d = full(1 + pull * p[:, 0] ** 2), full(pull * p[:, 0] * p[:, 1]), full(1 + pull * p[:, 1] ** 2)
            want = 1 + pull * (rest + (p**2).sum(1))
            s, t = full(p[:, 0] * want), full(p[:, 1] * want)
            det = a * d - b * b
            used = det > 0
            new = np.stack([d * s - b * t, a * t - b * s], 1)[used] / det[used, None]
            self.centres[m][used] = new.astype(np.float32)
            along[:, m] = ((p - self.centres[m][own]) * p).sum(1)
            total = rest + along[:, m]

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Partial products (queries, pairs, 16)."""
        return np.einsum("qmd,mcd->qmc", self._pairs(queries), self.centres)


def train(sample: np.ndarray, rounds: int = TRAIN_ROUNDS) -> Quantiser:
    dim = sample.shape[1]
    n = -(-dim // PAIR)
    first = np.random.default_rng(11).choice(len(sample), CENTRES, replace=len(sample) < CENTRES)
    quantiser = Quantiser(np.zeros((n, CENTRES, PAIR), np.float32), dim, weight(dim))
    quantiser.centres = quantiser._pairs(sample[first]).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        quantiser.refit(sample, quantiser.encode(sample))
    return quantiser


def pack_codes(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, the even pair in the low half."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
    return codes[:, 0::2] | codes[:, 1::2] << 4


def byte_tables(tables: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables by the byte of two neighbouring codes (bytes, 256, queries), with base and scale of each query.

    The entries of a query are quantised to 0..255 on one scale: base + scale * their sum is the partial products' sum.
    """
    if tables.shape[1] % 2:
        tables = np.concatenate([tables, np.zeros_like(tables[:, :1])], 1)
    least = tables.min(2)
    scale = np.maximum((tables.max(2) - least).max(1) / 255, 1e-30)
    small = np.rint((tables - least[:, :, None]) / scale[:, None, None]).astype(np.uint16 if tables.shape[1] < 257 else np.uint32)
    low, high = small[:, 0::2], small[:, 1::2]
    both = (high[:, :, :, None] + low[:, :, None, :]).reshape(*low.shape[:2], 256)
    return np.ascontiguousarray(both.transpose(1, 2, 0)), least.sum(1), scale


def scan_codes(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of table entries (queries, codes) for codes (bytes, codes): every lookup serves all queries."""
    n, queries = codes.shape[1], tables.shape[2]
    out = np.empty((queries, n), tables.dtype)
    part = np.empty((CODES_AT_ONCE, queries), tables.dtype)
    for i in range(0, n, CODES_AT_ONCE):
        own = codes[:, i : i + CODES_AT_ONCE]
        total, held = tables[0][own[0]], part[: own.shape[1]]
        for m in range(1, len(codes)):
            np.take(tables[m], own[m], axis=0, out=held, mode="clip")
            total += held
        out[:, i : i + CODES_AT_ONCE] = total.T
    return out


def exact(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first number to the last."""
    return np.cumsum(rows * query, axis=1)[:, -1] if len(rows) else np.zeros(0)


def vectors(frame: DataFrame, dim: int | None = None) -> tuple[DataFrame, int]:
    """(vec_id, v as doubles) of the rows that take part, and the dimension: the most frequent one if none is given.

    Null or empty vectors, zero vectors, those with null or non-finite numbers, those of another dimension and null ids
    take no part.
    """
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = frame.select(F.col("vec_id").cast("bigint"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)
    )
    if dim is None:
        common = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = common[0] if common else 1
    return good.where(F.size("v") == dim), dim


def _save(uri: str, **arrays: np.ndarray) -> None:
    held = io.BytesIO()
    np.savez(held, **arrays)
    write_bytes(uri, [held.getbuffer()])


def _load(uri: str) -> dict[str, np.ndarray]:
    with open_file(uri) as f, np.load(io.BytesIO(f.read())) as held:
        return dict(held)


def _starts(groups: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(groups, minlength=n))])


def tile_of(ids: np.ndarray, rows: np.ndarray, quantiser: Quantiser) -> dict[str, np.ndarray]:
    """Distinct vectors with their ids, ascending, under their distinct codes; and the longest residual of each code."""
    distinct, same = np.unique(rows, axis=0, return_inverse=True)
    packed = pack_codes(quantiser.encode(distinct))
    codes, of = np.unique(packed, axis=0, return_inverse=True)
    nibbles = np.stack([packed & 15, packed >> 4], 2).reshape(len(packed), -1)[:, : len(quantiser.centres)]
    residual = np.sqrt(((distinct - quantiser.decode(nibbles)) ** 2).sum(1))
    by_code = np.argsort(of.ravel(), kind="stable")
    place = np.empty(len(distinct), np.int64)
    place[by_code] = np.arange(len(distinct))
    pairs = np.stack([place[same.ravel()], ids])
    pairs = pairs[:, np.lexsort((ids, pairs[0]))]  # by vector, then id
    longest = np.zeros(len(codes))
    np.maximum.at(longest, of.ravel(), residual)
    single = distinct.astype(np.float32)
    vecs = (single if (single == distinct).all() else distinct)[by_code]
    return {
        "vecs": vecs, "ids": pairs[1], "id_at": _starts(pairs[0], len(distinct)), "codes": np.ascontiguousarray(codes.T),
        "code_at": _starts(of.ravel(), len(codes)), "residual": longest.astype(np.float32),
    }


class Index(NamedTuple):
    """rows: vec_id and v of the vectors that take part; tiles: uri and n of the files that hold them with their codes."""

    rows: DataFrame
    tiles: DataFrame
    quantiser: Quantiser


def _in_tiles(rows: DataFrame, folder: str, most: int, make) -> DataFrame:
    """Write the rows (vec_id, v) of each task in tiles of at most so many, as make(ids, vectors) gives them: uri and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = np.concatenate([b.column("vec_id").to_numpy() for b in held])
            v = np.concatenate([b.column("v").flatten().to_numpy() for b in held]).reshape(len(ids), -1)
            uri = f"{folder}/{uuid.uuid4().hex}"  # of this attempt: only tiles of finished tasks are listed
            _save(uri, **make(ids, v))
            return pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([len(ids)], pa.int64())], names=["uri", "n"])

        for batch in batches:
            for i in range(0, batch.num_rows, most):
                part = batch.slice(i, most)
                if size + part.num_rows > most:
                    yield flush()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if held:
            yield flush()

    return staged(rows.select("vec_id", "v").mapInArrow(run, "uri string, n bigint"), "vector-tiles")


def build_index(frame: DataFrame) -> Index:
    """Every vector that takes part with its codes, in tiles.

    The quantiser is trained on at most SAMPLE rows, drawn by a hash of vec_id; every row is encoded, where it is read.
    """
    rows, dim = vectors(frame)
    drawn = hash_sample(rows, ["vec_id"], SAMPLE).collect()
    quantiser = train(np.array([r.v for r in drawn]) if drawn else np.zeros((1, dim)))
    shared = frame.sparkSession.sparkContext.broadcast(quantiser)
    folder = fresh_path(frame.sparkSession, "vectors")
    return Index(rows, _in_tiles(rows, folder, ROW_BLOCK, lambda ids, v: tile_of(ids, v, shared.value)), quantiser)


def _spread(begin: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The members of some groups, given where each group begins."""
    n = begin[which + 1] - begin[which]
    return np.arange(int(n.sum())) + np.repeat(begin[which] - (np.cumsum(n) - n), n)


class Nearest:
    """The k best rows so far of each query of a tile."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, quantiser: Quantiser, k: int, depth: int):
        self.ids, self.queries, self.quantiser, self.k, self.depth = ids, queries, quantiser, k, depth
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)  # scores, ids
        self.norms = np.sqrt((queries**2).sum(1))

    def add(self, tile: dict[str, np.ndarray]) -> None:
        codes = tile["codes"].astype(np.intp)
        slack = tile["residual"] * np.float32(DEVIATIONS / np.sqrt(self.quantiser.dim))
        rounding = DEVIATIONS * np.sqrt(len(self.quantiser.centres) / 12)
        vector_of = np.repeat(np.arange(len(tile["vecs"])), np.diff(tile["id_at"]))
        order = np.argsort(tile["ids"], kind="stable")
        first, last = (np.searchsorted(tile["ids"][order], self.ids, side) for side in ("left", "right"))
        for i in range(0, len(self.ids), QUERIES_AT_ONCE):
            tables, base, scale = byte_tables(self.quantiser.tables(self.queries[i : i + QUERIES_AT_ONCE]))
            for q, sums in enumerate(scan_codes(tables, codes), i):
                # rows of the query's own id are no candidates: how many of them each vector has
                own = dict(zip(*(x.tolist() for x in np.unique(vector_of[order[first[q] : last[q]]], return_counts=True)), strict=True))
                some = slack * np.float32(self.norms[q] / scale[q - i])
                some += sums
                least = self._kth(q, tile, sums, own)
                self._merge(q, tile, np.flatnonzero(some >= (least - base[q - i]) / scale[q - i] - rounding), own)

    @staticmethod
    def _others(tile: dict[str, np.ndarray], rows: np.ndarray, own: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Of some vectors those that have an id besides the query's own, and how often each has that."""
        if not own:
            return rows, np.zeros(len(rows), np.int64)
        n = np.array([own.get(r, 0) for r in rows.tolist()], np.int64)
        good = tile["id_at"][rows + 1] - tile["id_at"][rows] > n
        return rows[good], n[good]

    def _kth(self, q: int, tile: dict[str, np.ndarray], sums: np.ndarray, own: dict[int, int]) -> float:
        """The exact k-th score so far; of a first tile that of the depth codes of the largest sums."""
        scores, _ = self.best[q]
        if len(scores) == self.k:
            return float(scores[-1])
        top = np.argpartition(sums, len(sums) - self.depth)[len(sums) - self.depth :] if len(sums) > self.depth else np.arange(len(sums))
        rows, _ = self._others(tile, _spread(tile["code_at"], top), own)
        found = exact(self.queries[q], tile["vecs"][rows].astype(np.float64))
        return float(np.partition(found, len(found) - self.k)[len(found) - self.k]) if len(found) >= self.k else -np.inf

    def _merge(self, q: int, tile: dict[str, np.ndarray], which: np.ndarray, own: dict[int, int]) -> None:
        rows, n_own = self._others(tile, _spread(tile["code_at"], which), own)
        found = exact(self.queries[q], tile["vecs"][rows].astype(np.float64))
        if len(found) > self.k:
            good = found >= np.partition(found, len(found) - self.k)[len(found) - self.k]
            rows, n_own, found = rows[good], n_own[good], found[good]
        # besides the own ones a vector's k smallest ids are all that can be among the k best
        ends = np.minimum(tile["id_at"][rows + 1], tile["id_at"][rows] + self.k + n_own)
        n = ends - tile["id_at"][rows]
        at = np.arange(int(n.sum())) + np.repeat(ends - np.cumsum(n), n)
        scores, ids = np.concatenate([self.best[q][0], np.repeat(found, n)]), np.concatenate([self.best[q][1], tile["ids"][at]])
        other = ids != self.ids[q]
        scores, ids = scores[other], ids[other]
        best = np.lexsort((ids, -scores))[: self.k]
        self.best[q] = scores[best], ids[best]


def search(index: Index, queries: DataFrame, k: int = 20, depth: int = DEPTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query but itself, ties to the smaller vec_id.

    queries: vec_id, v as in the index. Rows of the query's own id, whatever their vectors, are no candidates; of several vectors
    under one query id the smallest asks. All other rows count one by one, repeated ones and several vectors of an id too.
    """
    spark = index.tiles.sparkSession
    queries = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    folder = fresh_path(spark, "queries")
    parts = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = _in_tiles(queries.repartitionByRange(parts, "vec_id"), folder, QUERY_BLOCK, lambda ids, v: {"ids": ids, "queries": v})
    tiles = index.tiles.withColumn("g", F.floor((F.row_number().over(Window.orderBy("uri")) - 1) / GROUP))  # a row for each tile
    groups = tiles.groupBy("g").agg(F.array_sort(F.collect_list("uri")).alias("tiles"))
    n = -(-index.tiles.count() // GROUP)
    units = asked.select("uri", F.explode(F.expr(f"sequence(0L, {max(0, n - 1)}L)")).alias("g")).join(groups, "g")
    shared = spark.sparkContext.broadcast(index.quantiser)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, tiles in zip(batch.column("uri").to_pylist(), batch.column("tiles").to_pylist(), strict=True):
                own = _load(uri)
                nearest = Nearest(own["ids"], own["queries"], shared.value, k, depth)
                for tile in tiles:
                    nearest.add(_load(tile))
                found = nearest.best
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own["ids"], [len(s) for s, _ in found])), pa.array(np.concatenate([v for _, v in found])), pa.array(np.concatenate([s for s, _ in found]))],
                    names=["query_id", "vec_id", "score"],
                )

    found = file_by_file(units, 20_000, ["uri", "g"]).select("uri", "tiles").mapInArrow(scan, "query_id bigint, vec_id bigint, score double")
    one = F.struct((-F.col("score")).alias("less"), "vec_id")
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, k).alias("best"))  # k rows a group of tiles
    each = best.select("query_id", F.posexplode("best").alias("n", "b"))
    return each.select("query_id", (F.col("n") + 1).cast("int").alias("rank"), "b.vec_id", (-F.col("b.less")).alias("score"))
