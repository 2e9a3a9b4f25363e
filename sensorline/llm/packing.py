"""Best-fit packing of token sequences by a histogram of lengths.

Documents are encoded and cut once, into a staged table. The driver sees only the histogram (at most one count for each
length up to the limit). It enumerates patterns of few document lengths that fill a sequence, fits how often each is used
by non-negative least squares, rounds down, and packs what is left best-fit. The plan says which ranks of each length go
where; tasks look their pieces up by rank. Ranks come from counts by length and task, so no length meets in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .tokens import encoder

MOST = 4096
#: Bytes of ids that a task hands over at once.
BATCH_BYTES = 4 << 20
#: (coarse units of a sequence, documents of a pattern) that are tried; the plan with the fewest sequences is taken.
GRIDS = ((64, 3), (128, 3), (256, 2))


def patterns(units: int, parts: int) -> np.ndarray:
    """Counts of coarse lengths (columns 1..units) of every way to fill a sequence with at most so many documents."""
    found: list[list[int]] = []

    def extend(chosen: list[int], left: int, least: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < parts:
            for u in range(least, left + 1):
                if u == left or (len(chosen) + 2 <= parts and left - u >= u):
                    extend([*chosen, u], left - u, u)

    extend([], units, 1)
    out = np.zeros((len(found), units + 1))
    for row, chosen in zip(out, found, strict=True):
        np.add.at(row, chosen, 1)
    return out


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that minimises |ax - b|, by growing and shrinking the set of free variables."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    floor = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds):
        pull = a.T @ (b - a @ x)
        pull[free] = -np.inf
        best = int(np.argmax(pull))
        if pull[best] <= floor:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            z = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            low = z <= 0
            if not low.any():
                break
            old = x[at]
            step = float(np.min(old[low] / np.maximum(old[low] - z[low], 1e-300)))
            x[at] = old + step * (z - old)
            drop = at[(x[at] <= 1e-12) & low]
            x[drop], free[drop] = 0, False
        x[:] = 0
        x[at] = z
    return x


def _by_patterns(left: np.ndarray, most: int, units: int, parts: int) -> list[tuple[int, list[int]]]:
    """Sequences (repeats, lengths) of the fitted patterns; takes their pieces from left."""
    unit = most // units
    coarse = np.zeros(units + 1)
    np.add.at(coarse, -(-np.arange(len(left)) // unit), left)
    kinds = patterns(units, parts)
    repeats = np.floor(nonnegative_least_squares(kinds[:, 1:].T, coarse[1:]) + 1e-6).astype(np.int64)
    out = []
    for k in np.flatnonzero(repeats).tolist():
        wanted = np.repeat(np.arange(units + 1), kinds[k].astype(int)).tolist()[::-1]
        n = int(repeats[k])
        while n > 0:
            chosen: dict[int, int] = defaultdict(int)
            lengths = []
            for u in wanted:  # the longest length of the coarse class that is left
                free = [v for v in range(u * unit, (u - 1) * unit, -1) if left[v] > chosen.get(v, 0)]
                if not free:
                    break
                lengths.append(free[0])
                chosen[free[0]] += 1
            if len(lengths) < len(wanted):
                break
            times = min(n, *(int(left[v]) // c for v, c in chosen.items()))
            for v, c in chosen.items():
                left[v] -= c * times
            out.append((times, lengths))
            n -= times
    return out


def _best_fit(left: np.ndarray, most: int, groups: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
    """Put what is left, longest first, where it leaves the least room; open sequences when nothing has room."""
    room: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
    for n, lengths in groups:
        room[most - sum(lengths)].append((n, lengths))
    for v in range(most, 0, -1):
        count = int(left[v])
        while count:
            gap = next((g for g in range(v, most) if room[g]), most)
            each = min(gap // v, count)
            have, lengths = room[gap].pop() if gap < most else (count, [])
            times = min(have, count // each)
            if have > times and gap < most:
                room[gap].append((have - times, lengths))
            room[gap - each * v].append((times, lengths + [v] * each))
            count -= times * each
    return [g for own in room.values() for g in own]


def plan(histogram: dict[int, int], most: int = MOST) -> dict[str, np.ndarray]:
    """Where each rank of each length goes: arrays length, rank (first of a run), sequence (of that rank), offset."""
    counts = np.zeros(most + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    best: list[tuple[int, list[int]]] | None = None
    for units, parts in [g for g in GRIDS if most % g[0] == 0] or [(most, 1)]:
        left = counts.copy()
        groups = _best_fit(left, most, _by_patterns(left, most, units, parts))
        if best is None or sum(n for n, _ in groups) < sum(n for n, _ in best):
            best = groups
    rows, used, sequence = [], defaultdict(int), 0
    for n, lengths in best or []:
        offset = 0
        for v in lengths:
            rows.append((v, used[v], sequence, offset))
            used[v] += n
            offset += v
        sequence += n
    rows.sort()
    return dict(zip(("length", "rank", "sequence", "offset"), np.array(rows, np.int64).reshape(-1, 4).T, strict=True))


def pieces(docs: DataFrame, tokenizer: str, end_id: int, most: int = MOST, with_ids: bool = True) -> DataFrame:
    """Encoded pieces, staged: doc_id, piece, start, length, ids_crc32, part, nth of that length there and, with_ids, the
    ids (little-endian uint32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(tokenizer), TaskContext.get().partitionId(), [0] * (most + 1)
        kinds = KINDS | ({"ids": pa.binary()} if with_ids else {})

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.values(), strict=True)], names=list(kinds))

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(enc.encode(text.as_py()), np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), most)):
                    own = ids[start : start + most].tobytes()
                    length = len(own) // 4
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), part, seen[length], *[own] * with_ids))
                    seen[length] += 1
                    size += 4 * length
                if len(rows) >= 2_000 or size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    shape = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part bigint, nth bigint" + ", ids binary" * with_ids
    return staged(docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, shape), "pieces")


KINDS = {
    "doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64(),
    "part": pa.int64(), "nth": pa.int64(),
}


def pack(docs: DataFrame, tokenizer: str, end_id: int, most: int = MOST, with_ids: bool = True) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with_ids, its ids.

    Each document is its ids and end_id; only longer ones than most are cut. A null text is empty and so has one id.
    Repeated rows and null doc_ids are packed like others; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer, end_id, most, with_ids)
    counts = staged(cut.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    places = plan(dict(counts.groupBy("length").agg(F.sum("n")).collect()), most)  # at most one row for each length
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    before = before.hint("merge")  # it grows with the tasks: never broadcast
    shown = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    ranked = cut.select(*shown, "part", "nth").join(before, ["length", "part"])
    ranked = ranked.select(*shown, (F.col("before") + F.col("nth")).alias("rank"))
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(_runs(spark, places)), "length").withColumn("run", run)  # at most a row for each length
    return placed.select(*shown, (F.col("run.sequence") + F.col("rank") - F.col("run.rank")).alias("sequence_id"), F.col("run.offset").alias("offset"))


def _runs(spark, places: dict[str, np.ndarray]) -> DataFrame:
    """length and its runs of ranks in order: rank (first), sequence (of that rank), offset. Their number is bounded by
    lengths and patterns, not by documents."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for length, rank, sequence, offset in zip(*(places[c].tolist() for c in ("length", "rank", "sequence", "offset")), strict=True):
        runs[length].append((rank, sequence, offset))
    return spark.createDataFrame(sorted(runs.items()), "length bigint, runs array<struct<rank:bigint,sequence:bigint,offset:bigint>>")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, its ids in order, and the doc_ids and offsets that mark document borders."""
    one = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(one.alias("p")).select(
        "sequence_id", F.expr("aggregate(p, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"], x["piece"], x["offset"])).alias("documents"),
    )
