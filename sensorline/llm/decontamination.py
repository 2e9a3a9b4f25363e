"""Benchmark decontamination by suffix arrays over the training text.

Each shard (a bounded run of whole documents inside a task) numbers its words by the benchmark's vocabulary, sorts the
suffixes of its text and binary-searches the benchmark's suffixes in that order by their first window. The equal range of a
suffix is every place of its window; from each place that cannot be extended to the left the match is followed to its end,
which gives all longest verbatim matches and where they are. A suffix of the text that holds a word outside the vocabulary
within the shortest window cannot contain a window, so such suffixes stay out of the array; nothing else does.
Documents are never split and never shuffled, so a task's memory is bounded by a shard and the benchmark block.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, chunks_of, filtered, fresh_path, open_file, write_bytes

WINDOW = 10
SHARD_BYTES = 4 << 20
#: Text of a benchmark that is searched for at once. In words of a few letters it takes some 300 MB of a task.
BLOCK_BYTES = 8 << 20
#: Texts that a task keeps while it goes through several blocks.
HELD_BYTES = 64 << 20
#: Pairs of a place and a benchmark suffix that are followed at once.
PAIRS = 1 << 20

MATCH = "array<struct<item_id:string,n_words:bigint,item_word:bigint,doc_word:bigint>>"
OUT = f"doc_id bigint, items array<string>, matches {MATCH}, n_words bigint, n_hit bigint"
KIND = pa.struct([("item_id", pa.string()), ("n_words", pa.int64()), ("item_word", pa.int64()), ("doc_word", pa.int64())])


@dataclass
class Block:
    """Part of a benchmark as word numbers from 1: items end with 0."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    item_of: np.ndarray  # item number of each word
    starts: np.ndarray  # first word of each item
    left: np.ndarray  # words from here to the item's end
    names: list[str | None]
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length: first word of each distinct one, offsets, words


def make_block(rows: list[tuple[str | None, str | None]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    parts: list[np.ndarray] = []
    names: list[str | None] = []
    for name, text in rows:
        own = alnum_words(text)
        if own:
            names.append(name)
            parts.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary) + 1) for w in own), np.int32, len(own)))
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes + 1)
    starts = ends - sizes - 1
    words = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int32)
    for start, part in zip(starts.tolist(), parts, strict=True):
        words[start : start + len(part)] = part
    item_of = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes + 1)
    left = (np.repeat(ends, sizes + 1) - 1 - np.arange(len(item_of))).astype(np.int32)
    own_window = np.minimum(window, sizes)
    windows = {}
    for size in np.unique(own_window).tolist():
        at = np.flatnonzero((own_window[item_of] == size) & (left >= size))
        rows_of = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, size)[at])
        _, first, which = np.unique(rows_of.view(np.dtype((np.void, 4 * size))).ravel(), return_index=True, return_inverse=True)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(which, minlength=len(first)))])
        windows[size] = (at[first], offsets, at[np.argsort(which, kind="stable")])
    return Block(vocabulary, words, item_of, starts, left, names, windows)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text in the order of their suffixes, decided over at least depth words (prefix doubling)."""
    n, reach = len(text), 1
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while n:
        ahead = np.zeros(n, np.int64)
        ahead[: n - reach] = rank[reach:] + 1 if reach < n else 0
        key = rank * (int(rank.max()) + 2) + ahead
        order = np.argsort(key, kind="stable")
        steps = np.concatenate([[0], np.cumsum(np.diff(key[order]) > 0)])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        reach *= 2
        if reach >= depth or steps[-1] == n - 1:
            break
    return order


def common_prefix(text: np.ndarray, at: np.ndarray, query: np.ndarray, begin: np.ndarray, most: np.ndarray):
    """Words in common of suffixes of text and of query, at most so many each; and the sign of text against query."""
    length, sign = np.zeros(len(at), np.int64), np.zeros(len(at), np.int8)
    live = np.flatnonzero(most > 0)
    while len(live):
        k = length[live]
        a, b = text[np.minimum(at[live] + k, len(text) - 1)], query[begin[live] + k]
        same = a == b
        sign[live[~same]] = np.where(a[~same] < b[~same], -1, 1)
        live = live[same]
        length[live] += 1
        live = live[length[live] < most[live]]
    return length, sign


def first_place(text, order, query, begin, most, after: bool) -> np.ndarray:
    """Binary search: the number of suffixes before (or, with after, not after) each query prefix."""
    low, high = np.zeros(len(begin), np.int64), np.full(len(begin), len(order), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        _, sign = common_prefix(text, order[mid], query, begin[open_], most[open_])
        right = sign <= 0 if after else sign < 0
        low[open_[right]] = mid[right] + 1
        high[open_[~right]] = mid[~right]
    return low


def _repeated(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... n[i] numbers of each i in a row."""
    return np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)


def _pieces(n: np.ndarray) -> Iterator[slice]:
    """Slices of an array of counts, each of about PAIRS in sum (a larger single count comes alone)."""
    ends, begin = np.cumsum(n), 0
    while begin < len(n):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PAIRS, "right")))
        yield slice(begin, end)
        begin = end


def scan_shard(texts: list[str | None], block: Block, shortest: int):
    """For each text: its word count, a mask of hit words, and (item, words, item word, word) of the longest match of each
    of its items, ties to the smaller item word, then word."""
    number, counts, parts = block.vocabulary.get, [], []
    for text in texts:
        words = alnum_words(text)
        counts.append(len(words))
        parts.append(np.fromiter((number(w, 0) for w in words), np.int32, len(words)))
        parts.append(np.zeros(1, np.int32))
    ids = np.concatenate(parts) if parts else np.zeros(1, np.int32)
    bounds = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    hit = np.zeros(len(ids) + 1, np.int64)
    best: list[np.ndarray] = []

    edges = np.flatnonzero(np.diff(np.concatenate([[0], (ids > 0).astype(np.int8), [0]])))
    runs = edges.reshape(-1, 2)
    runs = runs[runs[:, 1] - runs[:, 0] >= shortest]
    if len(runs) and block.windows:
        sizes = runs[:, 1] - runs[:, 0] + 1  # with the 0 that ends a run
        ends = np.cumsum(sizes)
        origin = np.arange(ends[-1]) + np.repeat(runs[:, 0] - (ends - sizes), sizes)
        text = ids[origin]
        text[ends - 1] = 0
        order = suffix_array(text, max(block.windows))
        order = order[text[order] > 0]
        for size, (first, offsets, words_of) in block.windows.items():
            most = np.full(len(first), size)
            low = first_place(text, order, block.words, first, most, False)
            n = first_place(text, order, block.words, first, most, True) - low
            found = np.flatnonzero(n)
            which = np.repeat(found, n[found])
            place = order[_repeated(low[found], n[found])]
            at = origin[place]
            hit += np.bincount(at, minlength=len(hit)) - np.bincount(at + size, minlength=len(hit))
            owners = np.diff(offsets)[which]
            for some in _pieces(owners):
                own = owners[some]
                t, w = np.repeat(place[some], own), words_of[_repeated(offsets[:-1][which[some]], own)]
                before = np.where(w > 0, block.words[w - 1], 0)  # a match that goes on to the left is followed from there
                new = (before == 0) | (np.where(t > 0, text[t - 1], 0) != before)
                t, w = t[new], w[new]
                length, _ = common_prefix(text, t, block.words, w, block.left[w])
                a, item = origin[t], block.item_of[w]
                doc = np.searchsorted(bounds, a, "right") - 1
                best.append(_longest(np.stack([doc, item, length, w - block.starts[item], a - bounds[doc]])))
    rows = _longest(np.concatenate(best, 1)) if best else np.zeros((5, 0), np.int64)
    cut = np.searchsorted(rows[0], np.arange(len(texts) + 1))
    mask = np.cumsum(hit)[: len(ids)] > 0
    return [(counts[d], mask[bounds[d] : bounds[d] + counts[d]], rows[1:, cut[d] : cut[d + 1]].T.tolist()) for d in range(len(texts))]


def _longest(rows: np.ndarray) -> np.ndarray:
    """Of rows (document, item, words, item word, word) the longest of each document and item, in their order."""
    rows = rows[:, np.lexsort((rows[4], rows[3], -rows[2], rows[1], rows[0]))]
    return rows[:, np.concatenate([[True], (np.diff(rows[:2]) != 0).any(0)])] if rows.shape[1] else rows


def _rank(match: dict) -> tuple:
    return (-match["n_words"], match["item_id"] is None, match["item_id"] or "", match["item_word"], match["doc_word"])


@lru_cache(maxsize=1)
def _block(uri: str | None, window: int) -> Block:
    """A block from its file, kept until another one is asked for; without a file the empty one."""
    if uri is None:
        return make_block([], window)
    with open_file(uri) as f:
        return pickle.loads(f.read())


def _block_files(benchmark: DataFrame, window: int, block_bytes: int) -> list[str | None]:
    """Files of the parts of a benchmark, each of about block_bytes of text, made once and by tasks.

    Repeated rows count once, and a hash of the row deals them, so only a single text longer than that makes a larger part. The
    driver gets the names of the files.
    """
    folder = fresh_path(benchmark.sparkSession, "benchmark-blocks")
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string")).where("text is not null").distinct()
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def write(table: pa.Table) -> pa.Table:
        rows = table.select(["item_id", "text"]).to_pylist()
        block = make_block(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r)), window)
        uri = f"{folder}/{table.column('part')[0].as_py()}"
        write_bytes(uri, [pickle.dumps(block, protocol=5)])
        return pa.table({"uri": [uri]})

    dealt = named.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    return sorted(r.uri for r in dealt.groupBy("part").applyInArrow(write, "uri string").collect()) or [None]


def _shards(sizes: list[int]) -> Iterator[list[int]]:
    """Places of texts in turn, in runs of about SHARD_BYTES."""
    held: list[int] = []
    total = 0
    for i, size in enumerate(sizes):
        if held and total + size > SHARD_BYTES:
            yield held
            held, total = [], 0
        held.append(i)
        total += size
    if held:
        yield held


def _sizes(texts: list[str | None]) -> list[int]:
    return [len(t or "") for t in texts]


def _scanner(uris: list[str | None], window: int):
    """Goes through the blocks for some texts at a time; a block is read again only for the next HELD_BYTES of text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, "text", HELD_BYTES if len(uris) > 1 else SHARD_BYTES):
            texts = batch.column("text").to_pylist()
            masks: list[np.ndarray | None] = [None] * len(texts)
            told: list[list[dict]] = [[] for _ in texts]
            for uri in uris:
                own = _block(uri, window)
                for some in _shards(_sizes(texts)):
                    for i, (_, mask, matches) in zip(some, scan_shard([texts[i] for i in some], own, min([window, *own.windows])), strict=True):
                        masks[i] = mask if masks[i] is None else masks[i] | mask
                        told[i] += [{"item_id": own.names[k], "n_words": n, "item_word": q, "doc_word": d} for k, n, q, d in matches]
            items = [sorted({m["item_id"] for m in each} - {None}) for each in told]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(items, pa.list_(pa.string())), pa.array([sorted(each, key=_rank) for each in told], pa.list_(KIND)),
                 pa.array([len(m) for m in masks], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64())],
                names=["doc_id", "items", "matches", "n_words", "n_hit"],
            )

    return scan


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, items (sorted ids), matches, contaminated.

    ``matches`` has the longest verbatim match of each item that has a window in the document: item_id, n_words, item_word
    and doc_word (words from 0), the longest first, ties by item_id, item_word and doc_word. Matches below the item's window
    are not listed; items with a null id, and several texts under one id, are each listed on their own.

    A benchmark above block_bytes of text is written in blocks, and a task goes through them for each HELD_BYTES of its texts: the
    corpus is read once, and no text is written.
    Null texts have no words; items without words have no window; a null item_id counts as a hit but is in no list of items.
    Repeated rows give repeated rows; repeated rows of the benchmark count once. Other columns are ignored.
    """
    uris = _block_files(benchmark, window, block_bytes)
    out = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_scanner(uris, window), OUT)
    return out.select("doc_id", "n_words", "n_hit", "items", "matches", (F.col("n_hit") > 0).alias("contaminated"))


def longest_matches(found: DataFrame) -> DataFrame:
    """For each item its longest verbatim match over all documents: item_id, n_words, item_word, doc_id, doc_word.

    Ties go to the smaller item word, then doc_id, then document word. Items without a window anywhere have no row.
    """
    at = F.struct(-F.col("m.n_words"), "m.item_word", "doc_id", "m.doc_word")
    best = found.select("doc_id", F.explode("matches").alias("m")).groupBy("m.item_id").agg(F.min(at.alias("b")).alias("b"))
    return best.select("item_id", (-F.col("b.col1")).alias("n_words"), "b.item_word", "b.doc_id", "b.doc_word")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents without any benchmark window, with all their columns, decided where they are read: nothing is shuffled.

    Null texts, and texts without words, stay. Each block of a larger benchmark sees what those before it have left.
    """
    uris = _block_files(benchmark, window, block_bytes)

    def decide(texts: list[str | None]) -> list[bool]:
        left = list(range(len(texts)))
        for uri in uris:
            own, kept = _block(uri, window), []
            for some in _shards(_sizes([texts[i] for i in left])):
                places = [left[i] for i in some]
                found = scan_shard([texts[i] for i in places], own, min([window, *own.windows]))
                kept += [i for i, (_, mask, _) in zip(places, found, strict=True) if not mask.any()]
            left = kept
        stays = set(left)
        return [i in stays for i in range(len(texts))]

    return filtered(docs, decide, HELD_BYTES if len(uris) > 1 else SHARD_BYTES)
