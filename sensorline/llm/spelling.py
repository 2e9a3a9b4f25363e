"""Spelling variants: near words of a vocabulary by wildcard groups, without a row for each pair of words.

Two words are near if they differ by one inserted, deleted or replaced code point. A word of L code points stands in L wildcard
groups (position, what is before it, what is after it). Words of one group differ in that position alone, so a group's size and
its two best words tell each member how many near words it has there and which is the best. Without the position, what is
before and after is the word with one code point deleted: it meets the vocabulary, and tells that word how many longer ones it has.
A group holds at most as many words as there are letters, so none is hot.

Words are known by rank: the smaller, the more frequent, then the earlier in code-point order. Groups carry ranks, not words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, split_join, staged

OUTSIDE = "[^a-zÀ-ÿ]+"
MODULUS, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Longer words are grouped by hashes of what is left of them: their deletions would have a length squared.
LONGEST = 64
PRIME, BASE = (1 << 127) - 1, 0x9E3779B97F4A7C15F39CC0605CEDC835
#: Rows of a batch of expansions.
ROWS = 50_000
#: A form with so many words is joined apart.
HUB = 100_000


def occurrences(docs: DataFrame, modulus: int = MODULUS) -> DataFrame:
    """(word): the runs of letters of whole texts, A-Z lower-cased; a null text has none.

    Where ``modulus`` divides the crc32 h of "doc_id:run", the run loses its code point h % length. A null doc_id is written as nothing.
    """
    runs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.explode(F.split(ascii_lower(F.col("text").cast("string")), OUTSIDE)).alias("run")).where("run <> ''")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    rows = runs.select("run", h.alias("h")).withColumn("at", (F.col("h") % F.char_length("run")).cast("int"))
    cut = F.concat(F.col("run").substr(F.lit(1), F.col("at")), F.col("run").substr(F.col("at") + 2, F.char_length("run")))
    return rows.select(F.when(F.col("h") % modulus == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(rank, word, n): the distinct words (column word) long and frequent enough, by n downwards, then by word."""
    counted = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)
    return staged(counted.orderBy(F.desc("n"), "word").select(F.monotonically_increasing_id().alias("rank"), "word", "n"), "vocabulary")


def _hashed(value: int, length: int) -> str:
    return f"#{value:032x}:{length}"


def keys(word: str, longest: int = LONGEST) -> Iterator[tuple[int, str, bool]]:
    """(-1, key of the word), then for each code point i (i, key of the word without it, whether no earlier i leaves the same).

    The key of a string of up to ``longest`` code points is itself, of a longer one its length and a hash of 127 bits.
    """
    n = len(word)
    once = [i == 0 or word[i] != word[i - 1] for i in range(n)]
    if n <= longest:
        yield -1, word, True
        for i in range(n):
            yield i, word[:i] + word[i + 1 :], once[i]
        return
    points = list(map(ord, word))
    after, power = [0] * (n + 1), [1] * (n + 1)  # hashes of what follows i
    for i in range(n - 1, -1, -1):
        after[i] = (points[i] * power[n - 1 - i] + after[i + 1]) % PRIME
        power[n - i] = power[n - 1 - i] * BASE % PRIME
    yield -1, _hashed(after[0], n), True
    before = 0
    for i in range(n):
        yield i, word[:i] + word[i + 1 :] if n - 1 <= longest else _hashed((before * power[n - 1 - i] + after[i + 1]) % PRIME, n - 1), once[i]
        before = (before * BASE + points[i]) % PRIME


def _expanded(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), (pa.int64(), pa.int32(), pa.string(), pa.bool_()), strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["rank", "at", "key", "once"])

        for part in batches:
            for rank, word in zip(part.column("rank").to_pylist(), part.column("word").to_pylist(), strict=True):
                for place in keys(word, longest):
                    held.append((rank, *place))
                    if len(held) >= ROWS:
                        yield batch()
        if held:
            yield batch()

    return run


def near_words(vocabulary: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(rank, n_near, best): how many near words each word has and the smallest rank of them (null if none).

    One shuffle by what is left of a word serves the wildcard groups and the meeting of deletions with the vocabulary, another
    one brings together what each word was told. Nothing is made for pairs: every row only learns its group's figures.
    """
    places = vocabulary.select("rank", "word").mapInArrow(_expanded(longest), "rank bigint, at int, key string, once boolean").repartition("key")
    key, group = Window.partitionBy("key"), Window.partitionBy("key", "at")
    whole, shorter = F.col("at") < 0, (F.col("at") >= 0) & F.col("once")
    met = places.select(
        "*", F.max(F.when(whole, F.col("rank"))).over(key).alias("word_rank"), F.count_if(shorter).over(key).alias("n_longer"),
        F.min(F.when(shorter, F.col("rank"))).over(key).alias("best_longer"),
    )
    ordered = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = met.select(
        "*", F.count("*").over(ordered).alias("size"), F.nth_value("rank", 1).over(ordered).alias("first"), F.nth_value("rank", 2).over(ordered).alias("second"),
    )
    replaced = F.when(F.col("first") == F.col("rank"), F.col("second")).otherwise(F.col("first"))
    deleted = F.when(F.col("once"), F.col("word_rank"))
    told = met.select(
        "rank",
        F.when(whole, F.col("n_longer")).otherwise(F.col("size") - 1 + deleted.isNotNull().cast("bigint")).alias("near"),
        F.when(whole, F.col("best_longer")).otherwise(F.least(replaced, deleted)).alias("best"),
    )
    return told.groupBy("rank").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def chain_ends(forms: DataFrame, hub: int = HUB) -> DataFrame:
    """(node, root) of (node, up), each node once and no circles: where following up ends. Each round doubles the way followed."""
    at = staged(forms.select("node", "up"), "forms")
    total = at.count()
    while True:
        fan = at.groupBy(F.col("up").alias("key")).agg(F.count("*").alias("n"))
        further = at.select(F.col("node").alias("key"), F.col("up").alias("next")).join(fan, "key")
        moved = staged(split_join(at.withColumnRenamed("up", "key"), further, "key", "n", total, floor=hub).select("node", F.col("next").alias("up")), "forms-further")
        if moved.isEmpty():
            return at.withColumnRenamed("up", "root")
        at = staged(moved.unionByName(at.join(moved.select("node"), "node", "left_anti")), "forms")


def variants(docs: DataFrame, modulus: int = MODULUS, ratio: int = 2, longest: int = LONGEST) -> DataFrame:
    """One row for each word of the vocabulary: word, form, root, n, n_near, form_n.

    form is the near word of largest n (ties: the smallest in code-point order) if that n (form_n) is at least ``ratio`` times the
    word's own, else null; root is where forms lead, the word itself if it has none. n grows along forms, so they end.
    Repeated rows count as often as they stand; no documents or no frequent words: no rows.
    """
    known = vocabulary(occurrences(docs, modulus))
    better = known.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    found = staged(near_words(known, longest), "near-words")
    named = known.join(found, "rank").join(better, "best", "left")
    formed: Column = F.col("form_n") >= ratio * F.col("n")
    named = staged(named.select("rank", "word", "n", "n_near", *[F.when(formed, F.col(c)).alias(c) for c in ("best", "form", "form_n")]), "forms-named")
    ends = chain_ends(named.where("best is not null").select(F.col("rank").alias("node"), F.col("best").alias("up")))
    last = known.select(F.col("rank").alias("root_rank"), F.col("word").alias("root"))
    rooted = named.join(ends.select(F.col("node").alias("rank"), F.col("root").alias("root_rank")), "rank", "left").join(last, "root_rank", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
