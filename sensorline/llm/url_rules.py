"""URL rules by a sort-merge range join.

The labels of a host in reverse order, each followed by a dot, make a key under which a host and all its subdomains are
one interval: the keys that begin with the host's own. Rules and pages are sorted by key, and one sweep keeps a stack of
the nested intervals that cover the current page; among their rules those whose path begins the page's path compete.

Pages are dealt to tasks by ranges of the key (bounds from a sample); a host with more than a range of its own is spread
over all of its ranges. A rule goes to every range that its interval meets.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, hash_sample

#: Rows of a range: so many at least before there are as many ranges as shuffle partitions, and at most on average.
LEAST_ROWS, MOST_ROWS = 2_000, 200_000
SAMPLE_PER_RANGE = 40


def host_path(url: str = "url") -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for a null or one without ://."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _after(key: str) -> str:
    """The end of the interval of keys that begin with a key."""
    return key + "\U0010ffff"


class Sweep:
    """The stack of active rules. Entries: key, path lengths (longest first), rules by path."""

    def __init__(self):
        self.stack: list[tuple[str, list[int], dict[str, tuple[str, str]]]] = []

    def move(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def add(self, key: str, path: str, name: str, verdict: str) -> None:
        self.move(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, [], {}))
        _, sizes, rules = self.stack[-1]
        if path not in rules or verdict == "block":
            rules[path] = (name, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str, str] | None:
        self.move(key)
        best, length = None, -1
        for own, sizes, rules in reversed(self.stack):
            for size in takewhile(lambda n, own=own: n + len(own) > length, sizes):
                if size <= len(path) and (hit := rules.get(path[:size])):
                    best, length = hit, size + len(own)
                    break
        return best


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep, part = Sweep(), None
    for batch in batches:
        columns = batch.to_pydict()
        out = []
        names = ("part", "key", "is_page", "page_id", "host", "path", "name", "verdict")
        for now, key, is_page, page_id, host, path, name, verdict in zip(*(columns[c] for c in names), strict=True):
            if now != part:
                sweep, part = Sweep(), now
            if not is_page:
                sweep.add(key, path, name, verdict)
            else:
                hit = sweep.judge(key, path) if key else None
                out.append((page_id, host, path, *(hit or (None, None))))
        if out:
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["page_id", "host", "path", "rule", "verdict"])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path, or null) and verdict of every page.

    rules: host, path, verdict. A rule fits its host and all subdomains where the page's path begins with its own; the
    longest host and path together wins, of equals the longer host, of one rule with both verdicts block. Where none fits
    the verdict is the default. Rules with a null column are ignored; null urls have an empty host and path, which no
    rule fits. Repeated rows stay.
    """
    spark = pages.sparkSession
    host, path = host_path()
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string")).select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host")))
    if not ranges:
        n = rows.count()
        ranges = max(1, min(n // LEAST_ROWS, int(spark.conf.get("spark.sql.shuffle.partitions"))), n // MOST_ROWS)
    drawn = hash_sample(rows, ["page_id", "path", "key"], ranges * SAMPLE_PER_RANGE).select("key")
    keys = sorted(r[0] for r in drawn.collect())
    bounds = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []

    @F.pandas_udf("int")
    def part_of(key, salt):
        import pandas as pd

        out = []
        for k, s in zip(key, salt, strict=True):
            low, high = bisect_left(bounds, k), bisect_right(bounds, k)
            out.append(low + s % (high - low + 1))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def parts_of(key):
        import pandas as pd

        return pd.Series([list(range(bisect_left(bounds, k), bisect_right(bounds, _after(k)) + 1)) for k in key])

    salt = F.pmod(F.xxhash64("page_id", "path"), F.lit(1 << 30))
    dealt = rows.select(
        part_of("key", salt).alias("part"), "key", F.lit(True).alias("is_page"), "page_id", "host", "path",
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("verdict"),
    )
    own = rules.select(ascii_lower(F.col("host")).alias("host"), F.col("path"), F.col("verdict")).dropna().where("host <> ''")
    own = own.select(host_key(F.col("host")).alias("key"), "host", "path", F.concat("host", "path").alias("name"), "verdict")
    own = own.select(
        F.explode(parts_of("key")).alias("part"), "key", F.lit(False).alias("is_page"), F.lit(None).cast("bigint").alias("page_id"),
        "host", "path", "name", "verdict",
    )
    merged = dealt.unionByName(own).repartitionById(ranges, "part").sortWithinPartitions("part", "key", "is_page")
    found = merged.mapInArrow(_sweep, "page_id bigint, host string, path string, rule string, verdict string")
    return found.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
