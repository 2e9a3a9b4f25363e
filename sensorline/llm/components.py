"""Connected components of an edge table by alternating star contractions, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_join, staged


#: Edges of one node that a task may hold; nodes with more (and a thousandth of all) are joined by broadcast.
HUB = 100_000


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    return split_join(both.where("v > u"), least, "u", "n", most, floor=HUB).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = split_join(down, least, "u", "n", most, floor=HUB).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs to (node, root): the smallest node that each node of an edge reaches.

    Every round is written to the shared folder; the loop ends when a round changes nothing. Only a count and a
    checksum of the edges come to the driver.
    """
    mark = None
    edges = staged(edges.where("u <> v").select("u", "v").distinct(), "edges")
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now[0] == 0 or now == mark:
            break
        mark = now
        most = 2 * now[0]  # neither star makes more rows of its edges
        edges = staged(_small_star(_large_star(edges, most), most), "edges")
    else:
        raise RuntimeError(f"no stable components after {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
