"""Comparison of tables by key and of datasets by stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .stats import difference_stats, find_column
from .windows import finite

KEYS = ("frame_index", "frame_id", "index", "timestamp", "ts")
SAME_SPAN_S = 0.5


def pick_key(a: DataFrame, b: DataFrame) -> str | None:
    """The first usual key that both tables have under the same name."""
    return next((c for k in KEYS if (c := find_column(a.columns, (k,))) and c in b.columns), None)


def key_conflicts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on both sides with different numbers of rows: pairing them row by row would be a guess."""
    na, nb = (t.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(n)) for t, n in ((a, "n_a"), (b, "n_b")))
    return na.join(nb, key).where("n_a <> n_b")


def join_by_key(
    a: DataFrame, b: DataFrame, key: str, columns_a: list[str], columns_b: list[str], order_a: str | list[str] | None = None, order_b: str | list[str] | None = None, check: bool = True
) -> DataFrame:
    """Inner join with columns named _a and _b. The k-th row of a key meets the k-th of the other side, by the order columns.

    Rows that are equal in the order columns go by the compared columns of their own side, so that the result is always the same;
    to keep values of one row together, name as many order columns as tell the rows apart. Null keys meet nothing. With check, keys whose numbers of rows differ are an error (one small aggregate). Unique keys
    (no order columns given) need no window.
    """
    if check and (clash := key_conflicts(a, b, key).limit(1).collect()):
        raise ValueError(f"{key} = {clash[0][0]} has {clash[0][1]} rows on one side and {clash[0][2]} on the other")
    def side(t: DataFrame, columns: list[str], order: str | list[str] | None, mark: str) -> DataFrame:
        by = [order] if isinstance(order, str) else order
        nth = F.row_number().over(Window.partitionBy(key).orderBy(*by, *[c for c in columns if c not in by])) if by else F.lit(1)
        return t.where(F.col(key).isNotNull()).select(key, nth.alias("_nth"), *[F.col(c).alias(f"{c}_{mark}") for c in columns])

    return side(a, columns_a, order_a, "a").join(side(b, columns_b, order_b, "b"), [key, "_nth"]).drop("_nth")


def compare_columns(joined: DataFrame, columns_a: list[str], columns_b: list[str], op: str = "diff") -> DataFrame:
    """The joined rows with value: difference or ratio of the first columns, or the distance over all of them."""
    a, b = [finite(f"{c}_a") for c in columns_a], [finite(f"{c}_b") for c in columns_b]
    if op == "diff":
        value = a[0] - b[0]
    elif op == "ratio":
        value = F.try_divide(a[0], b[0])
    elif op == "distance":
        value = F.sqrt(sum((F.pow(x - y, 2) for x, y in zip(a, b, strict=True)), F.lit(0.0)))
    else:
        raise ValueError(f"unknown comparison {op!r}")
    return joined.withColumn("value", value)


def compare_tables(a: DataFrame, b: DataFrame, key: str, columns_a: list[str], columns_b: list[str], op: str = "diff", settings: Settings = DEFAULTS, **how) -> DataFrame:
    """Statistics of the comparison and how many keys only one side has."""
    stats = difference_stats(compare_columns(join_by_key(a, b, key, columns_a, columns_b, **how), columns_a, columns_b, op), "value", settings)
    only = [x.join(y.select(key), key, "left_anti").where(F.col(key).isNotNull()).agg(F.count_distinct(key).alias(n)) for x, y, n in ((a, b, "keys_only_a"), (b, a, "keys_only_b"))]
    return stats.join(F.broadcast(only[0])).join(F.broadcast(only[1]))  # one row each


def compare_datasets(a: DataFrame, b: DataFrame, name: str = "stream") -> DataFrame:
    """Streams of two datasets (name, n, span_s, rate_hz): matched, only_a or only_b; same_n exact, same_span within 0.5 s."""
    def side(t: DataFrame, mark: str) -> DataFrame:
        return t.select(name, *[F.col(c).alias(f"{c}_{mark}") for c in ("n", "span_s", "rate_hz")], F.lit(True).alias(f"in_{mark}"))

    both = side(a, "a").join(side(b, "b"), name, "full_outer")
    state = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").otherwise("matched")
    return both.select(
        name, state.alias("state"), "n_a", "n_b", "span_s_a", "span_s_b", "rate_hz_a", "rate_hz_b",
        (F.col("n_a") == F.col("n_b")).alias("same_n"), (F.abs(F.col("span_s_a") - F.col("span_s_b")) < SAME_SPAN_S).alias("same_span"),
    )
