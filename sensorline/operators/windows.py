"""Ordered-row helpers: neighbours across buckets, runs, running sums, fills, nearest rows, exact quantiles.

A plain window puts all rows of a key into one task. Tables of more than PIECE_ROWS rows are therefore dealt by pieces of
their order column, of about equal counts, and only an edge row or a sum of each piece is carried to the next, so one long stream
spreads over many tasks. What is carried comes as a row of its own before or after the piece's rows, so rows move once. Smaller
tables, and those of which no key has many rows, take the plain window. Results are the same either way. What is known of a table's extent
is handed on, since none of these helpers adds rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import bad, epoch_ns, finite  # noqa: F401
from ..settings import DEFAULTS, Settings
from ..storage import staged

#: Rows from which on a table is dealt by pieces, and that a piece holds on average; and the most pieces.
PIECE_ROWS, MOST_PIECES = 2_000_000, 65_536
#: A table whose every key has at most this part of PIECE_ROWS rows is dealt by its keys, however long it is.
KEY_PART = 8
#: Bytes that a row of a source takes at least, for tables whose files are so small that nobody need count them.
ROW_BYTES = 4
#: Rows from which on exact quantiles are taken without gathering a group's values.
SPREAD_ROWS = 5_000_000
_MOST_KNOWN = 256
_KNOWN: dict[tuple, object] = {}


class Extent(NamedTuple):
    """About how many rows a table has, and where its pieces begin in a column: this decides how it is dealt, never what comes out."""

    n: int
    splits: tuple[float, ...] = ()
    column: str | None = None

    def of(self, column: str) -> Extent:
        """The same where the column goes by another name."""
        return self._replace(column=column)

    def dealt(self, frame: DataFrame, column: str, name: str) -> DataFrame:
        """Add the piece of each row, which never falls as the column grows: nulls in the first, NaN in the last one."""
        from pyspark.ml.feature import Bucketizer

        x = _number(frame, column)
        spot = frame.withColumn("_spot", F.when(F.isnan(x), float("inf")).otherwise(F.coalesce(x, F.lit(float("-inf")))))
        pieces = Bucketizer(splits=[float("-inf"), *self.splits, float("inf")], inputCol="_spot", outputCol=name)
        return pieces.transform(spot).drop("_spot").withColumn(name, F.col(name).cast("bigint"))


def _number(frame: DataFrame, column: str) -> Column | None:
    """A column as double in its own order, if it is a number or a time."""
    kind = frame.select(column).schema[0].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
        return F.unix_micros(F.col(column).cast("timestamp")).cast("double")
    return F.col(column).cast("double") if isinstance(kind, T.NumericType) else None


def _recall(key: tuple, make):
    if key not in _KNOWN:
        while len(_KNOWN) >= _MOST_KNOWN:
            _KNOWN.pop(next(iter(_KNOWN)))
        _KNOWN[key] = make()
    return _KNOWN[key]


def _source_bytes(frame: DataFrame) -> int:
    """Bytes of all that a plan reads, as the planner knows them (a very large number where it does not)."""
    leaves = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


def extent(frame: DataFrame, column: str | None = None, known: Extent | None = None, keys: list[str] | None = None) -> Extent:
    """The extent of a table in a column, without pieces if none of the keys has many rows.

    Small sources need no job. Else rows are counted once for a plan, and only tables above PIECE_ROWS have pieces of about equal
    counts, by a mergeable sketch of the column: no outlier makes a piece larger, and a value that fills a piece is one of its own.
    known is the extent of a table with these rows (or more) that a caller has at hand: if it is small, or of this column, nothing is
    asked.
    """
    if known is not None and (known.n <= PIECE_ROWS or column is None or known.column == column):
        return known
    plan = (frame.sparkSession.sparkContext.applicationId, frame.semanticHash(), PIECE_ROWS)

    def sizes() -> tuple[int, int]:
        per_key = frame.groupBy(*keys).agg(F.count("*").alias("_n"))
        return tuple(x or 0 for x in per_key.agg(F.sum("_n"), F.max("_n")).first())

    small = known is None and _source_bytes(frame) <= ROW_BYTES * PIECE_ROWS
    if keys and not small:
        n, most = _recall((*plan, *keys), sizes)
        if most <= PIECE_ROWS // KEY_PART:
            return Extent(n, (), column)
    elif known is not None:
        n = known.n
    else:
        n = _recall(plan, lambda: 0 if small else frame.count())
    x = _number(frame, column) if column is not None and n > PIECE_ROWS else None
    if x is None:
        return Extent(n)
    pieces = min(MOST_PIECES, -(-n // PIECE_ROWS))

    def split() -> tuple[float, ...]:
        shares = [i / pieces for i in range(1, pieces)]
        found = frame.select(x.alias("x")).where("not isnan(x)").agg(F.percentile_approx("x", shares, F.lit(8 * pieces))).first()[0] or []
        heavy = {v for v, w in zip(found, found[1:], strict=False) if v == w}
        return tuple(sorted({v for v in [*found, *(math.nextafter(v, math.inf) for v in heavy)] if math.isfinite(v)}))

    return Extent(n, _recall((*plan, column, MOST_PIECES), split), column)


def neighbours(
    frame: DataFrame, keys: list[str], order: list[str], columns: dict[str, tuple[str, int]], bucket: Column | None = None, known: Extent | None = None
) -> DataFrame:
    """Add columns {new: (source, -1 or 1)}: the source in the row before (-1) or after (1) by order within keys.

    ``bucket`` is a nondecreasing function of the order columns (for example ``floor(row_index / 200000)``); rows are then
    sorted within (keys, bucket) only, and each bucket's edge rows come from an aggregate. Without it the first order
    column's extent gives one, unless the table is small.
    """
    sources = list(dict.fromkeys(s for s, _ in columns.values()))
    spot = [F.col(c) for c in order]
    own = Extent(0) if bucket is not None else extent(frame, order[0], known, keys)
    if bucket is None and not own.splits:
        w = Window.partitionBy(*keys).orderBy(*spot)
        return frame.select("*", *[F.lag(s, -step).over(w).alias(new) if step < 0 else F.lead(s, step).over(w).alias(new) for new, (s, step) in columns.items()])
    dealt = own.dealt(frame, order[0], "_bucket") if bucket is None else frame.withColumn("_bucket", bucket)
    row, place = F.struct(*sources), F.struct(*order)
    edges = dealt.groupBy(*keys, "_bucket").agg(F.max_by(row, place).alias("_last"), F.min_by(row, place).alias("_first"))
    by_bucket = Window.partitionBy(*keys).orderBy("_bucket")  # a row for each bucket
    both = [(-1, F.lag("_last").over(by_bucket)), (1, F.lead("_first").over(by_bucket))]
    edges = edges.select(*keys, "_bucket", F.array(*[F.struct(F.lit(side).alias("_side"), e.alias("_row")) for side, e in both]).alias("_edges"))
    edges = edges.select(*keys, "_bucket", F.explode("_edges").alias("_e")).where("_e._row is not null")
    edges = edges.select(*keys, "_bucket", "_e._side", *[F.col(f"_e._row.{c}").alias(c) for c in sources if c not in keys])
    w = Window.partitionBy(*keys, "_bucket").orderBy("_side", *spot)
    merged = dealt.withColumn("_side", F.lit(0)).unionByName(edges, allowMissingColumns=True)
    near = merged.select("*", *[F.lag(s, -step).over(w).alias(new) if step < 0 else F.lead(s, step).over(w).alias(new) for new, (s, step) in columns.items()])
    return near.where("_side = 0").select(*frame.columns, *columns)


def running_sum(frame: DataFrame, keys: list[str], order: list[str], value: str, name: str, known: Extent | None = None) -> DataFrame:
    """Add the sum of a column over the rows up to and with this one, by order within keys (nulls count as nothing)."""
    own_extent = extent(frame, order[0], known, keys)
    spot = [F.col(c) for c in order]
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    if not own_extent.splits:
        return frame.withColumn(name, F.sum(value).over(upto(Window.partitionBy(*keys).orderBy(*spot))))
    dealt = own_extent.dealt(frame, order[0], "_bucket")
    sums = dealt.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    kind = sums.schema["_s"].dataType
    sums = sums.select(*keys, "_bucket", F.lit(-1).alias("_side"), F.sum("_s").over(before).cast(kind).alias("_v")).where("_v is not null")
    merged = dealt.withColumns({"_side": F.lit(0), "_v": F.col(value).cast(kind)}).unionByName(sums, allowMissingColumns=True)
    total = F.sum("_v").over(upto(Window.partitionBy(*keys, "_bucket").orderBy("_side", *spot))).cast(kind)
    return merged.withColumn("_total", total).where("_side = 0").select(*[F.col(c) for c in frame.columns if c != name], F.col("_total").alias(name))


def filled(frame: DataFrame, keys: list[str], order: str, columns: list[str], known: Extent | None = None) -> DataFrame:
    """Nulls of some columns take the last value before them, or the first after."""
    own_extent = extent(frame, order, known, keys)
    near = lambda c, w: F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    if not own_extent.splits:
        before, after = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
        new = {c: F.coalesce(near(c, before), near(c, after)).alias(c) for c in columns}
        return frame.select(*[new.get(c, F.col(c)) for c in frame.columns])
    plan = (frame.sparkSession.sparkContext.applicationId, frame.semanticHash(), "null", *columns)
    if not any(_recall(plan, lambda: frame.agg(*[F.count_if(F.col(c).isNull()) for c in columns]).first())):
        return frame  # nothing to fill: one look costs less than a shuffle
    dealt, inside = own_extent.dealt(frame, order, "_bucket"), [*keys, "_bucket"]
    ends = dealt.groupBy(*inside).agg(
        *[f(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{e}_{c}") for c in columns for e, f in (("last", F.max_by), ("first", F.min_by))]
    )
    past = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    next_ = Window.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    both = [(-1, "last", past), (1, "first", next_)]
    ends = ends.select(*inside, F.array(*[F.struct(F.lit(side).alias("_side"), *[F.last(f"_{e}_{c}", True).over(w).alias(c) for c in columns]) for side, e, w in both]).alias("_ends"))
    ends = ends.select(*inside, F.explode("_ends").alias("_e")).select(*inside, "_e.*")
    before, after = Window.partitionBy(*inside).orderBy("_side", order), Window.partitionBy(*inside).orderBy(F.desc("_side"), F.desc(order))
    merged = dealt.withColumn("_side", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    new = {c: F.coalesce(near(c, before), near(c, after)).alias(c) for c in columns}
    return merged.select("_side", *[new.get(c, F.col(c)) for c in frame.columns]).where("_side = 0").drop("_side")


def runs(frame: DataFrame, keys: list[str], order: list[str], flag: str, known: Extent | None = None) -> DataFrame:
    """Stretches of rows in a row with a true flag: keys, run, n_rows, and the first and last value of the order columns."""
    known = known or extent(frame, order[0], keys=keys)
    marked = neighbours(frame.withColumn("_on", F.coalesce(F.col(flag), F.lit(False))), keys, order, {"_was": ("_on", -1)}, known=known)
    marked = marked.withColumn("_new", (F.col("_on") & ~F.coalesce("_was", F.lit(False))).cast("int"))
    marked = running_sum(marked, keys, order, "_new", "run", known).where("_on")
    spot = F.struct(*order)
    return marked.groupBy(*keys, "run").agg(F.count("*").alias("n_rows"), F.min(spot).alias("first"), F.max(spot).alias("last"))


def around(left: DataFrame, right: DataFrame, keys: list[str], at: str, bucket_width: int | None = None, known: Extent | None = None) -> DataFrame:
    """For each left row the last right value of ``at`` before or at its own, and the first at or after it, within keys.

    Left columns, low and high (null where there is none). Both sides are merged into one sorted sequence, and
    two windows carry the last right row before and the first after. Long sequences are cut into pieces of ``at`` (of
    bucket_width, if given), and every piece gets the last right row before it and the first after it.
    """
    own = Extent(0) if bucket_width else extent(left.select(at).unionAll(right.select(at)), at, known)
    base = right.select(*keys, F.col(at).alias("_t")).where("_t is not null").distinct()
    rows = left.select(F.struct(*left.columns).alias("_row"), *keys, F.col(at).alias("_t"))
    if bucket_width or own.splits:
        base, rows = (x.withColumn("_b", F.floor(F.col("_t") / bucket_width)) if bucket_width else own.dealt(x, "_t", "_b") for x in (base, rows))
        used = rows.select(*keys, "_b").union(base.select(*keys, "_b")).distinct()
        edge = base.groupBy(*keys, "_b").agg(F.min("_t").alias("_lo"), F.max("_t").alias("_hi"))
        order, back = Window.partitionBy(*keys).orderBy("_b"), Window.partitionBy(*keys).orderBy(F.desc("_b"))
        edge = used.join(edge, [*keys, "_b"], "left").select(
            *keys, "_b", F.last("_hi", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("_hi"),
            F.last("_lo", True).over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_lo"),
        )
        extra = edge.select(*keys, "_b", F.explode(F.array("_hi", "_lo")).alias("_t")).where("_t is not null")
        base = base.select(*keys, "_b", "_t").union(extra.select(*keys, "_b", "_t"))
        part = [*keys, "_b"]
    else:
        part = keys
    merged = rows.withColumn("_is", F.lit(False)).unionByName(base.withColumn("_is", F.lit(True)), allowMissingColumns=True)
    # a frame to the end of the partition is computed anew for every row, so what follows is what came before in reverse
    w, back = Window.partitionBy(*part).orderBy("_t", F.desc("_is")), Window.partitionBy(*part).orderBy(F.desc("_t"), F.desc("_is"))
    mark = F.when(F.col("_is"), F.col("_t"))
    found = merged.select(
        "_row", "_is", "_t", F.last(mark, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_lo"),
        F.last(mark, True).over(back.rowsBetween(Window.unboundedPreceding, 0)).alias("_hi"),
    ).where("not _is")
    return found.select("_row.*", F.col("_lo").alias("low"), F.col("_hi").alias("high"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], at: str, bucket_width: int | None = None, known: Extent | None = None) -> DataFrame:
    """For each left row the right row of the same keys whose ``at`` is closest; of two as close the later one.

    Left columns, and ``near`` (null if the keys have no right row).
    """
    found = around(left, right, keys, at, bucket_width, known)
    later = F.col("low").isNull() | (F.col("high") - F.col(at) <= F.col(at) - F.col("low"))
    near = F.when(later & F.col("high").isNotNull(), F.col("high")).otherwise(F.col("low"))
    return found.select(*[f"`{c}`" for c in left.columns], near.alias("near"))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join in which null keys are equal; the keys come once."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, on, how).drop(*[f"_r_{k}" for k in keys])


def _step_of(x: Column) -> Column:
    """A whole number that never falls as x grows: about a thousand steps between a number and its double."""
    size = F.abs(x)
    power = F.floor(F.log2(size))
    step = (power + 1100) * 2048 + F.floor(size / F.pow(F.lit(2.0), power) * 1024)
    return F.when(x == 0, F.lit(0)).otherwise(F.signum(x) * step).cast("bigint")


def quantiles(frame: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, without gathering a key's values in one task.

    keys and a column for each name in ``at``. Counts of coarse steps of the value tell in which steps the wanted ranks lie, and
    only values of those steps move and are sorted. Null, NaN and infinite values are left out.
    """
    values = staged(frame.select(*keys, finite(value).alias("_v")).where("_v is not null"), "values").withColumn("_b", _step_of(F.col("_v")))
    steps = values.groupBy(*keys, "_b").agg(F.count("*").alias("_m"))
    key, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("_b")
    steps = steps.withColumn("_all", F.sum("_m").over(key)).withColumn("_before", F.sum("_m").over(order) - F.col("_m"))
    ranks = {name: (F.col("_all") - 1) * F.lit(float(p)) for name, p in at.items()}
    wanted = F.lit(False)
    for rank in ranks.values():
        for r in (F.floor(rank), F.ceil(rank)):
            wanted = wanted | ((r >= F.col("_before")) & (r < F.col("_before") + F.col("_m")))
    steps = staged(steps.where(wanted).drop("_m"), "steps")  # a table of known size, so that the planner need not move the values to join it
    inside = same_keys(values, steps, [*keys, "_b"]).groupBy(*keys, "_b", "_v", "_all", "_before").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy("_v")) + F.col("_before")
    inside = inside.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_n"))

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_from")) & (rank < F.col("_to")), F.col("_v")))

    picked = inside.groupBy(*keys).agg(
        F.first("_all").alias("_all"), *[value_at(f(r)).alias(f"_{e}_{n}") for n, r in ranks.items() for e, f in (("lo", F.floor), ("hi", F.ceil))]
    )
    return picked.select(*keys, *[(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (r - F.floor(r))).alias(n) for n, r in ranks.items()])


def summaries(frame: DataFrame, keys: list[str], sums: list[Column], wanted: dict[str, tuple[str, float]], settings: Settings = DEFAULTS, rows: int | None = None) -> DataFrame:
    """keys, the aggregates ``sums`` and exact quantiles {name: (column, share)} of finite values, null where there are none.

    One aggregate, whose buffers hold the distinct values of a group; of tables with more than SPREAD_ROWS rows (or as
    spread_quantiles says) by ``quantiles``, which gathers no group. ``rows`` is the table's size where it is known.
    """
    by_column = {c: {n: p for n, (own, p) in wanted.items() if own == c} for c, _ in wanted.values()}
    spread = settings.spread_quantiles
    if spread is None:
        spread = (extent(frame).n if rows is None else rows) > SPREAD_ROWS
    if not spread:
        shares = [F.percentile(finite(c), F.array(*map(F.lit, at.values()))).alias(f"_q_{c}") for c, at in by_column.items()]
        out = frame.groupBy(*keys).agg(*sums, *shares)
        place = {n: F.col(f"_q_{c}")[i].alias(n) for c, at in by_column.items() for i, n in enumerate(at)}
        return out.select(*out.columns[: -len(by_column)], *[place[n] for n in wanted])
    out = frame.groupBy(*keys).agg(*sums) if sums else frame.select(*keys).distinct()
    for column, at in by_column.items():
        own = quantiles(frame, keys, column, at)
        out = same_keys(out, own, keys, "left") if keys else out.join(F.broadcast(own), how="left")  # without keys one row each
    return staged(out.select(*keys, *[c for c in out.columns if c not in keys and c not in wanted], *wanted), "summaries")
