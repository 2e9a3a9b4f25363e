"""Statistics of tables, episodes, vectors and poses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..settings import DEFAULTS, Settings
from .windows import bad, extent, finite, neighbours, same_keys, summaries

#: Columns that name an episode, in order of preference (fixed values).
EPISODE_NAMES = ("episode_index", "episode", "episode_id", "traj_id", "trajectory", "demo")
JOINT_PREFIXES = ("qpos", "joint", "q_")
DURATION_NAMES = ("duration", "time", "elapsed", "duration_s")


def find_column(columns: list[str], names: tuple[str, ...], prefix: bool = False) -> str | None:
    """The first name that a column equals, ignoring case; with prefix also one that begins with name_ or name. ."""
    low = {c.lower(): c for c in reversed(columns)}
    for name in names:
        if name in low:
            return low[name]
    if prefix:
        for name in names:
            for c in columns:
                if c.lower().startswith((f"{name}_", f"{name}.")):
                    return c
    return None


def numeric_columns(frame: DataFrame, but: tuple[str, ...] = ()) -> list[str]:
    return [f.name for f in frame.schema if isinstance(f.dataType, T.NumericType | T.BooleanType) and f.name not in but]


def long_form(frame: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, column, value: one row for each number, so any count of columns needs one aggregate."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value")) for c in columns])
    return frame.select(*keys, F.explode(pairs).alias("_p")).select(*keys, "_p.column", "_p.value")


def generic_stats(frame: DataFrame, columns: list[str], keys: list[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """count, mean, std (n - 1), min, max and median of each column over its finite values, by keys (null keys left out)."""
    keys = keys or []
    for k in keys:
        frame = frame.where(F.col(k).isNotNull())
    x = finite("value")
    sums = [F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max")]
    return summaries(long_form(frame, keys, columns), [*keys, "column"], sums, {"median": ("value", 0.5)}, settings)


def column_profile(frame: DataFrame, columns: list[str] | None = None, max_unique: int = 20, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each column: type, n_missing, missing_share, n_distinct; for numbers mean, std (n - 1), min, max and the
    quartiles; and samples, the distinct values as sorted texts where there are at most max_unique.

    NaN counts as missing; infinite values are left out of the numbers. Arrays and structs are profiled by their text.
    """
    fields = [f for f in frame.schema if columns is None or f.name in columns]
    out = []
    for f in fields:
        number = isinstance(f.dataType, T.NumericType | T.BooleanType)
        c = F.col(f"`{f.name}`")
        x = c.cast("double") if number else F.lit(None).cast("double")
        text = c.cast("string") if not isinstance(f.dataType, T.ArrayType | T.StructType | T.MapType) else F.to_json(c)
        missing = (c.isNull() | F.isnan(x)) if number else c.isNull()
        out.append(F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.when(~missing, text).alias("text"), F.when(~F.isnan(x), x).alias("x")))
    rows = frame.select(F.explode(F.array(*out)).alias("_c")).select("_c.*")
    # cells that are alike are counted before they meet, so a column's distinct values spread over tasks
    cells = rows.groupBy("column", "type", "text", "x").agg(F.count("*").alias("n"))
    texts = cells.groupBy("column", "type").agg(
        F.coalesce(F.sum(F.when(F.col("text").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"), F.sum("n").alias("_all"), F.count("text").alias("n_distinct"),
    )
    nth = F.row_number().over(Window.partitionBy("column").orderBy("text"))
    first = cells.where("text is not null").withColumn("_nth", nth).where(F.col("_nth") <= max_unique)  # a task keeps no more of a column
    first = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("text")), "|").alias("samples"))
    good = F.when(F.abs("x") != float("inf"), F.col("x"))
    sums = [F.avg(good).alias("mean"), F.stddev_samp(good).alias("std"), F.min(good).alias("min"), F.max(good).alias("max")]
    wanted = {"q25": ("x", 0.25), "median": ("x", 0.5), "q75": ("x", 0.75)}
    numbers = summaries(rows, ["column", "type"], sums, wanted, settings, rows=extent(frame).n * len(fields))
    return texts.join(numbers, ["column", "type"]).join(first, "column", "left").select(
        "column", "type", "n_missing", (F.col("n_missing") / F.col("_all")).alias("missing_share"), "n_distinct", "mean", "std", "min", "max", *wanted,
        F.when(F.col("n_distinct") <= max_unique, F.col("samples")).alias("samples"),
    )


def episode_distribution(frame: DataFrame, episode: str) -> DataFrame:
    return frame.groupBy(episode).agg(F.count("*").alias("n_rows"))


def last_value(frame: DataFrame, episode: str, value: str, order: list[str]) -> DataFrame:
    """The value of the last row of each episode in file order (null episodes left out)."""
    place = F.struct(*order)
    return frame.where(F.col(episode).isNotNull()).groupBy(episode).agg(F.max_by(value, place).alias(value))


def success_rate(frame: DataFrame, episode: str, success: str, order: list[str]) -> DataFrame:
    """n_episodes, n_success and rate, where an episode succeeds if its last row says so."""
    last = last_value(frame, episode, success, order)
    return last.agg(F.count("*").alias("n_episodes"), F.sum(F.col(success).cast("bigint")).alias("n_success")).withColumn("rate", F.try_divide("n_success", "n_episodes"))


def range_of_motion(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, min, max, range of the joint columns."""
    names = columns or [c for c in numeric_columns(frame) if c.lower().startswith(JOINT_PREFIXES)]
    x = finite("value")
    return long_form(frame, [], names).groupBy("column").agg(F.min(x).alias("min"), F.max(x).alias("max"), (F.max(x) - F.min(x)).alias("range"))


def iqr_outliers(values: DataFrame, value: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows (episodes) outside the quartiles by k times their distance; none if there are fewer than 4 values."""
    x = finite(value)
    q = summaries(values, [], [F.count(x).alias("_n")], {"_low": (value, 0.25), "_high": (value, 0.75)}, settings)
    low, high = F.col("_low"), F.col("_high")
    rows = values.join(F.broadcast(q)).where("_n >= 4")  # one row
    k = settings.outlier_k
    out = rows.where((x < low - k * (high - low)) | (x > high + k * (high - low)))
    return out.select(*values.columns, (low - k * (high - low)).alias("low"), (high + k * (high - low)).alias("high"))


def parse_vector(text: Column) -> Column:
    """Numbers of a vector written as text, by commas or blanks, with or without brackets; null if any is not a number."""
    body = F.trim(F.regexp_replace(text, r"[\[\]()]", " "))
    parts = F.transform(F.split(body, r"[,\s]+"), lambda x: x.try_cast("double"))
    return F.when((body != "") & ~F.exists(parts, lambda x: x.isNull()), parts)


def vector_profile(frame: DataFrame, vector: str, row_index: str) -> DataFrame:
    """One row: n, n_vectors, n_zero, zero_share, dims (most frequent length, smaller first), first and last zero row,
    zero_contiguous, zero_in_first_20 and zero_by_tenth (the rows in ten parts, the first n % 10 of them one row longer)."""
    c = F.col(vector)
    v = parse_vector(c) if isinstance(frame.schema[vector].dataType, T.StringType) else c.cast("array<double>")
    rows = frame.select(F.col(row_index).alias("i"), v.alias("v")).withColumn("zero", F.col("v").isNotNull() & ~F.exists("v", lambda x: x != 0))
    total = rows.agg(F.count("*").alias("n_all"))
    size, longer = F.floor(F.col("n_all") / 10), F.col("n_all") % 10
    edge = longer * (size + 1)
    tenth = F.when(F.col("i") < edge, F.floor(F.col("i") / (size + 1))).otherwise(longer + F.floor((F.col("i") - edge) / F.greatest(size, F.lit(1))))
    rows = rows.join(F.broadcast(total)).withColumn("tenth", tenth)  # one row
    tenths = [F.count_if(F.col("zero") & (F.col("tenth") == i)) for i in range(10)]
    sums = rows.agg(
        F.count("*").alias("n"), F.count("v").alias("n_vectors"), F.count_if("zero").alias("n_zero"), F.min(F.when(F.col("zero"), F.col("i"))).alias("first_zero"),
        F.max(F.when(F.col("zero"), F.col("i"))).alias("last_zero"), F.count_if(F.col("zero") & (F.col("i") < 20)).alias("zero_in_first_20"), F.array(*tenths).alias("zero_by_tenth"),
    )
    dims = rows.where("v is not null").groupBy(F.size("v").alias("dims")).count().agg(F.max(F.struct("count", -F.col("dims"))).alias("_m")).select((-F.col("_m")["col2"]).alias("dims"))
    return sums.join(F.broadcast(dims)).select(  # one row each
        "n", "n_vectors", "n_zero", F.try_divide("n_zero", "n_vectors").alias("zero_share"), "dims", "first_zero", "last_zero",
        F.coalesce(F.col("last_zero") - F.col("first_zero") + 1 == F.col("n_zero"), F.lit(False)).alias("zero_contiguous"), "zero_in_first_20", "zero_by_tenth",
    )


def pose_blocks(frame: DataFrame, vector: str, width: int) -> DataFrame:
    """For each block of width numbers of a vector: ranges of x, y, z and, for width 7, the norm of the quaternion.

    n, n_zero, x/y/z min and max, quat_norm_mean, quat_norm_std (over blocks that are not zero), quat_valid.
    """
    v = F.col(vector).cast("array<double>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / width).cast("int") - 1), lambda i: F.slice(v, i * width + 1, F.lit(width)))
    rows = frame.where(F.size(v) >= width).select(F.posexplode(blocks).alias("block", "b"))
    zero = ~F.exists("b", lambda x: x != 0)
    norm = F.sqrt(sum((F.col("b")[i] * F.col("b")[i] for i in range(max(0, width - 4), width)), F.lit(0.0)))
    axes = [f(F.col("b")[i]).alias(f"{n}_{name}") for i, n in enumerate("xyz") for f, name in ((F.min, "min"), (F.max, "max")) if i < width]
    live = F.when(~F.col("zero"), norm)
    out = rows.withColumn("zero", zero).groupBy("block").agg(F.count("*").alias("n"), F.count_if("zero").alias("n_zero"), *axes, F.avg(live).alias("quat_norm_mean"), F.stddev_pop(live).alias("quat_norm_std"))
    return out.withColumn("quat_valid", F.coalesce((F.col("quat_norm_std") < 0.01) & (F.abs(F.col("quat_norm_mean") - 1) < 0.01), F.lit(False)))


def difference_stats(frame: DataFrame, value: str, settings: Settings = DEFAULTS) -> DataFrame:
    """n, mean, std (n), min, max, median, p05, p95 and a histogram of ten equal bins (the last closed) of finite values."""
    rows = frame.select(finite(value).alias("x")).where("x is not null")
    sums = [F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")]
    sums = summaries(rows, [], sums, {"median": ("x", 0.5), "p05": ("x", 0.05), "p95": ("x", 0.95)}, settings)
    return _with_bins(rows, sums, 10)


def _with_bins(rows: DataFrame, sums: DataFrame, n: int) -> DataFrame:
    step = (F.col("max") - F.col("min")) / n
    spot = F.when(step > 0, F.least(F.lit(n - 1), F.floor((F.col("x") - F.col("min")) / step))).otherwise(0)
    binned = rows.join(F.broadcast(sums.select("min", "max"))).select(spot.alias("b"))
    return sums.join(F.broadcast(binned.agg(F.array(*[F.count_if(F.col("b") == i) for i in range(n)]).alias("bins"))))


def histogram(frame: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin, low, high and n of equal bins between the smallest and largest finite value; the last bin is closed."""
    rows = frame.select(finite(value).alias("x")).where("x is not null")
    ends = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / bins
    spot = F.when(step > 0, F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / step))).otherwise(F.lit(0)).cast("int")
    counts = rows.join(F.broadcast(ends)).groupBy(spot.alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.where("lo is not null").select("lo", step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select(
        "bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("high"), F.coalesce("n", F.lit(0)).alias("n")
    )


def zscores(frame: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The frame with z: the value less its mean over its deviation (n) within keys; 0 where all values are equal.

    Rows with a null key are a group of their own.
    """
    x = finite(value)
    stats = frame.groupBy(*keys).agg(F.avg(x).alias("_m"), F.stddev_pop(x).alias("_s"))
    z = F.when(F.col("_s") > 0, (x - F.col("_m")) / F.col("_s")).when(x.isNotNull(), 0.0)
    return same_keys(frame, stats, keys).select(*frame.columns, z.alias("z"))


def bad_value_ratios(frame: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """column, n_bad and ratio of null, NaN and infinite values."""
    keys = keys or []
    return long_form(frame, keys, columns).groupBy(*keys, "column").agg(F.count_if(bad("value")).alias("n_bad"), F.avg(bad("value").cast("double")).alias("ratio"))


def capability_counts(frame: DataFrame, label: str) -> DataFrame:
    """n and share of each label, and whether one label dominates: of five or more rows it has over four fifths."""
    counts = frame.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"))
    share = F.col("n") / F.col("_n")
    return counts.join(F.broadcast(total)).select(label, "n", share.alias("share"), ((F.col("_n") >= 5) & (share > 0.8)).alias("dominates"))


def first_seen(frame: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Distinct non-empty texts of each key in the order they are first seen."""
    clean = F.trim(F.col(text))
    rows = frame.where(clean != "").groupBy(*keys, clean.alias("_t")).agg(F.min(F.struct(*order)).alias("_o"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]).alias("tasks"))


def rolling_mean(frame: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Add the centred mean of five values; null where fewer than two rows are before or after."""
    known = extent(frame, order[0])
    rows = neighbours(frame, keys, order, {"_b": (value, -1), "_a": (value, 1)}, known=known)
    rows = neighbours(rows, keys, order, {"_bb": ("_b", -1), "_aa": ("_a", 1)}, known=known)
    mean = (F.col("_bb") + F.col("_b") + F.col(value) + F.col("_a") + F.col("_aa")) / 5
    return rows.select(*frame.columns, mean.alias(name))
