"""Units of clocks, measured rates and their comparison."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .windows import extent, finite, neighbours, same_keys, summaries

#: Nanoseconds in a unit (fixed values).
UNIT_NS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1}
LEAST_HZ, MOST_HZ = 0.001, 1e7


def unit_from_name(name: str) -> str | None:
    """Unit that a column's name states: frame_index, ns, us, ms, s, or None.

    A suffix counts after an underscore, as a name of its own, or behind a word for time (timens, stamps): ``columns``,
    ``status`` or ``joints`` name no unit.
    """
    low = name.lower()
    if re.search(r"pts|packet|frame_index", low) or low.endswith(("_index", "_idx")):
        return "frame_index"
    hit = re.search(r"_(ns|us|ms|s|sec|secs|seconds)$", low) or re.fullmatch(r"(ns|us|ms)", low) or re.search(r"(?:time|stamp|clock)(ns|us|ms|s)$", low)
    return {"sec": "s", "secs": "s", "seconds": "s"}.get(hit[1], hit[1]) if hit else None


def unit_case(size: Column, step: Column) -> Column:
    """Unit of a clock from the median of its values' sizes and of its positive steps.

    Epochs first (size and step both in a unit's band), then steps alone, then sizes alone. Microsecond epochs have a band
    of their own, so they are not taken for nanoseconds.
    """
    def band(x: Column, low: float, high: float) -> Column:
        return (x >= low) & (x < high)

    return (
        F.when(band(size, 1e17, 1e19) & band(step, 1e4, 1e10), "ns")
        .when(band(size, 1e14, 1e17) & band(step, 1e1, 1e10), "us")
        .when(band(size, 1e11, 1e14) & band(step, 1e-3, 1e8), "ms")
        .when(band(size, 1e8, 1e11) & band(step, 1e-6, 1e5), "s")
        .when(step.isNotNull() & (step < 1e3), "ns")
        .when(band(step, 1e3, 1e5), "us")
        .when(band(step, 1e5, 1e9), "ms")
        .when(step >= 1e9, "s")
        .when(size >= 1e17, "ns").when(size >= 1e14, "us").when(size >= 1e11, "ms").when(size >= 1e8, "s")
        .otherwise("unknown")
    )


def corrected_unit(unit: Column, size: Column, step: Column) -> tuple[Column, Column]:
    """(unit, basis): where the rate that a unit gives is out of range, the first of size, s, ms, us, ns that fits.

    basis is inferred, corrected or ambiguous (nothing fits).
    """
    def fits(u: Column) -> Column:
        hz = F.lit(0.0)
        for name, ns in UNIT_NS.items():
            hz = F.when(u == name, 1e9 / (step * ns)).otherwise(hz)
        return (hz >= LEAST_HZ) & (hz <= MOST_HZ)

    by_size = F.when(size >= 1e17, "ns").when(size >= 1e14, "us").when(size >= 1e11, "ms").when(size >= 1e8, "s")
    out, basis = unit, F.lit("ambiguous")
    for other in [F.lit(u) for u in ("ns", "us", "ms", "s")] + [by_size]:
        good = F.coalesce(fits(other), F.lit(False))
        out, basis = F.when(good, other).otherwise(out), F.when(good, "corrected").otherwise(basis)
    good = F.coalesce(fits(unit), F.lit(False)) | step.isNull()
    return F.when(good, unit).otherwise(out), F.when(good, "inferred").otherwise(basis)


def infer_unit(frame: DataFrame, keys: list[str], clock: str, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each key: n, size, step (medians), unit, basis. Null, NaN and infinite clock values are left out."""
    rows = frame.select(*keys, finite(clock).alias("_t")).where("_t is not null")
    steps = neighbours(rows, keys, ["_t"], {"_p": ("_t", -1)}).withColumn("_d", F.col("_t") - F.col("_p"))
    sizes = steps.select(*keys, F.abs("_t").alias("_size"), F.when(F.col("_d") > 0, F.col("_d")).alias("_step"))
    stats = summaries(sizes, keys, [F.count("*").alias("n")], {"size": ("_size", 0.5), "step": ("_step", 0.5)}, settings, extent(rows).n)
    unit, basis = corrected_unit(unit_case(F.col("size"), F.col("step")), F.col("size"), F.col("step"))
    return stats.select(*keys, "n", "size", "step", unit.alias("unit"), basis.alias("basis"))


def to_ns(clock: Column, unit: Column) -> Column:
    """Nanoseconds as a long; null for frame_index and unknown units. Whole numbers stay exact."""
    out = F.lit(None).cast("bigint")
    for name, ns in UNIT_NS.items():
        out = F.when(unit == name, (clock * ns).cast("bigint")).otherwise(out)
    return out


def measured_rate(frame: DataFrame, keys: list[str], clock_ns: str, order: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """The authoritative rate: 10^9 over the median positive step in file order, of keys with at least 3 values."""
    steps = neighbours(frame.where(F.col(clock_ns).isNotNull()), keys, order, {"_p": (clock_ns, -1)}).withColumn("_d", F.col(clock_ns) - F.col("_p"))
    ahead = steps.select(*keys, F.when(F.col("_d") > 0, F.col("_d")).alias("_d"))
    stats = summaries(ahead, keys, [F.count("*").alias("n")], {"step_ns": ("_d", 0.5)}, settings)
    return stats.where("n >= 3").select(*keys, "n", "step_ns", (1e9 / F.col("step_ns")).alias("rate_hz"))


def steady_rate(frame: DataFrame, keys: list[str], clock_ns: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The rate shown on inspection: sorted steps up to ten medians, 10^9 over their mean; jitter is their deviation in ms."""
    steps = neighbours(frame.where(F.col(clock_ns).isNotNull()), keys, [clock_ns], {"_p": (clock_ns, -1)}).withColumn("_d", F.col(clock_ns) - F.col("_p"))
    middle = summaries(steps.select(*keys, F.when(F.col("_d") > 0, F.col("_d")).alias("_d")), keys, [], {"step_ns": ("_d", 0.5)}, settings)
    kept = same_keys(steps, middle, keys).where((F.col("_d") > 0) & (F.col("_d") <= 10 * F.col("step_ns")))
    return kept.groupBy(*keys).agg(
        F.count("*").alias("n_steps"), (1e9 / F.avg("_d")).alias("rate_hz"), (F.stddev_pop("_d") / 1e6).alias("jitter_ms")
    )


def is_clock(frame: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """For each key whether a number column is a clock by content: it never falls in file order, moves, and nine tenths of
    its steps are no longer than one and a half medians. keys, n, median_step, regular_share, monotone, is_clock."""
    rows = frame.select(*keys, *order, finite(value).alias("_v")).where("_v is not null")
    steps = neighbours(rows, keys, order, {"_p": ("_v", -1)}).withColumn("_d", F.col("_v") - F.col("_p"))
    middle = summaries(steps, keys, [F.min("_d").alias("_least")], {"median_step": ("_d", 0.5)})
    share = F.avg((F.col("_d") <= 1.5 * F.col("median_step")).cast("double"))
    sums = same_keys(steps, middle, keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.first("median_step").alias("median_step"), share.alias("regular_share"), F.first("_least").alias("_least")
    )
    monotone = F.coalesce(F.col("_least") >= 0, F.lit(False))
    good = monotone & (F.col("n") >= 3) & (F.col("median_step") > 0) & (F.col("regular_share") >= 0.9)
    return sums.select(*keys, "n", "median_step", "regular_share", monotone.alias("monotone"), F.coalesce(good, F.lit(False)).alias("is_clock"))


def compare_rates(measured: Column, nominal: Column, settings: Settings = DEFAULTS) -> Column:
    """match, mismatch, or unknown where either rate is missing."""
    off = F.try_divide(F.abs(measured - nominal), nominal)
    return F.when(off <= settings.rate_tolerance, "match").when(off > settings.rate_tolerance, "mismatch").otherwise("unknown")


def unit_hint(value: Column) -> Column:
    """Unit of a nested clock field from the size of its values alone; null below epochs."""
    return F.when(value >= 1e17, "ns").when(value >= 1e14, "us").when(value >= 1e11, "ms").when(value >= 1e8, "s")


def explain_rates(video_fps: float, data_hz: float, tolerance: float = 0.02) -> str:
    """How a video's rate relates to its data's: equal, a whole multiple, or unrelated."""
    if not video_fps or not data_hz:
        return "unknown"
    high, low = max(video_fps, data_hz), min(video_fps, data_hz)
    times = round(high / low)
    if abs(high / low - times) > tolerance * times:
        return "unrelated"
    return "equal" if times == 1 else f"{'video' if video_fps > data_hz else 'data'} is {times} times as fast"
