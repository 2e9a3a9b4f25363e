"""Checks of single clocks, choice of a baseline, residuals, drift and container alignment.

Streams are keys of one long frame with a clock in nanoseconds; all streams are checked in the same few aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from ..storage import staged
from .windows import Extent, extent, nearest, neighbours, same_keys, summaries

#: Parts of names that are never a baseline (fixed values).
NO_BASELINE = ("tf_static", "static_tf", "_static", "static_", "calib", "metadata", "metainfo")


def sorted_steps(frame: DataFrame, keys: list[str], clock_ns: str, bucket_width: int | None = None, known: Extent | None = None) -> DataFrame:
    """keys, t, p (the clock before in sorted order) and d, their difference.

    Long streams are sorted in pieces: of bucket_width nanoseconds if given, else by the clock's extent.
    """
    rows = frame.select(*keys, F.col(clock_ns).alias("t")).where("t is not null")
    bucket = F.floor(F.col("t") / bucket_width) if bucket_width else None
    known = known.of("t") if known and known.column == clock_ns else known
    return neighbours(rows, keys, ["t"], {"p": ("t", -1)}, bucket, known).withColumn("d", F.col("t") - F.col("p"))


def medians(steps: DataFrame, keys: list[str], settings: Settings = DEFAULTS, rows: int | None = None) -> DataFrame:
    """The median step of each key, steps of zero included (null if there is none above zero)."""
    found = summaries(steps.select(*keys, "d"), keys, [], {"step_ns": ("d", 0.5)}, settings, rows)
    return found.withColumn("step_ns", F.when(F.col("step_ns") > 0, F.col("step_ns")))


def shape_case(n: Column, span_ns: Column, step_ns: Column, mean_ns: Column, settings: Settings = DEFAULTS) -> Column:
    """static (few values, or a median step above a tenth of the span), burst (a mean step of burst_ratio medians or more) or
    periodic. A median step of zero (null here) tells neither static nor burst."""
    few = (n < settings.static_min_samples) | F.coalesce(step_ns > span_ns / 10, F.lit(False))
    return F.when(few, "static").when(F.coalesce(mean_ns >= settings.burst_ratio * step_ns, F.lit(False)), "burst").otherwise("periodic")


def _sums(frame: DataFrame, keys: list[str], clock_ns: str, settings: Settings, bucket_width: int | None, known: Extent | None = None) -> DataFrame:
    """One row for each key of what checks, shapes and alignment need of its sorted steps."""
    known = known or extent(frame, clock_ns)
    steps = sorted_steps(frame, keys, clock_ns, bucket_width, known)
    gap = F.col("d") > settings.gap_factor * F.col("step_ns")
    sums = same_keys(steps, medians(steps, keys, settings, known.n), keys).groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("t").alias("head"), F.max("t").alias("tail"), F.first("step_ns").alias("step_ns"), F.avg("d").alias("mean_ns"),
        F.count_if(F.col("d") == 0).alias("n_duplicates"), F.count_if(gap).alias("n_gaps"), F.count_if(F.col("d") > 2 * F.col("step_ns")).alias("breaks"),
        F.coalesce(F.sum(F.when(gap, F.col("d") - F.col("step_ns"))), F.lit(0.0)).alias("lost_ns"),
    )
    sums = sums.withColumn("span_ns", F.col("tail") - F.col("head"))
    return sums.withColumn("shape", shape_case(F.col("n"), F.col("span_ns"), F.col("step_ns"), F.col("mean_ns"), settings))


def _unless_burst(value: Column) -> Column:
    """Silence between bursts is neither loss nor a gap: such figures do not apply to bursts."""
    return F.when(F.col("shape") != "burst", value)


def stream_checks(
    frame: DataFrame, keys: list[str], clock_ns: str, order: list[str], settings: Settings = DEFAULTS, bucket_width: int | None = None, bucket_rows: int | None = None,
    known: Extent | None = None,
) -> DataFrame:
    """One row for each stream: n, span_s, step_ns, rate_hz, n_disorder, n_duplicates, shape, n_gaps, loss.

    Disorder counts steps back in file order; the rest follows the sorted clock. Loss is the time of gaps beyond a median
    step, over the span, at most 1; it and n_gaps are null for bursts. A stream of one value has no step: its rate is null,
    its gaps and loss are 0. Long streams are sorted in pieces: of bucket_width nanoseconds and of bucket_rows of the first
    order column if given, else by the extent of both.
    """
    pieces = F.floor(F.col(order[0]) / bucket_rows) if bucket_rows else None
    known = known or extent(frame, clock_ns)
    filed = neighbours(frame.where(F.col(clock_ns).isNotNull()), keys, order, {"_p": (clock_ns, -1)}, pieces, known)
    disorder = filed.groupBy(*keys).agg(F.count_if(F.col(clock_ns) < F.col("_p")).alias("n_disorder"))
    loss = F.when(F.col("span_ns") > 0, F.least(F.lit(1.0), F.col("lost_ns") / F.col("span_ns"))).otherwise(0.0)
    return same_keys(_sums(frame, keys, clock_ns, settings, bucket_width, known), disorder, keys).select(
        *keys, "n", (F.col("span_ns") / 1e9).alias("span_s"), "step_ns", F.when(F.col("mean_ns") > 0, 1e9 / F.col("mean_ns")).alias("rate_hz"),
        "n_disorder", "n_duplicates", "shape", _unless_burst(F.col("n_gaps")).alias("n_gaps"), _unless_burst(loss).alias("loss"),
    )


def stream_shape(frame: DataFrame, keys: list[str], clock_ns: str, settings: Settings = DEFAULTS, bucket_width: int | None = None) -> DataFrame:
    """The shape of each stream (see shape_case); n_bursts and effective_hz describe bursts and are null for other shapes."""
    burst = F.col("shape") == "burst"
    return _sums(frame, keys, clock_ns, settings, bucket_width).select(
        *keys, "n", "shape", F.when(burst, F.col("breaks") + 1).alias("n_bursts"),
        F.when(burst, F.col("n") / (F.col("span_ns") / 1e9)).alias("effective_hz"),
    )


def locate_gaps(frame: DataFrame, keys: list[str], clock_ns: str, settings: Settings = DEFAULTS, bucket_width: int | None = None) -> DataFrame:
    """The first gaps of each stream (gap_report_limit): nth, start_ns, end_ns, duration_s, n_missing. Bursts have none."""
    size = extent(frame, clock_ns)
    steps = sorted_steps(frame, keys, clock_ns, bucket_width, size)
    found = _sums(frame, keys, clock_ns, settings, bucket_width, size).where("shape <> 'burst' and n_gaps > 0").select(*keys, "step_ns")
    gaps = same_keys(steps, found, keys).where(F.col("d") > settings.gap_factor * F.col("step_ns"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("p")).cast("bigint")
    return gaps.withColumn("nth", nth).where(F.col("nth") <= settings.gap_report_limit).select(
        *keys, "nth", F.col("p").alias("start_ns"), F.col("t").alias("end_ns"), (F.col("d") / 1e9).alias("duration_s"),
        (F.floor(F.col("d") / F.col("step_ns")) - 1).alias("n_missing"),
    )


def rank_baselines(frame: DataFrame, key: str, clock_ns: str, settings: Settings = DEFAULTS, bucket_width: int | None = None, known: Extent | None = None) -> DataFrame:
    """Eligible streams by score: coverage over (1 + variation of steps) times log10 of the count; ties by name."""
    steps = sorted_steps(frame, [key], clock_ns, bucket_width, known)
    sums = steps.groupBy(key).agg(
        F.count("*").alias("n"), (F.max("t") - F.min("t")).alias("span_ns"),
        F.avg(F.when(F.col("d") > 0, F.col("d"))).alias("mean_ns"), F.stddev_pop(F.when(F.col("d") > 0, F.col("d"))).alias("dev_ns"),
    )
    longest = sums.agg(F.max("span_ns").alias("longest"))
    rows = sums.join(F.broadcast(longest))  # one row
    named = F.lower(F.col(key).cast("string")).rlike("|".join(NO_BASELINE))
    rows = rows.withColumn("coverage", F.try_divide("span_ns", "longest"))
    rows = rows.where((F.col("n") >= settings.static_min_samples) & ~named & (F.col("coverage") >= settings.baseline_min_coverage))
    variation = F.coalesce(F.try_divide("dev_ns", "mean_ns"), F.lit(0.0))
    score = F.col("coverage") / (1 + variation) * F.log10(F.greatest(F.col("n"), F.lit(10)).cast("double"))
    return rows.select(key, "n", "coverage", score.alias("score"))


def residuals(streams: DataFrame, baseline: DataFrame, keys: list[str], clock_ns: str, bucket_width: int | None = None, known: Extent | None = None) -> DataFrame:
    """Each row's offset in ms from the nearest baseline time: keys, clock, near, offset_ms."""
    base = baseline.select(F.col(clock_ns)).withColumn("_all", F.lit(1))
    near = nearest(streams.withColumn("_all", F.lit(1)), base, ["_all"], clock_ns, bucket_width, known)
    return near.drop("_all").withColumn("offset_ms", (F.col(clock_ns) - F.col("near")) / 1e6)


def residual_stats(offsets: DataFrame, keys: list[str], settings: Settings = DEFAULTS, n: int | None = None) -> DataFrame:
    """Mean, largest and 95th percentile of the sizes, and median, 5th and 95th percentile of the signed offsets."""
    rows = offsets.where("offset_ms is not null").withColumn("_size", F.abs("offset_ms"))
    sums = [F.count("*").alias("n"), F.avg("_size").alias("mean_ms"), F.max("_size").alias("max_ms")]
    signed = {"signed_p05_ms": ("offset_ms", 0.05), "signed_median_ms": ("offset_ms", 0.5), "signed_p95_ms": ("offset_ms", 0.95)}
    return summaries(rows, keys, sums, {"p95_ms": ("_size", 0.95)} | signed, settings, n)


def base_offsets(streams: DataFrame, baseline: DataFrame, key: str, clock_ns: str, bucket_width: int | None = None, known: Extent | None = None) -> DataFrame:
    """For each baseline row and each stream the stream's nearest time: key, clock (the baseline's), near, offset_ms.

    The other direction of residuals. Streams are few: their names come to the driver.
    """
    names = [r[0] for r in streams.select(key).distinct().orderBy(key).collect()]
    if not names:
        return streams.select(key, clock_ns, F.col(clock_ns).alias("near"), F.lit(0.0).alias("offset_ms"))
    rows = baseline.select(F.explode(F.array(*map(F.lit, names))).alias(key), clock_ns).where(F.col(clock_ns).isNotNull())
    near = nearest(rows, streams.select(key, clock_ns), [key], clock_ns, bucket_width, known)
    return near.withColumn("offset_ms", (F.col("near") - F.col(clock_ns)) / 1e6)


def drift(offsets: DataFrame, keys: list[str], clock_ns: str, base_step_ms: float | Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Slope of base_offsets in ms per s, and whether it is drift: steeper than the limit and ranging over two base steps.

    Time is counted from the first row, so epochs keep their digits. Fewer than three offsets have no slope.
    """
    first = offsets.groupBy(*keys).agg(F.min(clock_ns).alias("_t0"))
    rows = same_keys(offsets.where("offset_ms is not null"), first, keys).withColumn("_s", (F.col(clock_ns) - F.col("_t0")) / 1e9)
    step = F.lit(base_step_ms) if isinstance(base_step_ms, float | int) else base_step_ms
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.regr_slope("offset_ms", "_s").alias("_slope"), (F.max("offset_ms") - F.min("offset_ms")).alias("_range")
    )
    three = F.col("_n") >= 3
    stats = stats.select(*keys, F.when(three, F.col("_slope")).alias("slope_ms_per_s"), F.when(three, F.col("_range")).alias("range_ms"))
    found = (F.abs("slope_ms_per_s") > settings.drift_ms_per_s) & (F.col("range_ms") > 2 * step)
    return stats.select(*keys, "slope_ms_per_s", "range_ms", F.coalesce(found, F.lit(False)).alias("drifts"))


def verdict(loss: Column, drifts: Column, max_residual_ms: Column, most_hz: Column, faults: Column, settings: Settings = DEFAULTS) -> Column:
    """fail for loss (never of bursts, whose loss is null) or drift; warn for a residual near the threshold, or disorder and
    duplicates; else pass."""
    limit = 1000 / most_hz * settings.residual_ratio
    return (
        F.when(F.coalesce(loss > settings.frame_loss, F.lit(False)) | F.coalesce(drifts, F.lit(False)), "fail")
        .when(F.coalesce(max_residual_ms > 0.75 * limit, F.lit(False)) | (faults > 0), "warn").otherwise("pass")
    )


def sync_report(
    frame: DataFrame, key: str, clock_ns: str, order: list[str], baseline: str | None = None, bucket_width: int | None = None, settings: Settings = DEFAULTS, bucket_rows: int | None = None
) -> DataFrame:
    """Checks, residuals and drift of every stream against a baseline (the best ranked if none is named), with a verdict.

    Bursts take no part in residuals and drift: nearest rows across bursts tell nothing. The fastest stream that is no burst
    sets the residual's limit.
    """
    known = extent(frame, clock_ns)
    if baseline is None:
        best = rank_baselines(frame, key, clock_ns, settings, bucket_width, known).orderBy(F.desc("score"), key).select(key).first()
        baseline = best[0] if best else None
    checks = staged(stream_checks(frame, [key], clock_ns, order, settings, bucket_width, bucket_rows, known), "checks")  # a row for each stream
    told = {r[key]: r for r in checks.select(key, "shape", "step_ns").collect()}
    base = frame.where(F.col(key) == F.lit(baseline)).select(key, clock_ns)
    steady = [k for k, r in told.items() if r["shape"] != "burst" and k != baseline and k is not None]
    others = frame.where(F.col(key).isin(*steady) if steady else F.lit(False)).select(key, clock_ns)
    found = residual_stats(residuals(others, base, [key], clock_ns, bucket_width, known).select(key, "offset_ms"), [key], settings, known.n).drop("n")
    step = (told[baseline]["step_ns"] or 0) / 1e6 if baseline in told else 0.0
    many = Extent(known.n * max(1, len(steady)))  # a row for each of the baseline's and each stream
    slopes = drift(base_offsets(others, base, key, clock_ns, bucket_width, many), [key], clock_ns, float(step), settings)
    report = checks.join(found, [key], "left").join(slopes, [key], "left")
    fastest = checks.agg(F.max(_unless_burst(F.col("rate_hz"))).alias("_hz"))
    report = report.join(F.broadcast(fastest))  # one row
    return report.select(
        *report.columns[:-1], F.lit(baseline).alias("baseline"),
        verdict(F.col("loss"), F.col("drifts"), F.col("max_ms"), F.col("_hz"), F.col("n_disorder") + F.col("n_duplicates"), settings).alias("verdict"),
    )


def clock_conflicts(frame: DataFrame, keys: list[str], clocks: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Shapes of burst streams under their alternative clocks (at most two that 99 % of rows have): keys, clock, coverage,
    main_shape, shape, rate_hz, suspected. A shape that differs tells that the first clock is when rows were written."""
    first, *others = clocks
    main = stream_shape(frame, keys, first, settings).where("shape = 'burst'").select(*keys, F.col("shape").alias("main_shape"))
    kind = dict(frame.select(*keys).dtypes)
    out = frame.sparkSession.createDataFrame([], ", ".join([*[f"`{k}` {kind[k]}" for k in keys], "clock string, coverage double, main_shape string, shape string, rate_hz double, suspected boolean"]))
    for other in others[:2]:
        cover = frame.groupBy(*keys).agg(F.avg(F.col(other).isNotNull().cast("double")).alias("coverage"))
        sums = _sums(frame, keys, other, settings, None).select(*keys, "shape", F.try_divide(F.col("n") - 1, F.col("span_ns") / 1e9).alias("rate_hz"))
        one = same_keys(same_keys(sums, cover.where("coverage >= 0.99"), keys), main, keys)
        out = out.union(one.select(*keys, F.lit(other).alias("clock"), "coverage", "main_shape", "shape", "rate_hz", (F.col("main_shape") != F.col("shape")).alias("suspected")))
    return out


def container_alignment(frame: DataFrame, container: str, sub: str, clock_ns: str, ratio: float = 0.05, settings: Settings = DEFAULTS, bucket_width: int | None = None) -> DataFrame:
    """Head and tail offset of each sub-stream from its container's master, the one with the longest span (ties by name).

    Offsets above ratio of the master's span are flagged. rate_hz is (n - 1) over the span. Bursts have a null n_gaps.
    """
    sums = _sums(frame, [container, sub], clock_ns, settings, bucket_width)
    w = Window.partitionBy(container).orderBy(F.desc("span_ns"), sub).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each sub-stream
    rows = sums.select("*", F.first(sub).over(w).alias("master"), F.first("head").over(w).alias("_h"), F.first("tail").over(w).alias("_t"))
    head, tail, span = F.col("head") - F.col("_h"), F.col("tail") - F.col("_t"), F.col("_t") - F.col("_h")
    return rows.select(
        container, sub, "master", "n", F.try_divide(F.col("n") - 1, F.col("span_ns") / 1e9).alias("rate_hz"),
        (head / 1e9).alias("head_offset_s"), (tail / 1e9).alias("tail_offset_s"), "shape", _unless_burst(F.col("n_gaps")).alias("n_gaps"),
        ((F.abs(head) > ratio * span) | (F.abs(tail) > ratio * span)).alias("flagged"),
    )


def camera_coverage(nodes: DataFrame) -> DataFrame:
    """Cameras that only the images or only the clocks of a container know: container, without_clock, without_images.

    nodes: container, camera, is_clock.
    """
    sides = nodes.groupBy("container").agg(
        F.collect_set(F.when(~F.col("is_clock"), F.col("camera"))).alias("images"), F.collect_set(F.when(F.col("is_clock"), F.col("camera"))).alias("clocks")
    )
    return sides.select("container", F.array_sort(F.array_except("images", "clocks")).alias("without_clock"), F.array_sort(F.array_except("clocks", "images")).alias("without_images"))


def master_clock(nodes: list[str]) -> str | None:
    """The clock of a container's nodes: main_timestamp, else the first one that is no camera's, else the first."""
    clocks = sorted(n for n in nodes if "timestamp" in n.lower())
    named = [n for n in clocks if n.rsplit("/", 1)[-1] == "main_timestamp"]
    return next(iter(named or [n for n in clocks if "cam" not in n.lower()] or clocks), None)


def frame_clock(frames: DataFrame, clock: DataFrame, index: str = "frame_index") -> DataFrame:
    """Frames with the master clock's columns, if their numbers are 0 to n - 1, each once, on both sides; else an error."""
    ends = [x.agg(F.count("*").alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).first() for x in (frames, clock)]
    if any(e.n != e.d or e.lo != 0 or e.hi != e.n - 1 for e in ends) or ends[0].n != ends[1].n:
        raise ValueError("the frame numbers of the two tables do not pair one to one")
    return frames.join(clock, index)
