"""Action boundaries from motion: change points, gripper flips, spikes and pauses, then segments.

All steps are windows, joins by row number and aggregates over (episode, row); row counts each episode's rows from 0. Window
widths follow an episode's length, so moving means use running sums, each sent to the rows whose windows it bounds. The choice of boundaries that keep their
distance is sequential: it folds an episode's sorted array of up to FOLD boundaries; in longer episodes every boundary finds its
successor, and pointers that double in reach mark those that follow from the first, so no episode is ever one row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from ..storage import staged
from .windows import around, extent, filled, neighbours, running_sum, same_keys, summaries


def motion_columns(frame: DataFrame, columns: list[str]) -> list[str]:
    """Columns with more than five distinct values."""
    if not columns:
        return []
    counts = frame.agg(*[F.count_distinct(c).alias(c) for c in columns]).first()
    return [c for c in columns if counts[c] > 5]


def motion_steps(long: DataFrame, keys: list[str], row: str) -> DataFrame:
    """keys, row, channel, d and dd: size of the step to a row and second difference at it, gaps filled; null at the ends."""
    own, known = [*keys, "channel"], extent(long, row, keys=[*keys, "channel"])
    near = neighbours(filled(long, own, row, ["x"], known), own, [row], {"_p": ("x", -1), "_n": ("x", 1)}, known=known)
    return near.select(*own, row, F.abs(F.col("x") - F.col("_p")).alias("d"), (F.col("_p") - 2 * F.col("x") + F.col("_n")).alias("dd"))


def speed_profile(steps: DataFrame, keys: list[str], row: str, settings: Settings = DEFAULTS) -> DataFrame:
    """keys, row, speed: mean over channels of each step's size over its 95th percentile; row 0 repeats row 1.

    Channels that do not move are left out.
    """
    from .quality import mean_speed

    moving = mean_speed(steps.where("d is not null"), keys, row, settings)
    rows = F.when(F.col(row) == 1, F.array(F.col(row) - 1, F.col(row))).otherwise(F.array(row))
    return moving.select(*keys, F.explode(rows).alias(row), "speed")


def _bounded(rows: DataFrame, ends: DataFrame, keys: list[str], row: str, value: str, starts: dict[str, Column]) -> DataFrame:
    """keys, row and for each of starts the sum of the values before row + start, null where that is no row from 1 to n.

    Every running sum is sent to the rows that ask for it. ends has a row for each of the keys, with n and what starts need.
    """
    sums = running_sum(rows.select(*keys, row, value), keys, [row], value, "_s").join(ends, keys)
    asking = F.array(*[F.struct((F.col(row) + 1 - start).alias(row), F.lit(i).alias("_i"), F.col("_s").alias("_s")) for i, start in enumerate(starts.values())])
    sent = sums.select(*keys, "n", F.explode(asking).alias("_a")).where(f"_a.`{row}` >= 0 and _a.`{row}` < n")
    return sent.groupBy(*keys, F.col(f"_a.{row}").alias(row)).agg(*[F.max(F.when(F.col("_a._i") == i, F.col("_a._s"))).alias(name) for i, name in enumerate(starts)])


def smoothed(speed: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Moving mean of the speed over max(3, n // 100) rows (made odd); the ends repeat the first and last value."""
    ends = speed.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by("speed", row).alias("_x0"), F.max_by("speed", row).alias("_x1"), F.sum("speed").alias("_all"))
    ends = staged(ends.withColumn("h", F.floor(F.greatest(F.lit(3), F.floor(F.col("n") / 100)) / 2)), "ends")  # its size is known, so that rows need not move
    rows = _bounded(speed, ends.select(*keys, "n", "h"), keys, row, "speed", {"_lo": -F.col("h"), "_hi": F.col("h") + 1}).join(ends, keys)
    left, right = F.greatest(F.lit(0), F.col("h") - F.col(row)), F.greatest(F.lit(0), F.col(row) + F.col("h") + 1 - F.col("n"))
    inside = F.coalesce("_hi", "_all") - F.coalesce("_lo", F.lit(0.0))
    mean = (inside + left * F.col("_x0") + right * F.col("_x1")) / (2 * F.col("h") + 1)
    return rows.where("n >= 8").select(*keys, row, "n", mean.alias("speed"))


def _stretches(rows: DataFrame, keys: list[str], row: str) -> DataFrame:
    """Rows with _run, the same for those whose numbers follow each other."""
    near = neighbours(rows, keys, [row], {"_was": (row, -1)})
    new = F.coalesce(F.col(row) - F.col("_was") > 1, F.lit(True)).cast("int")
    return running_sum(near.withColumn("_new", new), keys, [row], "_new", "_run")


def change_points(speed: DataFrame, keys: list[str], row: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows where the mean speed of the window behind and ahead differ most, one for each stretch of large differences.

    Windows have min(25, max(3, n // 50)) rows; a difference is large above change_point_ratio medians. From 8 rows on.
    """
    rows = staged(smoothed(speed, keys, row), "smoothed")
    ends = staged(rows.groupBy(*keys).agg(F.max("n").alias("n")).withColumn("w", F.least(F.lit(25), F.greatest(F.lit(3), F.floor(F.col("n") / 50)))), "widths")
    sums = _bounded(rows, ends, keys, row, "speed", {"_a": -F.col("w"), "_b": F.lit(0), "_c": F.col("w")})
    inner = sums.join(ends, keys).where((F.col(row) >= F.col("w")) & (F.col(row) + F.col("w") <= F.col("n")))
    size = F.abs(F.col("_c") - F.col("_b") - (F.col("_b") - F.coalesce("_a", F.lit(0.0)))) / F.col("w")
    shift = staged(inner.select(*keys, row, size.alias("shift")), "shift")
    middle = staged(summaries(shift, keys, [], {"_m": ("shift", 0.5)}, settings), "middle")
    hot = shift.join(middle, keys).where((F.col("_m") > 0) & (F.col("shift") > settings.change_point_ratio * F.col("_m")))
    marked = _stretches(hot, keys, row)
    best = marked.groupBy(*keys, "_run").agg(F.max_by(row, F.struct("shift", -F.col(row))).alias("boundary"))
    return best.select(*keys, "boundary", F.lit("velocity").alias("evidence"))


def gripper_flips(frame: DataFrame, keys: list[str], row: str, gripper: str) -> DataFrame:
    """Rows where the gripper, scaled between its extremes, crosses one half."""
    ends = frame.groupBy(*keys).agg(F.min(gripper).alias("_lo"), F.max(gripper).alias("_hi")).where("_hi > _lo")
    open_ = (F.col(gripper) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) > 0.5
    rows = frame.where(F.col(gripper).isNotNull()).select(*keys, row, gripper).join(ends, keys).withColumn("_o", open_)
    return neighbours(rows, keys, [row], {"_p": ("_o", -1)}).where("_o <> _p").select(*keys, F.col(row).alias("boundary"), F.lit("gripper").alias("evidence"))


def spikes(steps: DataFrame, keys: list[str], row: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows after a second difference above the upper quartile by a large multiple of the quartile distance."""
    dd = steps.where("dd is not null").withColumn("a", F.abs("dd"))
    q = summaries(dd, [*keys, "channel"], [], {"_low": ("a", 0.25), "_high": ("a", 0.75)}, settings)
    limit = F.col("_high") + settings.spike_factor / 5 * (F.col("_high") - F.col("_low"))
    hits = dd.join(q, [*keys, "channel"]).where((F.col("a") > limit) & (F.col("_high") > F.col("_low")))
    return hits.select(*keys, (F.col(row) + 1).alias("boundary"), F.lit("spike").alias("evidence")).distinct()


def pause_ends(speed: DataFrame, keys: list[str], row: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Rows after stretches of at least max(min_pause_steps, 2 % of rows) that are slower than a tenth of the median."""
    stats = summaries(speed, keys, [F.count("*").alias("n"), F.min("speed").alias("_lo")], {"_m": ("speed", 0.5)}, settings)
    stats = staged(stats, "speed-stats")
    slow = speed.join(stats, keys).where(F.col("speed") < F.greatest(settings.segment_idle_speed * F.col("_m"), F.col("_lo")))
    found = _stretches(slow, keys, row).groupBy(*keys, "_run").agg(F.count("*").alias("n_rows"), F.max(row).alias("_last"), F.first("n").alias("n"))
    long = found.where(F.col("n_rows") >= F.greatest(F.lit(settings.min_pause_steps), F.floor(F.col("n") * 0.02)))
    after = F.col("_last") + 1
    return long.where(after < F.col("n")).select(*keys, after.alias("boundary"), F.lit("pause").alias("evidence"))


#: Boundaries of an episode that are folded as one array.
FOLD = 2_000


def spaced(boundaries: Column, gap: Column) -> Column:
    """Of a sorted array those that lie at least gap after the last one kept."""
    empty = F.array().cast("array<bigint>")
    return F.aggregate(
        boundaries, empty,
        lambda kept, b: F.when((F.size(kept) == 0) | (b - F.element_at(kept, F.greatest(F.size(kept), F.lit(1))) >= gap), F.concat(kept, F.array(b.cast("bigint")))).otherwise(kept),
    )


class Axis:
    """Seconds of rows: of a clock counted from each episode's first time, else rows over a rate, else unknown.

    lengths: keys, n and fps, the rows a second of an episode (by the clock's first and last row where there is one).
    """

    def __init__(self, frame: DataFrame, keys: list[str], row: str, fps: float | None, clock_s: str | None):
        self.keys, self.times = keys, None
        rate = F.lit(fps).cast("double")
        if clock_s:
            first = frame.groupBy(*keys).agg(F.min(clock_s).alias("_t0"))
            rows = frame.select(*keys, F.col(row).alias("_at"), F.col(clock_s).cast("double").alias("_t"))
            self.times = staged(same_keys(rows, first, keys).select(*keys, "_at", (F.col("_t") - F.col("_t0")).alias("_s")), "times")
            span = F.max_by("_s", "_at") - F.min_by("_s", "_at")
            own = F.when(span > 0, (F.count("*") - 1) / span)
            self.lengths = self.times.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(own, rate).alias("fps"))
        else:
            self.lengths = frame.groupBy(*keys).agg(F.count("*").alias("n"), F.max(rate).alias("fps"))
        self.lengths = staged(self.lengths, "lengths")

    def place(self, segments: DataFrame) -> DataFrame:
        """Segments with start_s and end_s, the time of the row after the last (at the end of the last), and fps."""
        rows = same_keys(segments, self.lengths, self.keys)
        if self.times is None:
            return rows.withColumns({"start_s": F.col("start_frame") / F.col("fps"), "end_s": (F.col("end_frame") + 1) / F.col("fps")}).drop("n")
        rows = rows.withColumn("_end", F.least(F.col("end_frame") + 1, F.col("n") - 1))
        for at, name in (("start_frame", "start_s"), ("_end", "end_s")):
            rows = same_keys(rows, self.times.select(*self.keys, F.col("_at").alias(at), F.col("_s").alias(name)), [*self.keys, at], "left")
        return rows.withColumn("end_s", F.greatest("start_s", "end_s")).drop("n", "_end")


def _followed(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, boundary: those kept of each episode, from (keys, boundary, gap): the first, then always the first one at least gap
    after the last kept. log2 of the number kept rounds of joins."""
    ahead = boundaries.select(*keys, "boundary", (F.col("boundary") + F.col("gap")).alias("_at"))
    # successor: the first boundary at or after this one plus the gap
    found = around(ahead, boundaries.select(*keys, F.col("boundary").alias("_at")), keys, "_at")
    jumps = staged(found.select(*keys, "boundary", F.col("high").alias("next")).where("next is not null"), "jumps")
    reached = staged(boundaries.groupBy(*keys).agg(F.min("boundary").alias("boundary")), "reached")
    while True:
        further = staged(same_keys(jumps, reached, [*keys, "boundary"]).select(*keys, F.col("next").alias("boundary")).distinct(), "further")
        if further.isEmpty():
            return reached
        reached = staged(reached.unionByName(further), "reached")  # jumps of a new length: these are all new
        onward = jumps.select(*keys, F.col("boundary").alias("next"), F.col("next").alias("_then"))
        jumps = staged(same_keys(jumps, onward, [*keys, "next"]).select(*keys, "boundary", F.col("_then").alias("next")), "jumps")


def kept_boundaries(boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, boundary: of (keys, boundary, gap), each once, those that keep their distance from the one kept before."""
    sizes = boundaries.groupBy(*keys).agg(F.count("*").alias("_n"))
    short = same_keys(boundaries, sizes.where(F.col("_n") <= FOLD), keys)
    lists = short.groupBy(*keys).agg(F.array_sort(F.collect_list("boundary")).alias("_all"), F.first("gap").alias("gap"))
    folded = lists.select(*keys, F.explode(spaced(F.col("_all"), F.col("gap"))).alias("boundary"))
    if sizes.where(F.col("_n") > FOLD).isEmpty():
        return folded
    long = staged(same_keys(boundaries, sizes.where(F.col("_n") > FOLD), keys).drop("_n"), "long-episodes")
    return folded.unionByName(_followed(long, keys))


def to_segments(found: DataFrame, lengths: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """keys, start_frame, end_frame (inclusive), evidence of the start: boundaries at least a quarter of min_segment_s apart.

    lengths has keys, n and fps (null: boundaries need be one row apart). Episodes without a boundary are one segment.
    """
    gap = F.coalesce(F.greatest(F.lit(1), F.bround(settings.min_segment_s / 4 * F.col("fps")).cast("bigint")), F.lit(1)).cast("bigint")
    inside = same_keys(found, lengths, keys).where((F.col("boundary") > 0) & (F.col("boundary") < F.col("n")))
    kinds = inside.groupBy(*keys, F.col("boundary").cast("bigint").alias("boundary"), gap.alias("gap")).agg(F.array_join(F.array_sort(F.collect_set("evidence")), "+").alias("evidence"))
    kinds = staged(kinds, "boundary-kinds")
    kept = kept_boundaries(kinds.select(*keys, "boundary", "gap"), keys)
    starts = lengths.select(*keys, F.lit(0).cast("bigint").alias("start_frame")).unionByName(kept.select(*keys, F.col("boundary").alias("start_frame")))
    ends = neighbours(starts, keys, ["start_frame"], {"_next": ("start_frame", 1)})
    out = same_keys(ends, lengths, keys).withColumn("end_frame", F.coalesce("_next", F.col("n")) - 1)
    out = same_keys(out, kinds.select(*keys, F.col("boundary").alias("start_frame"), "evidence"), [*keys, "start_frame"], "left")
    return out.select(*keys, "start_frame", "end_frame", F.coalesce("evidence", F.lit("start")).alias("evidence"))


def split_long(segments: DataFrame, speed: DataFrame, keys: list[str], row: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Cut segments (with start_s and end_s) above max_segment_s near equal parts, each time at the slowest row around the
    ideal place."""
    size = F.col("end_frame") - F.col("start_frame") + 1
    parts = F.ceil((F.col("end_s") - F.col("start_s")) / settings.max_segment_s)
    cuts = segments.withColumn("_size", size).withColumn("_parts", parts).where((F.col("_parts") > 1) & (F.col("_size") >= F.col("_parts")))
    cuts = cuts.select(*keys, "start_frame", "end_frame", "_size", "_parts", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_parts") - 1)).alias("_k"))
    target = F.col("start_frame") + F.bround(F.col("_size") * F.col("_k") / F.col("_parts")).cast("bigint")
    around = F.greatest(F.lit(1), F.floor(F.col("_size") / (F.col("_parts") * 4)))
    cuts = cuts.withColumn("_lo", F.greatest(F.col("start_frame") + 1, target - around)).withColumn("_hi", F.least(F.col("end_frame"), target + around))
    places = cuts.select(*keys, "start_frame", "_k", target.alias("_target"), F.explode(F.sequence("_lo", F.greatest("_lo", F.col("_hi") - 1))).alias(row))
    slow = F.min_by(row, F.struct(F.coalesce("speed", F.lit(float("inf"))), F.col(row)))
    at = same_keys(places, speed, [*keys, row], "left").groupBy(*keys, "start_frame", "_k").agg(slow.alias("cut"))
    new = at.groupBy(*keys, "start_frame").agg(F.array_sort(F.collect_set("cut")).alias("_cuts"))
    whole = same_keys(segments, new, [*keys, "start_frame"], "left").withColumn("_from", F.col("start_frame"))
    starts = whole.select(*keys, "end_frame", "evidence", "_from", F.explode(F.concat(F.array("_from"), F.coalesce("_cuts", F.array().cast("array<bigint>")))).alias("start_frame"))
    w = Window.partitionBy(*keys, "_from").orderBy("start_frame")
    return starts.select(
        *keys, "start_frame", F.coalesce(F.lead("start_frame").over(w) - 1, F.col("end_frame")).alias("end_frame"),
        F.when(F.col("start_frame") == F.col("_from"), F.col("evidence")).otherwise("split").alias("evidence"),
    )


def merge_short(segments: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Runs of segments (with start_s and end_s) below min_segment_s join the next long enough one, at the end the one
    before; if none is, all stay. Segments without times stay."""
    w, back = Window.partitionBy(*keys).orderBy("start_frame"), Window.partitionBy(*keys).orderBy(F.desc("start_frame"))
    good = F.when(F.coalesce(F.col("end_s") - F.col("start_s") >= settings.min_segment_s - 1e-9, F.lit(True)), F.col("start_frame"))
    rows = segments.withColumn("_good", good)
    group = F.coalesce(
        F.last("_good", True).over(back.rowsBetween(Window.unboundedPreceding, 0)), F.last("_good", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("start_frame")
    )
    kept = F.max_by("evidence", F.struct(F.col("_good").isNotNull(), -F.col("start_frame")))
    return rows.withColumn("_g", group).groupBy(*keys, "_g").agg(F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), kept.alias("evidence")).drop("_g")


def segment_actions(
    frame: DataFrame, keys: list[str], row: str, motion: list[str], gripper: str | None, fps: float | None, settings: Settings = DEFAULTS, clock_s: str | None = None
) -> DataFrame:
    """Segments of every episode: keys, id, start_frame, end_frame, start_s, end_s, evidence.

    Times follow the clock, in seconds, where there is one, else the rate; with neither they are null, and segments are
    neither split nor merged by length. Without motion columns and gripper there is no signal: an error, never segments of
    equal length.
    """
    if not motion and not gripper:
        raise ValueError("no signal to segment by")
    from .quality import channels

    axis = Axis(frame, keys, row, fps, clock_s)
    found, speed = [], None
    if motion:
        steps = staged(motion_steps(staged(channels(frame, keys, row, motion), "channels"), keys, row), "steps")
        speed = staged(speed_profile(steps, keys, row, settings), "speed")  # read by five steps
        found += [change_points(speed, keys, row, settings), spikes(steps, keys, row, settings), pause_ends(speed, keys, row, settings)]
    if gripper:
        found.append(gripper_flips(frame, keys, row, gripper))
    out = staged(to_segments(staged(reduce(DataFrame.unionByName, found), "boundaries"), axis.lengths, keys, settings), "segments")
    if speed is not None:
        out = split_long(axis.place(out), speed, keys, row, settings)
    out = merge_short(axis.place(out), keys, settings)
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("start_frame"))
    return axis.place(out).select(*keys, nth.alias("id"), "start_frame", "end_frame", "start_s", "end_s", "evidence")
