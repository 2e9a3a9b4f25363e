"""Times of video frames from side tables, and rates of videos checked against lists of frame times.

A side table has a row for each exposure of a camera. Videos are keys of one long frame; frames are numbered from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .windows import Extent, extent, neighbours, running_sum, same_keys, summaries

#: Words of names that speak of a real clock, and of numbers of frames (fixed values).
REAL_CLOCK = ("utc", "epoch", "real", "host")
FRAME_NUMBER = ("pts", "packet", "frame_index", "frame_id", "_idx")
#: Frames that one row is spread over at once.
STRETCH = 4_096


def numbers_frames(column: str) -> bool:
    """Whether a side table's column numbers frames and tells no time: words for real clocks and suffixes of units come before
    words for frames, so pts_us is a time and pts is none."""
    low = column.lower()
    if any(w in low for w in REAL_CLOCK) or re.search(r"_(ns|us|ms|s)$", low):
        return False
    return any(w in low for w in FRAME_NUMBER)


def is_side_table(stem: str, clock: str | None) -> bool:
    """Whether a table holds frames: its name says so, or its clock is of frames or exposures. A table with any other clock is data."""
    return stem.lower().endswith("_metainfo") or bool(re.match(r"exposure_|frame_|(pts|pts_us|frame|packet_index)$", (clock or "").lower().strip()))


def frame_times(sides: DataFrame, media: DataFrame, key: str, settings: Settings = DEFAULTS, known: Extent | None = None) -> DataFrame:
    """key, frame, t and how, for each frame whose time can be told. sides: key, t (ns); media: key, n_frames, a row for each key.

    Rows in order of their clock are the frames (how: row) if there are as many of them as frames, or the frames are not counted. Else
    the steps between clocks tell which frames lack a row: a step of about k medians goes k frames on. A frame takes the first clock
    that falls on it (row); frames without one lie evenly between their neighbours (between), those behind the last one follow by the
    median step (after), and rows behind the last frame are left out. Without any step only frame 0 has a time. Null clocks are no
    rows; a key on one side only has no frames; keys that are null are equal.
    """
    rows = sides.select(key, "t").where("t is not null")
    known = known or extent(rows, "t")
    clocks = rows.groupBy(key, "t").agg(F.count("*").alias("_k"))
    steps = neighbours(clocks, [key], ["t"], {"_p": ("t", -1)}, known=known).withColumn("_d", F.col("t") - F.col("_p"))
    sums = summaries(steps, [key], [F.sum("_k").alias("_n")], {"_step": ("_d", 0.5)}, settings, known.n)
    counts = same_keys(sums, media.select(key, "n_frames"), [key])
    plain = F.col("n_frames").isNull() | (F.col("n_frames") == F.col("_n"))
    told = same_keys(steps, counts.select(key, "_step", "n_frames", plain.alias("_plain")), [key])
    on = F.coalesce(F.round(F.col("_d") / F.col("_step")), F.lit(0)).cast("bigint")
    placed = running_sum(told.withColumn("_on", F.when(F.col("_plain"), F.col("_k")).otherwise(on)), [key], ["t"], "_on", "_sum", known)
    placed = placed.withColumn("_at", F.when(F.col("_plain"), F.col("_sum") - F.col("_k")).otherwise(F.col("_sum")))
    placed = placed.where(F.col("_plain") | (F.col("_on") > 0) | F.col("_p").isNull()).select(key, "t", "_k", "_step", "n_frames", "_plain", "_at")
    ahead = neighbours(placed, [key], ["t"], {"_t2": ("t", 1), "_at2": ("_at", 1)}, known=known)
    last = F.when(F.col("_step").isNull(), F.col("_at") + 1).otherwise(F.greatest(F.col("_at") + 1, F.col("n_frames")))
    end = F.when(F.col("_plain"), F.col("_at") + F.col("_k")).otherwise(F.least(F.coalesce("_at2", last), F.col("n_frames")))
    ahead = ahead.withColumn("_end", end).where(F.col("_at") < F.col("_end"))
    ahead = ahead.withColumn("_from", F.explode(F.sequence("_at", F.col("_end") - 1, F.lit(STRETCH).cast("bigint"))))
    each = ahead.withColumn("frame", F.explode(F.sequence("_from", F.least(F.col("_from") + STRETCH, F.col("_end")) - 1, F.lit(1).cast("bigint"))))
    past = F.col("frame") - F.col("_at")
    pace = F.coalesce((F.col("_t2") - F.col("t")) / (F.col("_at2") - F.col("_at")), F.col("_step"))
    own = F.col("_plain") | (past == 0)
    return each.select(
        key, "frame", F.when(own, F.col("t")).otherwise(F.col("t") + F.round(past * pace).cast("bigint")).alias("t"),
        F.when(own, "row").when(F.col("_t2").isNotNull(), "between").otherwise("after").alias("how"),
    )


def check_rates(media: DataFrame, sides: DataFrame, key: str) -> DataFrame:
    """key, fps, side_hz, contradicts, rate_hz and source of each video of media (key, fps), by the times of its frames (key, t in ns).

    side_hz is steps over span (null below two clocks or without a span). Where it is off by more than a tenth and by more than one
    frame a second, or no rate is given, it is the video's rate: headers of raw streams are wrong more often than lists of frames.
    """
    sums = sides.where("t is not null").groupBy(key).agg(F.count("*").alias("_n"), (F.max("t") - F.min("t")).alias("_span"))
    hz = F.when(F.col("_span") > 0, (F.col("_n") - 1) / (F.col("_span") / 1e9))
    rows = same_keys(media.select(key, F.col("fps").cast("double").alias("fps")), sums.select(key, hz.alias("side_hz")), [key], "left")
    off = F.coalesce(F.abs(F.col("side_hz") - F.col("fps")) > F.greatest(F.lit(1.0), 0.1 * F.col("fps")), F.lit(False))
    by_side = F.col("side_hz").isNotNull() & (off | F.col("fps").isNull())
    return rows.select(
        key, "fps", "side_hz", off.alias("contradicts"), F.when(by_side, F.round("side_hz", 3)).otherwise(F.col("fps")).alias("rate_hz"),
        F.when(by_side, "side list").when(F.col("fps").isNotNull(), "header").alias("source"),
    )
