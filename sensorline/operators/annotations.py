"""Annotations: validation, upsert with a change log, checks, snapshots and their differences.

Records are rows (scope, episode_key, id, start_s, end_s, source, ... ). Writers make a new version of a table; they never
change rows in place, so an upsert is a full outer join and the log its changed rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings

SCOPES = ("task", "segment")
SOURCES = ("user_confirmed", "imported", "signal_derived", "llm_proposed")
USES = ("training", "publication", "audit")
CONFIDENCES = ("high", "medium", "low")
HANDS = ("left", "right", "both", "none")
KEY = ["scope", "episode_key", "id"]


def parse_time(text: Column) -> Column:
    """Seconds of HH:MM:SS, MM:SS or seconds, with an optional minus; null where it cannot be read."""
    clean = F.trim(text)
    parts = F.transform(F.split(F.regexp_replace(clean, "^-", ""), ":"), lambda x: x.try_cast("double"))
    good = (clean != "") & (F.size(parts) <= 3) & ~F.exists(parts, lambda x: x.isNull())
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x)
    return F.when(good, F.when(clean.startswith("-"), -total).otherwise(total))


def format_time(seconds: Column) -> Column:
    """HH:MM:SS of seconds, rounded to even; empty for null."""
    whole = F.abs(F.bround(seconds).cast("bigint"))
    text = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(seconds.isNull(), "").otherwise(F.concat(F.when(F.bround(seconds) < 0, "-").otherwise(""), text))


def normalise(records: DataFrame) -> DataFrame:
    """Records with their defaults: an empty source is a model's proposal, confidence follows the source (high for what a
    user confirmed, low for proposals, else medium), and times may come as texts in start_timestamp and end_timestamp."""
    has, blank = records.columns, lambda c: F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit(""))
    source = F.coalesce(blank("source") if "source" in has else F.lit(None), F.lit("llm_proposed"))
    rows = records.withColumn("source", source)
    usual = F.when(F.col("source") == "user_confirmed", "high").when(F.col("source") == "llm_proposed", "low").otherwise("medium")
    rows = rows.withColumn("confidence", F.coalesce(blank("confidence") if "confidence" in has else F.lit(None), usual))
    for name, text in (("start_s", "start_timestamp"), ("end_s", "end_timestamp")):
        given = F.col(name).cast("double") if name in has else F.lit(None).cast("double")
        rows = rows.withColumn(name, F.coalesce(given, parse_time(F.col(text))) if text in has else given)
    return rows.withColumn("id", F.coalesce("id", F.lit(1)) if "id" in has else F.lit(1))


def validate(records: DataFrame) -> DataFrame:
    """The records with errors: an array of what is wrong with each (scope, source, confidence, key, times that are missing
    or reversed, noise without a reason, a task without a label, an unknown hand)."""
    has = records.columns
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == "" if c in has else F.lit(True)
    wrong = {
        "scope": ~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)),
        "source": ~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)),
        "confidence": ~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(True)) if "confidence" in has else F.lit(False),
        "episode_key": empty("episode_key"),
        "id": F.col("id").isNull(),
        "times": (F.col("scope") == "segment") & ~F.coalesce((F.col("start_s") >= 0) & (F.col("end_s") >= F.col("start_s")), F.lit(False)),
        "noise_reason": F.coalesce(F.col("is_noise"), F.lit(False)) & empty("cleaning_reason") if "is_noise" in has else F.lit(False),
        "task": (F.col("scope") == "task") & empty("label"),
        "hand": ~F.coalesce(F.trim("interacting_hand").isin("", *HANDS), F.lit(True)) if "interacting_hand" in has else F.lit(False),
    }
    return records.withColumn("errors", F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in wrong.items()])))


def with_times(records: DataFrame) -> DataFrame:
    """The records with their times as text, too: start_timestamp and end_timestamp."""
    return records.withColumns({"start_timestamp": format_time(F.col("start_s")), "end_timestamp": format_time(F.col("end_s"))})


def upsert(stored: DataFrame, incoming: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """(new table, log). By key the last incoming row wins; rows equal to the stored ones are skipped.

    The log has action (added, modified, skipped) for each incoming key. Columns are those of the stored table.
    """
    columns = [c for c in stored.columns if c not in KEY]
    last = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc(order)))
    new = incoming.withColumn("_n", last).where("_n = 1").select(*KEY, F.struct(*columns).alias("_new"))
    both = stored.select(*KEY, F.struct(*columns).alias("_old")).join(new, KEY, "full_outer")
    action = F.when(F.col("_new").isNull(), F.lit(None)).when(F.col("_old").isNull(), "added").when(F.col("_old").eqNullSafe(F.col("_new")), "skipped").otherwise("modified")
    both = both.withColumn("action", action)
    kept = both.select(*KEY, F.coalesce("_new", "_old").alias("_r")).select(*KEY, "_r.*").select(*stored.columns)
    return kept, both.where("action is not null").select(*KEY, "action")


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, state (added, removed, modified, unchanged) and the names of the columns that changed."""
    keys = keys or ["episode_key", "id"]
    columns = [c for c in old.columns if c not in keys and c in new.columns]
    a, b = old.select(*keys, F.struct(*columns).alias("_a")), new.select(*keys, F.struct(*columns).alias("_b"))
    both = a.join(b, keys, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    inner = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "modified").otherwise("unchanged")
    return both.select(*keys, state.alias("state"), F.when(inner, changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def check_source(records: DataFrame, use: str) -> DataFrame:
    """Records whose source the use does not admit: training takes confirmed and imported ones only."""
    if use not in USES:
        raise ValueError(f"use must be one of {USES}")
    banned = {"training": ("llm_proposed", "signal_derived"), "publication": (), "audit": ()}[use]
    return records.where(F.col("source").isin(*banned) if banned else F.lit(False))


def must_declare(records: DataFrame, use: str) -> DataFrame:
    """Records that a publication must declare as generated."""
    return records.where(F.col("source").isin("llm_proposed", "signal_derived") & F.lit(use == "publication"))


def _rule(rows: DataFrame, rule: str, level: str, value: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(level).alias("level"), F.col("episode_key").cast("string"), F.col("id").cast("bigint"), value.cast("double").alias("value"))


def check_annotations(
    records: DataFrame, use: str = "audit", durations: DataFrame | None = None, vocabulary: DataFrame | None = None, settings: Settings = DEFAULTS
) -> DataFrame:
    """Findings: rule, level (fail or warn), episode_key, id, value. No finding means pass.

    Fails: time_overlap, bounds_exceeded, non_monotonic_ids, noise_reason_empty, source_for_declared_use. Warnings:
    time_gap, segment_too_short, segment_too_long, missing_hand, action_vocab_offlist, category_imbalance. Neighbours are
    taken in order of start and id inside each episode. Columns that the records lack switch their rule off.
    """
    segments = records.where("scope = 'segment'") if "scope" in records.columns else records
    w = Window.partitionBy("episode_key").orderBy(F.coalesce("start_s", F.lit(0.0)), "id")
    rows = segments.withColumn("_end", F.lag("end_s").over(w)).withColumn("_id", F.lag("id").over(w))
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("episode_key", "id")))
    gap, length = F.col("start_s") - F.col("_end"), F.col("end_s") - F.col("start_s")
    found = [
        _rule(rows.where(gap < -1e-9), "time_overlap", "fail", -gap),
        _rule(rows.where((F.col("id") < F.col("_id")) | (F.col("_n") > 1)), "non_monotonic_ids", "fail", F.col("_n")),
        _rule(rows.where(gap > settings.max_gap_s), "time_gap", "warn", gap),
        _rule(rows.where(length < settings.min_segment_s), "segment_too_short", "warn", length),
        _rule(rows.where(length > settings.max_segment_s), "segment_too_long", "warn", length),
    ]
    if durations is not None:
        over = segments.join(durations, "episode_key").where(F.col("end_s") > F.col("duration_s") + settings.max_gap_s)
        found.append(_rule(over, "bounds_exceeded", "fail", F.col("end_s") - F.col("duration_s")))
    if {"is_noise", "cleaning_reason"} <= set(segments.columns):
        found.append(_rule(segments.where(F.col("is_noise") & (F.coalesce(F.trim("cleaning_reason"), F.lit("")) == "")), "noise_reason_empty", "fail", F.lit(None)))
    if {"target_object_class", "interacting_hand"} <= set(segments.columns):
        hand, thing = F.coalesce(F.trim("interacting_hand"), F.lit("")), F.coalesce("target_object_class", F.lit(""))
        odd = ((thing != "") & hand.isin("", "none")) | ((hand != "") & ~hand.isin(*HANDS))
        found.append(_rule(segments.where(odd), "missing_hand", "warn", F.lit(None)))
    if "atomic_action" in segments.columns:
        named = segments.where(F.trim("atomic_action") != "")
        if vocabulary is not None:
            found.append(_rule(named.join(vocabulary.select(F.col("action").alias("atomic_action")), "atomic_action", "left_anti"), "action_vocab_offlist", "warn", F.lit(None)))
        counts = named.groupBy("atomic_action").agg(F.count("*").alias("n"))
        top = counts.agg(F.max("n").alias("top"), F.sum("n").alias("all")).where("all >= 5 and top > 0.8 * all")
        found.append(_rule(top.withColumns({"episode_key": F.lit(None), "id": F.lit(None)}), "category_imbalance", "warn", F.col("top") / F.col("all")))
    if "source" in records.columns:
        found.append(_rule(check_source(records, use), "source_for_declared_use", "fail", F.lit(None)))
    return reduce(DataFrame.unionByName, found)


def episode_anchors(frame: DataFrame, episode: str | None, clock_s: str | None, row: str, fps: float | None = None) -> DataFrame:
    """One row for each episode (or one, all, for the whole table): episode_key, start_s, end_s, duration_s, first_row,
    last_row, n_rows. Null episodes too."""
    t = F.col(clock_s) if clock_s else F.col(row) / F.lit(fps) if fps else F.lit(None).cast("double")
    key = F.col(episode).cast("string") if episode else F.lit("all")
    sums = frame.groupBy(key.alias("episode_key")).agg(
        F.min(t).alias("start_s"), F.max(t).alias("end_s"), F.min(row).alias("first_row"), F.max(row).alias("last_row"), F.count("*").alias("n_rows")
    )
    return sums.withColumn("duration_s", F.col("end_s") - F.col("start_s"))
