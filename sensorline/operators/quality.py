"""Dataset quality: six gates that may fail a dataset and eight diagnostics that may only warn.

Rows are a long frame (keys of the episode, an ordinal within it, channel, value) wherever channels are checked alike, so
the number of channels never adds jobs. Diagnostics never look across the border of an episode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from ..storage import staged
from .stats import bad_value_ratios, numeric_columns, rolling_mean
from .windows import Extent, extent, finite, neighbours, runs, same_keys, summaries

#: Substrings of names that mark columns as no action (fixed values).
NO_ACTION = ("timestamp", "time", "ts", "frame", "index", "episode", "fps", "sequence", "step", "id")
#: What the names of action and of state columns begin with (fixed values).
ACTION_PREFIXES = ("action_", "actions.", "actions_", "action.")
STATE_PREFIXES = ("observation.state.", "observation_state.", "obs_", "state_", "state.", "qpos_")


def action_columns(frame: DataFrame) -> list[str]:
    """Numeric columns whose names hold none of the hints of an index or clock."""
    return [c for c in numeric_columns(frame) if not any(h in c.lower().strip() for h in NO_ACTION)]


def pair_action_state(columns: list[str]) -> list[tuple[str, str]]:
    """Action columns with the state column of the same name behind the prefix, whatever dots and underscores stand around it."""
    def stem(c: str, prefixes: tuple[str, ...]) -> str | None:
        own = max((p for p in prefixes if c.lower().startswith(p)), key=len, default=None)
        return None if own is None else c.lower()[len(own) :].strip("._")

    states = {s: c for c in columns if (s := stem(c, STATE_PREFIXES)) is not None}
    return [(c, states[s]) for c in columns if (s := stem(c, ACTION_PREFIXES)) is not None and s in states]


def channels(frame: DataFrame, keys: list[str], order: str, columns: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """keys, order, channel, x: finite values of all channels in long form (others null), and columns to keep as they are."""
    pairs = F.array(*[F.struct(F.lit(c).alias("channel"), finite(f"`{c}`").alias("x")) for c in columns])
    return frame.select(*keys, order, *also, F.explode(pairs).alias("_c")).select(*keys, order, *also, "_c.channel", "_c.x")


# Gates -------------------------------------------------------------------------------------------------------------------


def gate_bad_values(frame: DataFrame, columns: list[str], expected_missing: tuple[str, ...] = (), settings: Settings = DEFAULTS) -> DataFrame:
    """column, n_bad, ratio, fails: more null, NaN and infinite values than allowed, but for columns expected to lack some."""
    rows = bad_value_ratios(frame, columns)
    return rows.withColumn("fails", (F.col("ratio") > settings.gate_bad_values) & ~F.col("column").isin(*expected_missing) if expected_missing else F.col("ratio") > settings.gate_bad_values)


def gate_monotonic(frame: DataFrame, keys: list[str], clock: str, order: list[str], bucket: Column | None = None) -> DataFrame:
    """n, n_back, n_same, first_back (five ordinals at most) and verdict: fail for steps back, warn for repeated times."""
    rows = neighbours(frame.where(F.col(clock).isNotNull()), keys, order, {"_p": (clock, -1)}, bucket)
    back = F.col(clock) < F.col("_p")
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(back).alias("n_back"), F.count_if(F.col(clock) == F.col("_p")).alias("n_same"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = rows.where(back).withColumn("_n", nth).where("_n <= 5").groupBy(*keys).agg(F.array_sort(F.collect_list(order[0])).alias("first_back"))
    verdict = F.when(F.col("n_back") > 0, "fail").when(F.col("n_same") > 0, "warn").otherwise("pass")
    return same_keys(sums, first, keys, "left").select(*keys, "n", "n_back", "n_same", "first_back", verdict.alias("verdict"))


def gate_frame_loss(frame: DataFrame, keys: list[str], clock_s: str, declared_fps: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """n, n_missing, loss and fails. With a declared rate from the span in seconds, else from steps above five medians."""
    rows = frame.where(F.col(clock_s).isNotNull()).select(*keys, F.col(clock_s).cast("double").alias("t"))
    if declared_fps:
        sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), ((F.max("t") - F.min("t")) * declared_fps + 1).alias("_due"))
        out = sums.select(*keys, "n", F.greatest(F.lit(0.0), F.col("_due") - F.col("n")).alias("n_missing"), F.greatest(F.lit(0.0), F.try_divide(F.col("_due") - F.col("n"), "_due")).alias("loss"))
    else:
        known = extent(rows, "t")
        steps = neighbours(rows, keys, ["t"], {"p": ("t", -1)}, known=known).withColumn("d", F.col("t") - F.col("p"))
        middle = summaries(steps.select(*keys, F.when(F.col("d") > 0, F.col("d")).alias("d")), keys, [], {"m": ("d", 0.5)}, settings, known.n)
        gap = F.col("d") > settings.gap_factor * F.col("m")
        sums = same_keys(steps, middle, keys).groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.when(gap, F.round(F.col("d") / F.col("m")) - 1)), F.lit(0.0)).alias("n_missing"))
        out = sums.withColumn("loss", F.col("n_missing") / (F.col("n") + F.col("n_missing")))
    return out.withColumn("fails", F.col("loss") > settings.gate_frame_loss)


def gate_schema(tables: dict[str, list[str]], settings: Settings = DEFAULTS) -> list[dict]:
    """For each table (of an episode or file, by its columns) those it lacks and has beyond the first one by name, and
    whether all that differ anywhere are more than allowed."""
    names = sorted(tables)
    first = set(tables[names[0]]) if names else set()
    rows = [{"table": n, "missing": sorted(first - set(tables[n])), "extra": sorted(set(tables[n]) - first)} for n in names]
    differ = {c for r in rows for c in (*r["missing"], *r["extra"])}
    return [r | {"fails": len(differ) > settings.gate_schema_mismatch and bool(r["missing"] or r["extra"])} for r in rows]


def gate_fps(frame: DataFrame, keys: list[str], clock_ns: str, order: list[str], fps: float | None, settings: Settings = DEFAULTS) -> DataFrame:
    """Measured against declared rate: fail for a declared rate of zero or less, warn for one more than 5 % off; skip if none."""
    from .timeaxis import measured_rate

    rates = measured_rate(frame, keys, clock_ns, order, settings)
    declared = F.lit(fps).cast("double")
    off = F.when(declared > 0, F.abs(F.col("rate_hz") - declared) / declared)
    verdict = F.when(declared.isNull(), "skip").when(declared <= 0, "fail").when(off > settings.rate_tolerance, "warn").otherwise("pass")
    return rates.select(*keys, "rate_hz", declared.alias("declared_fps"), off.alias("deviation"), verdict.alias("verdict"))


def gate_episode_bounds(frame: DataFrame, episode: str, clock: str, order: str, declared: list | None = None) -> DataFrame:
    """first, last, fails: the last time in file order before the first. Declared episodes without rows fail as empty."""
    ends = frame.groupBy(episode).agg(F.min_by(clock, order).alias("first"), F.max_by(clock, order).alias("last"), F.count("*").alias("n"))
    if declared is not None:
        wanted = frame.sparkSession.createDataFrame([(e,) for e in declared], frame.select(episode).schema)
        ends = wanted.join(ends, episode, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ends.withColumn("fails", (F.col("n") == 0) | F.coalesce(F.col("last") < F.col("first"), F.lit(False)))


# Diagnostics -------------------------------------------------------------------------------------------------------------


def speeds(long: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS) -> DataFrame:
    """keys, order, speed: the mean over channels of each step's size over the channel's 95th percentile of sizes.

    Channels that never move in the episode are left out; an episode without moving channels has no rows.
    """
    known = extent(long, order, keys=keys)
    if known.splits or settings.spread_quantiles:
        steps = neighbours(long, [*keys, "channel"], [order], {"_p": ("x", -1)}, known=known).withColumn("d", F.abs(F.col("x") - F.col("_p"))).where("d is not null")
        return mean_speed(staged(steps.select(*keys, order, "channel", "d"), "steps"), keys, order, settings, known.n)
    # whole episodes meet in one task, so that steps, percentiles and means take one shuffle
    rows = long.repartition(*keys) if keys else long
    w = Window.partitionBy(*keys, "channel")
    steps = rows.withColumn("d", F.abs(F.col("x") - F.lag("x").over(w.orderBy(order)))).where("d is not null")
    steps = steps.withColumn("p95", F.percentile(finite("d"), F.lit(0.95)).over(w)).where("p95 > 0")
    return steps.groupBy(*keys, order).agg(F.avg(F.col("d") / F.col("p95")).alias("speed"))


def mean_speed(steps: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS, rows: int | None = None) -> DataFrame:
    """keys, order, speed from the step sizes d of all channels (read twice)."""
    top = summaries(steps, [*keys, "channel"], [], {"p95": ("d", 0.95)}, settings, rows).where("p95 > 0")
    return same_keys(steps, top, [*keys, "channel"]).groupBy(*keys, order).agg(F.avg(F.col("d") / F.col("p95")).alias("speed"))


def idle_ratio(long: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS, moving: DataFrame | None = None) -> DataFrame:
    """Share of steps slower than idle_speed for each episode, and a warning above idle_share. moving: speeds, if at hand."""
    idle = F.avg((F.col("speed") < settings.idle_speed).cast("double"))
    moving = speeds(long, keys, order, settings) if moving is None else moving
    return moving.groupBy(*keys).agg(F.count("*").alias("n_steps"), idle.alias("idle_ratio")).withColumn("warns", F.col("idle_ratio") > settings.idle_share)


def second_differences(long: DataFrame, keys: list[str], order: str, known: Extent | None = None) -> DataFrame:
    """The long frame with dd: the row before, less twice this one, plus the row after; null at the ends."""
    w = neighbours(long, [*keys, "channel"], [order], {"_p": ("x", -1), "_n": ("x", 1)}, known=known)
    return w.withColumn("dd", F.col("_p") - 2 * F.col("x") + F.col("_n")).drop("_p", "_n")


def action_spikes(long: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS, clock_s: str | None = None, bent: DataFrame | None = None) -> DataFrame:
    """n_spikes and the largest acceleration over its median size, for each episode and channel that has spikes.

    With a clock (a column of long, in seconds) the second difference is divided by the square of the step ahead; steps that
    do not go forward count for nothing. Without one the second difference is taken as it is. bent: second_differences, if at hand.
    """
    known = extent(long, order)
    dd = second_differences(long, keys, order, known) if bent is None else bent
    if clock_s:
        ahead = neighbours(long, [*keys, "channel"], [order], {"_t": (clock_s, 1)}, known=known).select(*keys, "channel", order, (F.col("_t") - F.col(clock_s)).alias("_dt"))
        dd = same_keys(dd, ahead, [*keys, "channel", order]).withColumn("dd", F.when(F.col("_dt") > 0, F.col("dd") / (F.col("_dt") * F.col("_dt"))))
    dd = dd.where("dd is not null").withColumn("a", F.abs("dd"))
    middle = summaries(dd, [*keys, "channel"], [], {"m": ("a", 0.5)}, settings, known.n).where("m > 0")
    hits = same_keys(dd, middle, [*keys, "channel"]).where(F.col("a") > settings.spike_factor * F.col("m"))
    return hits.groupBy(*keys, "channel").agg(F.count("*").alias("n_spikes"), F.max(F.col("a") / F.col("m")).alias("worst"))


def worst_channels(found: DataFrame, value: str, settings: Settings = DEFAULTS) -> DataFrame:
    """The report's top rows by a value, ties by channel."""
    return found.orderBy(F.desc(value), "channel").limit(settings.report_limit)


def actuator_saturation(frame: DataFrame, keys: list[str], order: str, pairs: list[tuple[str, str]], settings: Settings = DEFAULTS) -> DataFrame:
    """channel, n, n_over, worst: the action of a step against the state one step later, beyond the limit in degrees."""
    sides = F.array(*[F.struct(F.lit(a).alias("channel"), finite(f"`{a}`").alias("a"), finite(f"`{s}`").alias("s")) for a, s in pairs])
    long = frame.select(*keys, order, F.explode(sides).alias("_c")).select(*keys, order, "_c.*")
    gap = neighbours(long, [*keys, "channel"], [order], {"_s": ("s", 1)}).select(*keys, "channel", F.abs(F.col("a") - F.col("_s")).alias("g")).where("g is not null")
    return gap.groupBy(*keys, "channel").agg(F.count("*").alias("n"), F.count_if(F.col("g") > settings.saturation).alias("n_over"), F.max("g").alias("worst"))


def action_jerk(long: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Variance of what a centred mean of five leaves, over the variance, of channels with at least eight values."""
    rows = rolling_mean(long.where("x is not null"), [*keys, "channel"], [order], "x", "_m")
    sums = rows.groupBy(*keys, "channel").agg(F.count("*").alias("n"), F.var_pop(F.when(F.col("_m").isNotNull(), F.col("x") - F.col("_m"))).alias("_r"), F.var_pop("x").alias("_v"))
    ratio = F.when(F.col("_v") > 0, F.col("_r") / F.col("_v")).otherwise(0.0)
    return sums.where("n >= 8").select(*keys, "channel", "n", ratio.alias("jerk_ratio"), (ratio > settings.jerk_ratio).alias("warns"))


def pauses(long: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS, moving: DataFrame | None = None) -> DataFrame:
    """Runs of at least pause_steps slow steps: keys, run, n_rows, first, last. moving: speeds, if at hand."""
    slow = (speeds(long, keys, order, settings) if moving is None else moving).withColumn("_slow", F.col("speed") < settings.idle_speed)
    out = runs(slow, keys, [order], "_slow", extent(long, order, keys=keys)).where(F.col("n_rows") >= settings.pause_steps)
    return out.select(*keys, "n_rows", F.col(f"first.{order}").alias("first"), F.col(f"last.{order}").alias("last"))


def arm_shaking(long: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS, bent: DataFrame | None = None) -> DataFrame:
    """Share of sign changes among the second differences (bent, if at hand) that are not zero, for each channel."""
    known = extent(long, order)
    dd = (second_differences(long, keys, order, known) if bent is None else bent).where("dd <> 0")
    flips = neighbours(dd, [*keys, "channel"], [order], {"_p": ("dd", -1)}, known=known)
    share = F.count_if(F.signum("dd") != F.signum("_p")) / F.count("*")
    return flips.groupBy(*keys, "channel").agg(F.count("*").alias("n"), share.alias("flip_ratio")).withColumn("warns", F.col("flip_ratio") > settings.shake_ratio)


def path_efficiency(long: DataFrame, keys: list[str], order: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Distance from start to end over the length of the path, axes scaled by their ranges; from two channels on."""
    span = long.groupBy(*keys, "channel").agg((F.max("x") - F.min("x")).alias("r"), F.min_by("x", order).alias("x0"), F.max_by("x", order).alias("x1")).where("r > 0")
    steps = neighbours(long, [*keys, "channel"], [order], {"_p": ("x", -1)})
    steps = same_keys(steps, span, [*keys, "channel"])
    path = steps.groupBy(*keys, order).agg(F.sqrt(F.sum(F.pow((F.col("x") - F.col("_p")) / F.col("r"), 2))).alias("s")).groupBy(*keys).agg(F.sum("s").alias("path"))
    ends = span.groupBy(*keys).agg(F.count("*").alias("n_channels"), F.sqrt(F.sum(F.pow((F.col("x1") - F.col("x0")) / F.col("r"), 2))).alias("direct")).where("n_channels >= 2")
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide("direct", "path")))
    return same_keys(ends, path, keys).select(*keys, "n_channels", share.alias("efficiency"), (share < settings.path_efficiency).alias("warns"))


def visual_quality(media: DataFrame) -> DataFrame:
    """Media rows (width, height, duration_s) with the warnings small_frame and no_duration."""
    small = (F.col("width") < 64) | (F.col("height") < 64)
    return media.select("*", F.coalesce(small, F.lit(False)).alias("small_frame"), F.coalesce(F.col("duration_s") <= 0, F.lit(False)).alias("no_duration"))


def layered_verdict(gates: dict[str, str], diagnostics: dict[str, str]) -> dict:
    """fail if a gate fails; warn if anything warns; else pass. Diagnostics never fail; skipped checks are not audited."""
    failed = sorted(k for k, v in gates.items() if v == "fail")
    warned = sorted(k for k, v in {**gates, **diagnostics}.items() if v == "warn" or (v == "fail" and k in diagnostics))
    skipped = sorted(k for k, v in {**gates, **diagnostics}.items() if v == "skip")
    return {"verdict": "fail" if failed else "warn" if warned else "pass", "failed": failed, "warned": warned, "not_audited": skipped}
