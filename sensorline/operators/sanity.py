"""Sensor plausibility: stationary blocks, units, gravity, bias, clipping, constant channels, claims about streams."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .stats import long_form
from .windows import bad, finite, same_keys, summaries

G = 9.8


def split_imu(columns: list[str], name: str = "") -> dict[str, list[str]]:
    """Accelerometer and gyroscope columns by their names: accel, gyro and angular, or ax, ay, az and gx, gy, gz with or
    without a unit behind. Bare x, y and z belong to the sensor that the stream's name tells."""
    gyro = [c for c in columns if re.search(r"gyro?|angular|(^|[^a-z])g[xyz](_|$)", c.lower())]
    accel = [c for c in columns if re.search(r"accel|(^|[^a-z])a[xyz](_|$)", c.lower()) and c not in gyro]
    bare = [c for c in columns if c.lower().strip() in ("x", "y", "z")]
    if bare and not accel and not gyro:
        accel, gyro = (bare, []) if "accel" in name.lower() else ([], bare) if "gyr" in name.lower() else ([], [])
    return {"accel": accel, "gyro": gyro}


def vector_norm(columns: list[str]) -> Column:
    return F.sqrt(sum((F.pow(finite(c), 2) for c in columns), F.lit(0.0)))


def block_size(rate: float | None, settings: Settings = DEFAULTS) -> int:
    return max(2, round(rate or settings.block_rate))


def stationary_blocks(frame: DataFrame, keys: list[str], row: str, value: str, rate: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Blocks of one second of rows: block, n, mean, variation (variance over squared mean) and static.

    ``row`` counts each key's rows from 0. A shorter last block is never static unless the key has fewer rows than one
    block; a block needs three values.
    """
    size = block_size(rate, settings)
    x = finite(value)
    sums = frame.groupBy(*keys, F.floor(F.col(row) / size).alias("block")).agg(F.count("*").alias("n"), F.count(x).alias("n_values"), F.avg(x).alias("mean"), F.var_pop(x).alias("_v"))
    total = frame.groupBy(*keys).agg(F.count("*").alias("_all"))
    variation = F.when(F.col("mean") == 0, F.col("_v")).otherwise(F.col("_v") / F.pow("mean", 2))
    whole = (F.col("n") == size) | (F.col("_all") < size)
    rows = same_keys(sums, total, keys) if keys else sums.join(F.broadcast(total))
    return rows.select(*keys, "block", "n", "mean", variation.alias("variation"), F.coalesce(whole & (F.col("n_values") >= 3) & (variation < settings.static_variation), F.lit(False)).alias("static"))


def accel_unit(median_norm: Column) -> Column:
    return F.when((median_norm >= 8.5) & (median_norm <= 11), "m/s2").when((median_norm >= 0.8) & (median_norm <= 1.2), "g").when(median_norm > 100, "raw").otherwise("undetermined")


def gyro_unit(median_norm: Column) -> Column:
    return F.when(median_norm < 0.5, "rad/s").when(median_norm < 100, "deg/s").otherwise("undetermined")


def _moving(frame: DataFrame, keys: list[str], columns: list[str], settings: Settings) -> DataFrame:
    """keys and _c0, _c1 ...: whether a column has over ten values that stay the same within a key."""
    flags = []
    for i, c in enumerate(columns):
        x = finite(c)
        span, variation = F.max(x) - F.min(x), F.var_pop(x)
        flags.append(F.coalesce((F.count(x) > 10) & ((span == 0) | (variation / F.pow(span, 2) < settings.constant_variation)), F.lit(False)).alias(f"_c{i}"))
    return frame.groupBy(*keys).agg(*flags)


def imu_checks(frame: DataFrame, keys: list[str], row: str, accel: list[str], gyro: list[str], rate: float | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """One row for each key: unit, gravity, bias and static share of an IMU.

    Norms leave out axes that are constant. Gravity is the median norm of static blocks against 9.8 m/s2 or 1 g; raw and
    unknown units are not judged, nor is a sensor with a constant accelerometer axis, which warns. Gyro bias is the median
    static norm in degrees per second by its inferred unit. A row is bad if any accelerometer axis is.
    """
    rows = same_keys(frame, _moving(frame, keys, [*accel, *gyro], settings), keys)
    norm = lambda cs, at: F.sqrt(sum((F.when(F.col(f"_c{i}"), 0.0).otherwise(F.pow(finite(c), 2)) for i, c in enumerate(cs, at)), F.lit(0.0)))
    still = sum(((~F.col(f"_c{i}")).cast("int") for i in range(len(accel))), F.lit(0))
    anybad = F.lit(False)
    for c in accel:
        anybad = anybad | bad(c)
    rows = rows.withColumns({
        "_a": F.when(still >= 2, norm(accel, 0)), "_g": norm(gyro, len(accel)) if gyro else F.lit(None).cast("double"), "_n_still": len(accel) - still, "_bad": anybad,
    })
    blocks = stationary_blocks(rows, keys, row, "_a", rate, settings).select(*keys, F.col("block").alias("_block"), "static")
    rows = same_keys(rows.withColumn("_block", F.floor(F.col(row) / block_size(rate, settings))), blocks, [*keys, "_block"])
    rows = rows.withColumn("_still", F.when(F.col("static"), F.col("_a"))).withColumn("_turn", F.when(F.col("static"), F.col("_g")))
    sums = [
        F.count("*").alias("n"), F.max("_n_still").alias("n_constant"), F.avg(F.col("static").cast("double")).alias("static_share"), F.count("_still").alias("_n"),
        F.avg(F.col("_bad").cast("double")).alias("bad_share"),
    ]
    sums = summaries(rows, keys, sums, {"accel_norm": ("_still", 0.5), "gyro_norm": ("_turn", 0.5)}, settings)
    unit, g_unit = accel_unit(F.col("accel_norm")), gyro_unit(F.col("gyro_norm"))
    standard = F.when(unit == "m/s2", G).when(unit == "g", 1.0)
    off = F.when((F.col("n_constant") == 0) & (F.col("_n") >= 3), F.abs(F.col("accel_norm") - standard) / standard)
    bias = F.when(g_unit == "rad/s", F.degrees("gyro_norm")).when(g_unit == "deg/s", F.col("gyro_norm"))
    fails = (F.col("bad_share") > settings.bad_values) | F.coalesce(off > settings.gravity_tolerance, F.lit(False)) | F.coalesce(bias > 10, F.lit(False))
    warns = (F.col("n_constant") > 0) | (F.col("static_share") < settings.static_share_warn)
    return sums.select(
        *keys, "n", F.col("n_constant").cast("int").alias("n_constant"), "static_share", unit.alias("accel_unit"), "accel_norm", off.alias("gravity_error"),
        g_unit.alias("gyro_unit"), bias.alias("gyro_bias_deg_s"), "bad_share", F.when(fails, "fail").when(warns, "warn").otherwise("pass").alias("verdict"),
    )


def clipping(frame: DataFrame, columns: list[str], keys: list[str] | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """column, n, n_at_ends, share, fails: rows at the smallest or largest value; bad values count in n. Constant columns are not clipped."""
    keys = keys or []
    long = long_form(frame, keys, columns).withColumn("x", finite("value"))
    ends = long.groupBy(*keys, "column").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = (F.col("x") == F.col("lo")) | (F.col("x") == F.col("hi"))
    sums = same_keys(long, ends, [*keys, "column"]).groupBy(*keys, "column").agg(F.count("*").alias("n"), F.count_if(at & (F.col("lo") < F.col("hi"))).alias("n_at_ends"))
    return sums.withColumn("share", F.col("n_at_ends") / F.col("n")).withColumn("fails", F.col("share") > settings.clipping)


def constant_channels(frame: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """column, n, variation (variance over squared span, 0 for no span) and constant, of columns with over ten values."""
    x = finite("value")
    sums = long_form(frame, [], columns).groupBy("column").agg(F.count(x).alias("n"), F.var_pop(x).alias("_v"), (F.max(x) - F.min(x)).alias("_s")).where("n > 10")
    variation = F.when(F.col("_s") > 0, F.col("_v") / F.pow("_s", 2)).otherwise(0.0)
    return sums.select("column", "n", variation.alias("variation"), (variation < settings.constant_variation).alias("constant"))


def force_checks(frame: DataFrame, columns: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """column, share at the ends, bad_share and verdict of force channels."""
    wrong = long_form(frame, [], columns).groupBy("column").agg(F.avg(bad("value").cast("double")).alias("bad_share"))
    rows = clipping(frame, columns, None, settings).join(wrong, "column")
    return rows.select("column", "n", "share", "bad_share", F.when(F.col("fails") | (F.col("bad_share") > settings.bad_values), "fail").otherwise("pass").alias("verdict"))


def quaternion_groups(frame: DataFrame, groups: dict[str, list[str]], keys: list[str] | None = None) -> DataFrame:
    """keys, prefix, norm_mean, norm_std (n - 1) and whether four columns are a unit quaternion (std < 0.01 and mean > 0.99)."""
    pairs = F.array(*[F.struct(F.lit(p).alias("prefix"), vector_norm(c).alias("norm")) for p, c in groups.items()])
    keys = keys or []
    sums = frame.select(*keys, F.explode(pairs).alias("_q")).select(*keys, "_q.*").groupBy(*keys, "prefix").agg(F.avg("norm").alias("norm_mean"), F.stddev_samp("norm").alias("norm_std"))
    return sums.withColumn("is_unit", F.coalesce((F.col("norm_std") < 0.01) & (F.col("norm_mean") > 0.99), F.lit(False)))


def quaternion_names(columns: list[str]) -> dict[str, list[str]]:
    """Groups of columns that share a stem and end in w, x, y, z (after quat, rot, orientation, q, or an underscore)."""
    groups: dict[str, dict[str, str]] = {}
    for c in columns:
        if m := re.fullmatch(r"(.*(?:quat|rot|orientation|q)[_.]?|.*[_.])?([wxyz])", c, re.IGNORECASE):
            groups.setdefault(m[1] or "", {})[m[2].lower()] = c
    return {p: [g[a] for a in "wxyz"] for p, g in groups.items() if set("wxyz") <= set(g)}


def verify_claim(frame: DataFrame, kind: str, quaternion: list[str] | None = None, accel: list[str] | None = None, gyro: list[str] | None = None, fields: list[str] | None = None, sample: int = 50, order: str | None = None) -> dict:
    """Evidence for a claim about a stream from medians over its first rows (by order): strong, weak or failed.

    imu: two of a unit quaternion, an acceleration of half to twice gravity and a gyro vector are strong, one weak. pose: a
    unit quaternion. tf: transforms with a frame_id. joint_state: names or positions with velocities or efforts. image,
    tactile, actions and others: the named fields exist.
    """
    wanted = {"quaternion": quaternion, "accel": accel, "gyro": gyro}
    aggs = [F.median(vector_norm(c)).alias(k) for k, c in wanted.items() if c and set(c) <= set(frame.columns)]
    head = (frame.orderBy(order) if order else frame).limit(sample)
    seen = head.agg(*aggs).first().asDict() if aggs else {}
    signs = {
        "quaternion": 0.9 <= seen["quaternion"] <= 1.1 if seen.get("quaternion") is not None else False,
        "accel": any(0.5 * g <= seen["accel"] <= 2 * g for g in (G, 1.0)) if seen.get("accel") is not None else False,
        "gyro": seen.get("gyro") is not None,
    }
    if kind == "imu":
        n = sum(signs.values())
        level = "strong" if n >= 2 else "weak" if n else "failed"
    elif kind == "pose":
        level = "strong" if signs["quaternion"] else "failed"
    elif kind in ("tf", "joint_state"):
        named = head.schema.simpleString().lower()
        wanted_parts = ("transforms", "frame_id") if kind == "tf" else ("position", "velocity")
        n = sum(p in named for p in wanted_parts)
        level = "strong" if n == 2 else "weak" if n and kind == "joint_state" else "failed"
    else:
        level = "weak" if fields and set(fields) <= set(frame.columns) else "failed"
    return {"kind": kind, "level": level, "evidence": {k: seen.get(k) for k in wanted}, "signs": signs}
