"""Chart series as data frames of bounded size, with a small specification for any renderer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stats import histogram, zscores
from ..operators.windows import finite

KINDS = ("line", "scatter", "histogram", "bar", "overlay")
#: Words that parts of column names stand for.
WORDS = {
    "accel": "acceleration", "gyro": "angular rate", "mag": "magnetic field", "quat": "quaternion", "rot": "rotation", "pos": "position", "vel": "velocity", "acc": "acceleration",
    "qpos": "joint position", "qvel": "joint velocity", "obs": "observation", "cmd": "command", "ts": "time", "idx": "index", "temp": "temperature", "img": "image", "cam": "camera",
}
UNITS = {"ns": "ns", "us": "us", "ms": "ms", "s": "s", "mss2": "m/s2", "radps": "rad/s", "rad": "rad", "deg": "deg", "n": "N", "nm": "N m", "m": "m", "mm": "mm", "hz": "Hz"}


def label(column: str) -> str:
    """A column's name in words, with its unit in brackets where the last part names one."""
    parts = [p for p in column.lower().replace(".", "_").split("_") if p]
    unit = UNITS.get(parts[-1]) if len(parts) > 1 else None
    words = " ".join(WORDS.get(p, p) for p in (parts[:-1] if unit else parts))
    return f"{words} ({unit})" if unit else words


def trajectory_axes(columns: list[str], most: int = 8) -> list[str]:
    """What a path is drawn from: joints (eight at most), else positions x, y and z."""
    joints = [c for c in columns if c.lower().startswith(("qpos", "joint", "q_", "action_joint", "state_joint"))]
    if joints:
        return joints[:most]
    xyz = [c for a in "xyz" for c in columns if c.lower() in (a, f"pos_{a}", f"position_{a}", f"eef_{a}", f"ee_{a}", f"end_effector_{a}")]
    return xyz[:3]


def time_series(frame: DataFrame, key: str, clock: str, value: str, points: int = 1_000) -> DataFrame:
    """For each key at most points equal stretches of time: bin, n, t (first), mean, min and max of finite values."""
    ends = frame.groupBy(key).agg(F.min(clock).alias("_lo"), F.max(clock).alias("_hi"))
    spot = F.least(F.lit(points - 1), F.floor((F.col(clock) - F.col("_lo")) * points / F.greatest(F.lit(1), F.col("_hi") - F.col("_lo"))))
    x = finite(value)
    return frame.join(ends, key).groupBy(key, spot.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.min(clock).alias("t"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))


def chart(frame: DataFrame, kind: str, x: str, y: str | None = None, color: str | None = None, title: str = "", points: int = 1_000) -> tuple[DataFrame, dict]:
    """(series, specification) of a line, scatter, histogram, bar or overlay (z-scores of several streams) chart."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}")
    if kind == "histogram":
        series = histogram(frame, x)
    elif kind == "bar":
        series = frame.groupBy(x).agg(F.avg(finite(y)).alias("value") if y else F.count("*").alias("value")).orderBy(x).limit(points)
    elif kind == "scatter":
        series = frame.select(x, y, *[color] * bool(color)).orderBy(F.xxhash64(x, y), x, y).limit(points)
    else:
        key = color or "_series"
        rows = frame if color else frame.withColumn(key, F.lit("all"))
        if kind == "overlay":
            rows, y = zscores(rows, [key], y), "z"
        series = time_series(rows, key, x, y, points)
    return series, {"kind": kind, "x": x, "y": y, "color": color, "title": title, "columns": series.columns}


def trajectory(frame: DataFrame, order: str, axes: list[str], points: int = 1_000) -> DataFrame:
    """At most points rows of a path, evenly spread over its order: order and the axes."""
    ends = frame.agg(F.min(order).alias("_lo"), F.max(order).alias("_hi"))
    spot = F.floor((F.col(order) - F.col("_lo")) * points / F.greatest(F.lit(1), F.col("_hi") - F.col("_lo") + 1))
    rows = frame.join(F.broadcast(ends)).groupBy(spot.alias("_b")).agg(F.min_by(F.struct(order, *axes), order).alias("_r"))  # one row
    return rows.select("_r.*")


def vector_series(frame: DataFrame, x: str, vector: str, dims: int = 8) -> DataFrame:
    """x, dim and value of the first dimensions of a vector column."""
    return frame.select(x, F.posexplode(F.slice(F.col(vector).cast("array<double>"), 1, dims)).alias("dim", "value"))


def overlay(streams: dict[str, DataFrame], clock: str, value: dict[str, str], points: int = 500) -> DataFrame:
    """Several streams on one relative time axis: stream, bin, t, raw mean and its z-score."""
    rows = None
    for name, frame in streams.items():
        one = frame.select(F.lit(name).alias("stream"), F.col(clock).alias("t"), finite(value[name]).alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    first = rows.groupBy("stream").agg(F.min("t").alias("_t0"))
    rows = zscores(rows.join(first, "stream").withColumn("t", F.col("t") - F.col("_t0")).drop("_t0"), ["stream"], "x")
    raw, z = time_series(rows, "stream", "t", "x", points), time_series(rows, "stream", "t", "z", points)
    return raw.select("stream", "bin", "n", "t", F.col("mean").alias("raw")).join(z.select("stream", "bin", F.col("mean").alias("z")), ["stream", "bin"])
