"""The public functions, one for each question a user asks of a dataset.

Each returns a dict: success, and either error and reason or the results, where tables are lazy DataFrames and verdicts
plain values. Errors that a user can mend are returned, not raised.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import annotations, compare, quality, sanity, segment, stats, sync, timeaxis, windows
from .operators import media as media_times
from .plans import charts, report
from .settings import DEFAULTS, Settings
from .sources import annotation_store, catalog, envelope, hdf5, mcap, text
from .sources.readers import split_path, with_row_index
from .storage import staged


def tool(f: Callable[..., dict]) -> Callable[..., dict]:
    @functools.wraps(f)
    def run(*args, **kwargs) -> dict:
        try:
            return {"success": True} | f(*args, **kwargs)
        except (KeyError, ValueError, RuntimeError) as e:
            return {"success": False, "error": type(e).__name__, "reason": str(e.args[0] if e.args else e)}

    return run


def output_dir(root: str, dataset: str) -> str:
    """A folder for a dataset's results: its name and six digits of a hash."""
    name = dataset.rstrip("/").rsplit("/", 1)[-1]
    return f"{root.rstrip('/')}/by_dataset/{name}-{hashlib.sha1(dataset.encode()).hexdigest()[:6]}"


@tool
def load_dataset(spark: SparkSession, path: str, fmt: str | None = None, profile_root: str | None = None) -> dict:
    """Register a folder's or file's tables. A profile confirmed before (profile_root) overrides what is found out."""
    data = catalog.load_dataset(spark, path, fmt)
    if not data.entries and not data.errors:
        raise ValueError(f"no tables below {path}")
    if profile_root:
        known = annotation_store.ProfileStore(spark, profile_root).load(data.path)["kinds"]
        data = data.confirm({n: k for n, k in known.items() if n in data.tables})
    shown = report.fit_result({"probe_errors": data.errors})
    capabilities = data.capabilities()
    return {
        "dataset": data, "main_table": data.main_table() if data.entries else None, "n_tables": len(data.entries), **shown, "capabilities": capabilities,
        "capability_matrix": report.capability_matrix(capabilities), "relations": data.relations(), "nominal_rate": data.nominal_rate() if data.entries else None, "meta": data.meta,
    }


@tool
def list_tables(data: catalog.Dataset) -> dict:
    return {"tables": data.list_tables(), "n_tables": len(data.entries)}


@tool
def profile_data(data: catalog.Dataset, table: str | None = None, expand: bool = False, focus_fields: list[str] | None = None, max_unique: int = 20, settings: Settings = DEFAULTS) -> dict:
    """A row for each column, and statistics of the vector columns (numbers in arrays or texts)."""
    frame = data.table(table)
    numbered = with_row_index(frame)
    vectors = [f.name for f in frame.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.NumericType)]
    texts = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType)]
    if texts:
        shares = frame.agg(*[F.avg((F.size(stats.parse_vector(F.col(f"`{c}`"))) > 1).cast("double")).alias(str(i)) for i, c in enumerate(texts)]).first()
        vectors += [c for c, share in zip(texts, shares, strict=True) if share and share >= 0.9]
    plain, left_out = envelope.expansion(frame, focus_fields) if expand else (frame, [])
    times = [c for c in envelope.time_fields(frame.schema) if "." in c]
    hints = {}
    if times:
        largest = frame.agg(*[F.max(F.abs(F.col(c))).cast("double").alias(str(i)) for i, c in enumerate(times)])
        hints = dict(zip(times, largest.select(*[timeaxis.unit_hint(F.col(str(i))).alias(str(i)) for i in range(len(times))]).first(), strict=True))
    return {
        "profile": stats.column_profile(plain, max_unique=max_unique, settings=settings), "n_rows": frame.count(), "nested_clocks": hints, "left_out": left_out,
        "vectors": {c: stats.vector_profile(numbered.select("row_index", F.col(f"`{c}`").alias("v")), "v", "row_index") for c in vectors},
    }


def _ns(frame: DataFrame, column: str, unit: str, *keep: str) -> DataFrame:
    """Some columns and t, a clock column in nanoseconds; whole numbers and decimals stay exact."""
    scale = timeaxis.UNIT_NS[unit]
    if isinstance(frame.select(F.col(f"`{column}`")).schema[0].dataType, T.DecimalType):
        return frame.select(*keep, (F.col(f"`{column}`").cast("decimal(28,9)") * F.lit(scale).cast("decimal(10,0)")).cast("bigint").alias("t"))
    v, whole = F.col(f"`{column}`").cast("double"), F.col(f"`{column}`").try_cast("bigint")
    return frame.select(*keep, F.when(whole == v, whole * scale).otherwise((v * scale).cast("bigint")).alias("t"))


def _in_ns(frame: DataFrame, column: str, unit: str) -> DataFrame:
    """row_index and t."""
    return _ns(frame, column, unit, "row_index")


def _units(frames: dict[str, tuple[DataFrame, str]], settings: Settings, more: list[tuple[DataFrame, dict[str, str]]] = ()) -> dict[str, str]:
    """The unit of each table's clock column (table, column), all inferred in one aggregate over their values. more: frames of several
    streams (stream, v) with the clock column of each stream."""
    columns = {name: column for name, (_, column) in frames.items()} | {n: c for _, own in more for n, c in own.items()}
    found = {name: timeaxis.unit_from_name(column) for name, column in columns.items()}
    rows = [frame.select(F.lit(name).alias("stream"), F.col(f"`{column}`").cast("double").alias("v")) for name, (frame, column) in frames.items() if found[name] is None]
    rows += [frame.select("stream", F.col("v").cast("double").alias("v")) for frame, own in more if any(found[n] is None for n in own)]  # frame numbers are no time
    if rows:
        told = timeaxis.infer_unit(functools.reduce(DataFrame.unionByName, rows), ["stream"], "v", settings)
        found |= {r.stream: r.unit for r in told.select("stream", "unit").collect() if found.get(r.stream) is None}
    return {n: u for n, u in found.items() if u in timeaxis.UNIT_NS}


def _together(data: catalog.Dataset, columns: dict[str, str], formats: dict[str, tuple[str, str]]) -> list[tuple[DataFrame, dict[str, str]]]:
    """Streams that one scan gives: (stream, i, v), and the clock column of each. Files of a group with one clock, and all topics of a
    container."""
    out = []
    for group in data.groups:
        own = {p: n for p, n in group.names.items() if columns.get(n)}
        for column in sorted({columns[n] for n in own.values()}):
            names = {p: n for p, n in own.items() if columns[n] == column}
            rows = with_row_index(group.frame.select(catalog.FILE, F.col(f"`{column}`").alias("v")))
            known = data.spark.createDataFrame(list(names.items()), f"{catalog.FILE} string, stream string")  # a row for each file
            out.append((rows.join(known, catalog.FILE).select("stream", F.col("row_index").alias("i"), "v"), dict.fromkeys(names.values(), column)))
    inside = {n: split_path(p) for n, (p, fmt) in formats.items() if fmt == "mcap" and columns.get(n) == "mcap_log_time_ns"}
    for path in sorted({p for p, _ in inside.values()}):
        names = {topic: n for n, (p, topic) in inside.items() if p == path}
        times = mcap.read_messages(data.spark, path, times_only=True).where(F.col("topic").isin(*names))
        named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("topic")]
        out.append((times.select(named.alias("stream"), F.col("mcap_place").alias("i"), F.col("mcap_log_time_ns").alias("v")), dict.fromkeys(names.values(), "mcap_log_time_ns")))
    return out


def _frame_clocks(data: catalog.Dataset, videos: list[catalog.Video], media: DataFrame | None, settings: Settings) -> list[DataFrame]:
    """The times of the frames of videos with side tables: stream (the video), i, t in nanoseconds. media may tell their frames."""
    sides = {v.video: (data.tables[v.table], v.column) for v in videos}
    values = [frame.select(F.lit(name).alias("stream"), F.col(f"`{column}`").cast("double").alias("v")) for name, (frame, column) in sides.items()]
    if not values:
        return []
    units = {r.stream: r.unit for r in timeaxis.infer_unit(functools.reduce(DataFrame.unionByName, values), ["stream"], "v", settings).collect() if r.unit in timeaxis.UNIT_NS}
    rows = [_ns(frame.withColumn("stream", F.lit(name)), column, units[name], "stream") for name, (frame, column) in sides.items() if name in units]
    if not rows:
        return []
    counts = data.spark.createDataFrame([(name, None) for name in units], "stream string, n_frames bigint")
    if media is not None:
        known = catalog.estimate_frames(media).groupBy(F.col("name").alias("stream")).agg(F.max("n_frames").alias("n_frames"))
        counts = counts.select("stream").join(known, "stream", "left")
    times = media_times.frame_times(functools.reduce(DataFrame.unionByName, rows), counts, "stream", settings)
    return [times.select("stream", F.col("frame").alias("i"), "t")]


def _clocks(
    data: catalog.Dataset, names: list[str] | None = None, settings: Settings = DEFAULTS, time_column: str | None = None, more: list[DataFrame] = ()
) -> DataFrame:
    """All streams with a clock as one frame: stream, i, t in nanoseconds by their inferred units; and more such rows.

    Files of one schema and topics of one container come from one scan each; what comes out is written once, so that sources are not
    read again whatever is asked of their clocks.
    """
    wanted = [s for s in data.entries if not names or any(n.lower() in s.name.lower() for n in names)]
    columns = {s.name: time_column if time_column in s.columns else s.timestamp_column for s in wanted}
    together = _together(data, columns, {s.name: (s.path, s.format) for s in wanted})
    shared = {n for _, own in together for n in own}
    frames = {n: (data.tables[n], c) for n, c in columns.items() if c and n not in shared}
    units = _units(frames, settings, together)
    rows = [_in_ns(with_row_index(frame), column, units[n]).select(F.lit(n).alias("stream"), F.col("row_index").alias("i"), "t") for n, (frame, column) in frames.items() if n in units]
    for frame, own in together:
        for unit in sorted({units[n] for n in own if n in units}):
            some = [n for n in own if units.get(n) == unit]
            part = frame if len(some) == len(own) else frame.where(F.col("stream").isin(*some))
            rows.append(_ns(part, "v", unit, "stream", "i"))
    rows += more
    if not rows:
        raise ValueError("no stream has a clock whose unit is known")
    return staged(functools.reduce(DataFrame.unionByName, rows), "clocks")


def _declared(data: catalog.Dataset, table: str | None, fps: float | None) -> float | None:
    found = None if fps is not None else data.nominal_rate(table)
    return fps if fps is not None else found["value"] if found else None


@tool
def inspect_streams(data: catalog.Dataset, media: DataFrame | None = None, settings: Settings = DEFAULTS) -> dict:
    """Rates, jitter, shape and role of every stream, against the declared rate; and how videos (media: name, fps) relate.

    A video's rate is checked against the text list or side table of its stem; where they contradict each other the list counts.
    """
    clocks = _clocks(data, settings=settings)
    rates = timeaxis.steady_rate(clocks, ["stream"], "t", settings).join(sync.stream_shape(clocks, ["stream"], "t", settings), "stream", "right")
    nominal = data.nominal_rate()
    burst, declared = F.col("shape") == "burst", F.lit(nominal["value"] if nominal else None).cast("double")
    rates = rates.withColumn("rate_hz", F.when(~burst, F.col("rate_hz"))).withColumn("nominal_hz", declared)
    rates = rates.withColumn("consistency", timeaxis.compare_rates(F.col("rate_hz"), F.col("nominal_hz"), settings))
    shown = data.streams().join(rates.withColumnRenamed("stream", "name").drop("n"), "name", "left").withColumn("role", catalog.role_of(F.col("name")))
    shown = shown.withColumn("shape_of_data", F.concat_ws(" x ", "n_rows", "n_cols"))
    cameras, checked = {}, None
    if media is not None:
        fastest = rates.agg(F.max("rate_hz")).first()[0]
        lists = {v.video: v.table for v in data.videos() if v.column}
        lists |= {r.media: r.table for r in data.relations()["media"].where("kind = 'media_samename' and lower(table) like '%.txt'").collect()}  # a row a video
        known = data.spark.createDataFrame(list(lists.items()), "name string, stream string")
        checked = staged(media_times.check_rates(media, clocks.join(known, "stream").select("name", "t"), "name"), "media-rates")
        cameras = {r.name: timeaxis.explain_rates(r.rate_hz, fastest) for r in checked.collect()}  # a row a video
    return {"streams": shown, "nominal_rate": nominal, "cameras": cameras, "media_rates": checked}


@tool
def check_temporal_sync(
    data: catalog.Dataset, baseline_stream: str | None = None, streams: list[str] | None = None, time_column: str | None = None, locate_gaps: bool = False,
    media: DataFrame | None = None, settings: Settings = DEFAULTS,
) -> dict:
    """Checks, residuals, drift and verdicts; for burst streams with other clocks also whether those contradict the first.

    Videos with a side table of exposures take part with the times of their frames, counted in media (name, fps, duration_s, n_frames)
    where it is given; videos tells of each whether it does.
    """
    seen = data.videos(media)
    shown = [v for v in seen if not streams or any(n.lower() in v.video.lower() for n in streams)]
    clocks = _clocks(data, streams, settings, time_column, _frame_clocks(data, [v for v in shown if v.column], media, settings))
    present = {r[0] for r in clocks.select("stream").distinct().collect()}
    if len(present) < 2:
        raise ValueError("at least two streams with clocks are needed")
    if baseline_stream and not (baseline_stream := next((n for n in sorted(present) if baseline_stream.lower() in n.lower()), None)):
        raise ValueError("no stream with a clock has that name")
    if baseline_stream is None:
        still = [s.name for s in data.entries if data.kind(s) == "calibration"]
        ranked = sync.rank_baselines(clocks.where(~F.col("stream").isin(*still)) if still else clocks, "stream", "t", settings)
        best = ranked.orderBy(F.desc("score"), "stream").first()
        baseline_stream = best[0] if best else None
    checked = staged(sync.sync_report(clocks, "stream", "t", ["i"], baseline_stream, settings=settings), "sync-report")
    conflicts = {}
    for name in [r[0] for r in checked.where("shape = 'burst'").select("stream").collect() if r[0] in data.tables]:
        frame, main = with_row_index(data.tables[name]), time_column or next(s.timestamp_column for s in data.entries if s.name == name)
        others = [c for c in catalog.clock_names(data.tables[name]) if c != main and timeaxis.unit_from_name(c) != "frame_index"][:2]
        units = {c: u for c in [main, *others] if (u := _units({c: (frame, c)}, settings).get(c))}
        if len(units) > 1:
            rows = _in_ns(frame, main, units[main]).withColumnRenamed("t", main)
            for c in list(units)[1:]:
                rows = rows.join(_in_ns(frame, c, units[c]).withColumnRenamed("t", c), "row_index")
            conflicts[name] = sync.clock_conflicts(rows.withColumn("_stream", F.lit(name)), ["_stream"], list(units), settings)
    told = data.spark.createDataFrame([(v.video, v.table, v.status) for v in shown], "video string, table string, status string")
    out = {"report": checked, "baseline": baseline_stream, "clock_conflicts": conflicts, "videos": told}
    return out | ({"gaps": sync.locate_gaps(clocks, ["stream"], "t", settings)} if locate_gaps else {})


@tool
def check_sensor_sanity(data: catalog.Dataset, sensor: str | None = None, table: str | None = None, expand: bool = False, settings: Settings = DEFAULTS) -> dict:
    """IMU, force and constant-channel checks of all tables, or of one, or of one kind of sensor. Accelerometers and
    gyroscopes in files of their own are judged together; blocks follow the measured rate."""
    wanted = [s for s in data.entries if table is None or s.name == data.name_of(table)]
    pairs = {} if table else {r.accel: r.gyro for r in data.relations()["imu"].collect()}  # a row for each device
    rates = {}
    try:
        rates = {r.stream: r.rate_hz for r in timeaxis.measured_rate(_clocks(data, [s.name for s in wanted], settings), ["stream"], "t", ["i"], settings).collect()}
    except ValueError:
        pass  # no clock: blocks take the usual rate
    out: dict[str, DataFrame] = {}
    for s in wanted:
        frame = envelope.expand(data.tables[s.name]) if expand else data.tables[s.name]
        numbers = [c for c in stats.numeric_columns(frame) if c != s.timestamp_column]
        if not numbers:
            continue
        kind, axes = data.kind(s), sanity.split_imu(numbers, s.name)
        if sensor is None:
            out[f"{s.name}:constant"] = sanity.constant_channels(frame, numbers, settings)
        if kind == "imu" and sensor in (None, "imu") and axes["accel"]:
            rows = with_row_index(frame).select("row_index", *[F.col(f"`{c}`").alias(_flat(c)) for c in axes["accel"] + axes["gyro"]])
            accel, gyro = [_flat(c) for c in axes["accel"]], [_flat(c) for c in axes["gyro"]]
            if s.name in pairs and not gyro:
                other = data.tables[pairs[s.name]]
                turn = sanity.split_imu(stats.numeric_columns(other), pairs[s.name])["gyro"]
                gyro = [f"gyro_{_flat(c)}" for c in turn]
                rows = rows.join(with_row_index(other).select("row_index", *[F.col(f"`{c}`").alias(n) for c, n in zip(turn, gyro, strict=True)]), "row_index", "left")
            rows = rows.withColumn("_stream", F.lit(s.name))
            out[f"{s.name}:imu"] = sanity.imu_checks(rows, ["_stream"], "row_index", accel, gyro, rates.get(s.name), settings)
            out[f"{s.name}:clipping"] = sanity.clipping(rows, accel + gyro, None, settings)
        if kind == "force" and sensor in (None, "force"):
            out[f"{s.name}:force"] = sanity.force_checks(frame, numbers, settings)
    if not out:
        raise ValueError("no table with numeric channels")
    return {"checks": out}


def _flat(name: str) -> str:
    return name.replace(".", "_")


def _timed(data: catalog.Dataset, table: str | None, frame: DataFrame, settings: Settings) -> tuple[DataFrame | None, str | None]:
    """The frame (with row_index) with _ns and _s by the table's clock, if its unit is known; and the clock's name."""
    clock, _ = catalog.find_timestamp(data.table(table), content=True)
    unit = _units({"clock": (frame, clock)}, settings).get("clock") if clock else None
    if unit is None:
        return None, clock
    scale, v = timeaxis.UNIT_NS[unit], F.col(f"`{clock}`").cast("double")
    whole = F.col(f"`{clock}`").try_cast("bigint")
    ns = F.when(whole == v, whole * scale).otherwise((v * scale).cast("bigint"))
    return frame.withColumn("_ns", ns).withColumn("_s", v * scale / 1e9), clock


def _episodes(frame: DataFrame) -> tuple[DataFrame, str]:
    found = stats.find_column(frame.columns, stats.EPISODE_NAMES)
    return (frame, found) if found else (frame.withColumn("_episode", F.lit(0)), "_episode")


@tool
def check_dataset_quality(
    data: catalog.Dataset, table: str | None = None, fps: float | None = None, profile: dict | None = None, profile_root: str | None = None, media: DataFrame | None = None, settings: Settings = DEFAULTS
) -> dict:
    """All gates and diagnostics of a table with their layered verdict.

    The rate is the one given or declared; columns that may lack values come from the profile, or the stored one
    (profile_root); media (width, height, duration_s) are judged by what is known of them. The table is read once into the shared
    folder, steps that several rules take are taken once, and one job finds the verdicts of all rules.
    """
    name = data.name_of(table)
    if profile is None and profile_root:
        profile = annotation_store.ProfileStore(data.spark, profile_root).load(data.path)
    frame, episode = _episodes(staged(with_row_index(data.table(name)), "audited"))
    fps = _declared(data, name, fps)
    timed, clock = _timed(data, name, frame, settings)
    actions = [c for c in quality.action_columns(data.table(name)) if c not in (episode, clock, "row_index")]
    gates, diagnostics, detail = {}, {}, {}
    asked: list[tuple[dict, str, DataFrame]] = []

    def judge(level: dict, rule: str, rows: DataFrame | None, bad: str, state: str = "fail") -> None:
        """bad rows give the state; where rows have a verdict of their own, the worst of them counts."""
        if rows is None:
            level[rule] = "skip"
            return
        detail[rule], level[rule] = rows, "pass"
        worst = {"fail": 2, "warn": 1}
        if bad == "verdict":
            level[rule] = "skip"  # unless there are rows
            rank = F.max(F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "warn", 1).otherwise(0))
        else:
            rank = F.max(F.when(F.expr(bad), worst[state]))
        asked.append((level, rule, rows.agg(rank.alias("rank")).select(F.lit(rule).alias("rule"), "rank")))

    numbers = [c for c in stats.numeric_columns(frame) if c not in ("row_index", "_episode")]
    judge(gates, "nan_inf", quality.gate_bad_values(frame, numbers, annotation_store.expected_missing(profile or {}, name, numbers), settings) if numbers else None, "fails")
    judge(gates, "timestamp_monotonic", quality.gate_monotonic(frame, [episode], clock, ["row_index"]) if clock else None, "verdict")
    judge(gates, "episode_bounds", quality.gate_episode_bounds(frame, episode, clock, "row_index") if clock else None, "fails")
    judge(gates, "frame_loss", quality.gate_frame_loss(timed, [episode], "_s", fps if fps and fps > 0 else None, settings) if timed is not None else None, "fails")
    judge(gates, "fps_valid", quality.gate_fps(timed, [episode], "_ns", ["row_index"], fps, settings) if timed is not None and fps is not None else None, "verdict")
    alike = {s.name: s.columns for s in data.entries if s.format == name.rsplit(".", 1)[-1] and s.name.lower().startswith(("episode", "file", "chunk"))}
    lacks = quality.gate_schema(alike, settings) if len(alike) > 1 else []
    gates["schema_consistency"] = "fail" if any(r["fails"] for r in lacks) else "pass" if lacks else "skip"
    long = quality.channels(timed if timed is not None else frame, [episode], "row_index", actions, ("_s",) if timed is not None else ()) if actions else None
    rules: dict[str, tuple[Callable[[], DataFrame], str]] = {}
    if long is not None:
        given = (long, [episode], "row_index", settings)
        moving = staged(quality.speeds(*given), "speeds")
        bent = staged(quality.second_differences(long, [episode], "row_index"), "second-differences")
        rules = {
            "idle_ratio": (lambda: quality.idle_ratio(*given, moving), "warns"), "action_jerk": (lambda: quality.action_jerk(*given), "warns"),
            "robot_induced_pause": (lambda: quality.pauses(*given, moving), "n_rows > 0"), "arm_shaking": (lambda: quality.arm_shaking(*given, bent), "warns"),
            "path_efficiency": (lambda: quality.path_efficiency(*given), "warns"),
            "action_spike": (lambda: quality.action_spikes(*given, "_s" if timed is not None else None, bent), "n_spikes > 0"),
        }
    for rule in ("idle_ratio", "action_jerk", "robot_induced_pause", "arm_shaking", "path_efficiency", "action_spike"):
        check, bad = rules.get(rule, (None, ""))
        judge(diagnostics, rule, check() if check else None, bad, "warn")
    if "action_spike" in detail:
        detail["action_spike_worst"] = quality.worst_channels(detail["action_spike"], "n_spikes", settings)
    pairs = quality.pair_action_state(frame.columns)
    judge(diagnostics, "actuator_saturation", quality.actuator_saturation(frame, [episode], "row_index", pairs, settings) if pairs else None, "n_over > 0", "warn")
    judge(diagnostics, "visual_quality", quality.visual_quality(media) if media is not None else None, "small_frame or no_duration", "warn")
    found = {r.rule: r["rank"] for r in functools.reduce(DataFrame.unionByName, [rows for _, _, rows in asked]).collect()} if asked else {}
    for level, rule, _ in asked:
        if found.get(rule) is not None:
            level[rule] = ("pass", "warn", "fail")[found[rule]]
    return {"table": name, "declared_fps": fps, "gates": gates, "diagnostics": diagnostics, "details": detail, **quality.layered_verdict(gates, diagnostics)}


@tool
def compute_stats(data: catalog.Dataset, metric: str = "generic", column: str | None = None, group_by: str | None = None, table: str | None = None, settings: Settings = DEFAULTS) -> dict:
    frame = data.table(table)
    episode = stats.find_column(frame.columns, stats.EPISODE_NAMES)
    numbers = [column] if column else [c for c in stats.numeric_columns(frame) if c != group_by]
    if metric == "generic":
        return {"stats": stats.generic_stats(frame, numbers, [group_by] if group_by else None, settings)}
    if metric == "range_of_motion":
        return {"stats": stats.range_of_motion(frame, [column] if column else None)}
    if metric == "pose_blocks":
        return {"stats": stats.pose_blocks(frame, column, 7)}
    if episode is None:
        raise ValueError(f"{metric} needs an episode column")
    if metric == "episodes":
        return {"stats": stats.episode_distribution(frame, episode)}
    rows = with_row_index(frame)
    if metric == "success_rate":
        return {"stats": stats.success_rate(rows, episode, column or "success", ["row_index"])}
    if metric in ("duration", "outliers"):
        value = column or stats.find_column(frame.columns, stats.DURATION_NAMES)
        if value is None:
            raise ValueError("no duration column")
        last = stats.last_value(rows, episode, value, ["row_index"])
        middle = windows.summaries(last, [], [F.min(value).alias("min"), F.max(value).alias("max")], {"median": (value, 0.5)}, settings)
        return {"stats": middle if metric == "duration" else stats.iqr_outliers(last, value, settings)}
    raise ValueError(f"unknown metric {metric!r}")


@tool
def plot_chart(
    data: catalog.Dataset, chart_type: str, x: str | None = None, y: str | None = None, color: str | None = None, title: str = "", table: str | None = None, streams: list[str] | None = None
) -> dict:
    """Series and specification of a chart: line, scatter, histogram, bar, trajectory or multi_stream_overlay.

    x defaults to the clock, else the first column; y to the first other number. A vector column as y gives its first
    dimensions. A trajectory takes the table's blocks of joints or xyz; an overlay the first channel of each stream.
    """
    if chart_type == "multi_stream_overlay":
        clocks = {s.name: s.timestamp_column for s in data.entries if s.timestamp_column and (not streams or s.name in streams)}
        frames = {n: (data.tables[n], c) for n, c in clocks.items()}
        units = _units(frames, DEFAULTS) if frames else {}
        values = {n: next((c for c in stats.numeric_columns(f) if c not in catalog.clock_names(f)), None) for n, (f, _) in frames.items()}
        picked = {n: c for n, c in values.items() if c and n in units}
        if not picked:
            raise ValueError("no stream has a clock and a number")
        rows = {}
        for n, c in picked.items():
            numbered = with_row_index(data.tables[n])
            rows[n] = _in_ns(numbered, clocks[n], units[n]).join(numbered.select("row_index", F.col(f"`{c}`").alias("v")), "row_index")
        series = charts.overlay(rows, "t", dict.fromkeys(rows, "v"))
        return {"series": series, "plot_spec": {"kind": chart_type, "title": title, "columns": series.columns, "labels": {n: charts.label(c) for n, c in picked.items()}}}
    frame = data.table(table)
    if chart_type == "trajectory":
        axes = charts.trajectory_axes(stats.numeric_columns(frame))
        if not axes:
            raise ValueError("no joints or positions to draw")
        series = charts.trajectory(with_row_index(frame), "row_index", axes)
        return {"series": series, "plot_spec": {"kind": chart_type, "title": title, "columns": series.columns, "labels": {c: charts.label(c) for c in axes}}}
    clock, _ = catalog.find_timestamp(frame)
    numbers = [c for c in stats.numeric_columns(frame) if c != clock]
    x = x or (numbers[0] if chart_type == "histogram" and numbers else clock or frame.columns[0])
    y = y or (None if chart_type in ("histogram", "bar") else next((c for c in numbers if c != x), None))
    if y and isinstance(frame.schema[y].dataType, T.ArrayType):
        frame, y, color = charts.vector_series(frame, x, y), "value", "dim"
    series, spec = charts.chart(frame, chart_type, x, y, color, title)
    return {"series": series, "plot_spec": spec | {"labels": {c: charts.label(c) for c in (x, y) if c}}}


@tool
def generate_report(spark: SparkSession, title: str, sections: dict | None = None, findings: DataFrame | None = None, data: catalog.Dataset | None = None, quality_result: dict | None = None) -> dict:
    """A Markdown report. With a dataset it begins with an overview, its capabilities and what they lack, then the quality
    verdict if there is one; then the sections given."""
    own: dict = {}
    if data is not None:
        matrix = report.capability_matrix(data.capabilities())
        own["Overview"] = data.list_tables()
        own["Capabilities"] = spark.createDataFrame([(r["capability"], r["present"], r["note"]) for r in matrix], "capability string, present boolean, note string")
        own["Limitations"] = "\n".join(f"* {r['capability']}: {r['note']}" for r in matrix if r["note"]) or "none"
    if quality_result is not None:
        plain = {k: quality_result[k] for k in ("verdict", "failed", "warned", "not_audited") if k in quality_result}
        own["Quality"] = "\n".join(f"* {k}: {v}" for k, v in report.fit_result(plain).items())
    return {"markdown": report.report(title, own | (sections or {}), findings)}


@tool
def propose_stream_semantics(data: catalog.Dataset, claims: dict[str, str], confirm: bool = False, profile_root: str | None = None) -> dict:
    """Evidence for claimed kinds (table: kind); with confirm those that do not fail are taken over, and kept in the stored
    profile if its folder is named."""
    results = {}
    for name, kind in claims.items():
        frame = data.table(name)
        axes, quats = sanity.split_imu(stats.numeric_columns(frame), name), sanity.quaternion_names(frame.columns)
        rows = with_row_index(frame)
        results[name] = sanity.verify_claim(rows, kind, next(iter(quats.values()), None), axes["accel"] or None, axes["gyro"] or None, frame.columns, order="row_index")
    good = {data.name_of(n): r["kind"] for n, r in results.items() if r["level"] != "failed"}
    if confirm and good and profile_root:
        annotation_store.ProfileStore(data.spark, profile_root).save(data.path, kinds=good)
    return {"results": report.fit_result(results), "dataset": data.confirm(good) if confirm and good else data}


@tool
def unpack_mcap(spark: SparkSession, path: str, out: str, topics: list[str] | None = None, fmt: str = "jsonl", max_messages: int | None = None) -> dict:
    if fmt not in ("jsonl", "json", "csv"):
        raise ValueError("fmt must be jsonl, json or csv")
    mcap.unpack(spark, path, out, topics, fmt, max_messages)
    return {"path": out}


@tool
def align_container_streams(spark: SparkSession, container: str, max_streams: int | None = None, settings: Settings = DEFAULTS) -> dict:
    """Offsets of a container's topics, from one pass over their times; of HDF5 containers the master clock and cameras that
    only images or only clocks know."""
    if container.lower().endswith((".h5", ".hdf5")):
        nodes = [r.node for r in hdf5.list_nodes(spark, container).select("node").collect()]  # names only
        cameras = [(container, m[1], "timestamp" in n.lower()) for n in nodes if (m := re.search(r"(cam[^/]*)", n.lower()))]
        found = spark.createDataFrame(cameras, "container string, camera string, is_clock boolean")
        return {"master_clock": sync.master_clock(nodes), "cameras": sync.camera_coverage(found)}
    rows = staged(mcap.read_messages(spark, container, times_only=True).select(F.col("path").alias("container"), "topic", "mcap_log_time_ns"), "container-times")
    found = sync.container_alignment(rows, "container", "topic", "mcap_log_time_ns", settings=settings)
    return {"alignment": found if max_streams is None else found.orderBy(F.desc("n"), "topic").limit(max_streams)}


@tool
def frame_times(data: catalog.Dataset, frames: str, clock: str, index: str = "frame_index") -> dict:
    """The rows of a table of frames with the columns of a clock table, by frame number."""
    return {"frames": sync.frame_clock(data.table(frames), data.table(clock), index)}


@tool
def compare_datasets(a: catalog.Dataset, b: catalog.Dataset, settings: Settings = DEFAULTS) -> dict:
    def side(data: catalog.Dataset) -> DataFrame:
        return sync.stream_checks(_clocks(data, settings=settings), ["stream"], "t", ["i"], settings).select("stream", "n", "span_s", "rate_hz")

    return {"streams": compare.compare_datasets(side(a), side(b))}


@tool
def compare_table_columns(data: catalog.Dataset, table_a: str, table_b: str, columns_a: list[str], columns_b: list[str], op: str = "diff", on: str | None = None, settings: Settings = DEFAULTS) -> dict:
    a, b = with_row_index(data.table(table_a)), with_row_index(data.table(table_b))
    key = on or compare.pick_key(a, b)
    if key is None:
        raise ValueError("the tables have no key in common")
    return {"key": key, "stats": compare.compare_tables(a, b, key, columns_a, columns_b, op, settings, order_a="row_index", order_b="row_index")}


@tool
def segment_actions(data: catalog.Dataset, table: str | None = None, fps: float | None = None, method: str = "auto", episode_key: str | None = None, settings: Settings = DEFAULTS) -> dict:
    """Segments of a table, or of one episode. method: auto (all signals), velocity (motion only) or gripper.

    Times follow the table's clock, else the rate given or declared; with neither they are null.
    """
    name = data.name_of(table)
    frame, episode = _episodes(with_row_index(data.table(name)))
    if episode_key is not None:
        frame = frame.where(F.col(episode).cast("string") == F.lit(episode_key))
    gripper = next((c for c in stats.numeric_columns(frame) if "gripper" in c.lower()), None) if method != "velocity" else None
    timed, clock = _timed(data, name, frame, settings)
    usable = [c for c in quality.action_columns(frame) if c not in (episode, clock, gripper)] if method != "gripper" else []
    motion = segment.motion_columns(frame, usable)
    rows = (frame if timed is None else timed).withColumn("_one", F.lit(1))
    rows = windows.running_sum(rows, [episode], ["row_index"], "_one", "_row").withColumn("_row", F.col("_row") - 1)
    return {"segments": segment.segment_actions(rows, [episode], "_row", motion, gripper, _declared(data, name, fps), settings, None if timed is None else "_s")}


def _anchors(data: catalog.Dataset, table: str | None, settings: Settings) -> DataFrame:
    """Where episodes begin and end: by the dataset's own list of episodes and its rate, else by the table's episode column,
    else one for all."""
    if data.meta.get("episodes") and data.meta.get("fps"):
        listed = catalog.lerobot_tasks(data.spark, data.meta.get("tasks", ""), data.meta["episodes"])
        end = F.col("length") / F.lit(float(data.meta["fps"]))
        return listed.select(
            F.col("episode_index").cast("string").alias("episode_key"), F.lit(0.0).alias("start_s"), end.alias("end_s"), F.lit(0).cast("bigint").alias("first_row"),
            (F.col("length") - 1).alias("last_row"), F.col("length").alias("n_rows"), end.alias("duration_s"),
        )
    frame = with_row_index(data.table(table))
    timed, _ = _timed(data, table, frame, settings)
    episode = stats.find_column(frame.columns, stats.EPISODE_NAMES)
    return annotations.episode_anchors(frame if timed is None else timed, episode, None if timed is None else "_s", "row_index", _declared(data, table, None))


@tool
def annotate_task(
    data: catalog.Dataset, table: str | None = None, column: str | None = None, root: str | None = None, confirm: bool = False, settings: Settings = DEFAULTS
) -> dict:
    """Candidate tasks of each episode from a text column, else from the dataset's own list; and the episodes' anchors.

    With a store's folder (root) and confirm the first task of each episode is stored as a record of scope task.
    """
    frame = with_row_index(data.table(table))
    episode = stats.find_column(frame.columns, stats.EPISODE_NAMES)
    text_column = column or stats.find_column(frame.columns, ("task", "instruction", "language_instruction", "task_description"), prefix=True)
    if episode and text_column:
        tasks = stats.first_seen(frame, [episode], text_column, ["row_index"])
    elif data.meta.get("episodes"):
        tasks, episode = catalog.lerobot_tasks(data.spark, data.meta.get("tasks", ""), data.meta["episodes"]).select("episode_index", "tasks"), "episode_index"
    else:
        raise ValueError("an episode column and a text column are needed")
    out = {"tasks": tasks, "anchors": _anchors(data, table, settings)}
    if root and confirm:
        records = tasks.where(F.size("tasks") > 0).select(
            F.lit("task").alias("scope"), F.col(episode).cast("string").alias("episode_key"), F.lit(1).cast("bigint").alias("id"), F.lit("imported").alias("source"), F.col("tasks")[0].alias("label")
        )
        out["saved"] = annotation_store.AnnotationStore(data.spark, root).save(records)
    return out


def _qc(records: DataFrame, use: str, data: catalog.Dataset | None, table: str | None, vocabulary: list[str] | None, settings: Settings) -> DataFrame:
    """The checks of a store's records, with the durations of a dataset's episodes and a vocabulary where they are given."""
    durations = _anchors(data, table, settings).where("duration_s is not null").select("episode_key", "duration_s") if data is not None else None
    words = records.sparkSession.createDataFrame([(w,) for w in vocabulary], "action string") if vocabulary else None
    return annotations.check_annotations(records, use, durations, words, settings)


@tool
def save_annotations(
    spark: SparkSession, root: str, records: DataFrame, use: str = "audit", source: str | None = None, confirmed_by_user: bool = False, dry_run: bool = False,
    episodes: DataFrame | None = None, data: catalog.Dataset | None = None, table: str | None = None, vocabulary: list[str] | None = None, settings: Settings = DEFAULTS,
) -> dict:
    """Validate and store records, then check the whole store for the declared use. A dataset gives the episodes that there
    are and how long they last."""
    if source == "user_confirmed" and not confirmed_by_user:
        raise ValueError("user_confirmed records need confirmed_by_user")
    store = annotation_store.AnnotationStore(spark, root)
    known = episodes if episodes is not None or data is None else _anchors(data, table, settings).select("episode_key")
    saved = store.save(records.withColumn("source", F.lit(source)) if source else records, episodes=known, dry_run=dry_run)
    return saved | ({"qc": _qc(store.load(), use, data, table, vocabulary, settings)} if saved["success"] else {})


@tool
def check_annotation_qc(
    spark: SparkSession, root: str, use: str = "audit", scope: str | None = None, episode_key: str | None = None,
    data: catalog.Dataset | None = None, table: str | None = None, vocabulary: list[str] | None = None, settings: Settings = DEFAULTS,
) -> dict:
    """Findings over a store: with a dataset also what exceeds its episodes, with a vocabulary what is not in it."""
    records = annotation_store.AnnotationStore(spark, root).load(scope=scope, episode_key=episode_key)
    found = _qc(records, use, data, table, vocabulary, settings)
    levels = {r.level for r in found.select("level").distinct().collect()}
    return {
        "findings": found, "result": "fail" if "fail" in levels else "warn" if levels else "pass", "must_declare": annotations.must_declare(records, use).count(),
        "records": annotations.with_times(records),
    }


@tool
def confirm_dataset_profile(spark: SparkSession, root: str, data: catalog.Dataset, kinds: dict | None = None, expected_missing: dict | None = None, capabilities: dict | None = None) -> dict:
    confirmed = data.confirm(kinds or {})
    profile = annotation_store.ProfileStore(spark, root).save(data.path, kinds=kinds or {}, expected_missing=expected_missing or {}, capabilities=capabilities or {})
    return {"profile": profile, "dataset": confirmed}


@tool
def read_file_content(spark: SparkSession, path: str, max_chars: int = DEFAULTS.read_max_chars, start_line: int = 1, keyword: str | None = None) -> dict:
    lines = text.read_lines(spark, path)
    if keyword:
        found = text.grep(lines, keyword)
        return {"lines": found, "text": text.read_excerpt(found, start_line, max_chars)}
    return {"text": text.read_excerpt(lines, start_line, max_chars)}
