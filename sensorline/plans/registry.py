"""Queries of the sensor operators on the test tables, and the SQL each must equal.

The tables stand in for recordings: event types are streams, users are episodes, embeddings are vector columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import annotations, compare, media, quality, sanity, segment, stats, sync, timeaxis, windows
from ..operators.windows import epoch_ns
from ..sources import catalog, envelope, text
from . import charts, sql


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("stream"), "value", epoch_ns("ts").alias("t"), (epoch_ns("ts") / 1e9).alias("s"))


DAY = 86_400_000_000_000


def q01_stream_checks(spark, d):
    return sync.stream_checks(_events(spark, d), ["stream"], "t", ["event_id"], bucket_width=DAY, bucket_rows=200_000)


def q02_stream_shape(spark, d):
    return sync.stream_shape(_events(spark, d), ["stream"], "t", bucket_width=DAY)


def q03_gaps(spark, d):
    return sync.locate_gaps(_events(spark, d), ["stream"], "t", bucket_width=DAY)


def q04_baseline_rank(spark, d):
    return sync.rank_baselines(_events(spark, d), "stream", "t", bucket_width=DAY)


def _offsets(spark, d):
    e = _events(spark, d)
    return sync.residuals(e.where("stream = 'view'").select("stream", "t"), e.where("stream = 'click'"), ["stream"], "t", bucket_width=DAY)


def q05_nearest_residual(spark, d):
    return sync.residual_stats(_offsets(spark, d), ["stream"])


def q06_drift(spark, d):
    e = _events(spark, d)
    offsets = sync.base_offsets(e.where("stream in ('view', 'purchase')").select("stream", "t"), e.where("stream = 'click'"), "stream", "t", bucket_width=DAY)
    return sync.drift(offsets, ["stream"], "t", 1000.0)


def q07_measured_rate(spark, d):
    return timeaxis.measured_rate(_events(spark, d), ["stream"], "t", ["event_id"])


def q08_unit_inference(spark, d):
    e = _events(spark, d)
    clocks = F.array(*[F.struct(F.lit(u).alias("clock"), (F.col("t") / ns).alias("v")) for u, ns in timeaxis.UNIT_NS.items()])
    return timeaxis.infer_unit(e.select(F.explode(clocks).alias("c")).select("c.*"), ["clock"], "v")


def q09_generic_stats(spark, d):
    return stats.generic_stats(_t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag"])


def q10_column_profile(spark, d):
    return stats.column_profile(_t(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])


def _durations(spark, d):
    return _events(spark, d).groupBy("user_id").agg(((F.max("t") - F.min("t")) / 1e9).alias("duration_s"), F.sum("value").alias("total"))


def q11_iqr_outliers(spark, d):
    return stats.iqr_outliers(_durations(spark, d), "total").select("user_id", "total", "low", "high")


def q12_episode_distribution(spark, d):
    return stats.episode_distribution(_events(spark, d), "user_id")


def q13_success_rate(spark, d):
    e = _events(spark, d).withColumn("success", (F.col("stream") == "purchase").cast("int"))
    return stats.success_rate(e, "user_id", "success", ["event_id"])


def q14_bad_values_gate(spark, d):
    l = _t(spark, d, "lineitem")
    odd = l.select(
        F.when(F.col("l_linenumber") == 7, F.lit(None)).otherwise(F.col("l_quantity")).alias("with_null"),
        F.when(F.col("l_quantity") > 45, F.lit(float("nan"))).otherwise(F.col("l_tax")).alias("with_nan"),
        F.when(F.col("l_quantity") < 2, F.lit(float("inf"))).otherwise(F.col("l_discount")).alias("with_inf"),
    )
    return quality.gate_bad_values(odd, ["with_null", "with_nan", "with_inf"])


def q15_monotonic_gate(spark, d):
    e = _events(spark, d).withColumn("shaken", F.when(F.col("event_id") % 97 == 0, F.col("t") - 86_400_000_000_000).otherwise(F.col("t")))
    return quality.gate_monotonic(e, ["user_id"], "shaken", ["event_id"], F.floor(F.col("event_id") / 1000)).drop("first_back")


def q16_frame_loss_gate(spark, d):
    return quality.gate_frame_loss(_events(spark, d), ["stream"], "s")


def _values(spark, d):
    return quality.channels(_events(spark, d), ["user_id"], "event_id", ["value", "s"])


def q17_idle_ratio(spark, d):
    return quality.idle_ratio(_values(spark, d), ["user_id"], "event_id")


def q18_action_spike(spark, d):
    long = quality.channels(_events(spark, d), ["stream"], "event_id", ["value"])
    return quality.action_spikes(long, ["stream"], "event_id", quality.Settings(spike_factor=4.0))


def q18_timed_action_spike(spark, d):
    e = _events(spark, d).withColumn("at", F.col("event_id") / 10 + F.col("event_id") % 3 / 50)
    return quality.action_spikes(quality.channels(e, ["stream"], "event_id", ["value"], ("at",)), ["stream"], "event_id", quality.Settings(spike_factor=4.0), "at")


def q19_action_jerk(spark, d):
    long = quality.channels(_events(spark, d), ["stream"], "event_id", ["value"])
    return quality.action_jerk(long, ["stream"], "event_id")


def q20_pauses(spark, d):
    return quality.pauses(_values(spark, d), ["user_id"], "event_id", quality.Settings(pause_steps=3, idle_speed=0.3))


def q21_arm_shaking(spark, d):
    long = quality.channels(_events(spark, d), ["stream"], "event_id", ["value"])
    return quality.arm_shaking(long, ["stream"], "event_id")


def q22_path_efficiency(spark, d):
    return quality.path_efficiency(_values(spark, d), ["user_id"], "event_id")


def q23_actuator_saturation(spark, d):
    l = _t(spark, d, "lineitem").select(F.col("l_suppkey"), (F.col("l_orderkey") * F.lit(10_000_000_000) + F.col("l_linenumber").cast("bigint") * F.lit(1_000_000_000) + F.col("l_partkey")).alias("row"), "l_quantity", (F.col("l_tax") * 500).alias("scaled"))
    return quality.actuator_saturation(l, ["l_suppkey"], "row", [("l_quantity", "scaled")])


def _totals(spark, d):
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("index")).agg(F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity"))


def _orders(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("index"), F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("quantity"))


def _compared(op):
    def run(spark, d):
        columns = ["price", "quantity"] if op == "distance" else ["price"]
        return compare.compare_tables(_orders(spark, d), _totals(spark, d), "index", columns, columns, op, check=False).withColumn("bins", F.array_join("bins", ","))

    return run


q24_compare_diff, q24_compare_ratio, q24_compare_distance = map(_compared, ("diff", "ratio", "distance"))


def q25_compare_duplicate_keys(spark, d):
    l = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("index"), "l_linenumber", "l_extendedprice", "l_quantity")
    order = ["l_linenumber", "l_extendedprice", "l_quantity"]  # line numbers repeat within orders; rows equal in all three are alike
    joined = compare.join_by_key(l, l, "index", ["l_extendedprice"], ["l_quantity"], order, order)
    return compare.compare_columns(joined, ["l_extendedprice"], ["l_quantity"], "ratio")


def q26_dataset_diff(spark, d):
    def side(name, key, value):
        return _t(spark, d, name).groupBy(F.col(key).alias("stream")).agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("span_s"), F.avg(value).alias("rate_hz"))

    a = side("customer", "c_nationkey", "c_acctbal").where("stream < 20")
    return compare.compare_datasets(a, side("supplier", "s_nationkey", "s_acctbal").where("stream > 3"))


def q27_vector_profile(spark, d):
    e = _t(spark, d, "embeddings")
    zero = F.when(F.col("vec_id") % 7 == 3, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    return stats.vector_profile(e.select("vec_id", zero.alias("v")), "v", "vec_id").withColumn("zero_by_tenth", F.array_join("zero_by_tenth", ","))


def q28_pose_blocks(spark, d):
    return stats.pose_blocks(_t(spark, d, "embeddings"), "embedding", 7)


def q29_stationary_blocks(spark, d):
    return sanity.stationary_blocks(_events(spark, d).withColumn("row", F.col("event_id") - 1), [], "row", "value")


def q30_constant_channels(spark, d):
    o = _t(spark, d, "orders").withColumn("flat", F.lit(3.5))
    return sanity.constant_channels(o, ["o_custkey", "o_totalprice", "flat"])


def q31_clipping(spark, d):
    return sanity.clipping(_t(spark, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"])


def q32_zscores(spark, d):
    return stats.zscores(_events(spark, d).select("event_id", "stream", "value"), ["stream"], "value")


def q33_histogram(spark, d):
    return stats.histogram(_t(spark, d, "lineitem"), "l_extendedprice")


def q34_envelope(spark, d):
    return envelope.json_fields(_t(spark, d, "events").select("event_id", "props"), "props", {"props.k": ("$.k", "bigint")}).select("event_id", F.col("`props.k`").alias("k"))


def q35_segments(spark, d):
    e = _events(spark, d)
    e = windows.running_sum(e.withColumn("one", F.lit(1)), ["stream"], ["event_id"], "one", "row").withColumn("row", F.col("row") - 1)
    return segment.segment_actions(e, ["stream"], "row", ["value"], None, 50.0, segment.Settings(max_segment_s=4.0))


def _sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = _events(spark, d).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(w) > 86_400_000_000_000).cast("int"), F.lit(1)))
    e = e.withColumn("id", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = e.groupBy(F.col("user_id").cast("string").alias("episode_key"), "id").agg((F.min("t") / 1e9 - 1704067200).alias("start_s"), (F.max("t") / 1e9 - 1704067200).alias("end_s"), F.first("stream").alias("_x"))
    return rows.select("episode_key", "id", "start_s", F.when(F.col("id") % 5 == 0, F.col("end_s") + 100000).otherwise(F.col("end_s")).alias("end_s"), F.lit("segment").alias("scope"), F.when(F.col("id") == 2, "llm_proposed").otherwise("imported").alias("source"))


def q36_annotation_qc(spark, d):
    return annotations.check_annotations(_sessions(spark, d), "training")


def q37_snapshot_diff(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("episode_key"), "o_orderstatus", "o_totalprice")
    old = o.where("id % 5 <> 0")
    new = o.where("id % 7 <> 0").withColumn("o_orderstatus", F.when(F.col("id") % 11 == 0, "X").otherwise(F.col("o_orderstatus")))
    return annotations.diff_snapshots(old, new).withColumn("changed", F.array_join("changed", ","))


def q37_upsert_log(spark, d):
    o = _t(spark, d, "orders").select(F.lit("segment").alias("scope"), F.col("o_custkey").cast("string").alias("episode_key"), F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    stored = o.where("id % 3 <> 0")
    incoming = o.where("id % 2 = 0").withColumn("o_orderstatus", F.when(F.col("id") % 4 == 0, "U").otherwise(F.col("o_orderstatus"))).withColumn("nth", F.col("id"))
    return annotations.upsert(stored, incoming, "nth")[1]


def q38_log_lines(spark, d):
    e = _t(spark, d, "events")
    line = F.concat(F.lit("I0101 00:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit(".000250 17 feed.cc:12] "), "event_type")
    lines = e.select(F.col("event_id").alias("row_index"), F.when(F.col("event_id") % 10 == 0, F.col("props")).otherwise(line).alias("value"))
    return text.parse_log(lines)


def q38_timestamp_lines(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("row_index"), F.concat_ws(" ", epoch_ns("ts").cast("string"), F.col("event_id").cast("string")).alias("value"))
    return text.parse_timestamps(e)


def q38_fractional_timestamps(spark, d):
    """Lines of seconds with fractions, a number that rises, one that does not, and a letter; columns as they are found."""
    e = _t(spark, d, "events")
    seconds = F.concat_ws(".", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("string"), F.lpad((F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000).cast("string"), 6, "0"))
    letter = F.when(F.col("event_type") == "click", "C").otherwise("O")
    found = text.parse_timestamps(e.select(F.col("event_id").alias("row_index"), F.concat_ws("  ", seconds, F.col("event_id").cast("string"), F.col("value").cast("string"), letter).alias("value")))
    return found.select("row_index", (F.col("timestamp") * 1_000_000).cast("bigint").alias("timestamp_us"), "frame_index", "value_2", "status")


def q58_props_fields(spark, d):
    """Fields of JSON texts, with the schema of all rows, as columns."""
    flat = envelope.expand(_t(spark, d, "events").select("event_id", "props"), ["event_id", "props.k"])
    return flat.select("event_id", F.col("`props.k`").alias("k"), F.lit(flat.schema["props.k"].dataType.simpleString()).alias("kind"))


def q59_message_fields(spark, d):
    """Conversations as JSON messages whose fields differ by role, opened into columns."""
    c = _t(spark, d, "conversations")
    said = F.struct(F.col("turn").alias("n"), F.length("text").alias("size"))
    message = F.when(F.col("role") == "user", F.to_json(F.struct("role", said.alias("said")))).otherwise(F.to_json(F.struct(F.col("role"), (F.length("text") / 4).alias("score"), F.array(F.col("turn"), F.col("turn") + 1).alias("span"))))
    flat = envelope.expand(c.select("conv_id", "turn", message.alias("m")))
    return flat.select("conv_id", "turn", *[F.col(f"`m.{f}`").alias(f.replace(".", "_")) for f in ("role", "said.n", "said.size", "score", "span.0", "span.1")])


def q39_steady_rate(spark, d):
    return timeaxis.steady_rate(_events(spark, d), ["stream"], "t")


def q40_container_alignment(spark, d):
    e = _events(spark, d).withColumn("container", F.concat(F.lit("c"), F.col("user_id") % 4))
    return sync.container_alignment(e, "container", "stream", "t")


def _recording(spark, d):
    """The event streams and a burst stream: each order's row times twenty points, two milliseconds from burst to burst."""
    e = _events(spark, d).select("stream", "t", F.col("event_id").alias("i"))
    low = e.agg(F.min("t")).first()[0]
    o = _t(spark, d, "orders").where("o_orderkey <= 200").select(F.col("o_orderkey").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(19))).alias("j"))
    burst = o.select(F.lit("tf").alias("stream"), (F.lit(low) + F.col("k") * 2_000_000 + F.col("j") * 1_000).alias("t"), (F.col("k") * 20 + F.col("j")).alias("i"))
    return e.unionByName(burst)


def q40_burst_alignment(spark, d):
    rows = _recording(spark, d).withColumn("container", F.lit("c"))
    return sync.container_alignment(rows, "container", "stream", "t", bucket_width=DAY)


def q41_sync_report(spark, d):
    return sync.sync_report(_recording(spark, d), "stream", "t", ["i"], baseline="click", bucket_width=DAY, bucket_rows=200_000)


def q42_episode_bounds(spark, d):
    e = _events(spark, d).withColumn("t", F.when(F.col("user_id") % 9 == 0, -F.col("t")).otherwise(F.col("t")))
    return quality.gate_episode_bounds(e, "user_id", "t", "event_id")


def q43_range_of_motion(spark, d):
    return stats.range_of_motion(_t(spark, d, "part"), ["p_size", "p_retailprice"])


def q44_last_duration(spark, d):
    return stats.last_value(_events(spark, d), "user_id", "value", ["event_id"])


def q45_label_balance(spark, d):
    return stats.capability_counts(_t(spark, d, "events"), "event_type")


def q46_task_candidates(spark, d):
    return stats.first_seen(_events(spark, d), ["user_id"], "stream", ["event_id"]).withColumn("tasks", F.array_join("tasks", ","))


def q47_gate_fps(spark, d):
    return quality.gate_fps(_events(spark, d), ["stream"], "t", ["event_id"], 0.001)


def q48_difference_stats(spark, d):
    return stats.difference_stats(_t(spark, d, "orders"), "o_totalprice").withColumn("bins", F.array_join("bins", ","))


def q49_chart_series(spark, d):
    return charts.time_series(_events(spark, d), "stream", "t", "value", 200)


def q50_force_checks(spark, d):
    return sanity.force_checks(_t(spark, d, "lineitem"), ["l_quantity", "l_discount"])


def q51_document_grep(spark, d):
    lines = _t(spark, d, "events").select(F.col("event_id").alias("row_index"), F.concat_ws(" ", "event_type", "props").alias("value"))
    return text.grep(lines, "purchase", bucket=F.floor(F.col("row_index") / 1000))


def q52_episode_anchors(spark, d):
    return annotations.episode_anchors(_events(spark, d), "user_id", "s", "event_id")


def q53_quaternion_groups(spark, d):
    e = _t(spark, d, "embeddings")
    cols = [F.col("embedding")[i].alias(f"rot_{a}") for i, a in enumerate("wxyz")]
    return sanity.quaternion_groups(e.select(*cols), {"rot_": [f"rot_{a}" for a in "wxyz"]})


def q54_imu_checks(spark, d):
    """Two devices, one of them with a constant axis."""
    e = _events(spark, d)
    e = e.select(
        F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd").alias("device"), "event_id", (9.7 + F.col("value") / 1e4).alias("accel_x"),
        (F.col("value") / 1e3).alias("accel_y"), F.when(F.col("user_id") % 2 == 0, 0.1).otherwise(F.col("event_id") % 7 / 100).alias("accel_z"), (0.001 + F.col("value") / 1e6).alias("gyro_x"),
    )
    e = windows.running_sum(e.withColumn("one", F.lit(1)), ["device"], ["event_id"], "one", "row").withColumn("row", F.col("row") - 1)
    return sanity.imu_checks(e, ["device"], "row", ["accel_x", "accel_y", "accel_z"], ["gyro_x"])


def q55_running_sum(spark, d):
    return windows.running_sum(_events(spark, d).select("event_id", "stream", "value"), ["stream"], ["event_id"], "value", "total")


def q56_fill(spark, d):
    e = _events(spark, d).select("event_id", "stream", F.when(F.col("event_id") % 5 < 2, F.col("value")).alias("value"))
    return windows.filled(e, ["stream"], "event_id", ["value"])


def q57_is_clock(spark, d):
    e = _events(spark, d).select("stream", "event_id", (F.col("event_id") * 8.33).alias("steady"), "value")
    columns = F.explode(F.array(F.struct(F.lit("steady").alias("column"), F.col("steady").alias("v")), F.struct(F.lit("value").alias("column"), F.col("value").alias("v"))))
    return timeaxis.is_clock(e.select("event_id", columns.alias("c")).select("event_id", "c.*"), ["column"], "v", ["event_id"])


def q60_times_in_ns(spark, d):
    """Clock values of several units in nanoseconds, and the unit that the size of a value hints at."""
    units = F.element_at(F.array(*map(F.lit, ("ns", "us", "ms", "s", "frame_index"))), (F.col("event_id") % 5 + 1).cast("int"))
    rows = _events(spark, d).select("event_id", "t", units.alias("unit"))
    scaled = F.expr("t div element_at(array(1L, 1000L, 1000000L, 1000000000L, 1L), int(event_id % 5 + 1))")
    return rows.select("event_id", "unit", timeaxis.to_ns(scaled, F.col("unit")).alias("ns"), timeaxis.unit_hint(scaled).alias("hint"))


def q61_gripper_flips(spark, d):
    return segment.gripper_flips(_events(spark, d), ["stream"], "event_id", "value")


def q62_merged_segments(spark, d):
    """A customer's orders as segments in a row, of lengths by their keys; short ones join their neighbours."""
    orders = _t(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("k"))
    parts = orders.select(
        "o_custkey", (F.col("k") * 10).alias("start_frame"), (F.col("k") * 10 + 9).alias("end_frame"), F.col("k").cast("double").alias("start_s"),
        (F.col("k") + F.col("k") * 7 % 100 / 128).alias("end_s"), F.concat(F.lit("e"), F.col("k").cast("string")).alias("evidence"),
    )
    return segment.merge_short(parts, ["o_custkey"])


def q64_time_texts(spark, d):
    e = _events(spark, d).withColumn("sec", F.col("value") * 37 - 900)
    texts = F.when(F.col("event_id") % 4 == 0, F.concat_ws(":", (F.col("event_id") % 100).cast("string"), F.lit("07"), F.lit("1.5"))).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" -"), (F.col("event_id") % 60).cast("string"), F.lit(":30")))
    texts = texts.when(F.col("event_id") % 4 == 2, F.col("event_id").cast("string")).otherwise(F.lit("1:x"))
    return e.select("event_id", annotations.format_time(F.col("sec")).alias("shown"), annotations.parse_time(texts).alias("parsed"))


def q65_record_errors(spark, d):
    """Orders as annotations with all that can be wrong; their defaults and errors."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    pick = lambda n, *values: F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (k % n % len(values) + 1).cast("int"))
    records = o.select(
        pick(7, "segment", "task", "other").alias("scope"), pick(5, None, " Imported ", "user_confirmed", "guess").alias("source"), pick(11, None, "HIGH", "odd").alias("confidence"),
        F.when(k % 13 > 0, F.col("o_custkey").cast("string")).alias("episode_key"), k.alias("id"), (k % 17 - 1).cast("double").alias("start_s"), (k % 19).cast("double").alias("end_s"),
        (k % 3 == 0).alias("is_noise"), pick(4, None, "blur").alias("cleaning_reason"), pick(2, "pick", " ").alias("label"), pick(6, "left", "foot", None).alias("interacting_hand"),
    )
    got = annotations.validate(annotations.normalise(records))
    return got.select("id", "source", "confidence", F.array_join("errors", ",").alias("errors"))


def q66_estimated_frames(spark, d):
    line = _t(spark, d, "lineitem")
    frames = F.when(F.col("l_linenumber") % 3 == 1, 1).when(F.col("l_linenumber") % 3 == 2, F.col("l_quantity") * 40)
    media = line.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("fps"), (F.col("l_extendedprice") / 1000).cast("double").alias("duration_s"), frames.cast("bigint").alias("n_frames"))
    return catalog.estimate_frames(media).select("l_orderkey", "l_linenumber", "n_frames", "estimated")


def q67_rate_consistency(spark, d):
    rates = timeaxis.measured_rate(_events(spark, d), ["stream"], "t", ["event_id"])
    nominal = F.when(F.col("stream") == "click", F.col("rate_hz") * 1.04).when(F.col("stream") == "view", F.col("rate_hz") * 1.2)
    return rates.select("stream", "n", timeaxis.compare_rates(F.col("rate_hz"), nominal).alias("consistency"))


def q68_camera_coverage(spark, d):
    o = _t(spark, d, "orders")
    nodes = o.select((F.col("o_custkey") % 50).alias("container"), F.concat(F.lit("cam"), (F.col("o_orderkey") % 23).cast("string")).alias("camera"), (F.col("o_orderkey") % 3 == 0).alias("is_clock"))
    found = sync.camera_coverage(nodes)
    return found.select("container", F.array_join("without_clock", ",").alias("without_clock"), F.array_join("without_images", ",").alias("without_images"))


def q69_frame_clock(spark, d):
    e = _events(spark, d).withColumnRenamed("event_id", "frame_index")
    return sync.frame_clock(e.select("frame_index", "value"), e.select("frame_index", "t"))


def q70_clock_conflicts(spark, d):
    """Streams written in bursts, with a steady clock of their own beside."""
    e = _events(spark, d).select(
        F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("stream"), (F.floor(F.col("event_id") / 200) * 2_000_000_000 + F.col("event_id") % 200 * 1_000).alias("written"),
        (F.col("event_id") * 100_000_000).alias("taken"), F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("rare"),
    )
    return sync.clock_conflicts(e, ["stream"], ["written", "taken", "rare"])


def q71_trajectory(spark, d):
    return charts.trajectory(_events(spark, d).select("event_id", "value", "user_id"), "event_id", ["value", "user_id"], 100)


def q72_overlay(spark, d):
    e = _events(spark, d)
    return charts.overlay({n: e.where(F.col("stream") == n) for n in ("click", "view", "error")}, "t", dict.fromkeys(("click", "view", "error"), "value"), 50)


def q73_visual_quality(spark, d):
    return quality.visual_quality(_t(spark, d, "part").select("p_partkey", (F.col("p_size") * 4).alias("width"), (F.col("p_size") * 8).alias("height"), (F.col("p_retailprice") - 1000).cast("double").alias("duration_s")))


def q75_video_versions(spark, d):
    """Names of video files, with the suffixes of versions."""
    end = F.element_at(F.array(*map(F.lit, ("_480", "_1080", "_HD", "_raw", ""))), (F.col("p_partkey") % 5 + 1).cast("int"))
    stem = F.concat(F.lit("Clip"), (F.col("p_partkey") % 97).cast("string"), end)
    files = _t(spark, d, "part").select(stem.alias("stem"), F.concat(stem, F.lit(".mp4")).alias("name"), F.when(F.col("p_partkey") % 10 > 0, "video").otherwise("audio").alias("group")).distinct()
    return catalog.version_groups(files).select("base", F.array_join("names", ",").alias("names"))


def q76_imu_pairs(spark, d):
    word = F.element_at(F.array(*map(F.lit, ("_accel", "_Accelerometer", "_gyro", "_gyroscope", "_mag"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    streams = _t(spark, d, "customer").select(F.concat(F.lit("dev"), (F.col("c_custkey") % 31).cast("string"), word, F.lit(".csv")).alias("name")).distinct()
    return catalog.imu_pairs(streams)


def q77_episode_mirrors(spark, d):
    fmt = F.element_at(F.array(*map(F.lit, (".csv", ".parquet", ".jsonl"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    stem = F.concat(F.when(F.col("o_custkey") % 4 > 0, "episode_").otherwise("other_"), F.col("o_custkey").cast("string"))
    tables = _t(spark, d, "orders").select(F.concat(stem, fmt).alias("name"), stem.alias("stem"), (F.col("o_orderkey") % 2).alias("n_rows")).distinct()
    return catalog.episode_mirrors(tables).select("stem", F.array_join("names", ",").alias("names"))


def q78_frame_times(spark, d):
    """Streams as side tables of videos: of one as many frames as rows, of one uncounted frames, the others with more or fewer."""
    e = _events(spark, d)
    frames = F.when(F.col("stream") == "click", F.lit(None)).when(F.col("stream") == "view", F.col("n")).otherwise(F.expr("n * if(stream < 'm', 2, 1) + n div 10"))
    counts = e.groupBy("stream").agg(F.count("*").alias("n")).select("stream", frames.cast("bigint").alias("n_frames"))
    return media.frame_times(e, counts, "stream")


def q79_media_rates(spark, d):
    """Users as videos whose headers state 20 to 29 frames a second, beside their times taken a million times as fast."""
    e = _events(spark, d)
    videos = e.groupBy("user_id").agg(F.when(F.col("user_id") % 7 > 0, 20 + F.col("user_id") % 10).alias("fps"))
    return media.check_rates(videos, e.where("event_id % 5 > 0").select("user_id", F.expr("t div 1000000").alias("t")), "user_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for k, v in globals().items() if k[0] == "q" and k[1:3].isdigit()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return q41_sync_report(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: sql.ORACLES[k] for k in QUERIES if k in sql.ORACLES}
