"""Statistics, sanity, comparison, segments and annotations on closed-form inputs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sensorline.operators import annotations, compare, sanity, segment, stats, windows


def test_generic_stats_skips_bad_values_and_null_groups(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), (None, 9.0)], "g string, x double")
    got = stats.generic_stats(rows, ["x"], ["g"]).collect()
    assert [(r.g, r.n, r.mean, r.median) for r in got] == [("a", 2, 2.0, 2.0)]


def test_success_takes_the_last_row(spark):
    rows = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, 0, 0), (2, 1, 1)], "ep int, i int, ok int")
    assert tuple(stats.success_rate(rows, "ep", "ok", ["i"]).first()) == (2, 1, 0.5)


def test_iqr(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.1, 1.2, 1.3, 8.0])], "ep int, v double")
    assert [r.ep for r in stats.iqr_outliers(rows, "v").collect()] == [4]
    assert stats.iqr_outliers(rows.where("ep < 3"), "v").count() == 0


def test_vector_text(spark):
    rows = spark.createDataFrame([(i, "0.0 0.0 0.0" if i < 20 else f"[{i}, 1 2]") for i in range(50)] + [(50, "x y")], "i bigint, v string")
    got = stats.vector_profile(rows, "v", "i").first()
    assert (got.n, got.n_vectors, got.n_zero, got.zero_share, got.dims, got.zero_contiguous) == (51, 50, 20, 0.4, 3, True)


def test_unit_quaternion_block(spark):
    rows = spark.createDataFrame([([float(i), 0.0, 1.0, 0.0, 0.0, 0.0, 1.0],) for i in range(5)], "v array<double>")
    got = stats.pose_blocks(rows, "v", 7).first()
    assert got.quat_valid and (got.x_min, got.x_max) == (0.0, 4.0)


def test_histogram_closes_the_last_bin(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    assert [r.n for r in stats.histogram(rows, "x", 10).orderBy("bin").collect()] == [1] * 9 + [2]
    assert stats.histogram(rows.limit(0), "x").count() == 0


def imu(spark, norm, gyro=0.001):
    wave = [norm * 1e-3 * math.sin(i) for i in range(200)]
    rows = [(i, (norm if i < 100 else norm + 5 * norm * math.sin(i)), wave[i], wave[-i], gyro * (1 + i % 3 / 1000)) for i in range(200)]
    return spark.createDataFrame(rows, "row bigint, accel_x double, accel_y double, accel_z double, gyro_x double").withColumn("d", F.lit("imu"))


@pytest.mark.parametrize(("norm", "unit", "verdict"), [(9.8, "m/s2", "pass"), (1.0, "g", "pass"), (8.6, "m/s2", "fail"), (16_000.0, "raw", "pass"), (5.0, "undetermined", "pass")])
def test_imu(spark, norm, unit, verdict):
    got = sanity.imu_checks(imu(spark, norm), ["d"], "row", ["accel_x", "accel_y", "accel_z"], ["gyro_x"]).first()
    assert (got.accel_unit, got.verdict) == (unit, verdict)


def test_gyro_bias_by_unit(spark):
    axes = ["accel_x", "accel_y", "accel_z"]
    assert sanity.imu_checks(imu(spark, 9.8, 0.3), ["d"], "row", axes, ["gyro_x"]).first().verdict == "fail"
    assert sanity.imu_checks(imu(spark, 9.8, 3.0), ["d"], "row", axes, ["gyro_x"]).first().gyro_bias_deg_s == pytest.approx(3.0, rel=1e-2)


def test_a_constant_axis_warns_and_is_not_judged(spark):
    rows = imu(spark, 7.0).withColumn("accel_z", F.lit(0.0))
    got = sanity.imu_checks(rows, ["d"], "row", ["accel_x", "accel_y", "accel_z"], []).first()
    assert (got.n_constant, got.gravity_error, got.verdict) == (1, None, "warn")


def test_axes_by_column_and_stream_name():
    assert sanity.split_imu(["t", "ax_mss2", "ay_mss2", "gx_radps"]) == {"accel": ["ax_mss2", "ay_mss2"], "gyro": ["gx_radps"]}
    assert sanity.split_imu(["x", "y", "z"], "left_gyro.csv")["gyro"] == ["x", "y", "z"]
    assert sanity.split_imu(["x", "y"], "accel.csv")["accel"] == ["x", "y"] and sanity.split_imu(["x"], "pose.csv") == {"accel": [], "gyro": []}


def test_clipping_and_constant(spark):
    rows = spark.createDataFrame([(max(-0.9, min(0.9, 2 * math.sin(i / 5))), 1.0) for i in range(200)], "fx double, fz double")
    got = {r.column: r.fails for r in sanity.clipping(rows, ["fx", "fz"]).collect()}
    assert got == {"fx": True, "fz": False}
    assert {r.column: r.constant for r in sanity.constant_channels(rows, ["fx", "fz"]).collect()} == {"fx": False, "fz": True}


def test_claims(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 9.8, 0.1, 1.0, 0.0, 0.0, 0.0)] * 5, "ax double, ay double, az double, g double, qw double, qx double, qy double, qz double")
    claim = lambda kind, **k: sanity.verify_claim(rows, kind, **k)["level"]
    assert claim("imu", accel=["ax", "ay", "az"], gyro=["g"]) == "strong"
    assert claim("imu", accel=["ax"]) == "failed"
    assert claim("pose", quaternion=["qw", "qx", "qy", "qz"]) == "strong"
    assert claim("other", fields=["nope"]) == "failed"
    assert sanity.quaternion_names(["rot_w", "rot_x", "rot_y", "rot_z", "px"]) == {"rot_": ["rot_w", "rot_x", "rot_y", "rot_z"]}


def test_duplicate_keys_pair_in_order_or_fail(spark):
    a = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 5.0)], "frame_index int, i int, v double")
    b = spark.createDataFrame([(1, 0, 10.0), (1, 1, 20.0), (3, 0, 7.0)], "frame_index int, i int, v double")
    assert compare.pick_key(a, b) == "frame_index"
    got = compare.compare_columns(compare.join_by_key(a, b, "frame_index", ["v"], ["v"], "i", "i"), ["v"], ["v"])
    assert sorted(r.value for r in got.collect()) == [-18.0, -9.0]
    with pytest.raises(ValueError, match="has 2 rows on one side and 1"):
        compare.join_by_key(a, b.where("i = 0"), "frame_index", ["v"], ["v"], "i", "i")


def test_lines_of_one_number_stay_whole(spark, tmp_path, monkeypatch):
    """Rows alike in key and line number, read by the two sides in opposite order, meet themselves."""
    from sensorline.plans import registry

    lines = spark.range(200).select(F.lit(1).cast("bigint").alias("l_orderkey"), (F.col("id") % 2).cast("int").alias("l_linenumber"), (F.col("id") * 37 % 101 + 1.0).alias("l_quantity"))
    lines.withColumn("l_extendedprice", F.col("l_quantity") * 3).write.parquet(f"{tmp_path}/lineitem.parquet")
    turned = lambda a, b, *how, own=compare.join_by_key: own(a, b.coalesce(1).sortWithinPartitions(F.desc("l_quantity")), *how)
    monkeypatch.setattr(compare, "join_by_key", turned)
    got = registry.q25_compare_duplicate_keys(spark, str(tmp_path)).collect()
    assert len(got) == 200 and {r.value for r in got} == {3.0}


def test_unmatched_keys(spark):
    a, b = (spark.createDataFrame([(k, float(k)) for k in ks], "frame_index int, v double") for ks in ([1, 2, 3], [1, 3, 9]))
    got = compare.compare_tables(a, b, "frame_index", ["v"], ["v"])
    assert (got.first().n, got.first().keys_only_a, got.first().keys_only_b) == (2, 1, 1)


def test_gripper_segments(spark):
    state = [0, 1, 0, 1]
    rows = [("e", i, math.sin(i / 9), float(state[i // 100])) for i in range(400)]
    table = spark.createDataFrame(rows, "ep string, row bigint, joint double, gripper double")
    assert [r.boundary for r in segment.gripper_flips(table, ["ep"], "row", "gripper").orderBy("boundary").collect()] == [100, 200, 300]
    got = segment.segment_actions(table, ["ep"], "row", [], "gripper", 50.0).orderBy("id").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 99), (100, 199), (200, 299), (300, 399)]


def test_motion_segments_cover_every_row(spark):
    speed = [0.1] * 150 + [3.0] * 150 + [0.1] * 150
    place = [sum(speed[: i + 1]) + 0.01 * math.sin(i) for i in range(450)]
    table = spark.createDataFrame([("e", i, p) for i, p in enumerate(place)], "ep string, row bigint, joint double")
    got = segment.segment_actions(table, ["ep"], "row", ["joint"], None, 50.0).orderBy("id").collect()
    assert got[0].start_frame == 0 and got[-1].end_frame == 449
    assert all(a.end_frame + 1 == b.start_frame for a, b in zip(got, got[1:], strict=False))
    assert any(abs(r.start_frame - 150) <= 10 for r in got) and any(abs(r.start_frame - 300) <= 10 for r in got)


def test_long_segments_split_and_no_signal_fails(spark):
    table = spark.createDataFrame([("e", i, float(i % 7), float(i > 3000)) for i in range(4000)], "ep string, row bigint, joint double, gripper double")
    got = segment.segment_actions(table, ["ep"], "row", ["joint"], "gripper", 50.0).collect()
    assert max(r.end_s - r.start_s for r in got) <= 60 and sum(r.end_frame - r.start_frame + 1 for r in got) == 4000
    with pytest.raises(ValueError):
        segment.segment_actions(table, ["ep"], "row", [], None, 50.0)


def test_long_episodes_move_few_times(spark, duck, monkeypatch, tmp_path):
    """In pieces a mean moves each row twice (sum, and sums to the rows that they bound), and segments are those of the SQL."""
    from sensorline.plans import registry

    from .conftest import SF, canonical

    spark.range(2_000).select((F.col("id") % 2).alias("ep"), F.floor(F.col("id") / 2).alias("row"), (F.hash("id") % 100 + 100.0).alias("speed")).write.parquet(f"{tmp_path}/speed")
    speed = spark.read.parquet(f"{tmp_path}/speed")
    plain = {(r.ep, r.row): r.speed for r in segment.smoothed(speed, ["ep"], "row").collect()}
    monkeypatch.setattr(windows, "PIECE_ROWS", 300)
    monkeypatch.setattr(windows, "SPREAD_ROWS", 500)
    dealt = segment.smoothed(speed, ["ep"], "row")
    assert dealt._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 4  # two of them of a row for each piece
    assert {(r.ep, r.row): r.speed for r in dealt.collect()} == pytest.approx(plain) and len(plain) == 2_000
    got = registry.q35_segments(spark, SF)
    want = duck.sql(registry.oracle_sql()["q35_segments"])
    assert canonical([tuple(r) for r in got.collect()], got.columns) == canonical(want.fetchall(), want.columns)


def test_merge_short_keeps_runs_bounded(spark):
    rows = spark.createDataFrame([("e", 0, 4, "start"), ("e", 5, 9, "x"), ("e", 10, 99, "y"), ("e", 100, 104, "z")], "ep string, start_frame bigint, end_frame bigint, evidence string")
    rows = rows.withColumns({"start_s": F.col("start_frame") / 50.0, "end_s": (F.col("end_frame") + 1) / 50.0})
    got = segment.merge_short(rows, ["ep"]).orderBy("start_frame").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == [(0, 104)]
    short = rows.where("end_frame < 10")
    assert segment.merge_short(short, ["ep"]).count() == 2
    assert segment.merge_short(rows.withColumn("end_s", F.lit(None).cast("double")), ["ep"]).count() == 4


def test_segments_on_a_clock(spark):
    """Rows at ten a second, with a pause of the clock in the middle: times are the clock's."""
    state = [0, 1, 0, 1]
    rows = [("e", i, float(state[i // 100]), 50.0 + i / 10 + (5.0 if i >= 150 else 0.0)) for i in range(400)]
    table = spark.createDataFrame(rows, "ep string, row bigint, gripper double, t double")
    got = segment.segment_actions(table, ["ep"], "row", [], "gripper", None, clock_s="t").orderBy("id").collect()
    assert [(r.start_frame, r.start_s, r.end_s) for r in got] == [(0, 0.0, 10.0), (100, 10.0, 25.0), (200, 25.0, 35.0), (300, 35.0, pytest.approx(44.9))]
    none = segment.segment_actions(table, ["ep"], "row", [], "gripper", None).orderBy("id").collect()
    assert [(r.start_frame, r.start_s) for r in none] == [(i, None) for i in (0, 100, 200, 300)]


def test_pieces_change_nothing(spark, monkeypatch):
    """Neighbours, running sums, fills, runs and nearest rows in pieces of few rows, with null and repeated keys."""
    draw = random.Random(4)
    rows = [(draw.choice(["a", "b", None]), i, draw.choice([None, 1.0, 2.0, 5.0]), draw.random() < 0.6) for i in range(500)]
    table = spark.createDataFrame(rows, "k string, i bigint, x double, f boolean")
    right = spark.createDataFrame([(draw.choice(["a", "b"]), draw.randrange(-50, 600)) for _ in range(80)], "k string, i bigint")

    def results():
        near = windows.neighbours(table, ["k"], ["i"], {"p": ("x", -1), "n": ("x", 1)})
        sums = windows.running_sum(table, ["k"], ["i"], "x", "s")
        runs = windows.runs(table, ["k"], ["i"], "f").select("k", "n_rows", "first.i", F.col("last.i").alias("j"))
        frames = [near, sums, windows.filled(table, ["k"], "i", ["x"]), runs, windows.nearest(table, right, ["k"], "i"), stats.rolling_mean(table, ["k"], ["i"], "x", "m")]
        return [sorted(map(str, f.collect())) for f in frames]

    plain = results()
    monkeypatch.setattr(windows, "PIECE_ROWS", 20)
    assert results() == plain


def test_pieces_hold_about_equal_counts(spark, monkeypatch):
    """A zero, a far future, a heavy value and a year's pause among epoch nanoseconds: no piece above twice the mean, and the results
    of the plain window."""
    monkeypatch.setattr(windows, "PIECE_ROWS", 100)
    start, year = 1_700_000_000_000_000_000, 31_536_000_000_000_000
    clock = [0, 9_000_000_000_000_000_000] + [start + i * 1_000_000 + (year if i > 1500 else 0) for i in range(3_000)]
    table = spark.createDataFrame([("a", t, i % 7 == 0) for i, t in enumerate(clock)], "k string, t bigint, f boolean")
    own = windows.extent(table, "t")
    sizes = [r["count"] for r in own.dealt(table, "t", "b").groupBy("b").count().collect()]
    assert len(sizes) >= 25 and max(sizes) <= 2 * len(clock) / len(sizes)
    heavy = table.union(spark.range(2_000).selectExpr("'a'", f"{start + 5}L", "true"))
    parts = windows.extent(heavy, "t").dealt(heavy, "t", "b").groupBy("b").agg(F.count("*").alias("n"), F.count_distinct("t").alias("d")).collect()
    assert max(r.n for r in parts) <= 2_001  # the heavy value, and one that is the same as a double
    times = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (float("inf"),)], "x double").withColumn("d", F.lit("2024-01-01").cast("timestamp"))
    assert windows.Extent(9, (0.0,)).dealt(times, "x", "b").select("b").collect() == [(0,), (1,), (1,), (1,)] and windows.Extent(9, (0.0,)).dealt(times, "d", "b").first().b == 1

    def results():
        near = windows.neighbours(table, ["k"], ["t"], {"p": ("t", -1), "n": ("t", 1)})
        runs = windows.runs(table, ["k"], ["t"], "f").select("k", "n_rows", "first.t")
        return [sorted(map(str, f.collect())) for f in (near, runs, windows.nearest(table, table.where("f"), ["k"], "t"), windows.running_sum(table.withColumn("o", F.lit(1)), ["k"], ["t"], "o", "s"))]

    dealt = results()
    monkeypatch.setattr(windows, "PIECE_ROWS", 1_000_000)
    assert dealt == results()


def jobs(spark, run):
    """How many jobs a call and the collection of its result take."""
    spark.sparkContext.setJobGroup("counted", "counted")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    run().collect()
    after = set(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(after - before)


def test_small_sources_need_no_jobs_for_extents(spark, monkeypatch):
    from sensorline.operators import quality
    from sensorline.plans import registry

    from .conftest import SF

    asked = []
    monkeypatch.setattr(windows, "_recall", lambda key, make, own=windows._recall: asked.append(key) or own(key, make))
    for name, most in (("q23_actuator_saturation", 4), ("q21_arm_shaking", 8), ("q20_pauses", 14), ("q41_sync_report", 50)):
        assert jobs(spark, lambda name=name: registry.queries()[name](spark, SF)) <= most, name
    large = spark.range(300).withColumn("x", F.col("id") % 3).withColumn("channel", F.lit("c"))
    monkeypatch.setattr(windows, "PIECE_ROWS", 100)
    asked.clear()
    quality.arm_shaking(large, [], "id").collect()
    assert len(asked) == 2  # the count and the splits, once


def greedy(values, gap):
    kept = []
    for b in sorted(set(values)):
        if not kept or b - kept[-1] >= gap:
            kept.append(b)
    return kept


@pytest.mark.parametrize("piece", [200, 1_000_000])
def test_boundaries_by_doubling_equal_the_fold(spark, monkeypatch, piece):
    draw = random.Random(piece)
    episodes = {"a": (sorted(draw.sample(range(1, 9_000), 3_000)), 13), "b": ([5, 6, 7, 40], 10), None: (list(range(1, 1_500)), 4), "c": ([77], 9), "d": ([i * 50 for i in range(1, 400)], 50)}
    rows = [(k, b, g) for k, (bs, g) in episodes.items() for b in bs]
    table = spark.createDataFrame(rows, "ep string, boundary bigint, gap bigint")
    want = sorted(((k, b) for k, (bs, g) in episodes.items() for b in greedy(bs, g)), key=str)
    monkeypatch.setattr(windows, "PIECE_ROWS", piece)
    for fold in (1_000_000, 100, 0):
        monkeypatch.setattr(segment, "FOLD", fold)
        assert sorted(((r.ep, r.boundary) for r in segment.kept_boundaries(table, ["ep"]).collect()), key=str) == want
    assert segment.kept_boundaries(table.limit(0), ["ep"]).count() == 0


def test_a_long_episode_of_boundaries(spark):
    """A quarter of a million boundaries in one episode, more than a fold could append."""
    n, gap = 250_000, 7
    table = spark.range(n).select(F.lit("e").alias("ep"), (F.col("id") * 3 + F.col("id") % 2).alias("boundary"), F.lit(gap).cast("bigint").alias("gap"))
    got = [r.boundary for r in segment.kept_boundaries(table, ["ep"]).orderBy("boundary").collect()]
    assert got == greedy([i * 3 + i % 2 for i in range(n)], gap)


SEGMENT = "scope string, episode_key string, id bigint, start_s double, end_s double, source string, is_noise boolean, cleaning_reason string, interacting_hand string, target_object_class string, atomic_action string"


def records(spark):
    return spark.createDataFrame(
        [
            ("segment", "a", 1, 0.0, 2.0, "imported", False, None, "left", "cup", "pick"),
            ("segment", "a", 2, 1.5, 3.0, "llm_proposed", True, " ", None, "cup", "pick"),
            ("segment", "a", 4, 5.0, 5.1, "imported", False, None, "foot", None, "fly"),
            ("segment", "a", 3, 6.0, 90.0, "imported", False, None, None, None, "pick"),
            ("task", "a", 0, None, None, "user_confirmed", None, None, None, None, None),
        ],
        SEGMENT,
    )


def test_annotation_rules(spark):
    vocabulary = spark.createDataFrame([("pick",)], "action string")
    durations = spark.createDataFrame([("a", 60.0)], "episode_key string, duration_s double")
    got = annotations.check_annotations(records(spark), "training", durations, vocabulary).collect()
    assert {(r.rule, r.id) for r in got} == {
        ("time_overlap", 2), ("time_gap", 4), ("time_gap", 3), ("segment_too_short", 4), ("segment_too_long", 3), ("non_monotonic_ids", 3), ("bounds_exceeded", 3),
        ("noise_reason_empty", 2), ("missing_hand", 2), ("missing_hand", 4), ("action_vocab_offlist", 4), ("source_for_declared_use", 2),
    }
    assert annotations.check_annotations(records(spark).limit(0)).count() == 0


def test_upsert_and_diff(spark):
    stored = records(spark)
    new = stored.where("id in (1, 2)").withColumn("end_s", F.when(F.col("id") == 2, 9.0).otherwise(F.col("end_s"))).withColumn("n", F.lit(1))
    later = new.where("id = 2").withColumn("end_s", F.lit(7.0)).withColumn("n", F.lit(2))
    extra = new.where("id = 1").withColumn("id", F.lit(77).cast("bigint"))
    table, log = annotations.upsert(stored, new.union(later).union(extra), "n")
    assert {(r.id, r.action) for r in log.collect()} == {(1, "skipped"), (2, "modified"), (77, "added")}
    assert table.where("id = 2").first().end_s == 7.0 and table.count() == 6
    got = {r.id: (r.state, r.changed) for r in annotations.diff_snapshots(stored, table).collect()}
    assert got[2] == ("modified", ["end_s"]) and got[77][0] == "added" and got[1][0] == "unchanged"


def test_validation_and_times(spark):
    bad = spark.createDataFrame([("x", " ", None, 2.0, 1.0, "rumour")], "scope string, episode_key string, id bigint, start_s double, end_s double, source string")
    assert annotations.validate(bad).first().errors == ["scope", "source", "episode_key", "id"]
    got = spark.createDataFrame([("01:02:03",), ("2:03",), ("-5",), ("x",), ("",), (None,)], "t string").select(annotations.parse_time(F.col("t")).alias("s"))
    assert [r.s for r in got.collect()] == [3723.0, 123.0, -5.0, None, None, None]
    shown = spark.createDataFrame([(3723.4,), (None,), (-61.0,)], "s double").select(annotations.format_time(F.col("s")).alias("t"))
    assert [r.t for r in shown.collect()] == ["01:02:03", "", "-00:01:01"]


def test_anchors(spark):
    rows = spark.createDataFrame([(1, 0, 0.0), (1, 1, 0.5), (None, 2, 7.0)], "ep int, row bigint, s double")
    got = {r.episode_key: (r.duration_s, r.n_rows) for r in annotations.episode_anchors(rows, "ep", "s", "row").collect()}
    assert got == {"1": (0.5, 2), None: (0.0, 1)}


def test_small_rules(spark):
    from sensorline.operators import sync, timeaxis
    from sensorline.plans import charts, report
    from sensorline.sources import catalog

    assert timeaxis.explain_rates(60, 30) == "video is 2 times as fast" and timeaxis.explain_rates(30, 30.1) == "equal" and timeaxis.explain_rates(30, 21) == "unrelated"
    assert sync.master_clock(["/cam/timestamp", "/a/timestamp", "/main_timestamp"]) == "/main_timestamp" and sync.master_clock(["/x"]) is None
    nodes = spark.createDataFrame([("c", "left", False), ("c", "right", False), ("c", "left", True), ("c", "top", True)], "container string, camera string, is_clock boolean")
    assert tuple(sync.camera_coverage(nodes).first()) == ("c", ["right"], ["top"])
    frames = spark.range(5).withColumnRenamed("id", "frame_index")
    assert sync.frame_clock(frames, frames.withColumn("t", F.col("frame_index") * 10)).count() == 5
    with pytest.raises(ValueError):
        sync.frame_clock(frames, frames.where("frame_index > 0"))
    names = spark.createDataFrame([("left_accel.csv",), ("left_gyro.csv",), ("right_accel.csv",)], "name string")
    assert [(r.accel, r.gyro) for r in catalog.imu_pairs(names).collect()] == [("left_accel.csv", "left_gyro.csv")]
    path = spark.range(10_000).select(F.col("id").alias("i"), F.col("id").cast("double").alias("x"))
    assert charts.trajectory(path, "i", ["x"], 100).count() == 100
    assert charts.overlay({"a": path, "b": path}, "i", {"a": "x", "b": "x"}, 10).count() == 20
    assert report.fit_result({"rows": list(range(100_000)), "ok": True}, 2_000)["rows_total"] == 100_000
    assert report.capability_matrix({"has_imu": False})[0]["note"]
