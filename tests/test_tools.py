"""The public functions on a small dataset made here."""

import math

import pytest

from sensorline import tools
from sensorline.sources import mcap


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    imu = ["timestamp_ns,accel_x,accel_y,accel_z,gyro_x"] + [f"{i * 10_000_000},{0.0 if i < 100 else math.sin(i)},0.0,9.8,0.001" for i in range(300)]
    cam = ["timestamp_ns,frame"] + [f"{i * 10_000_000 + 1_000_000},{i}" for i in range(300)]
    arm = ["episode_index,timestamp,action_joint0,action_joint1,state_joint0,gripper,success,task"]
    arm += [f"{e},{i / 50},{math.sin(i / 9)},{math.cos(i / 9)},{math.sin(i / 9)},{int(i >= 100)},{int(e == 0 and i == 199)},pick up" for e in range(2) for i in range(200)]
    for name, lines in (("imu.csv", imu), ("cam_front.csv", cam), ("arm_actions.csv", arm)):
        (root / name).write_text("\n".join(lines) + "\n")
    (root / "notes.md").write_text("first\nsecond line\nthird\n")
    return str(root)


@pytest.fixture(scope="module")
def data(spark, folder):
    got = tools.load_dataset(spark, folder)
    assert got["success"] and got["n_tables"] == 3 and got["probe_errors"] == []
    return got["dataset"]


def test_overview(data):
    assert data.main_table() == "arm_actions.csv"
    assert tools.list_tables(data)["tables"].count() == 3
    assert tools.profile_data(data, "imu")["n_rows"] == 300
    rows = {r.name: r for r in tools.inspect_streams(data)["streams"].collect()}
    assert rows["imu.csv"].rate_hz == pytest.approx(100) and rows["imu.csv"]["shape"] == "periodic"


def test_sync_and_sanity(data):
    got = {r.stream: r for r in tools.check_temporal_sync(data, streams=["imu", "cam"], locate_gaps=True)["report"].collect()}
    assert got["imu.csv"].verdict == "pass" or got["cam_front.csv"].verdict == "pass"
    assert max(r.mean_ms or 0 for r in got.values()) == pytest.approx(1.0)
    assert tools.check_temporal_sync(data, streams=["imu"])["success"] is False
    checks = tools.check_sensor_sanity(data, table="imu.csv")["checks"]
    got = checks["imu.csv:imu"].first()
    assert (got.n, got.n_constant, got.verdict) == (300, 2, "warn") and checks["imu.csv:clipping"].count() == 4
    assert set(tools.check_sensor_sanity(data, "imu")["checks"]) == {"imu.csv:imu", "imu.csv:clipping"}
    assert tools.check_temporal_sync(data, "nothing")["success"] is False


def test_quality(data):
    got = tools.check_dataset_quality(data, fps=50.0)
    assert got["gates"]["nan_inf"] == "pass" and got["gates"]["frame_loss"] == "pass" and got["gates"]["fps_valid"] == "pass"
    assert got["verdict"] in ("pass", "warn") and "visual_quality" in got["not_audited"]
    assert tools.check_dataset_quality(data, fps=40.0)["gates"]["fps_valid"] == "warn"
    media = data.spark.createDataFrame([(32, 480, 1.0)], "width int, height int, duration_s double")
    assert tools.check_dataset_quality(data, fps=0.0, media=media)["diagnostics"]["visual_quality"] == "warn"


def test_declared_rates_and_warnings(spark, tmp_path):
    """A configuration's rate, a repeated time, accelerometer and gyroscope in files of their own, and a clock known by content."""
    (tmp_path / "session.json").write_text('{"nominal_hz": 50, "name": "x"}')
    rows = [f"{0 if i == 1 else i * 20},{math.sin(i / 9)},{i % 2}" for i in range(200)]
    (tmp_path / "arm_actions.csv").write_text("\n".join(["timestamp_ms,action_joint0,gripper", *rows]) + "\n")
    for name, scale in (("left_accel.csv", 9.8), ("left_gyro.csv", 0.01)):
        lines = [f"{1_700_000_000_000_000_000 + i * 10_000_000},{scale + i % 7 / 1000},{i % 5 / 1000},{i % 3 / 1000}" for i in range(300)]
        (tmp_path / name).write_text("\n".join(["tick,x,y,z", *lines]) + "\n")
    (tmp_path / "clip.mp4").write_bytes(b"x")
    found = tools.load_dataset(spark, str(tmp_path))
    data = found["dataset"]
    assert found["nominal_rate"] == {"value": 50.0, "provenance": "declared", "source": "session.json:nominal_hz"} and found["capabilities"]["has_declared_rate"]
    assert [tuple(r) for r in found["relations"]["imu"].collect()] == [("imu_6axis", "left_accel.csv", "left_gyro.csv")]
    assert {s.name: s.timestamp_column for s in data.entries if "left" in s.name} == {"left_accel.csv": "tick", "left_gyro.csv": "tick"}
    got = tools.check_dataset_quality(data, "arm_actions")
    assert (got["declared_fps"], got["gates"]["timestamp_monotonic"], got["gates"]["fps_valid"]) == (50.0, "warn", "pass")
    imu = tools.check_sensor_sanity(data, "imu")["checks"]["left_accel.csv:imu"].first()
    assert (imu.accel_unit, imu.gyro_unit, imu.n_constant) == ("m/s2", "rad/s", 0)
    streams = {r.name: r.consistency for r in tools.inspect_streams(data)["streams"].collect()}
    assert streams["arm_actions.csv"] == "match" and streams["left_gyro.csv"] == "mismatch"
    spans = tools.segment_actions(data, "arm_actions", method="velocity")["segments"].agg({"end_s": "max"}).first()[0]
    assert spans == pytest.approx(199 * 0.02)


def test_stats_and_charts(data):
    rate = tools.compute_stats(data, "success_rate")["stats"].first()
    assert (rate.n_episodes, rate.n_success) == (2, 1)
    assert tools.compute_stats(data, "episodes")["stats"].count() == 2
    assert tools.compute_stats(data, "nope")["success"] is False
    assert tools.plot_chart(data, "histogram", "action_joint0")["series"].count() == 30
    tasks = tools.annotate_task(data)
    assert tasks["tasks"].first().tasks == ["pick up"] and {r.duration_s for r in tasks["anchors"].collect()} == {199 / 50}
    path = tools.plot_chart(data, "trajectory")
    assert path["plot_spec"]["labels"] == {"action_joint0": "action joint0", "action_joint1": "action joint1", "state_joint0": "state joint0"}
    assert tools.plot_chart(data, "multi_stream_overlay", streams=["imu.csv", "cam_front.csv"])["series"].select("stream").distinct().count() == 2
    line = tools.plot_chart(data, "line", table="imu")["plot_spec"]
    assert (line["x"], line["y"], line["labels"]["timestamp_ns"]) == ("timestamp_ns", "accel_x", "timestamp (ns)")
    assert {"std", "q25", "samples"} <= set(tools.profile_data(data)["profile"].columns)


def test_segments_and_comparison(data):
    got = tools.segment_actions(data, fps=50.0, method="gripper")["segments"].collect()
    assert sorted((r.episode_index, r.start_frame) for r in got) == [(0, 0), (0, 100), (1, 0), (1, 100)]
    same = tools.compare_table_columns(data, "imu", "imu", ["accel_z"], ["accel_z"], on="timestamp_ns")["stats"].first()
    assert same.n == 300 and same.max == 0
    assert {r.state for r in tools.compare_datasets(data, data)["streams"].collect()} == {"matched"}


def test_claims_profiles_and_documents(spark, data, folder, tmp_path):
    got = tools.propose_stream_semantics(data, {"imu.csv": "imu", "cam_front.csv": "pose"}, confirm=True)
    assert got["results"]["imu.csv"]["level"] == "strong" and got["results"]["cam_front.csv"]["level"] == "failed"
    kept = tools.confirm_dataset_profile(spark, str(tmp_path / "profiles"), data, {"cam_front.csv": "video"}, {"imu.csv": ["gyro_*"]})
    assert kept["profile"]["kinds"] == {"cam_front.csv": "video"}
    again = tools.confirm_dataset_profile(spark, str(tmp_path / "profiles"), data, {"imu.csv": "imu"})
    assert set(again["profile"]["kinds"]) == {"cam_front.csv", "imu.csv"} and again["profile"]["expected_missing"] == {"imu.csv": ["gyro_*"]}
    assert tools.confirm_dataset_profile(spark, str(tmp_path), data, {"x": "imu"})["success"] is False
    assert tools.read_file_content(spark, f"{folder}/notes.md", start_line=2)["text"].startswith("second line")
    assert tools.read_file_content(spark, f"{folder}/notes.md", keyword="SECOND")["lines"].count() == 3


def test_annotation_store(spark, tmp_path):
    root = str(tmp_path / "annotations")
    rows = spark.createDataFrame([("segment", "a", 1, 0.0, 2.0), ("segment", "a", 2, 2.0, 4.0)], "scope string, episode_key string, id bigint, start_s double, end_s double")
    assert tools.save_annotations(spark, root, rows, source="user_confirmed")["success"] is False
    first = tools.save_annotations(spark, root, rows, source="imported")
    assert (first["added"], first["version"]) == (2, 1)
    assert tools.save_annotations(spark, root, rows, source="imported")["skipped"] == 2
    store = tools.annotation_store.AnnotationStore(spark, root)
    assert store.snapshot("one")["success"] and not store.snapshot("one")["success"]
    bad = spark.createDataFrame([("segment", "a", 9, 5.0, 1.0)], rows.schema)
    assert tools.save_annotations(spark, root, bad, source="imported")["error"] == "invalid_records"
    assert tools.save_annotations(spark, root, rows.union(rows), source="imported")["success"] is False
    changed = spark.createDataFrame([("segment", "a", 2, 2.5, 4.0)], rows.schema)
    assert tools.save_annotations(spark, root, changed, source="imported", dry_run=True)["version"] is None
    assert tools.save_annotations(spark, root, changed, source="imported")["modified"] == 1
    assert store.delete(rows.where("id = 1"))["removed"] == 1 and not store.delete(rows.where("id = 1"))["success"]
    assert store.snapshot("two")["version"] == 3
    assert {(r.id, r.state) for r in store.diff("one", "two").collect()} == {(1, "removed"), (2, "modified")}
    assert {r.action for r in store.history().collect()} == {"added", "modified", "removed"}
    assert tools.check_annotation_qc(spark, root)["result"] == "pass" and len(store.snapshots()) == 2


def test_annotation_checks_against_a_dataset(spark, data, tmp_path):
    """Durations and vocabulary reach the checks; defaults, texts for times and rules of records."""
    root = str(tmp_path / "a")
    columns = "scope string, episode_key string, id bigint, start_timestamp string, end_timestamp string, atomic_action string, is_noise boolean, cleaning_reason string"
    rows = spark.createDataFrame([("segment", "0", 1, "0", "00:00:02", "pick", False, None), ("segment", "1", 1, "1.5", "9", "fly", False, None)], columns)
    saved = tools.save_annotations(spark, root, rows, data=data, vocabulary=["pick"])
    assert saved["success"] and {r.rule for r in saved["qc"].collect()} >= {"bounds_exceeded", "action_vocab_offlist"}
    got = tools.check_annotation_qc(spark, root, data=data, vocabulary=["pick", "fly"])
    assert got["result"] == "fail" and {r.rule for r in got["findings"].collect()} == {"bounds_exceeded"}
    kept = {r.episode_key: (r.source, r.confidence, r.end_timestamp) for r in got["records"].collect()}
    assert kept == {"0": ("llm_proposed", "low", "00:00:02"), "1": ("llm_proposed", "low", "00:00:09")}
    unknown = spark.createDataFrame([("segment", "7", 1, "0", "1", "pick", False, None)], columns)
    assert tools.save_annotations(spark, root, unknown, data=data)["errors"][0]["errors"] == ["unknown_episode"]
    noisy = spark.createDataFrame([("segment", "0", 2, "2", "3", "pick", True, " ")], columns)
    assert tools.save_annotations(spark, root, noisy, data=data)["errors"][0]["errors"] == ["noise_reason"]
    assert tools.annotate_task(data, root=root, confirm=True)["saved"]["added"] == 2


def test_containers(spark, tmp_path):
    messages = [("/a", "json", i * 1_000_000, {}) for i in range(200)] + [("/b", "json", 50_000_000 + i * 1_000_000, {}) for i in range(150)]
    (tmp_path / "c.mcap").write_bytes(mcap.write_example(messages))
    got = {r.topic: r for r in tools.align_container_streams(spark, str(tmp_path / "c.mcap"))["alignment"].collect()}
    assert got["/b"].head_offset_s == 0.05 and got["/b"].flagged and got["/a"].master == "/a"
    assert tools.unpack_mcap(spark, str(tmp_path / "c.mcap"), str(tmp_path / "out"), fmt="xml")["success"] is False
    assert tools.unpack_mcap(spark, str(tmp_path / "c.mcap"), str(tmp_path / "out"), ["/a"], "csv")["success"]


def test_report(spark, data):
    got = tools.generate_report(spark, "Title", {"Tables": data.list_tables(), "Note": "text"}, data=data, quality_result={"verdict": "warn", "warned": ["idle_ratio"]})
    assert "## Capabilities" in got["markdown"] and "* verdict: warn" in got["markdown"] and "no force check" in got["markdown"]
    assert got["markdown"].startswith("# Title") and "arm_actions.csv" in got["markdown"]


def test_output_dir():
    assert tools.output_dir("out/", "/data/set1").startswith("out/by_dataset/set1-")
