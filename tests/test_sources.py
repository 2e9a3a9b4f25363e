import json

import pytest
from pyspark.sql import functions as F

from sensorline.plans import charts, report
from sensorline.sources import catalog, envelope, hdf5, mcap, readers, text
from sensorline.streaming import checks


def test_csv_delimiter_and_encoding(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("t;näme\n1;é\n2;b\nbad;x;y\n".encode("cp1252"))
    got = readers.read(spark, str(path))
    assert got.columns == ["t", "näme"] and [r["näme"] for r in got.collect()][:2] == ["é", "b"]


def test_json_rows_and_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"frames": [{"i": 1}, {"i": 2}]}))
    (tmp_path / "b.jsonl").write_text('{"i": 1}\nnot json\n{"i": 3}\n')
    assert sorted(r.i for r in readers.read(spark, str(tmp_path / "a.json")).collect()) == [1, 2]
    assert sorted(r.i for r in readers.read(spark, str(tmp_path / "b.jsonl")).select("i").where("i is not null").collect()) == [1, 3]


def test_unknown_format_and_paths(spark):
    with pytest.raises(ValueError, match="no reader"):
        readers.read(spark, "a.xyz")
    assert readers.split_path("a.mcap::/imu") == ("a.mcap", "/imu")
    assert readers.clean_path(" '​file:///x/y.csv' ") == "/x/y.csv"


def test_row_index(spark):
    rows = readers.with_row_index(spark.range(100, numPartitions=4))
    assert sorted((r.row_index, r.id) for r in rows.collect()) == [(i, i) for i in range(100)]


def test_log_and_timestamps(spark, tmp_path):
    (tmp_path / "a.log").write_text("I0102 03:04:05.000006 77 main.cc:1] hello\nplain line\n")
    got = [r for r in readers.read(spark, str(tmp_path / "a.log")).orderBy("row_index").collect() if r.message]
    assert (got[0].level, got[0].time_of_day_us, got[0].message, got[1].message) == ("I", 11045000006, "hello", "plain line")
    (tmp_path / "a.txt").write_text("".join(f"{1_700_000_000_000_000_000 + i} {i}\n" for i in range(50)))
    frame = readers.read(spark, str(tmp_path / "a.txt"))
    assert frame.columns == ["row_index", "timestamp", "frame_index"] and frame.count() == 50
    (tmp_path / "b.txt").write_text("".join(f"{1_700_000_000_000_000_000 + i} k\n" for i in range(50)))
    assert readers.read(spark, str(tmp_path / "b.txt")).columns == ["row_index", "timestamp", "status"]
    (tmp_path / "c.txt").write_text("some words\nand more of them\n")
    assert readers.read(spark, str(tmp_path / "c.txt")).count() == 0


def test_grep_and_excerpt(spark):
    lines = spark.createDataFrame([(i, w) for i, w in enumerate("a b KEY c d e key".split())], "row_index bigint, value string")
    assert sorted(r.row_index for r in text.grep(lines, "key").collect()) == [1, 2, 3, 5, 6]
    assert text.read_excerpt(lines, 3, 5) == "KEY\nc"


@pytest.mark.parametrize("compress", [False, True])
def test_mcap(spark, tmp_path, compress):
    messages = [("/imu", "json", 1000 + i, {"x": i}) for i in range(100)] + [("/scan", "cdr", 5000, b"\0\1")]
    (tmp_path / "a.mcap").write_bytes(mcap.write_example(messages, compress))
    path = str(tmp_path / "a.mcap")
    got = {r.topic: (r.n, r.first_ns, r.last_ns, r.decodable) for r in mcap.topics(spark, path).collect()}
    assert got == {"/imu": (100, 1000, 1099, True), "/scan": (1, 5000, 5000, False)}
    rows = readers.read(spark, f"{path}::/imu")
    assert rows.count() == 100 and json.loads(rows.orderBy("mcap_log_time_ns").first().data) == {"x": 0}
    mcap.unpack(spark, path, str(tmp_path / "out"), most=10)
    assert spark.read.json(str(tmp_path / "out")).count() == 10


@pytest.mark.parametrize(("compress", "channels_first"), [("", True), ("zstd", True), ("lz4", True), ("zstd", False)])
def test_mcap_in_several_tasks(spark, tmp_path, monkeypatch, compress, channels_first):
    """Chunks are read side by side where the channels stand outside of them; the rows are the same."""
    monkeypatch.setattr(mcap, "READ_BYTES", 1)
    messages = [(f"/t{i % 3}", "json", 1_000 + i, {"x": i}) for i in range(600)]
    (tmp_path / "a.mcap").write_bytes(mcap.write_example(messages, compress, each=100, channels_first=channels_first))
    rows = mcap.read_messages(spark, str(tmp_path / "a.mcap")).withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.topic, r.mcap_log_time_ns, json.loads(r.data)["x"]) for r in rows) == sorted((t, n, v["x"]) for t, _, n, v in messages)
    assert len({r.task for r in rows}) == (6 if channels_first else 1)
    mcap.unpack(spark, str(tmp_path / "a.mcap"), str(tmp_path / "out"), ["/t1"], "json")
    arrays = [json.loads(line.value) for line in spark.read.text(str(tmp_path / "out")).collect()]
    assert [m["mcap_log_time_ns"] for a in arrays for m in a] == [1_000 + i for i in range(1, 600, 3)]


def test_rows_of_several_files_are_numbered_in_their_order(spark, tmp_path):
    for part, n in (("a", 40), ("b", 3_000), ("c", 7)):
        (tmp_path / f"{part}.txt").write_text("".join(f"{part}{i}\n" for i in range(n)))
        spark.range(n).selectExpr(f"concat('{part}', id) as value").coalesce(1).write.mode("append").parquet(str(tmp_path / "table" / f"k={part}"))
    want = [f"{p}{i}" for p, n in (("a", 40), ("b", 3_000), ("c", 7)) for i in range(n)]
    for frame in (text.read_lines(spark, str(tmp_path / "*.txt")), readers.with_row_index(spark.read.parquet(str(tmp_path / "table")))):
        assert [r.value for r in frame.orderBy("row_index").collect()] == want and frame.agg({"row_index": "max"}).first()[0] == len(want) - 1


def test_cp1252_and_drive_paths(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("preis €;n\n„x“ – œ;1\né;2\n".encode("cp1252"))
    got = readers.read(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["preis €", "n"] and [r[0] for r in got.collect()] == ["„x“ – œ", "é"]
    assert readers.clean_path("'C:\\data\\a.csv'") == "/C:/data/a.csv"


def test_log_tolerances(spark):
    lines = spark.createDataFrame([(0, "W0102   03:04:05.5  77\tmain.cc:1] hello")], "row_index bigint, value string")
    got = text.parse_log(lines).first()
    assert (got.level, got.time_of_day_us, got.thread, got.source, got.message) == ("W", 11045500000, 77, "main.cc:1", "hello")


def test_hdf5_stretches():
    """What a task reads of a node and of a file of frames; plain dictionaries of arrays stand for the file."""
    import numpy as np

    tree = {"imu": np.arange(12.0).reshape(6, 2), "one": np.array(7.0), "pair": np.array([(1, 2.5), (3, 4.5)], [("a", "i4"), ("b", "f8")])}
    assert hdf5.stretches(tree, "/imu") == [(0, 6)] and hdf5.rows_of(tree, "/imu", 2, 4) == [(2, [4.0, 5.0]), (3, [6.0, 7.0])]
    assert hdf5.rows_of(tree, "one", 0, 1) == [(0, [7.0])] and hdf5.rows_of(tree, "pair", 1, 2) == [(1, [3.0, 4.5])]
    frames = {str(i): {"pos": np.array([i, i + 0.5])} for i in range(60)} | {"60": {}}
    assert hdf5.stretches(frames, "pos") == [(0, 61)] and hdf5.rows_of(frames, "pos", 58, 61) == [(58, [58.0, 58.5]), (59, [59.0, 59.5])]


def test_hdf5_is_gated(spark):
    assert hdf5.is_frame_layout([str(i) for i in range(70)]) and not hdf5.is_frame_layout(["a"] * 70)
    if not hdf5.available():
        with pytest.raises(RuntimeError, match="h5py"):
            hdf5.list_nodes(spark, "x.h5")


def dataset(tmp_path):
    (tmp_path / "imu.csv").write_text("timestamp_ns,accel_x,gyro_x\n" + "".join(f"{i * 1000000},{9.8},{0.1}\n" for i in range(20)))
    (tmp_path / "head_pose.csv").write_text("timestamp_ns,pos_x,quat_w,quat_x,quat_y,quat_z\n" + "".join(f"{i},0,1,0,0,0\n" for i in range(30)))
    (tmp_path / "empty.csv").write_text("pose_x,pose_y\n")
    (tmp_path / "calib_cam.json").write_text('{"frames": [{"fx": 1}, {"fx": 2}, {"fx": 3}]}')
    for name in ("cam_480.mp4", "cam_960.mp4", ".DS_Store"):
        (tmp_path / name).write_bytes(b"x")
    (tmp_path / "__pycache__").mkdir()
    (tmp_path / "__pycache__" / "x.csv").write_text("a\n1\n")


def test_catalog(spark, tmp_path):
    dataset(tmp_path)
    found = catalog.load_dataset(spark, str(tmp_path))
    assert {s.name: s.kind for s in found.entries} == {"imu.csv": "imu", "head_pose.csv": "pose", "empty.csv": "unknown", "calib_cam.json": "calibration"}
    assert found.main_table() == "head_pose.csv" and found.table("IMU").count() == 20
    assert found.capabilities()["multi_stream"] and found.capabilities()["has_video"]
    assert [r.names for r in catalog.version_groups(found.files).collect()] == [["cam_480.mp4", "cam_960.mp4"]]
    assert found.confirm({"imu.csv": "force"}).streams().where("name = 'imu.csv'").first().kind == "force"
    assert found.list_tables().first().is_main and found.errors == []
    with pytest.raises(KeyError):
        found.table("nope")


def test_pairs_and_frames(spark):
    tables = spark.createDataFrame([("cam_metainfo.csv", "cam_metainfo", 100), ("other.csv", "other", 100)], "name string, stem string, n_rows bigint")
    media = spark.createDataFrame([("cam.mp4", "cam", 95), ("othe.mp4", "othe", 10)], "name string, stem string, n_frames bigint")
    assert [(r.table, r.media) for r in catalog.pair_streams(tables, media).collect()] == [("cam_metainfo.csv", "cam.mp4")]
    odd = spark.createDataFrame([(30.0, 10.0, 1), (30.0, 10.0, 299)], "fps double, duration_s double, n_frames bigint")
    assert [(r.n_frames, r.estimated) for r in catalog.estimate_frames(odd).collect()] == [(300, True), (299, False)]
    assert catalog.block_declaration(["body_24x7"], [168]) == (24, 7) and catalog.block_declaration(["b_2x3"], [10]) is None


def test_envelope(spark):
    rows = spark.createDataFrame([((1, (2.0, [1.0, 2.0])),), ((3, (4.0, [5.0])),)], "data struct<stamp_us:bigint, inner:struct<x:double, v:array<double>>>")
    assert envelope.expand(rows).columns == ["data.stamp_us", "data.inner.x", "data.inner.v.0", "data.inner.v.1"]
    assert envelope.expand(rows, ["data.inner.v"], 2).columns == ["data.inner.v.0", "data.inner.v.1"]
    assert envelope.time_fields(rows.schema) == ["data.stamp_us"]


def test_charts_and_report(spark):
    rows = spark.range(1000).selectExpr("id as t", "cast(id % 7 as double) as v", "'a' as s")
    series, spec = charts.chart(rows, "line", "t", "v", "s", points=50)
    assert series.count() == 50 and spec["kind"] == "line"
    assert charts.chart(rows, "histogram", "v")[0].count() == 30
    found = report.findings(spark, [("sync", "fail", "imu", {"loss": 0.5})])
    assert "| sync | fail | imu |" in report.report("T", {"Rows": rows.limit(2)}, found)


def test_live_gaps(spark, tmp_path):
    import pandas as pd

    for i, times in enumerate(([0, 10, 20], [500, 510], [505, 520])):
        pd.DataFrame({"k": "a", "t": times}).to_parquet(tmp_path / f"{i}.parquet")
    live = spark.readStream.schema("k string, t bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    run = checks.live_gaps(live, "k", "t", 100).writeStream.format("memory").queryName("gaps").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    assert [(r.start_ns, r.end_ns) for r in spark.table("gaps").collect()] == [(20, 500)]
