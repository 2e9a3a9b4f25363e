"""Folders of many files as few scans."""

import math
import os

import pyarrow as pa
import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from sensorline import tools
from sensorline.sources import readers


def episodes(folder, n, rows=20):
    folder.mkdir(parents=True, exist_ok=True)
    for e in range(n):
        t = [1_700_000_000.0 + e * 100 + i * 0.02 for i in range(rows)]
        parquet.write_table(pa.table({"episode_index": [e] * rows, "timestamp": t, "action_a": [math.sin(i + e) for i in range(rows)]}), folder / f"episode_{e:06d}.parquet")


def counted(spark, run):
    spark.sparkContext.setJobGroup("folders", "folders")
    before = set(spark.sparkContext.statusTracker().getJobIdsForGroup("folders"))
    out = run()
    after = set(spark.sparkContext.statusTracker().getJobIdsForGroup("folders"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(after - before)


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    episodes(tmp_path / "few", 40)
    episodes(tmp_path / "many", 2_000, rows=4)
    few, some = counted(spark, lambda: tools.load_dataset(spark, str(tmp_path / "few")))
    many, same = counted(spark, lambda: tools.load_dataset(spark, str(tmp_path / "many")))
    assert few["n_tables"] == 40 and many["n_tables"] == 2_000 and same <= some + 2 <= 16
    data = few["dataset"]
    assert {s.kind for s in data.entries} == {"actions"} and {s.n_rows for s in data.entries} == {20} and {s.timestamp_column for s in data.entries} == {"timestamp"}
    clocks = tools._clocks(data)
    assert clocks.count() == 800 and clocks.where("stream = 'episode_000007.parquet'").agg(F.min("t")).first()[0] == 1_700_000_700_000_000_000
    assert data.table("episode_000003").agg(F.max("episode_index")).first()[0] == 3
    got = tools.check_temporal_sync(data)
    assert got["report"].count() == 40 and {r.n for r in got["report"].collect()} == {20}
    assert tools.check_dataset_quality(data, "episode_000003", fps=50.0)["gates"]["schema_consistency"] == "pass"


def test_groups_of_mixed_folders(spark, tmp_path):
    """Two CSV schemas, a second file of one name, a broken file, forces that move and that do not, poses, and a clock by content."""
    for sub in ("x", "y"):
        (tmp_path / sub).mkdir()
        (tmp_path / sub / "imu.csv").write_text("t_ns;accel_x\n" + "".join(f"{1_700_000_000_000_000_000 + i * 10_000_000};{i % 5}.5\n" for i in range(50)))
    for name, value in (("still", 1.0), ("moving", 2.0)):
        (tmp_path / f"{name}.csv").write_text("tick,force_x\n" + "".join(f"{i * 8.33},{value if name == 'still' else i * value}\n" for i in range(60)))
    (tmp_path / "odd.csv").write_text("a,b\n1,2\n3,4\n5,x\n")
    for name, scale in (("head", 1.0), ("wrong", 0.5)):
        rows = {"rot_w": [scale] * 9, "rot_x": [0.0] * 9, "rot_y": [0.0] * 9, "rot_z": [0.0] * 9}
        parquet.write_table(pa.table(rows), tmp_path / f"{name}.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 is not all")
    got = tools.load_dataset(spark, str(tmp_path))
    data = got["dataset"]
    kinds = {s.name: (s.kind, s.n_rows, s.timestamp_column) for s in data.entries}
    assert kinds["x/imu.csv"] == kinds["y/imu.csv"] == ("imu", 50, "t_ns") and kinds["moving.csv"] == ("force", 60, "tick") and kinds["still.csv"][0] != "force"
    assert kinds["head.parquet"][0] == "pose" and kinds["wrong.parquet"][0] != "pose" and kinds["odd.csv"][1] == 3
    assert [e["path"].rsplit("/", 1)[-1] for e in data.errors] == ["broken.parquet"] and len(data.entries) == 7
    clocks = tools._clocks(data)
    assert {r.stream: r.n for r in clocks.groupBy("stream").agg(F.count("*").alias("n")).collect()} == {"x/imu.csv": 50, "y/imu.csv": 50, "moving.csv": 60, "still.csv": 60, "odd.csv": 3}
    assert clocks.where("stream = 'y/imu.csv'").agg(F.max("t")).first()[0] == 1_700_000_000_490_000_000
    assert [r.i for r in clocks.where("stream = 'moving.csv'").orderBy("t").collect()] == sorted(r.i for r in clocks.where("stream = 'moving.csv'").collect())
    assert data.table("y/imu.csv").count() == 50


def test_head_of_a_huge_file_is_a_range(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("a|b\n1|2\n")
    os.truncate(path, 3 << 30)  # a sparse file of 3 GB
    assert readers._head(spark, str(path))[:8] == b"a|b\n1|2\n" and len(readers._head(spark, str(path))) == readers.SNIFF_BYTES


@pytest.mark.parametrize("n", [0, 1])
def test_no_group_of_one(spark, tmp_path, n):
    if n:
        episodes(tmp_path, n)
    got = tools.load_dataset(spark, str(tmp_path))
    assert got["success"] == bool(n) and (not n or got["dataset"].groups == [])
