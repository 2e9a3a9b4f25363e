"""Times of video frames from side tables, against a plain version, and videos in the public functions."""

import statistics

import numpy as np
import pytest

from sensorline import tools
from sensorline.operators import media, windows


def plain_times(clocks, n_frames):
    clocks = sorted(t for t in clocks if t is not None)
    if not clocks:
        return {}
    if n_frames in (None, len(clocks)):
        return {i: (t, "row") for i, t in enumerate(clocks)}
    distinct = sorted(set(clocks))
    steps = [b - a for a, b in zip(distinct, distinct[1:], strict=False)]
    step = statistics.median(steps) if steps else None
    at, spots = 0, {0: distinct[0]}
    for t, d in zip(distinct[1:], steps, strict=True):
        at += int(d / step + 0.5)
        spots.setdefault(at, t)
    out, known = {}, sorted(spots)
    for f in range(n_frames):
        before = max(k for k in known if k <= f)
        after = min((k for k in known if k > f), default=None)
        if f == before:
            out[f] = (spots[f], "row")
        elif after is not None:
            out[f] = (spots[before] + int((f - before) * (spots[after] - spots[before]) / (after - before) + 0.5), "between")
        elif step is not None:
            out[f] = (spots[before] + int((f - before) * step + 0.5), "after")
    return out


def cases():
    draw = np.random.default_rng(7)
    out = {
        "none": ([], 5), "nulls": ([None, None, 5], 1), "one": ([7], 3), "same": ([4, 4, 4], 3), "same fewer": ([4, 4, 4], 2), "uncounted": ([9, 3, 3, None], None),
        "gap": ([0, 10, 20, 60, 70], 8), "short": ([0, 10, 20, 60, 70], 6), "tail": ([0, 10, 20, 30], 7), "no frames": ([1, 2, 3], 0), None: ([0, 100, 400], 5),
    }
    for i in range(12):
        base = 1_700_000_000_000_000_000 + np.arange(60) * 33_333_333 + draw.integers(-2_000_000, 2_000_000, 60)
        kept = base[draw.random(60) > 0.15 * (i % 4)].tolist()
        out[f"random {i}"] = (kept + kept[: i % 3] + [kept[5] + 100] * (i % 2), [60, None, len(kept), 55][i % 4])
    return out


@pytest.mark.parametrize("piece", [None, 50])
def test_frames_equal_the_plain_version(spark, monkeypatch, piece):
    if piece:
        monkeypatch.setattr(windows, "PIECE_ROWS", piece)
        monkeypatch.setattr(windows, "ROW_BYTES", 0)
        monkeypatch.setattr(windows, "_source_bytes", lambda _: 1 << 40)
    given = cases()
    sides = spark.createDataFrame([(k, t, 0) for k, (ts, _) in given.items() for t in ts], "video string, t bigint, n_frames int")
    videos = spark.createDataFrame([(k, n) for k, (_, n) in given.items()], "video string, n_frames bigint")
    got = {(r.video, r.frame): (r.t, r.how) for r in media.frame_times(sides, videos, "video").collect()}
    assert got == {(k, f): x for k, (ts, n) in given.items() for f, x in plain_times(ts, n).items()}
    assert media.frame_times(sides.limit(0), videos, "video").count() == 0 == media.frame_times(sides, videos.limit(0), "video").count()


def test_a_long_gap_is_spread_in_stretches(spark):
    sides = spark.createDataFrame([(1, t) for t in (0, 10, 20, 200_000)], "video int, t bigint")
    frames = media.frame_times(sides, spark.createDataFrame([(1, 20_001)], "video int, n_frames bigint"), "video")
    assert frames.count() == 20_001 and frames.where("t <> frame * 10").count() == 0


def test_rates_against_lists(spark):
    videos = spark.createDataFrame([("ok", 30.0), ("wrong", 60.0), ("none", None), ("alone", 25.0), ("still", 25.0)], "video string, fps double")
    sides = spark.createDataFrame([(v, i * 33_333_333) for v in ("ok", "wrong", "none") for i in range(31)] + [("still", 5), ("still", 5), ("still", None)], "video string, t bigint")
    got = {r.video: (r.contradicts, r.rate_hz, r.source) for r in media.check_rates(videos, sides, "video").collect()}
    assert got == {"ok": (False, 30.0, "header"), "wrong": (True, 30.0, "side list"), "none": (False, 30.0, "side list"), "alone": (False, 25.0, "header"), "still": (False, 25.0, "header")}


def test_names():
    assert [media.numbers_frames(c) for c in ("pts", "pts_us", "frame_index", "capture_utc_ns", "packet_index", "frame_timestamps_ns", "stamp")] == [True, False, True, False, True, False, False]
    assert media.is_side_table("cam_metainfo", None) and media.is_side_table("cam", "exposure_start_utc_ns") and media.is_side_table("cam", "pts")
    assert not media.is_side_table("episode_000001", "timestamp") and not media.is_side_table("cam", None)


@pytest.fixture
def recording(tmp_path):
    start, ms = 1_700_000_000_000_000_000, 1_000_000
    lines = {"imu.csv": ["timestamp_ns,accel_x", *(f"{start + i * 10 * ms},{i % 7}" for i in range(600))]}
    cam = [f"{i},{i * 40_000},{start + i * 40 * ms + 2 * ms}" for i in range(150) if i not in (50, 51)]
    lines["cam_metainfo.csv"] = ["frame_index,pts_us,capture_utc_ns", *cam]
    lines["numbers_metainfo.csv"] = ["frame_index", *map(str, range(150))]
    lines["raw.txt"] = [f"{start + i * 40 * ms} {i}" for i in range(150)]
    for name, rows in lines.items():
        (tmp_path / name).write_text("\n".join(rows) + "\n")
    for name in ("cam.mp4", "cam_480.mp4", "numbers.mp4", "other.mp4", "raw.h265"):
        (tmp_path / name).write_bytes(b"-")
    return str(tmp_path)


def test_videos_take_part_in_sync(spark, recording):
    data = tools.load_dataset(spark, recording)["dataset"]
    known = spark.createDataFrame([("cam.mp4", 25.0, 6.0, 150), ("raw.h265", 60.0, 6.0, 150)], "name string, fps double, duration_s double, n_frames bigint")
    got = tools.check_temporal_sync(data, "imu", media=known)
    assert got["success"], got
    rows, videos = {r.stream: r for r in got["report"].collect()}, {r.video: (r.table, r.status) for r in got["videos"].collect()}
    assert rows["cam.mp4"].n == 150 and rows["cam_metainfo.csv"].n == 148 and rows["cam.mp4"].max_ms == pytest.approx(2.0) and rows["cam.mp4"].n_gaps == 0
    assert videos["cam.mp4"] == ("cam_metainfo.csv", "takes part") and videos["cam_480.mp4"][1] == "version"
    assert videos["numbers.mp4"] == ("numbers_metainfo.csv", "frame numbers only") and videos["other.mp4"] == (None, "no side table")
    assert {r.stream for r in tools.check_temporal_sync(data, "imu", streams=["imu", "cam.mp4"])["report"].collect()} == {"imu.csv", "cam.mp4"}
    rates = {r.name: (r.contradicts, r.rate_hz) for r in tools.inspect_streams(data, media=known)["media_rates"].collect()}
    assert rates == {"cam.mp4": (False, 25.0), "raw.h265": (True, 25.0)}
