"""Containers read in one pass for all topics, chunks left out by topic and time, and fields of JSON texts."""

import collections
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorline import tools
from sensorline.sources import envelope, mcap, readers

from .conftest import SF

TOPICS = 26


def recording(n=2_600, each=100):
    """26 topics; the last one only in the last chunk, with numbers that are whole in some messages and not in others."""
    out = []
    for i in range(n):
        topic = i % (TOPICS - 1) if i < n - each else TOPICS - 1
        out.append((f"/t{topic}", "json", 1_700_000_000_000_000_000 + i * 1_000_000, {"header": {"stamp_ns": i}, "x": i if i % 2 else i / 2, "v": [i, i + 1]}))
    return out


@pytest.fixture
def traced(spark, tmp_path):
    folder = tmp_path / "trace"
    folder.mkdir()
    spark.conf.set("spark.sensorline.mcap.trace", str(folder))
    yield lambda: collections.Counter(line for f in folder.iterdir() for line in f.read_text().splitlines())
    spark.conf.unset("spark.sensorline.mcap.trace")


def write(path, summary, **how):
    path.write_bytes(mcap.write_example(recording(), "zstd", each=100, channels_first=True, summary=summary, **how))
    return str(path)


@pytest.mark.parametrize("summary", [True, False])
def test_load_and_sync_read_each_chunk_twice_at_most(spark, tmp_path, traced, summary):
    path = write(tmp_path / "run.mcap", summary)
    data = tools.load_dataset(spark, path)["dataset"]
    assert len(data.entries) == TOPICS and traced().most_common(1)[0][1] == 1 and len(traced()) == 26
    got = tools.check_temporal_sync(data)
    assert got["report"].count() == TOPICS and {r.n for r in got["report"].collect()} == {100}
    assert traced().most_common(1)[0][1] == 2
    assert {s.n_rows for s in data.entries} == {100} and data.entries[0].timestamp_column == "mcap_log_time_ns"


@pytest.mark.parametrize("summary", [True, False])
def test_chunks_without_the_topic_or_the_time_are_not_read(spark, tmp_path, traced, summary):
    path = write(tmp_path / "run.mcap", summary)
    rows = mcap.read_messages(spark, path, f"/t{TOPICS - 1}")
    assert rows.count() == 100
    assert len(traced()) == (1 if summary else 26)  # without message indexes only the times tell
    late = mcap.read_messages(spark, path).where(F.col("mcap_log_time_ns") >= 1_700_000_000_000_000_000 + 1_250 * 1_000_000)
    before = sum(traced().values())
    assert late.where("topic in ('/t1', '/t2')").count() == 100 and sum(traced().values()) - before == (13 if summary else 14)
    assert mcap.read_messages(spark, path, "/none").count() == 0


def test_places_follow_the_file(spark, tmp_path):
    messages = [("/a", "json", t, {"n": n}) for n, t in enumerate((5, 3, 9, 1, 7, 7, 2))]
    (tmp_path / "a.mcap").write_bytes(mcap.write_example(messages, each=2, channels_first=True, summary=True))
    rows = mcap.read_messages(spark, str(tmp_path / "a.mcap")).orderBy("mcap_place").collect()
    assert [json.loads(r.data)["n"] for r in rows] == list(range(7)) and [r.mcap_log_time_ns for r in rows] == [5, 3, 9, 1, 7, 7, 2]


def test_cut_and_odd_containers(spark, tmp_path):
    whole = mcap.write_example(recording(), "", each=100, channels_first=True, summary=True)
    (tmp_path / "cut.mcap").write_bytes(whole[: len(whole) // 2])
    assert 1_000 < mcap.read_messages(spark, str(tmp_path / "cut.mcap")).count() < 1_700
    (tmp_path / "none.mcap").write_bytes(mcap.write_example([], channels_first=True, summary=True))
    assert mcap.read_messages(spark, str(tmp_path / "none.mcap")).count() == 0
    inside = mcap.write_example(recording()[:200], "zstd", each=50)
    (tmp_path / "inside.mcap").write_bytes(inside)
    assert mcap.read_messages(spark, str(tmp_path / "inside.mcap")).count() == 200
    # a message between chunks, which no chunk index tells
    messages = [("/a", "json", 1, {}), ("/a", "json", 2, {})]
    parts = mcap.write_example(messages, each=1, channels_first=True)
    import struct

    entries, channels = mcap.entries_of(str(tmp_path / "inside.mcap"))
    assert len(entries) == 1 and channels == {}
    loose = struct.pack("<BQ", mcap.MESSAGE, 22 + 2) + struct.pack("<HIQQ", 0, 9, 3, 3) + b"{}"
    at = len(parts) - len(mcap.MAGIC) - 29
    (tmp_path / "loose.mcap").write_bytes(parts[:at] + loose + parts[at:])
    assert sorted(r.mcap_log_time_ns for r in mcap.read_messages(spark, str(tmp_path / "loose.mcap")).collect()) == [1, 2, 3]


def test_a_changed_container_is_listed_anew(spark, tmp_path):
    path = tmp_path / "a.mcap"
    path.write_bytes(mcap.write_example(recording()[:100], channels_first=True))
    assert mcap.read_messages(spark, str(path)).count() == 100
    path.write_bytes(mcap.write_example(recording()[:300], channels_first=True))
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert mcap.read_messages(spark, str(path)).count() == 300


def test_fields_of_messages_are_columns(spark, tmp_path):
    data = tools.load_dataset(spark, write(tmp_path / "run.mcap", True))["dataset"]
    frame = data.table("/t3")
    assert isinstance(frame.schema["data"].dataType, T.StructType) and dict(frame.select("data.x", "data.header.stamp_ns").dtypes) == {"x": "double", "stamp_ns": "bigint"}
    want = [v["x"] for t, _, _, v in recording() if t == "/t3"]
    assert [r.x for r in frame.orderBy("mcap_place").select("data.x").collect()] == [float(x) for x in want]
    flat, left = envelope.expansion(frame)
    assert {"data.x", "data.header.stamp_ns", "data.v.0", "data.v.1"} <= set(flat.columns) and left == []
    got = tools.profile_data(data, "/t3", expand=True, focus_fields=["data.x"])
    assert got["success"] and "data.header.stamp_ns" in got["nested_clocks"] and got["left_out"] == []
    assert readers.read(spark, f"{tmp_path}/run.mcap::/t3").schema["data"].dataType == T.StringType()


def test_json_texts(spark):
    rows = [('{"a": 1, "b": {"t_ms": 1.5, "s": "x"}, "l": [1, 2, 3]}', "plain"), ('{"a": "odd", "l": [4.5], "b": null, "new`s": true}', "{"), (None, None), ('{"b": {"t_ms": 7}}', "")]
    frame = spark.createDataFrame(rows, "j string, other string")
    kinds = envelope.json_schemas(frame)
    assert list(kinds) == ["j"] and kinds["j"].simpleString() == "struct<a:string,b:struct<s:string,t_ms:double>,l:array<double>,new`s:boolean>"
    got = envelope.parsed(frame, kinds)
    assert [r.j and (r.j.a, r.j.b and r.j.b.t_ms, r.j.l) for r in got.collect()] == [("1", 1.5, [1.0, 2.0, 3.0]), ("odd", None, [4.5]), None, (None, 7.0, None)]
    flat, left = envelope.expansion(frame, most=3)
    assert flat.columns == ["j.a", "j.b.s", "j.b.t_ms"] and left == ["j.l.0", "j.l.1", "j.l.2", "j.new`s", "other"]
    assert envelope.time_fields(got.schema) == ["j.b.t_ms"]
    assert envelope.json_schemas(frame.limit(0)) == {} and envelope.json_schemas(frame.select("other")) == {}
    long = spark.createDataFrame([([float(i) for i in range(40)],)], "v array<double>")
    assert envelope.expansion(long)[1] == ["v.32..."]


def test_expand_opens_event_props(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    flat = envelope.expand(events, ["props.k"])
    assert flat.columns[0] == "props.k" and dict(flat.dtypes)["props.k"] == "bigint" and flat.where("`props.k` is null").count() == 0
