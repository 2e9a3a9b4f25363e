"""Annotation versions by compare and swap, profile names, lists of any width, and pairs of actions and states."""

from pyspark.sql import functions as F

from sensorline.operators.quality import pair_action_state
from sensorline.sources import annotation_store, readers, text


def records(spark, ids, label="pick"):
    rows = [("segment", "e", i, 0.0, 1.0, "imported", label) for i in ids]
    return spark.createDataFrame(rows, "scope string, episode_key string, id bigint, start_s double, end_s double, source string, atomic_action string")


def test_two_writers_keep_all_rows(spark, tmp_path):
    """A second writer commits while the first one merges: the first merges again, and nobody's rows are lost."""
    one, two = (annotation_store.AnnotationStore(spark, str(tmp_path / "s")) for _ in range(2))
    assert one.save(records(spark, [1]))["version"] == 1
    real, done = one.folder.create, []

    def later(name, body):
        if not done and name.startswith("versions/"):
            done.append(two.save(records(spark, [3]))["version"])
        return real(name, body)

    one.folder.create = later
    got = one.save(records(spark, [2]))
    assert done == [2] and got == {"success": True, "version": 3, "added": 1, "modified": 0, "skipped": 0}
    assert sorted(r.id for r in two.load().collect()) == [1, 2, 3] and one.versions() == [1, 2, 3]
    assert [(r.version, r.id, r.action) for r in two.history().collect()] == [(3, 2, "added"), (2, 3, "added"), (1, 1, "added")]
    assert [r.version for r in two.history(2).collect()] == [3, 2]
    done.clear()
    gone = one.delete(records(spark, [1]))  # again another writer is first
    assert gone["version"] == 5 or gone["version"] == 4
    assert sorted(r.id for r in two.load().collect()) == [2, 3] and sorted(r.id for r in two.load(1).collect()) == [1]


def test_a_dead_writer_leaves_nothing(spark, tmp_path):
    store = annotation_store.AnnotationStore(spark, str(tmp_path / "s"))
    store.save(records(spark, [1]))

    def dies(name, body):
        raise OSError("gone")

    real, store.folder.create = store.folder.create, dies
    try:
        store.save(records(spark, [2]))
    except OSError:
        pass
    store.folder.create = real
    assert [r.id for r in store.load().collect()] == [1] and store.history().count() == 1 and store.versions() == [1]
    assert store.save(records(spark, [1]))["skipped"] == 1 and store.save(records(spark, [9]), dry_run=True)["version"] is None
    assert store.snapshot("a")["success"] and store.snapshot("a")["error"] == "snapshot_exists"
    assert store.folder.create("versions/v000000001.json", "{}") is False


def test_profiles_of_like_names_stay_apart(spark, tmp_path):
    store = annotation_store.ProfileStore(spark, str(tmp_path))
    names = ["/data/run a/x", "/data/run_a/x", "/" + "p" * 200 + "/tail" * 40, "/q" + "p" * 200 + "/tail" * 40]
    for i, n in enumerate(names):
        store.save(n, kinds={"t": str(i)})
    assert [store.load(n)["kinds"] for n in names] == [{"t": str(i)} for i in range(4)]


def test_pairs_of_actions_and_states():
    assert pair_action_state(["action_joint0", "observation.state.joint0"]) == [("action_joint0", "observation.state.joint0")]
    assert pair_action_state(["actions.j0", "obs_j0", "action.x", "state_y"]) == [("actions.j0", "obs_j0")]
    assert pair_action_state(["Action_A", "QPOS_a", "other"]) == [("Action_A", "QPOS_a")] and pair_action_state([]) == []


def read(spark, path, body):
    path.write_text(body)
    return readers.read(spark, str(path))


def test_lists_of_any_width(spark, tmp_path):
    rows = [(f"{1_700_000_000 + i // 30}.{i % 30 * 33_000_001:09d}", i * 2, i % 7 / 4, "P", "two words".split()[i % 2], 5 - i) for i in range(90)]
    got = read(spark, tmp_path / "a.txt", "".join(f"{t}, {a};{b}  {c}\t{d} {e}\n" for t, a, b, c, d, e in rows) + "\n\n")
    assert dict(got.dtypes) == {"row_index": "bigint", "timestamp": "decimal(28,9)", "frame_index": "bigint", "value_2": "double", "status": "string", "col_4": "string", "value_5": "double"}
    first = sorted(got.collect())[1]
    assert (str(first.timestamp), first.frame_index, first.value_2, first.status, first.col_4, first.value_5) == ("1700000000.033000001", 2, 0.25, "P", "words", 4.0)
    assert dict(read(spark, tmp_path / "b.txt", "".join(f"{1_700_000_000_000_000_001 + i} {i % 3} {i} A B\n" for i in range(30))).dtypes) == {
        "row_index": "bigint", "timestamp": "bigint", "value": "double", "frame_index_2": "bigint", "status": "string", "status_4": "string"}
    assert read(spark, tmp_path / "c.txt", "".join(f"0.{i} x{i}\n" for i in range(30))).columns == ["row_index", "col_0", "col_1"]
    assert read(spark, tmp_path / "d.txt", "".join(f"{1_700_000_000 + i}.5\n" for i in range(30))).columns == ["row_index", "timestamp"]
    for name, body in {"e": "1\n2\n3\n", "f": "", "g": "1 2\n3 4\n5 6 7\n", "h": "a 1\nb 2\n"}.items():
        assert read(spark, tmp_path / f"{name}.txt", body).count() == 0
    odd = read(spark, tmp_path / "i.txt", "".join(f"{'nan' if i == 3 else 1_700_000_000 + i} {i}\n" for i in range(40)))
    assert odd.columns == ["row_index", "col_0", "frame_index"] and odd.count() == 40


def test_log_lines_of_the_public_format(spark):
    lines = ["I0102 03:04:05.000006 77 main.cc:1] hello", "E1231 23:59:60.5  9 a b.cc:22] x]y", "W1301 00:00:00.1 1 a:1] bad month", "D0101 00:00:00.1 1 a:1] bad level", "F0101 00:00:00.123456 1 a:1]"]
    got = text.parse_log(spark.createDataFrame(list(enumerate(lines)), "row_index bigint, value string")).orderBy("row_index").collect()
    assert [(r.level, r.time_of_day_us, r.message) for r in got] == [
        ("I", 11_045_000_006, "hello"), ("E", 86_400_500_000, "x]y"), (None, None, lines[2]), (None, None, lines[3]), ("F", 123_456, "")]
    assert got[0].source == "main.cc:1" and got[1].thread == 9


def test_fractional_clocks_stay_exact(spark, tmp_path):
    from sensorline import tools

    for name in ("left", "right"):
        (tmp_path / f"{name}.txt").write_text("".join(f"{1_700_000_000 + i // 1000}.{i % 1000 * 1_000_001:09d} {i}\n" for i in range(3_000)))
    data = tools.load_dataset(spark, str(tmp_path))["dataset"]
    clocks = tools._clocks(data)
    assert clocks.where("stream = 'left.txt'").agg(F.max("t")).first()[0] == 1_700_000_002_999_000_999
