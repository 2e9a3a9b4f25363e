import math

import pytest
from pyspark.sql import functions as F

from sensorline.operators import quality
from sensorline.settings import Settings


def frame(spark, values, episode="e"):
    return spark.createDataFrame([(episode, i, None if v is None else float(v)) for i, v in enumerate(values)], "ep string, i bigint, a double")


def long(rows, *columns):
    return quality.channels(rows, ["ep"], "i", list(columns or ["a"]))


def test_bad_values_gate(spark):
    rows = frame(spark, [1, None, float("nan"), float("inf"), 2, 3, 4, 5, 6, 7])
    got = quality.gate_bad_values(rows, ["a"]).first()
    assert got.n_bad == 3 and got.ratio == pytest.approx(0.3) and got.fails
    assert not quality.gate_bad_values(rows, ["a"], ("a",)).first().fails


def test_monotonic_gate(spark):
    got = quality.gate_monotonic(frame(spark, [0, 1, 1, 0.5, 2]), ["ep"], "a", ["i"]).first()
    assert (got.n_back, got.n_same, got.first_back, got.verdict) == (1, 1, [3], "fail")


def test_frame_loss_declared_and_by_gaps(spark):
    clock = [i / 100 for i in range(1000)]
    assert quality.gate_frame_loss(frame(spark, clock), ["ep"], "a", 100.0).first().loss == pytest.approx(0, abs=1e-9)
    half = quality.gate_frame_loss(frame(spark, clock[::2]), ["ep"], "a", 100.0).first()
    assert half.loss == pytest.approx(0.5, abs=0.01) and half.fails
    gap = quality.gate_frame_loss(frame(spark, clock[:400] + clock[600:]), ["ep"], "a").first()
    assert gap.n_missing == 200 and gap.fails


def test_schema_gate(spark):
    a, b = frame(spark, [1]), frame(spark, [1]).withColumn("extra", F.lit(1))
    got = quality.gate_schema({"a": a.columns, "b": b.columns, "c": a.columns})
    assert [(r["table"], r["missing"], r["extra"], r["fails"]) for r in got] == [("a", [], [], False), ("b", [], ["extra"], True), ("c", [], [], False)]


@pytest.mark.parametrize("hint", quality.NO_ACTION)
def test_hints_are_substrings(spark, hint):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0)], f"arm{hint}x double, joint double, {hint} double")
    assert quality.action_columns(rows) == ["joint"]


def test_timed_spikes(spark):
    """The same second difference over half the time is four times the acceleration."""
    rows = [("e", i, float(i % 2), i * 0.1 if i <= 50 else 5.0 + (i - 50) * 0.01) for i in range(60)]
    long_rows = quality.channels(spark.createDataFrame(rows, "ep string, i bigint, a double, t double"), ["ep"], "i", ["a"], ("t",))
    assert quality.action_spikes(long_rows, ["ep"], "i").count() == 0
    got = quality.action_spikes(long_rows, ["ep"], "i", clock_s="t").first()
    assert got.n_spikes == 9 and got.worst == pytest.approx(100)


@pytest.mark.parametrize(("fps", "verdict"), [(100.0, "pass"), (90.0, "warn"), (0.0, "fail"), (None, "skip")])
def test_fps_gate(spark, fps, verdict):
    rows = frame(spark, range(100)).withColumn("t", F.col("i") * 10_000_000)
    assert quality.gate_fps(rows, ["ep"], "t", ["i"], fps).first().verdict == verdict


def test_episode_bounds_with_a_declared_empty_episode(spark):
    rows = frame(spark, [5, 1])
    got = {r.ep: r.fails for r in quality.gate_episode_bounds(rows, "ep", "a", "i", ["e", "none"]).collect()}
    assert got == {"e": True, "none": True}


def test_idle_and_pause(spark):
    rows = frame(spark, [0] * 50 + [i for i in range(50)])
    got = quality.idle_ratio(long(rows), ["ep"], "i").first()
    assert got.idle_ratio == pytest.approx(50 / 99) and not got.warns
    runs = quality.pauses(long(rows), ["ep"], "i").collect()
    assert [(r.n_rows, r["first"], r["last"]) for r in runs] == [(50, 1, 50)]


def test_spike(spark):
    values = [math.sin(i / 10) for i in range(200)]
    values[100] += 50
    got = quality.action_spikes(long(frame(spark, values)), ["ep"], "i").first()
    assert got.channel == "a" and got.n_spikes == 3
    assert quality.action_spikes(long(frame(spark, [math.sin(i / 10) for i in range(200)])), ["ep"], "i").count() == 0


def test_jerk_and_shaking(spark):
    smooth = [math.sin(i / 30) for i in range(300)]
    rough = [(-1) ** i for i in range(300)]
    jerk = lambda v: quality.action_jerk(long(frame(spark, v)), ["ep"], "i").first().warns
    shake = lambda v: quality.arm_shaking(long(frame(spark, v)), ["ep"], "i").first().warns
    assert (jerk(smooth), jerk(rough), shake(smooth), shake(rough)) == (False, True, False, True)


def test_path_efficiency(spark):
    rows = spark.createDataFrame([("e", i, float(i), float(2 * i)) for i in range(50)], "ep string, i bigint, a double, b double")
    assert quality.path_efficiency(long(rows, "a", "b"), ["ep"], "i").first().efficiency == pytest.approx(1)
    loop = spark.createDataFrame([("e", i, math.cos(i), math.sin(i)) for i in range(100)], "ep string, i bigint, a double, b double")
    assert quality.path_efficiency(long(loop, "a", "b"), ["ep"], "i").first().warns


def test_saturation_looks_one_step_ahead(spark):
    rows = spark.createDataFrame([("e", i, 10.0, 0.0 if i < 5 else 10.0) for i in range(10)], "ep string, i bigint, action_x double, state_x double")
    assert quality.pair_action_state(rows.columns) == [("action_x", "state_x")]
    got = quality.actuator_saturation(rows, ["ep"], "i", [("action_x", "state_x")]).first()
    assert (got.n, got.n_over, got.worst) == (9, 4, 10.0)


def test_short_episodes_of_a_long_table_move_once(spark, monkeypatch):
    """No episode is long: one shuffle, however long the table; with a long one among them results are those of the plain window."""
    from sensorline.operators import windows

    def table(longest):
        rows = spark.range(600 + longest).withColumn("ep", F.when(F.col("id") < 600, F.col("id") % 60)).withColumn("a", F.hash("id") % 50 * 1.0)
        return quality.channels(rows.withColumn("b", F.floor(F.col("id") / 7) % 5 * 1.0), ["ep"], "id", ["a", "b"])

    def found(longest):
        own = Settings(pause_steps=2, idle_speed=0.3)
        return [f(table(longest), ["ep"], "id", own) for f in (quality.idle_ratio, quality.pauses)]

    plain = [[sorted(map(str, f.collect())) for f in found(n)] for n in (0, 400)]
    monkeypatch.setattr(windows, "PIECE_ROWS", 200)
    monkeypatch.setattr(windows, "SPREAD_ROWS", 500)
    assert [f._jdf.queryExecution().executedPlan().toString().count("Exchange ") for f in found(0)] == [1, 1]
    assert [[sorted(map(str, f.collect())) for f in found(n)] for n in (0, 400)] == plain


def test_episodes_do_not_mix(spark):
    rows = frame(spark, [0, 0, 0], "x").union(frame(spark, [100, 100, 100], "y"))
    assert quality.speeds(long(rows), ["ep"], "i").count() == 0


def test_layers_and_settings():
    assert quality.layered_verdict({"nan_inf": "pass", "fps_valid": "skip"}, {"idle_ratio": "fail"}) == {"verdict": "warn", "failed": [], "warned": ["idle_ratio"], "not_audited": ["fps_valid"]}
    assert quality.layered_verdict({"nan_inf": "fail"}, {})["verdict"] == "fail"
    assert Settings().spike_factor == 15.0


def test_empty_table(spark):
    rows = frame(spark, [1]).limit(0)
    assert quality.idle_ratio(long(rows), ["ep"], "i").count() == 0
    assert quality.gate_frame_loss(rows, ["ep"], "a").count() == 0
