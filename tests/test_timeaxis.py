import pytest
from pyspark.sql import functions as F

from sensorline.operators import timeaxis, windows


@pytest.mark.parametrize(
    ("name", "unit"),
    [("timestamp_ns", "ns"), ("t_us", "us"), ("stamp_ms", "ms"), ("time_s", "s"), ("frame_index", "frame_index"), ("pts", "frame_index"),
     ("columns", None), ("status", None), ("params", None), ("value", None), ("elapsed_seconds", "s")],
)
def test_unit_from_name(name, unit):
    assert timeaxis.unit_from_name(name) == unit


@pytest.mark.parametrize(
    ("start", "step", "unit"),
    [(1_704_067_200_000_000_000, 10_000_000, "ns"), (1_704_067_200_000_000, 10_000, "us"), (1_704_067_200_000, 10, "ms"), (1_704_067_200, 1, "s")],
)
def test_epoch_units(spark, start, step, unit):
    rows = spark.range(200).select(F.lit("a").alias("k"), (F.lit(start) + F.col("id") * step).alias("t"))
    assert timeaxis.infer_unit(rows, ["k"], "t").first().unit == unit


def test_unit_of_bad_clock(spark):
    rows = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 5.0)], "k string, t double")
    got = {r.k: (r.n, r.step) for r in timeaxis.infer_unit(rows, ["k"], "t").collect()}
    assert got == {"b": (1, None)}


def test_measured_rate_uses_file_order(spark):
    rows = spark.createDataFrame([("a", i, i * 10_000_000) for i in range(50)], "k string, i bigint, t bigint")
    assert timeaxis.measured_rate(rows, ["k"], "t", ["i"]).first().rate_hz == pytest.approx(100)
    assert timeaxis.measured_rate(rows.where("i < 2"), ["k"], "t", ["i"]).count() == 0


def test_steady_rate_drops_pauses(spark):
    times = [i * 10_000_000 for i in range(100)] + [5_000_000_000 + i * 10_000_000 for i in range(100)]
    rows = spark.createDataFrame([("a", t) for t in times], "k string, t bigint")
    got = timeaxis.steady_rate(rows, ["k"], "t").first()
    assert got.rate_hz == pytest.approx(100) and got.jitter_ms == pytest.approx(0) and got.n_steps == 198


def test_to_ns_keeps_whole_numbers(spark):
    got = spark.createDataFrame([(1_704_067_200_123_456, "us"), (5, "frame_index")], "t bigint, u string").select(timeaxis.to_ns(F.col("t"), F.col("u")).alias("n")).collect()
    assert [r.n for r in got] == [1_704_067_200_123_456_000, None]


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_neighbours_across_buckets(spark, width):
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    plain = windows.neighbours(rows, ["k"], ["i"], {"p": ("v", -1), "n": ("v", 1)})
    dealt = windows.neighbours(rows, ["k"], ["i"], {"p": ("v", -1), "n": ("v", 1)}, F.floor(F.col("i") / width))
    assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, dealt.collect()), key=str)


def test_neighbours_of_null_keys_and_empty(spark):
    rows = spark.createDataFrame([(None, 1, 1.0), (None, 2, 2.0), ("a", 1, None)], "k string, i int, v double")
    got = windows.neighbours(rows, ["k"], ["i"], {"p": ("v", -1)}, F.floor(F.col("i") / 1))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(None, 1, 1.0, None), (None, 2, 2.0, 1.0), ("a", 1, None, None)], key=str)
    assert windows.neighbours(rows.limit(0), ["k"], ["i"], {"p": ("v", -1)}).count() == 0


@pytest.mark.parametrize("width", [None, 3, 1000])
def test_nearest(spark, width):
    left = spark.createDataFrame([(t,) for t in (0, 5, 10, 14, 15, 16, 40, None)], "t bigint").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(0,), (10,), (20,)], "t bigint").withColumn("k", F.lit(1))
    got = {r.t: r.near for r in windows.nearest(left, right, ["k"], "t", width).where("t is not null").collect()}
    assert got == {0: 0, 5: 10, 10: 10, 14: 10, 15: 20, 16: 20, 40: 20}
    assert windows.nearest(left, right.limit(0), ["k"], "t", width).where("near is not null").count() == 0


def test_runs(spark):
    flags = [True, True, False, None, True, False, True]
    rows = spark.createDataFrame([("a", i, f) for i, f in enumerate(flags)], "k string, i int, f boolean")
    got = sorted((r["first"].i, r["last"].i, r.n_rows) for r in windows.runs(rows, ["k"], ["i"], "f").collect())
    assert got == [(0, 1, 2), (4, 4, 1), (6, 6, 1)]


def test_quantiles_equal_percentiles(spark):
    import numpy as np

    draw = np.random.default_rng(2)
    values = [float(v) for v in draw.normal(0, 1e6, 500)] + [0.0, 0.0, -0.0, 2.0, 4.0, 8.0, 1e-9, -3.0] + [7.0] * 300
    rows = [("a", v) for v in values] + [("b", 5.0), (None, 1.0), (None, 2.0), ("c", None), ("a", float("nan"))]
    frame = spark.createDataFrame(rows, "k string, v double")
    names = {"p0": 0.0, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: [r[n] for n in names] for r in windows.quantiles(frame, ["k"], "v", names).collect()}
    assert got["a"] == pytest.approx(np.quantile(values, list(names.values())).tolist()) and got["b"] == [5.0] * 5 and got[None] == pytest.approx([1, 1.05, 1.5, 1.95, 2])
    assert "c" not in got


def test_spread_quantiles_change_nothing(spark):
    from sensorline.operators import sync
    from sensorline.settings import Settings

    rows = spark.range(2_000).select((F.col("id") % 3).cast("string").alias("stream"), F.col("id").alias("i"), (F.col("id") * 1_000_003 + F.col("id") * F.col("id") % 977).alias("t"))
    plain, spread = (sorted(map(tuple, sync.stream_checks(rows, ["stream"], "t", ["i"], Settings(spread_quantiles=s)).collect())) for s in (False, True))
    assert plain == spread


def test_summaries_equal_either_way(spark):
    from sensorline.settings import Settings

    rows = [("a", 1.0, 4.0), ("a", 3.0, None), ("a", float("inf"), 8.0), (None, 2.0, 1.0), (None, 7.0, 1.5), ("b", None, float("nan"))]
    frame = spark.createDataFrame(rows, "k string, v double, u double")
    wanted = {"low": ("v", 0.25), "other": ("u", 0.5), "high": ("v", 0.75)}
    for keys, sums in ((["k"], []), (["k"], [F.count("*").alias("n")]), ([], [F.count("v").alias("n")])):
        for own in (frame, frame.where("false")):
            plain, spread = (windows.summaries(own, keys, sums, wanted, Settings(spread_quantiles=s)) for s in (False, True))
            assert plain.columns == spread.columns == [*keys, *["n"] * len(sums), *wanted]
            assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))
