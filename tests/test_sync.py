import pytest
from pyspark.sql import functions as F

from sensorline.operators import sync
from sensorline.settings import Settings

MS = 1_000_000


def stream(spark, name, times):
    return spark.createDataFrame([(name, i, int(t)) for i, t in enumerate(times)], "stream string, i bigint, t bigint")


def test_clean_stream(spark):
    got = sync.stream_checks(stream(spark, "a", [i * 10 * MS for i in range(500)]), ["stream"], "t", ["i"]).first()
    assert (got.n, got.n_disorder, got.n_duplicates, got.n_gaps, got.loss) == (500, 0, 0, 0, 0)
    assert got.rate_hz == pytest.approx(100)


def test_gap_disorder_and_duplicates(spark):
    times = [i * 10 * MS for i in range(100)] + [2_000 * MS + i * 10 * MS for i in range(100)]
    times[10], times[11] = times[11], times[10]
    times[20] = times[19]
    got = sync.stream_checks(stream(spark, "a", times), ["stream"], "t", ["i"]).first()
    assert (got.n_disorder, got.n_duplicates, got.n_gaps) == (1, 1, 1)
    assert got.loss == pytest.approx((1010 - 10) / 2990)


def test_one_value_and_nulls(spark):
    rows = spark.createDataFrame([("a", 0, 5), ("b", 0, None)], "stream string, i bigint, t bigint")
    got = sync.stream_checks(rows, ["stream"], "t", ["i"]).collect()
    assert [(r.stream, r.n, r.rate_hz, r.loss) for r in got] == [("a", 1, None, 0.0)]


def test_shapes(spark):
    periodic = stream(spark, "periodic", [i * 8_333_333 for i in range(1000)])
    burst = stream(spark, "burst", [b * 50 * MS + i * 1_792 for b in range(30) for i in range(20)])
    static = stream(spark, "static", [0, 5, 9])
    got = {r.stream: r for r in sync.stream_shape(periodic.union(burst).union(static), ["stream"], "t").collect()}
    assert {k: v["shape"] for k, v in got.items()} == {"periodic": "periodic", "burst": "burst", "static": "static"}
    assert got["burst"].n_bursts == 30


def test_constant_offset_and_drift(spark):
    base = stream(spark, "base", [i * 10 * MS for i in range(500)])
    late = stream(spark, "late", [i * 10 * MS + 2 * MS for i in range(500)])
    slow = stream(spark, "slow", [i * 10 * MS + i * 8_000 for i in range(500)])
    offsets = sync.residuals(late.union(slow), base, ["stream"], "t", 100 * MS)
    stats = {r.stream: r for r in sync.residual_stats(offsets, ["stream"]).collect()}
    assert stats["late"].mean_ms == pytest.approx(2) and stats["late"].signed_median_ms == pytest.approx(2)
    found = {r.stream: r for r in sync.drift(sync.base_offsets(late.union(slow), base, "stream", "t"), ["stream"], "t", 1.0).collect()}
    assert not found["late"].drifts and found["late"].slope_ms_per_s == pytest.approx(0, abs=1e-9)
    assert found["slow"].drifts and found["slow"].slope_ms_per_s == pytest.approx(0.8, rel=0.01)
    two = sync.drift(sync.base_offsets(late, base.where("i < 2"), "stream", "t"), ["stream"], "t", 1.0).first()
    assert two.slope_ms_per_s is None and not two.drifts
    assert sync.base_offsets(late.limit(0), base, "stream", "t").count() == 0


def test_bursts_have_neither_gaps_nor_loss(spark):
    """Two hundred bursts of a hundred rows, ten milliseconds of silence between them."""
    times, t = [], 0
    for _ in range(200):
        times += [t + 1_000 * (i + 1) for i in range(100)]
        t = times[-1] + 10 * MS
    rows = stream(spark, "tf", times).union(stream(spark, "imu", [i * MS for i in range(2_000)])).union(stream(spark, "cam", [i * MS for i in range(2_000)]))
    checks = {r.stream: r for r in sync.stream_checks(rows, ["stream"], "t", ["i"]).collect()}
    assert (checks["tf"]["shape"], checks["tf"].loss, checks["tf"].n_gaps, checks["imu"].loss) == ("burst", None, None, 0.0)
    assert sync.locate_gaps(rows, ["stream"], "t").count() == 0
    report = {r.stream: r for r in sync.sync_report(rows, "stream", "t", ["i"], "imu").collect()}
    assert {k: r.verdict for k, r in report.items()} == {"tf": "pass", "imu": "pass", "cam": "pass"} and report["tf"].mean_ms is None
    aligned = {r.stream: r.n_gaps for r in sync.container_alignment(rows.withColumn("file", F.lit("f")), "file", "stream", "t").collect()}
    assert aligned == {"tf": None, "imu": 0, "cam": 0}


def test_residuals_do_not_depend_on_buckets(spark):
    base, other = stream(spark, "b", [i * i * 1000 for i in range(300)]), stream(spark, "o", [i * 7919 for i in range(5000)])
    pick = lambda width: sorted(map(tuple, sync.residuals(other, base, ["stream"], "t", width).collect()))
    assert pick(None) == pick(10_000) == pick(10**7)


def test_baseline_rank_leaves_out_static_names_and_short_streams(spark):
    rows = stream(spark, "imu", [i * MS for i in range(1000)]).union(stream(spark, "tf_static", [i * MS for i in range(1000)])).union(stream(spark, "short", [i * MS for i in range(200)]))
    assert [r.stream for r in sync.rank_baselines(rows, "stream", "t").collect()] == ["imu"]


def test_report_fails_lossy_stream(spark):
    whole = stream(spark, "imu", [i * 10 * MS for i in range(1000)])
    lossy = stream(spark, "cam", [i * 10 * MS for i in range(1000) if not 300 < i < 500])
    got = {r.stream: (r.baseline, r.verdict) for r in sync.sync_report(whole.union(lossy), "stream", "t", ["i"]).collect()}
    assert got == {"imu": ("imu", "pass"), "cam": ("imu", "fail")}


def test_gap_limit(spark):
    times = [b * 1_100 * MS + i * 10 * MS for b in range(12) for i in range(100)]
    got = sync.locate_gaps(stream(spark, "a", times), ["stream"], "t", Settings(gap_report_limit=7)).collect()
    assert len(got) == 7 and {round(r.duration_s, 3) for r in got} == {0.11}


def test_container_alignment(spark):
    rows = stream(spark, "long", [i * 10 * MS for i in range(1001)]).union(stream(spark, "late", [3_000 * MS + i * 10 * MS for i in range(701)])).withColumn("file", F.lit("f"))
    got = {r.stream: r for r in sync.container_alignment(rows, "file", "stream", "t").collect()}
    assert got["late"].master == "long" and got["late"].head_offset_s == 3.0 and got["late"].flagged and not got["long"].flagged


def test_clock_conflict(spark):
    times = [b * 50 * MS + i * 1_792 for b in range(30) for i in range(20)]
    rows = spark.createDataFrame([("a", t, i * MS) for i, t in enumerate(times)], "stream string, t bigint, u bigint")
    got = sync.clock_conflicts(rows, ["stream"], ["t", "u"]).first()
    assert (got.main_shape, got["shape"], got.suspected) == ("burst", "periodic", True)
