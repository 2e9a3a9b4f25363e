from sensorline.functions import scalars as S


def test_scalars(spark):
    rows = spark.createDataFrame([(2.5, "3.5", [3.0, 4.0]), (float("nan"), "x", [0.0]), (None, None, None), (float("inf"), "", [])], "x double, s string, v array<double>")
    got = rows.select(S.finite("x").alias("f"), S.bad("x").alias("b"), S.clip("x", 0, 1).alias("c"), S.round_even("x").alias("r"), S.number("s").alias("n"), S.array_norm("v").alias("v"), S.short_hash("s").alias("h")).collect()
    assert (got[0].f, got[0].b, got[0].c, got[0].r, got[0].n, got[0].v) == (2.5, False, 1.0, 2.0, 3.5, 5.0)
    assert [r.f for r in got[1:]] == [None] * 3 and [r.b for r in got[1:]] == [True] * 3 and [r.n for r in got[1:]] == [None] * 3
    assert got[2].c is None and got[2].v is None and len(got[0].h) == 6


def test_epochs_are_exact(spark):
    row = spark.sql("select timestamp_ntz'2024-01-01 00:00:00.000001' as t").select(S.epoch_ns("t").alias("n")).first()
    assert row.n == 1_704_067_200_000_001_000
