"""Live checks that wait for late rows and end idle streams."""

import pandas as pd

from sensorline.streaming import checks

S = 1_000_000_000


def test_late_rows_are_sorted_in_and_idle_streams_end(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    batches = [
        [("a", 100.0), ("a", 101.0), ("b", 100.5)],
        [("a", 104.0), ("a", 103.0), ("b", 101.5)],  # 102 is still to come
        [("a", 102.0), ("a", 109.0)],  # late, but in time: no gap before 104; a gap from 104 to 109
        [("a", 125.0)],
        [("a", 200.0)],
        [("a", 201.0)],
    ]
    for i, rows in enumerate(batches):
        pd.DataFrame({"k": [k for k, _ in rows], "t": [int(t * S) for _, t in rows]}).to_parquet(tmp_path / f"{i}.parquet")
    live = spark.readStream.schema("k string, t bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    found = checks.held_gaps(live, "k", "t", int(2.5 * S), late="10 seconds", idle_ms=50_000)
    run = found.writeStream.format("memory").queryName("held").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted((r.k, r.event, r.start_ns / S, r.end_ns and r.end_ns / S) for r in spark.table("held").collect())
    assert ("a", "gap", 104.0, 109.0) in got and ("a", "gap", 109.0, 125.0) in got and not [g for g in got if g[2] in (101.0, 102.0, 103.0) and g[1] == "gap"]
    assert [g for g in got if g[0] == "b"] == [("b", "end", 101.5, None)]
