"""The stateful feed: complete windows only, repeated and late rows, interrupted runs."""

import os

from marlstone.streaming import incremental

SCHEMA = "event_id string, ts timestamp, event_type string, value double"


def add(spark, folder, rows):
    df = spark.createDataFrame([(k, f"2024-05-01 {t}:00", "view", v) for k, t, v in rows], "event_id string, ts string, event_type string, value double")
    df.withColumn("ts", df["ts"].cast("timestamp")).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base):
    out = incremental.run_rollup(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", SCHEMA, partitions=2, time="ts", key="event_id", groups=["event_type"], value="value")
    return sorted((r["event_type"], r["start"].hour, r["n"], r["total"]) for r in out.collect())


def test_windows_are_written_once_complete(spark, tmp_path):
    base, before = str(tmp_path), spark.conf.get("spark.sql.shuffle.partitions")
    add(spark, f"{base}/in", [("a", "10:05", 1.5), ("a", "10:06", 1.5), ("b", "10:30", 2.0)])
    assert run(spark, base) == []
    add(spark, f"{base}/in", [("c", "11:15", 4.0), ("b", "10:31", 9.0)])
    assert run(spark, base) == [("view", 10, 2, 3.5)] == run(spark, base)
    add(spark, f"{base}/in", [("d", "10:40", 7.0), ("e", "12:30", 8.0)])  # the first is late: its window is written
    want = [("view", 10, 2, 3.5), ("view", 11, 1, 4.0)]
    assert run(spark, base) == want
    # a run that ended before its last batch was committed
    last = max(int(f) for f in os.listdir(f"{base}/checkpoint/commits") if f.isdigit())
    for f in (f"{last}", f".{last}.crc"):
        os.remove(f"{base}/checkpoint/commits/{f}")
    assert run(spark, base) == want and spark.conf.get("spark.sql.shuffle.partitions") == before
