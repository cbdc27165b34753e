"""Live companion merge over several triggers against the rule row by row."""

import random
from datetime import datetime, timedelta

from welltide.streaming import live

START = datetime(2024, 1, 1)


def test_depths_of_live_time_rows(spark, tmp_path):
    rng = random.Random(5)
    time_cols, depth_cols = "ip string, wits_id string, ts timestamp, value double, pos long", "ip string, wits_id string, ts timestamp, depth double, value double"
    rows = [(ip, w, START + timedelta(minutes=m), rng.random() if rng.random() < 0.9 else None, m * 10 + k)
            for ip in ("a", "b", None) for m in range(240) for w in ("0108", "0130") for k in range(rng.randrange(3))]
    for i in range(4):  # an hour each; within an hour in any order
        part = [r for r in rows if r[2].hour == i]
        rng.shuffle(part)
        spark.createDataFrame(part + ([("a", "0130", None, 7.0, 0)] if i == 1 else []), time_cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "time"))
    deep = [("a", "0110", START + timedelta(days=i - 5), float(i), 1.0) for i in range(10)] + [("b", "0110", None, None, None)]
    spark.createDataFrame(deep, depth_cols).coalesce(1).write.parquet(str(tmp_path / "depth"))
    time = spark.readStream.schema(time_cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "time")).withWatermark("ts", "1 hour")
    depth = spark.readStream.schema(depth_cols).parquet(str(tmp_path / "depth"))
    live.run_available(live.companion_rows(depth, time), str(tmp_path / "out"), str(tmp_path / "state"))

    limit, last = max(r[2] for r in rows) - timedelta(hours=1), {}
    for ip, w, ts, v, pos in sorted(rows, key=lambda r: r[4]):
        if w == "0108" and ip is not None:
            last[ip, ts] = v
    want = [(ip, w, ts, last.get((ip, ts)), v, "time") for ip, w, ts, v, _ in rows if ts <= limit]
    want += [("a", "0130", None, None, 7.0, "time")] + [(*r, "depth") for r in deep]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == sorted(want, key=str)
