import datetime
import math
import random

from welltide.plans import load_all
from welltide.plans.registry import QUERIES

load_all()


def test_even_grid_needs_no_numbering_and_leaves_out_events_without_well_channel_or_time(spark, tmp_path):
    rnd = random.Random(6)
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 17 == 0 else day + datetime.timedelta(minutes=i), None if i % 13 == 0 else rnd.choice([1, 2, 3]), None if i % 11 == 0 else rnd.choice(["view", "click"]),
             None if i % 7 == 0 else rnd.random(), '{"k": 1}') for i in rnd.sample(range(200_000), 60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    out = QUERIES["depth_grid_resample"](spark, str(tmp_path))
    assert "unix_date" not in out._jdf.queryExecution().optimizedPlan().toString()
    groups = {}
    for i, ts, well, kind, value, _ in sorted(rows):
        if ts and well and kind:
            groups.setdefault((well, {"view": "0120", "click": "0130"}[kind]), []).append((5000.0 + i * 0.1, value))
    want = {}
    for key, found in groups.items():
        for k in range(math.floor(found[0][0] / 10), math.ceil(found[-1][0] / 10) + 1):
            x = k * 10.0
            low, high = [s for s in found if s[0] <= x][-1:], [s for s in found if s[0] > x][:1]
            v = None
            if low and low[0][0] == x:
                v = low[0][1]
            elif low and high and None not in (low[0][1], high[0][1]):
                v = low[0][1] + (x - low[0][0]) / (high[0][0] - low[0][0]) * (high[0][1] - low[0][1])
            want[*key, x] = v
    got = {(r.well_id, r.wits_id, r.depth): r.value for r in out.collect()}
    assert got.keys() == want.keys() and len(want) > 1000
    assert all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-3) for k, v in want.items())
