"""Coherence of windows: samples are repeated for their windows only where they are summed up, in any chunks."""

import numpy as np

from conftest import close
from welltide.operators import coherence as C

NAMES = ["rop", "gamma_ray", "wob"]


def test_samples_are_not_shuffled_once_per_window(spark, monkeypatch):
    rng = np.random.default_rng(7)
    data = [(w, i, 5000.0 + step * i, *map(float, rng.uniform(10, 90, 3))) for w, n, step in ((1, 400, 5.0), (2, 30, 5.0), (3, 2, 1.0), (4, 300, 40.0)) for i in range(n)]
    df = spark.createDataFrame(data, "well_id int, pos long, depth_md double, rop double, gamma_ray double, wob double").repartition(4)
    seen, real = [], C.fibers
    monkeypatch.setattr(C, "fibers", lambda *a, **k: (seen.append(real(*a, **k)), seen[-1])[1])
    out = C.window_coherence(df, NAMES, size=64)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Join")
    got = {(r.well_id, r.window): r for r in out.collect()}

    # The windows made by repeating every sample first, each a key of its own.
    long = C.window_rows(df)
    keys = ["well_id", "window"]
    lim = long.groupBy(*keys).agg({"depth_md": "min", "*": "count"}).toDF(*keys, "n", "lo").join(
        long.groupBy(*keys).agg({"depth_md": "max"}).toDF(*keys, "hi"), keys).where("n * 3 >= 10")
    res = C.residuals(real(long, NAMES, 20, keys, limits=lim), NAMES, keys, 10.0)
    want = {}
    for r in res.collect():
        want.setdefault((r.well_id, r.window), []).append(r.r_composite ** 2)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(close(got[k].coherence, float(np.exp(-np.mean(v)))) and got[k].n_bins == len(v) + 1 for k, v in want.items())
