"""Correlations from blocks against direct computation, with gaps, constants, many groups and many channels."""

import numpy as np
import pytest

from welltide.operators import correlations as R


def brute(data, names):
    out = {}
    for g in {r[0] for r in data}:
        x = np.array([[np.nan if v is None else v for v in r[1:]] for r in data if r[0] == g], dtype=float)
        for i in range(len(names)):
            for j in range(i + 1, len(names)):
                both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
                a, b = x[both, i], x[both, j]
                flat = not both.any() or a.min() == a.max() or b.min() == b.max()
                out[g, names[i], names[j]] = (int(both.sum()), None if flat else float(np.corrcoef(a, b)[0, 1]))
    return out


@pytest.mark.parametrize("held", [R.HELD_BYTES, 1])
def test_blocks_equal_direct_computation(spark, monkeypatch, held):
    monkeypatch.setattr(R, "HELD_BYTES", held)
    rng = np.random.default_rng(3)
    data = []
    for i in range(3000):
        g = None if i % 50 == 0 else "hot" if i % 3 else f"w{i % 11}"
        t = rng.normal()
        row = [1e6 + t, 5 * t + rng.normal(), rng.normal(), 7.25, -t, 3.0 if i % 2 else None]
        row[1] = None if rng.random() < 0.3 else row[1]
        row[4] = None if g == "w1" else row[4]
        data.append((g, *row))
    names = ["a", "b", "c", "constant", "e", "half"]
    df = spark.createDataFrame(data, "well_id string, a double, b double, c double, constant double, e double, half double").repartition(7)
    got = {(r.well_id, r.channel_a, r.channel_b): (r.n, r.r) for r in R.pair_correlations(df, ["well_id"], names).collect()}
    want = brute(data, names)
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and (got[k][1] is None) == (r is None), k
        assert r is None or got[k][1] == pytest.approx(r, abs=1e-7)


def test_many_channels_leave_no_row_per_pair(spark):
    """400 channels: the plan neither explodes rows nor grows, and a task returns one row per group and channel."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 400))
    names = [f"c{i}" for i in range(400)]
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], ", ".join(["well_id int", *[f"{n} double" for n in names]])).coalesce(2)
    out = R.pair_correlations(df, ["well_id"], names)
    assert "Generate" not in out._jdf.queryExecution().toString()
    got = {(r.channel_a, r.channel_b): r.r for r in out.collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 400 * 399 // 2 and all(abs(got[names[i], names[j]] - want[i, j]) < 1e-9 for i, j in [(0, 1), (5, 399), (200, 300), (398, 399)])
    assert R.pair_correlations(df.limit(0), ["well_id"], names[:3]).count() == 0
