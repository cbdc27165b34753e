"""Profiles made of whole groups in one task against those of the chunked way, and rows instead of one row per channel in the shuffle."""

import numpy as np

from conftest import close
from welltide.operators import knowledge as K

NAMES = ["a", "b", "two", "flat", "gaps", "odd"]
COLUMNS = "well_id int, state string, pos long, " + ", ".join(f"{x} double" for x in NAMES)


def sampled(spark):
    rng = np.random.default_rng(5)
    data = []
    for i in range(4000):
        well, t = i % 3, float(rng.normal())
        state = ["x", "y", "z"][int(rng.integers(3))] if well else "x"
        v = [t, i * 0.01 + t, 5.0 * (i % 7 < 3) + 0.1 * t, 7.25, None if rng.random() < 0.4 else float(rng.exponential()),
             float("nan") if well == 2 and i % 50 == 0 else t]
        data.append((well, state, i // 3, *v))
    data += [(9, "x", i, 1.0 * i, None, 0.0, 2.0, None, -1.0 * i) for i in range(7)] + [(9, "y", 7, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(data, COLUMNS).repartition(5)


def found(df):
    return {(r.well_id, r.channel, r.state): r for r in df.collect()}


def test_groups_in_one_task_equal_the_chunked_way(spark):
    df = sampled(spark)
    want = found(K.state_profiles(df.unpivot(["well_id", "pos", "state"], NAMES, "channel", "v"), 64))
    for small in (1, 700, 1 << 16):
        got = found(K.profiles_in_states(df, NAMES, 64, small))
        assert got.keys() == want.keys()
        for k, w in want.items():
            g = got[k]
            assert (g.n, g.distribution, g.trend, g.informative) == (w.n, w.distribution, w.trend, w.informative), (small, k, g, w)
            assert all(close(g[x], w[x]) or (np.isnan(g[x]) and np.isnan(w[x])) for x in ("lo", "hi", "variance")), (small, k, g, w)


def test_no_row_per_channel_is_shuffled(spark):
    """The rows of small groups are shuffled as they are: what is written for them does not grow with the steps and channels."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i % 4, "x", i, *map(float, rng.normal(size=6))) for i in range(2000)], COLUMNS)
    calls = []
    real = K.state_profiles
    K.state_profiles = lambda long, *a: (calls.append(long.count()), real(long, *a))[1]
    try:
        assert K.profiles_in_states(df, NAMES).count() == 24
    finally:
        K.state_profiles = real
    assert calls == [0]
