"""Nearest samples of every channel and around a probe, and counts within a radius, against brute force."""

import random

from pyspark.sql import functions as F

from tests.conftest import rows
from welltide.operators import joins as J


def made(spark, seed):
    rng = random.Random(seed)
    s = sorted({(w, rng.randint(0, 400) / 4) for w in (1, 2) for _ in range(60)})
    samples = [(w, x, rng.choice("ab" if w == 1 else "bc"), float(rng.randint(0, 99))) for w, x in s] + [(3, 40_000.0, "a", 7.0)]
    probes = [(w, i, rng.randint(-40, 480) / 4 + 0.05) for i in range(80) for w in (1, 2)] + [(3, 900, 0.0), (4, 901, 5.0)]
    return samples, probes, spark.createDataFrame(samples, "well_id int, x double, kind string, value double"), spark.createDataFrame(probes, "well_id int, id int, x double")


def test_nearest_of_each_kind(spark):
    samples, probes, s, p = made(spark, 3)
    got = J.nearest_each(p, s, ["well_id"], "x", "value", "kind", ["a", "b", "c"], F.floor(F.col("x") / 10))
    want = []
    for w, i, x in probes:
        for k in "abc":
            near = min(((abs(y - x), y, v) for u, y, q, v in samples if u == w and q == k), default=None)
            want += [(w, i, k, near[1], near[2])] if near else []
    assert rows(got.select("well_id", "id", "kind", "near.*"), "well_id", "id", "kind", "at", "value") == sorted(want)
    # Probes are repeated for their channels after the last shuffle, not before.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Window")


def test_samples_around_the_nearest(spark):
    samples, probes, s, p = made(spark, 5)
    got = J.around_nearest(p, s, ["well_id"], "id", "x", F.floor(F.col("x") / 10), 0.5)
    want = []
    for w, i, x in probes:
        mine = [(y, k, v) for u, y, k, v in samples if u == w]
        if mine:
            far = min(abs(y - x) for y, _, _ in mine) + 0.5
            want += [(w, i, y, k, v) for y, k, v in mine if abs(y - x) <= far]
    assert rows(got, "well_id", "id", "x", "kind", "value") == sorted(want)
