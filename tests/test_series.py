"""Chunked frames must not depend on the chunk size and must equal plain sequential models."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import close, rows
from welltide.operators import joins as J
from welltide.operators import knowledge as K
from welltide.operators import projections as P
from welltide.operators import segment as G
from welltide.operators import zones as Z
from welltide.operators.quantiles import exact_percentiles
from welltide.operators.series import bounded, carry, dense_positions, runs

c = F.col


def frame(spark, wells, seed=1):
    rnd = random.Random(seed)
    data = [(w, p, rnd.choice([None, 1.0, 2.0, 3.5, rnd.random()])) for w, n in wells.items() for p in range(n)]
    return spark.createDataFrame(data, "well_id int, pos long, v double"), data


def test_dense_positions(spark):
    data = [(w, t, t // 10) for w in (1, 2) for t in range(0, 95, 3)]
    d = spark.createDataFrame(data, "k int, t int, b int")
    got = rows(dense_positions(d, ["k"], [c("t")], c("b")), "k", "t", "pos")
    assert got == [(k, t, i) for k in (1, 2) for i, t in enumerate(range(0, 95, 3))]


@pytest.mark.parametrize("size", [7, 16, 1 << 20])
def test_carry_and_bounded(spark, size):
    df, data = frame(spark, {1: 50, 2: 5, 3: 1})
    out = carry(df, ["well_id"], last={"l": c("v")}, total={"t": F.coalesce("v", F.lit(0.0))}, following={"f": c("v")}, size=size)
    by = {}
    for w, p, v in data:
        by.setdefault(w, []).append(v)
    for w, p, l, t, f in rows(out, "well_id", "pos", "l", "t", "f"):
        vs = by[w]
        seen = [x for x in vs[:p + 1] if x is not None]
        later = [x for x in vs[p + 1:] if x is not None]
        assert l == (seen[-1] if seen else None) and f == (later[0] if later else None)
        assert close(t, sum(seen))
    out = bounded(df, ["well_id"], 3, 2, lambda w: {"m": F.avg("v").over(w.rowsBetween(-3, 2)), "g": F.lag("v").over(w)}, size=size)
    for w, p, m, g in rows(out, "well_id", "pos", "m", "g"):
        part = [x for x in by[w][max(0, p - 3):p + 3] if x is not None]
        assert close(m, sum(part) / len(part) if part else None)
        assert g == (by[w][p - 1] if p else None)


@pytest.mark.parametrize("size", [5, 1 << 20])
def test_runs(spark, size):
    rnd = random.Random(3)
    seq = [rnd.choice("ab") for _ in range(60)]
    d = spark.createDataFrame([(1, i, s) for i, s in enumerate(seq)], "well_id int, pos long, state string")
    start = 0
    for p, got in rows(runs(d, ["well_id"], "state", size), "pos", "run_start"):
        if p and seq[p] != seq[p - 1]:
            start = p
        assert got == start


@pytest.mark.parametrize("small", [0, 1 << 16])
@pytest.mark.parametrize("n,accuracy", [(1, 10000), (9, 10000), (3000, 10000), (3000, 200)])
def test_exact_percentiles(spark, n, accuracy, small):
    rng = np.random.default_rng(n)
    v = np.concatenate([rng.normal(0, 1, n), np.full(n // 3, -999.25), rng.choice([1e9, 5.0], n // 10)])
    d = spark.createDataFrame([(7, i, float(x)) for i, x in enumerate(v)], "k int, pos long, v double")
    got = exact_percentiles(d, ["k"], c("v"), {"a": 0.02, "b": 0.25, "m": 0.5, "z": 0.98, "e": 1.0, "s": 0.0}, size=64, accuracy=accuracy, small=small).first()
    for name, p in [("a", 2), ("b", 25), ("m", 50), ("z", 98), ("e", 100), ("s", 0)]:
        assert close(got[name], float(np.percentile(v, p))), name


def hysteresis_model(raw, n):
    cur, run, out = raw[0], 0, []
    for x in raw:
        if x == cur:
            run = 0
        else:
            run += 1
            if run >= n - 1:
                cur, run = x, 0
        out.append(cur)
    return out


def debounce_model(seq, m):
    """Repeat left-to-right passes until nothing changes: short runs take the state before them, else after."""
    s, moved = list(seq), True
    while moved:
        moved, i = False, 0
        while i < len(s):
            j = i
            while j < len(s) and s[j] == s[i]:
                j += 1
            if j - i < m:
                repl = s[i - 1] if i else (s[j] if j < len(s) else None)
                if repl is not None:
                    s[i:j] = [repl] * (j - i)
                    moved = True
            i = j
    return s


@pytest.mark.parametrize("size", [8, 1 << 20])
def test_hysteresis_and_debounce(spark, size):
    rnd = random.Random(11)
    flags, states = {}, {}
    for w in range(60):
        n, p = rnd.randint(1, 45), rnd.choice([0.1, 0.3, 0.5])
        b, s = [rnd.random() < 0.5], [rnd.choice("abc")]
        for _ in range(n - 1):
            b.append(not b[-1] if rnd.random() < p else b[-1])
            s.append(rnd.choice("abc") if rnd.random() < p else s[-1])
        flags[w], states[w] = b, s
    d = spark.createDataFrame([(w, i, f, states[w][i]) for w, fs in flags.items() for i, f in enumerate(fs)], "well_id int, pos long, up boolean, state string")
    got = {}
    for w, p, h in rows(G.hysteresis(d.drop("state"), ["up"], 4, size), "well_id", "pos", "up_held"):
        got.setdefault(w, []).append(h)
    assert got == {w: hysteresis_model(f, 4) for w, f in flags.items()}
    got = {}
    for w, p, s in rows(G.debounce(d.drop("up"), 5, size), "well_id", "pos", "state"):
        got.setdefault(w, []).append(s)
    assert got == {w: debounce_model(s, 5) for w, s in states.items()}


@pytest.fixture(scope="module")
def wide(spark, sf):
    from welltide.session import stage
    from welltide.sources.tables import drill_wide
    return stage(drill_wide(spark, sf), "test-wide")


def test_adapter_numbering_does_not_depend_on_buckets(spark, sf):
    from welltide.sources.tables import drill_wide
    a, b = drill_wide(spark, sf), drill_wide(spark, sf, ordered_by=50)
    assert rows(a, "well_id", "pos", "rop", "apwd") == rows(b, "well_id", "pos", "rop", "apwd")


def test_states_do_not_depend_on_chunks(wide):
    a = rows(G.detect_states(wide, 10, keep=["depth_md"]), "well_id", "pos", "state")
    b = rows(G.detect_states(wide, 10, size=64, keep=["depth_md"]), "well_id", "pos", "state")
    assert a == b and len({s for _, _, s in a}) > 4


def test_segment_outputs_do_not_depend_on_chunks(wide):
    st = wide.withColumn("state", F.when(c("wob") > 20, "x").otherwise("y"))
    for f in (lambda s: rows(G.timeline(st, size=s), "well_id", "run_start", "state", "run_end", "n_samples"),
              lambda s: rows(G.transitions(st, size=s), "well_id", "pos", "from_state", "to_state"),
              lambda s: rows(G.stands(wide, size=s), "well_id", "index_start", "index_end", "depth_start"),
              lambda s: rows(G.reclassify_connections(wide.select("well_id", "pos", F.when(c("wob") < 20, "UP").when(c("wob") > 30, "DOWN").otherwise("STATIC").alias("motion"), F.when(
                  c("pos") % 40 < 25, "drilling").when(c("wob").between(20, 30), "static").otherwise("tripping").alias("state")), s), "well_id", "pos", "state"),
              lambda s: rows(P.downsample(wide, ["well_id"], 37, s), "well_id", "pos"),
              lambda s: rows(P.recent_window(wide, 100.0, size=s), "well_id", "pos"),
              lambda s: [(w, k, round(t, 9), ch) for w, k, t, ch in rows(Z.flag_windows(wide.withColumn("depth_md", 5000 + c("pos") * 5.0), Z.baseline(wide), s), "well_id", "k", "confidence", "classification")]):
        assert f(64) == f(1 << 20)


def test_merged_zones_equal_ordered_fold(wide):
    w = Z.flag_windows(wide.withColumn("depth_md", 5000 + c("pos") * 5.0), Z.baseline(wide)).withColumn(
        "classification", F.when(c("k") % 7 < 4, "normal").otherwise("depleted"))
    want = []
    by = {}
    for r in w.orderBy("well_id", "k").collect():
        by.setdefault(r.well_id, []).append(r)
    for well, zs in by.items():
        cur = None
        for z in zs:
            if cur and z.classification == cur["c"] and z.top_md - cur["b"] < 50:
                cur.update(b=z.bottom_md, g=(cur["g"] + z.gamma_avg) / 2, conf=max(cur["conf"], z.confidence))
            else:
                cur = {"w": well, "t": z.top_md, "b": z.bottom_md, "c": z.classification, "g": z.gamma_avg, "conf": z.confidence}
                want.append(cur)
    for size in (8, 1 << 20):
        got = rows(Z.merge_adjacent(w, size), "well_id", "top_md", "bottom_md", "classification", "gamma_avg", "confidence")
        exp = sorted((x["w"], x["t"], x["b"], x["c"], x["g"], x["conf"]) for x in want)
        assert len(got) == len(exp)
        for a, b in zip(got, exp):
            assert a[:4] == b[:4] and close(a[4], b[4]) and close(a[5], b[5])


def test_survey_straight_well_and_chunks(spark, wide):
    s = spark.createDataFrame([(1, i, 30.0 * i, 0.0, 0.0) for i in range(40)], "well_id int, pos long, md double, inc double, azm double")
    for size in (7, 1 << 20):
        assert all(close(t, 30.0 * p) and n == 0 for p, t, n in rows(Z.minimum_curvature(s, size), "pos", "tvd", "north"))


def test_nearest_and_resample_do_not_depend_on_buckets(spark):
    rnd = random.Random(5)
    xs = sorted(rnd.uniform(0, 100) for _ in range(80))
    r = spark.createDataFrame([(1, x, x * 2) for x in xs], "k int, x double, v double")
    l = spark.createDataFrame([(1, rnd.uniform(-10, 110), i) for i in range(200)], "k int, x double, id int")
    for width in (3.0, 1000.0):
        n = J.nearest(l, r, ["k"], "x", "v", F.floor(c("x") / width))
        for x, at, d in [(a, b["at"], q) for a, b, q in n.select("x", "near", "distance").collect()]:
            best = min(xs, key=lambda y: (abs(y - x), y))
            assert at == best and close(d, abs(best - x))
        g = J.resample(l.select("k", "x"), r, ["k"], "x", "v", F.floor(c("x") / width))
        for x, v in rows(g, "x", "v"):
            want = None if x < xs[0] or x > xs[-1] else float(np.interp(x, xs, [2 * y for y in xs]))
            assert close(v, want)


def test_relationships_do_not_depend_on_chunks(wide):
    st = wide.withColumn("state", F.when(c("pos") % 200 < 150, "a").otherwise("b")).withColumn("lagged", F.sin(c("pos") / 9.0)) \
        .withColumn("lead", F.sin((c("pos") + 4) / 9.0)).withColumn("step", F.when(c("wob") > 25, 100.0).otherwise(c("wob") * 0.01))
    ch = ["wob", "step", "lagged", "lead", "torque", "rop"]
    cols = ["well_id", "state", "channel", "target", "relationship", "strength", "lag"]
    key = lambda t: tuple(str(x) for x in t)
    a = sorted((tuple(r) for r in K.relationships(st, ch).select(*cols).collect()), key=key)
    b = sorted((tuple(r) for r in K.relationships(st, ch, size=100).select(*cols).collect()), key=key)
    assert a == b
    kinds = {r[4] for r in a}
    assert "threshold" in kinds and "lagged" in kinds and "proportional" in kinds
    # The shifted pair is found with its shift.
    assert all(r[6] in (4, -4) for r in a if {r[2], r[3]} == {"lagged", "lead"} and r[1] == "a" and r[6] is not None)


def test_threshold_pattern_with_heavy_ties(spark):
    data = [(1, "s", "a", "b", i, 0.0 if i % 3 else float(i % 11), float(i % 2) if i < 300 else 50.0) for i in range(400)]
    d = spark.createDataFrame(data, "well_id int, state string, channel_a string, channel_b string, rn long, va double, vb double")
    order = sorted(data, key=lambda r: (r[5], r[4]))
    vb = np.array([r[6] for r in order])
    j, span = np.abs(np.diff(vb)), vb.max() - vb.min()
    want = bool(j.max() > span * 0.5 and (j > span * 0.1).sum() <= max(3, len(vb) // 50))
    for size in (20, 64, 1 << 20):
        assert K.threshold_patterns(d, size).first()["is_threshold"] == want


@pytest.mark.parametrize("lagsize", [100, 130, 1 << 16])
def test_lags_equal_direct_sums(spark, lagsize):
    rng = np.random.default_rng(4)
    a = np.cumsum(rng.normal(size=350))
    b = np.roll(a, -7) + rng.normal(size=350) * 0.01
    d = spark.createDataFrame([(1, "s", "a", "b", i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b))],
                              "well_id int, state string, channel_a string, channel_b string, rn long, va double, vb double")
    za, zb, n = (a - a.mean()) / a.std(), (b - b.mean()) / b.std(), len(a)
    cc = {k: (za[max(0, k):min(n, n + k)] * zb[max(0, -k):min(n, n - k)]).sum() / (n - abs(k)) for k in range(-87, 88)}
    best = max(cc, key=cc.get)
    got = K.lags(d, lagsize).collect()
    assert [r["lag"] for r in got] == ([best] if cc[best] - cc[0] >= 0.05 and best else [])


def test_constant_channel_has_no_correlation(spark):
    d = spark.createDataFrame([(1, float(i), 5.0, -2.0 * i) for i in range(40)], "k int, a double, b double, c double")
    got = {(r.channel_a, r.channel_b): r.r for r in J.pair_correlations(d, ["k"], ["a", "b", "c"]).collect()}
    assert got[("a", "b")] is None and got[("b", "c")] is None and close(got[("a", "c")], -1.0)


def test_no_frame_is_computed_anew_for_every_row(spark):
    df, _ = frame(spark, {1: 50})
    plan = lambda d: d._jdf.queryExecution().analyzed().toString().lower()
    assert "unboundedfollowing" not in plan(carry(df, ["well_id"], following={"f": c("v")}, size=7))
    assert "unboundedfollowing" not in plan(J.neighbours(df, ["well_id"], F.floor(c("pos") / 7), ["pos"], ["v"]))


@pytest.mark.parametrize("width", [3.0, 1000.0])
def test_even_grid_equals_resampling_onto_its_points(spark, width):
    rnd = random.Random(5)
    xs = sorted(rnd.sample(range(0, 4000), 40))
    data = [(1, x / 8, rnd.random()) for x in xs] + [(2, 30.0, 1.0), (3, 31.5, 2.0), (4, 20.0, 1.0), (4, 55.5, 3.0)]
    s = spark.createDataFrame(data, "well_id int, x double, v double")
    lim = s.groupBy("well_id").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    grid = lim.select("well_id", F.explode(F.sequence(F.floor(c("a") / 10), F.ceil(c("b") / 10))).alias("k")).select("well_id", (c("k") * 10.0).alias("x"))
    b = F.floor(c("x") / width)
    want = rows(J.resample(grid, s, ["well_id"], "x", "v", b), "well_id", "x", "v")
    got = J.resample_evenly(s, ["well_id"], "x", "v", 10.0, b)
    assert [(r[0], r[1]) for r in rows(got, "well_id", "x", "v")] == [(r[0], r[1]) for r in want]
    assert all(close(a[2], e[2]) for a, e in zip(rows(got, "well_id", "x", "v"), want))
    # The points are made where their samples are, after the last exchange.
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_responses_do_not_depend_on_chunks_and_shuffle_no_sample_twice(spark):
    rnd = random.Random(8)
    data = [(w, p, 5000.0 + p, float(rnd.random() + (p // 70) % 2), rnd.choice([None, 1.0, 4.0, 9.0]) if p % 3 else 2.0) for w in (1, 2) for p in range(400)]
    wide = spark.createDataFrame(data, "well_id int, pos long, depth_md double, a double, b double")
    moves = spark.createDataFrame([(w, p, "x", "y") for w in (1, 2) for p in (20, 70, 140, 141, 210, 349, 350, 390)], "well_id int, pos long, from_state string, to_state string")
    names = ["well_id", "at_pos", "channel", "peak", "settle_ft", "settle_samples", "shape"]
    whole = K.transition_responses(moves, wide, ["a", "b"])
    want = rows(whole, *names)
    assert {r[1] for r in want} == {70, 140, 141, 210, 349} and {r[2] for r in want} == {"a", "b"}
    assert rows(K.transition_responses(moves, wide, ["a", "b"], size=60), *names) == want
    # By hand: one channel at one transition.
    v = {p: a for w, p, _, a, _ in data if w == 1}
    pre = sum(v[p] for p in range(20, 70)) / 50
    got = next(r for r in want if r[:3] == (1, 70, "a"))
    assert close(got[3], max(abs(v[p] - pre) for p in range(70, 120)))
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1   # the number of samples per well


def test_patterns_of_whole_groups_equal_those_of_chunks(spark):
    rnd = random.Random(4)
    base = [rnd.random() for _ in range(130)]
    data = [(1, "s", i, base[i + 7], base[i], (2.0 if base[i] > 0.5 else 0.0) + base[i] / 100, rnd.choice([None, base[i], base[i]])) for i in range(120)]
    chans = ["a", "b", "d", "e"]
    r = spark.createDataFrame(data, "well_id int, state string, rn long, a double, b double, d double, e double")
    asked = spark.createDataFrame([(1, "s", x, y) for x, y in (("a", "b"), ("b", "d"), ("b", "e"))], "well_id int, state string, channel_a string, channel_b string")
    names = ["channel_a", "channel_b", "is_threshold", "lag"]
    key = lambda d: sorted(map(str, d.select(*names).collect()))
    whole, parts = key(K.patterns(r, asked, chans)), key(K.patterns(r, asked, chans, size=128, small=0))
    assert whole == parts
    assert "lag=7" in whole[0] or "lag=-7" in whole[0]


def test_small_groups_interpolate_like_large_ones(spark):
    lo = 0.1
    vals = [(1, i, x) for i, x in enumerate([lo, float(np.nextafter(lo, 1)), 0.3, 0.7, 0.9, 1.1])]
    d = spark.createDataFrame(vals, "k int, pos long, v double")
    for p in (0.05, 0.15, 0.25, 0.5, 0.73):
        got = exact_percentiles(d, ["k"], c("v"), {"q": p}).collect()[0]["q"]
        at = p * 5
        a, b = vals[int(at)][2], vals[int(np.ceil(at))][2]
        assert got == a + (b - a) * (at - int(at))
