"""Trees, components, bars and spectra against direct computation on small wells."""

import numpy as np
from pyspark.sql import functions as F

from conftest import close, rows
from welltide.operators import coherence as C
from welltide.operators import topology as T


def vectors(spark, n=14, wells=3):
    rng = np.random.default_rng(2)
    data = [(w, i, 100.0 + i, [float(x) for x in rng.normal(size=4)]) for w in range(wells) for i in range(n)]
    return spark.createDataFrame(data, "well_id int, bin int, centre double, vec array<double>"), data


def test_tree_and_regime_boundaries(spark):
    v, data = vectors(spark)
    tree = T.spanning_tree(v)
    reg = {(r.well_id, r.i, r.j): r for r in T.regime_boundaries(tree, v).collect()}
    for w in range(3):
        x = np.array([d[3] for d in data if d[0] == w])
        dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        group, merges = {i: {i} for i in range(len(x))}, []
        for d, i, j in sorted((dist[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x))):
            a, b = group[i], group[j]
            if a is not b:
                dying, kept = (a, b) if len(a) < len(b) else (b, a)
                merges.append((i, j, d, min(dying), max(dying), len(dying)))
                kept |= dying
                for m in dying:
                    group[m] = kept
        got = rows(tree.where(F.col("well_id") == w), "i", "j", "w", "dying_lo", "dying_hi", "dying_n")
        assert [g[:2] + g[3:] for g in got] == [m[:2] + m[3:] for m in sorted(merges)]
        assert all(close(g[2], m[2]) for g, m in zip(got, sorted(merges)))
        cut = np.percentile([m[2] for m in merges], 75)
        assert {k for k in reg if k[0] == w} == {(w, m[0], m[1]) for m in merges if m[2] >= cut - 1e-12}


def test_components_on_long_chain(spark):
    nodes = spark.range(64).select(F.lit(1).alias("well_id"), F.col("id").cast("int").alias("bin"))
    edges = spark.range(63).where("id <> 40").select(F.lit(1).alias("well_id"), F.col("id").cast("int").alias("i"), (F.col("id") + 1).cast("int").alias("j"))
    assert {r.label for r in T.connected_components(nodes, edges).collect()} == {0, 41}


def test_well_behaved_well_has_no_anomaly(spark):
    f = spark.createDataFrame([(1, i, 10.0 * i, *([0.5] * 4)) for i in range(9)], "well_id int, bin int, centre double, rop double, wob double, torque double, rpm double")
    r = C.residuals(f, ["rop", "wob", "torque", "rpm"])
    assert all(x.r_smoothness == 0.0 for x in r.collect())
    assert C.anomalies(C.defects(r, f)).count() == 0


def test_tree_of_one_large_well_takes_few_rounds(spark, monkeypatch):
    """600 bins in one well, with equal bins, besides wells of one and two bins; rounds are the logarithm of the bins."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(590, 3)), np.zeros((10, 3))])
    data = [(1, 2 * i, 0.0, v.tolist()) for i, v in enumerate(x)] + [(2, 5, 0.0, [1.0, 2.0, 3.0]), (3, 1, 0.0, [0.0, 0.0, 0.0]), (3, 9, 0.0, [0.0, 3.0, 4.0])]
    v = spark.createDataFrame(data, "well_id int, bin int, centre double, vec array<double>")
    rounds = []
    monkeypatch.setattr(T, "_contracted", lambda best, f=T._contracted: (rounds.append(1), f(best))[1])
    tree = T.spanning_tree(v)
    assert "applyInPandas" not in tree._jdf.queryExecution().toString() and len(rounds) <= 10
    got = rows(tree, "well_id", "i", "j", "w")
    assert [r for r in got if r[0] == 3] == [(3, 1, 9, 5.0)] and not [r for r in got if r[0] == 2]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    a, b = np.triu_indices(600, 1)
    parent = list(range(600))

    def find(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    want = []
    for k in np.lexsort((b, a, d[a, b])):
        p, q = find(a[k]), find(b[k])
        if p != q:
            parent[q] = p
            want.append((1, 2 * int(a[k]), 2 * int(b[k])))
    assert [r[:3] for r in got if r[0] == 1] == sorted(want)
    assert tree.where("well_id = 1").agg({"dying_n": "max"}).first()[0] >= 1 and T.spanning_tree(v.limit(0)).count() == 0


def test_similar_wells_are_all_pairs_above_the_bound(spark):
    rng = np.random.default_rng(7)
    h = rng.dirichlet(np.full(10, 0.3), 150)
    h = np.concatenate([h, h[:20] + rng.normal(size=(20, 10)) * 0.01, np.repeat(h[:1], 5, axis=0)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(h)], "well_id int, histogram array<double>")
    for least in (0.97, 0.9, 0.5, 0.0):
        want = {(i, j) for i in range(len(h)) for j in range(i + 1, len(h)) if max(0.0, 1 - np.sqrt(((h[i] - h[j]) ** 2).sum()) / np.sqrt(2)) >= least}
        assert {(r.well_a, r.well_b) for r in C.similar_wells(df, least).collect()} == want
    assert C.similar_wells(df.limit(0), 0.9).count() == 0 and C.similar_wells(df.limit(1), 0.9).count() == 0


def test_similar_wells_of_equal_histograms_are_compared_in_blocks_and_keep_repeated_rows(spark):
    rng = np.random.default_rng(5)
    kinds = rng.dirichlet(np.full(10, 0.3), 12)
    h = [kinds[i] for i in rng.integers(0, 12, 150)]
    ids = [None if i == 4 else 7 if i in (7, 8, 9) else i for i in range(150)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, h)], "well_id int, histogram array<double>")
    for least in (0.95, 0.7, 0.0):
        want = sorted((min(ids[i], ids[j]), max(ids[i], ids[j])) for i in range(150) for j in range(i + 1, 150) if None not in (ids[i], ids[j]) and ids[i] != ids[j]
                      and max(0.0, 1 - np.sqrt(((h[i] - h[j]) ** 2).sum()) / np.sqrt(2)) >= least)
        out = C.similar_wells(df, least, members=5, part=3)
        assert sorted((r.well_a, r.well_b) for r in out.collect()) == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(_i") == 2
