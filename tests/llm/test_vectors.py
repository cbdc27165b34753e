"""Hard negatives and centroid clustering against brute force, with ties, copies and odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from welltide.llm import kmeans, negatives

ODD = [(9001, None, 1), (9002, [None] * 64, 1), (9003, [float("nan")] * 64, 1), (9004, [float("inf")] + [0.0] * 63, 2)]
SCHEMA = "vec_id long, embedding array<double>, label int"


def vectors(seed, n, copies=0):
    """n vectors around few centres, and ``copies`` of the first."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, 64)) / 8
    x = centres[rng.integers(0, 5, n)] + rng.standard_normal((n, 64)) * rng.choice([0.01, 0.1], n)[:, None]
    return np.concatenate([x, np.repeat(x[:1], copies, axis=0)]), rng


def brute_negatives(ids, label, x, anchors, k=5, m=10):
    v = np.floor(256 * x).astype(int).astype(object)
    out = []
    for a in anchors:
        s = {i: int(np.dot(v[a], v[i])) for i in range(len(ids)) if i != a}
        order = sorted(s, key=lambda i: (-s[i], ids[i]))
        for p in [i for i in order if label[i] == label[a]][:k]:
            fit = [i for i in order if label[i] != label[a] and 30 * s[p] <= 100 * s[i] <= 90 * s[p]][:m]
            out += [(ids[a], ids[p], r, ids[i], s[p], s[i]) for r, i in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("split_rows,group_anchors", [(1 << 14, 2048), (60, 3)])
def test_hard_negatives(spark, split_rows, group_anchors):
    x, rng = vectors(1, 500, copies=120)
    ids = rng.permutation(len(x)).tolist()
    label = rng.integers(0, 4, len(x)).tolist()
    df = spark.createDataFrame([*zip(ids, x.tolist(), label), *ODD, (None, x[0].tolist(), 1), (9005, x[0].tolist(), None)], SCHEMA)
    df = df.withColumns({"id": F.lit(5), "split": F.lit(1), "rank": F.lit("x")})
    got = negatives.hard_negatives(df, F.col("id") % 25 == 0, split_rows=split_rows, group_anchors=group_anchors)
    anchors = [i for i, k in enumerate(ids) if k % 25 == 0]
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == brute_negatives(ids, label, x, anchors)


def test_hard_negatives_short_repeated_and_large(spark):
    x, rng = vectors(2, 80)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows[4] = (4, rows[4][1][:40], 1)
    full = np.array([np.pad(v, (0, 64 - len(v))) for _, v, _ in rows])
    df = spark.createDataFrame([*rows, (7, rows[9][1], 2), (8, rows[8][1], 2)], SCHEMA)  # of a key the smallest label and vector count
    label = [r[2] for r in rows]
    scaled = negatives.hard_negatives(df.withColumn("embedding", F.transform("embedding", lambda v: v * 50000)), F.col("id") % 10 == 0).collect()
    want = brute_negatives(list(range(80)), label, full * 50000, range(0, 80, 10))
    assert sorted(tuple(r) for r in scaled) == want and want
    assert negatives.hard_negatives(df.limit(0), F.col("id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame(ODD, SCHEMA), F.col("id") % 10 == 0).count() == 0
    with pytest.raises(Exception, match="larger than"):
        negatives.hard_negatives(df.withColumn("embedding", F.transform("embedding", lambda v: v * 1e12)), F.col("id") % 10 == 0).count()


def test_the_scan_reads_less_than_everything():
    """Bounds alone drop most rows of near groups before all dimensions have been read."""
    import pandas as pd

    x, rng = vectors(3, 4000)
    ints = np.floor(256 * x).astype(np.int32)
    rows = negatives.Vertical(pd.DataFrame({"id": np.arange(len(x)), "label": 0, "ints": [r.tobytes() for r in ints]}))
    seen = []
    at, score = rows.scan(ints[0], np.arange(len(x)), lambda low, high: (seen.append(len(low)), high >= negatives._kth(low, 5))[1])
    exact = ints.astype(int) @ ints[0].astype(int)
    assert set(at) >= set(np.argsort(-exact, kind="stable")[:5]) and (score == exact[at]).all()
    assert seen[-1] < seen[0] / 2


def brute_clusters(ids, x, k=8, rounds=10):
    v = np.floor(1024 * x).astype(np.int64)
    c = v[sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"3:{ids[i]}".encode()).hexdigest())[:k]]
    for r in range(rounds + 1):
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if r < rounds:
            c = np.array([v[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    best = d[np.arange(len(v)), own]
    name = [hashlib.sha256(",".join(map(str, y.tolist())).encode()).hexdigest() for y in c]
    return sorted((i, int(o), int(b), int(best[own == o].sum()), int(best.sum()), name[o]) for i, o, b in zip(ids, own, best))


@pytest.mark.parametrize("n,copies,scale", [(600, 0, 1.0), (300, 200, 1.0), (5, 0, 1.0), (200, 0, 20000.0)])
def test_clusters(spark, n, copies, scale):
    x, rng = vectors(4, n, copies)
    x, ids = x * scale, list(range(len(x)))
    df = spark.createDataFrame([*zip(ids, x.tolist(), [0] * len(x)), *ODD, (9006, [1.0] * 63, 1), (9007, [], 1)], SCHEMA)
    got = kmeans.clustered(df.withColumns({"id": F.lit(1), "cluster": F.lit(1), "vec": F.lit(1)}))
    assert sorted(tuple(r) for r in got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()) == brute_clusters(ids, x)


def test_clusters_of_equal_vectors_and_null_keys(spark):
    df = spark.createDataFrame([(i if i else None, [0.5] * 64, 0) for i in range(30)], SCHEMA)
    got = kmeans.clustered(df).collect()
    assert len(got) == 30 and {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}  # ties go to cluster 0
    assert kmeans.clustered(df.limit(0)).count() == 0 and kmeans.clustered(spark.createDataFrame(ODD, SCHEMA)).count() == 0


def test_the_filter_never_drops_the_nearest():
    x, rng = vectors(5, 3000)
    v = np.floor(1024 * x).astype(np.int64)
    centres = v[rng.integers(0, len(v), 40)]
    mean = v.mean(axis=0)
    directions = np.linalg.eigh(np.cov(v.T))[1][:, ::-1][:, :8]
    own, d = kmeans.nearest_centroid(v, *kmeans.rotated(v, mean, directions), centres, *kmeans.rotated(centres, mean, directions))
    every = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (own == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
