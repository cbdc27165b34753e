"""Recall of the nearest neighbours where one byte per component could not tell vectors apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from welltide.llm import ann


def clusters(rng):
    centre = rng.standard_normal((4, 32))
    centre /= np.linalg.norm(centre, axis=1)[:, None]
    x = np.repeat(centre, 1000, axis=0) + rng.standard_normal((4000, 32)) * 0.01 / np.sqrt(32)
    return x / np.linalg.norm(x, axis=1)[:, None]


def one_long(rng):
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[7] *= 100
    return x


@pytest.mark.parametrize("make", [clusters, one_long])
def test_recall_of_near_copies_and_beside_a_long_vector(spark, make):
    x = make(np.random.default_rng(3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    by = {}
    for r in ann.nearest(df, F.pmod(F.col("id"), F.lit(40)) == 0, 20).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    s = x[::40] @ x.T
    s[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    want = np.argsort(-s, axis=1, kind="stable")[:, :20]
    recall = np.mean([len(by[40 * i] & set(w.tolist())) / 20 for i, w in enumerate(want)])
    print(make.__name__, "recall", recall)
    assert recall >= 0.95
