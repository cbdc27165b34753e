"""Small wells and states go through one task each; their results are those of the chunked way."""

import random

import pytest
from pyspark.sql import functions as F

from welltide.operators import alerts as A
from welltide.operators import knowledge as K
from welltide.operators import segment as G
from welltide.session import stage
from welltide.sources import files


@pytest.fixture(scope="module")
def wells(spark):
    rnd, data = random.Random(1), []
    for w in range(24):
        n, period, b = rnd.choice([1, 2, 3, 5, 9, 10, 11, 40, 128, 300]) if w else 400, rnd.choice([7, 30, 60]), 0.0
        for p in range(n):
            b += rnd.choice([0, 0, 1, -1, 2.5, -0.3]) if w % 3 else ((p // 12) % 2 * 2 - 1) * 1.5
            data.append((w, p, 5000.0 + p, rnd.choice([0.0, 500.0, 510.0]) if w % 4 else (p // period) % 2 * 600.0 + rnd.random(),
                         (p // 25) % 2 * 100.0 * (w % 5 > 0) + (rnd.random() if w % 2 else 0.0), b, rnd.choice([1.0, 5.0, -20.0, 22.0]) if w % 7 else 3.0))
    return stage(spark.createDataFrame(data, "well_id int, pos long, depth_md double, flow_in double, rpm double, block_position double, wob double"), "test-wells")


def table(df):
    cols = sorted(df.columns)
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def test_states_from_one_task_are_those_of_the_chunked_way(wells):
    d = wells.withColumn("flow_in", F.when((F.col("well_id") % 6 > 0) | (F.col("pos") % 5 > 0), F.col("flow_in")))
    got = stage(G.detect_states(d, 10, keep=["depth_md", "block_position"], moves=True), "test-states")
    assert table(got) == table(G.detect_states(d, 10, keep=["depth_md", "block_position"], moves=True, small=0, size=64))
    assert got.select("state").distinct().count() > 5
    moved = G.transitions(got)
    assert table(moved) == table(G.transitions(got.drop("from_state")))
    # Samples are shuffled once, and transitions need no window.
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    once = plan(G.detect_states(wells, 10, keep=["depth_md", "block_position"]))
    assert once.count("RepartitionByExpression") == 1 and "Join" not in once and "Window" not in once + plan(moved)


def test_relations_from_one_task_are_those_of_the_chunked_way(wells):
    chans = ["flow_in", "rpm", "block_position", "wob"]
    d = wells.withColumn("rpm", F.when(F.col("pos") % 9 > 0, F.col("rpm"))).withColumn("state", F.when(F.col("pos") % 100 < 60, "x").otherwise("y"))
    r = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in table(df)]
    got = K.patterns_in_states(d, chans)
    assert r(got) == r(K.patterns_in_states(d, chans, size=64, small=0)) and got.count() > 4
    assert r(K.correlations_in_states(d, chans)) == r(K.correlations_in_states(d, chans, small=0)) == r(got.drop("is_threshold", "lag"))


def test_transitions_with_channels_are_not_joined_to_samples(wells):
    st = stage(G.detect_states(wells, 10, keep=["depth_md", "rpm", "wob"], moves=True), "test-states")
    p = K.profiles_in_states(st.where("pos < 60"), ["rpm", "wob"])
    got = A.scan_transitions(G.transitions(st, keep=["rpm", "wob"]), st, p, ["rpm", "wob"])
    assert table(got) == table(A.scan_transitions(G.transitions(st), wells, p, ["rpm", "wob"]))


def test_cloud_is_described_from_its_stored_points(spark, tmp_path):
    cloud = spark.range(1000).select((F.col("id") % 3).alias("well_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("channel"), F.rand().alias("depth"), F.col("id").alias("v"))
    files.save_cloud(cloud, str(tmp_path))  # points that differ each time they are made
    points, described = files.load_cloud(spark, str(tmp_path))
    want = points.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_points"), F.countDistinct("channel").alias("n_channels"), F.min("depth").alias("top"), F.max("depth").alias("bottom"))
    assert table(described) == table(want)
    assert any(p.name.endswith(".zstd.parquet") for p in tmp_path.rglob("*.parquet"))
