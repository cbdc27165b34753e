"""Inputs beyond the tidy ones: gaps, outliers, several dumps and layouts, late rows, per-well calibration."""

import datetime as dt
import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from welltide import session
from welltide.operators import joins as J
from welltide.operators import knowledge as K
from welltide.operators import projections as P
from welltide.operators import topology as T
from welltide.plans import d_segments
from welltide.sources import dumps, files
from welltide.streaming.live import flip_after

c = F.col


def test_lag_does_not_depend_on_the_chunk_when_rows_are_missing(spark):
    rnd = random.Random(4)
    base = [rnd.random() for _ in range(1000)]
    kept = [i for i in range(0, 2700, 3)]
    pr = spark.createDataFrame([(1, "s", "a", "b", r, base[k + 60], base[k]) for k, r in enumerate(kept) if k + 60 < 1000],
                               "well_id int, state string, channel_a string, channel_b string, rn long, va double, vb double")
    got = {size: [r.lag for r in K.lags(pr, size).collect()] for size in (65536, 300, 128)}
    assert got == {65536: [-60], 300: [-60], 128: [-60]}


def test_one_spike_leaves_value_buckets_small(spark):
    rnd = random.Random(1)
    data = [(1, i, rnd.random()) for i in range(20000)] + [(1, 20000, 1e9)]
    df = spark.createDataFrame(data, "well_id int, rn long, v double")
    b = K.value_buckets(df, ["well_id"], "v", "rn", 1000).groupBy("well_id", "_vb").count()
    assert b.agg(F.max("count")).first()[0] <= 2000
    order = K.value_buckets(df, ["well_id"], "v", "rn", 1000).select("_vb", "v").collect()
    spans = {}
    for r in order:
        lo, hi = spans.get(r._vb, (r.v, r.v))
        spans[r._vb] = (min(lo, r.v), max(hi, r.v))
    ends = [spans[k] for k in sorted(spans)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))


def test_bins_are_as_many_as_asked_for(spark):
    w = spark.range(4000).select(F.lit(1).alias("well_id"), c("id").alias("pos"), (c("id") * 1.0).alias("depth_md"), F.sin("id").alias("a"))
    assert T.bin_vectors(w, ["a"], 500).count() == 500
    with pytest.raises(ValueError):
        T.bin_vectors(w, ["a"], 1)


def test_pair_correlations(spark):
    rng = np.random.default_rng(0)
    x = rng.random((200, 4))
    x[:, 3] = 1.0
    df = spark.createDataFrame([(1, *map(float, r)) for r in x] + [(1, None, 1.0, 2.0, 1.0)], "k int, a double, b double, d double, e double")
    got = {(r.channel_a, r.channel_b): (r.n, r.r) for r in J.pair_correlations(df, ["k"], ["a", "b", "d", "e"]).collect()}
    assert got[("a", "b")][0] == 200 and got[("b", "d")][0] == 201 and got[("a", "e")][1] is None
    assert got[("a", "b")][1] == pytest.approx(np.corrcoef(x[:, 0], x[:, 1])[0, 1])


def test_calibration_and_units_by_well(spark):
    m = spark.createDataFrame([(1, "0121", 10.0, 5.0), (2, "0121", 10.0, 5.0), (3, "0121", 10.0, 5.0)], "well_id int, wits_id string, value double, depth double")
    cal = spark.createDataFrame([(1, "0121", 1.0, 2.0, 0.0), (2, "0121", 0.0, 3.0, 1.0)], "well_id int, wits_id string, bias double, scale double, depth_offset double")
    assert rows(P.calibrate(m, cal), "well_id", "calibrated", "depth_corrected") == [(1, 21.0, 5.0), (2, 30.0, 6.0), (3, 10.0, 5.0)]
    units = spark.createDataFrame([(1, "0121", "bar", "psi"), (2, "0121", "psi", "psi")], "well_id int, wits_id string, from_unit string, to_unit string")
    factors = spark.createDataFrame([("bar", "psi", 14.5)], "from_unit string, to_unit string, factor double")
    assert rows(P.convert_units(m, units, factors), "well_id", "converted") == [(1, 145.0), (2, 10.0), (3, 10.0)]


DEPTH = """COPY public."T0121" (id, timedate, depth, value, hide) FROM stdin;
1\t2024-01-01 00:00:00\t1.0\t{a}\t0
2\t2024-01-01 00:00:10\t2.0\t{b}\t0
\\.
"""
TIME = """COPY public.timedata (timedate, realtime) FROM stdin;
2024-01-01 00:00:05\t0108=100.5,0121=7
\\.
"""


def test_only_the_chosen_dumps_are_merged(spark, tmp_path):
    import os
    for epoch, a in ((1700000000000, 1), (1700000009000, 3)):
        p = tmp_path / f"10.0.0.1_{epoch}.sql"
        p.write_text(DEPTH.format(a=a, b=a + 1))
        os.utime(p, (epoch / 1000, epoch / 1000))
    for epoch in (1700000000001, 1700000009001):
        (tmp_path / f"10.0.0.1_timedata_{epoch}.sql").write_text(TIME)
    folder = str(tmp_path)
    _, s = dumps.depth_dump(spark, folder)
    _, t = dumps.time_dump(spark, folder)
    m = dumps.merge_companion(s, t, dumps.pairs(dumps.discover(spark, folder))).where("wits_id = '0121'")
    assert rows(m, "pos", "origin", "value") == [(0, "depth", 3.0), (1, "time", 7.0), (2, "depth", 4.0)]


def test_each_log_is_read_by_its_own_layout(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ROP,WOB,Note\n20,200,x\n21,201,y\nshort\n")
    (tmp_path / "b.csv").write_text("WOB;ROP\n200;20\n201;21\n1;2;3\n")
    (tmp_path / "c.csv").write_text("Weight on Bit\tRate of Pen\n200\t20\n")
    (tmp_path / "empty.csv").write_text("")
    ok, bad = files.read_with_rejects(spark, str(tmp_path))
    assert rows(ok.where("rop is not null"), "rop", "wob") == [(20.0, 200.0)] * 3 + [(21.0, 201.0)] * 2
    assert sorted(r.line for r in bad.collect()) == ["1;2;3", "short"]
    assert {r.file.rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv", "b.csv"}


def test_refresh_takes_late_rows_and_keeps_wells_apart(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    schema = "well_id int, wits_id string, ts timestamp, value double"
    path = str(tmp_path / "copy")
    spark.createDataFrame([(1, "0121", at(9), 1.0), (2, "0121", at(3), 1.0)], schema).write.parquet(path)
    source = spark.createDataFrame([(1, "0121", at(9), 1.0), (1, "0121", at(9), 2.0), (2, "0121", at(3), 1.0), (2, "0121", at(5), 5.0), (3, "0121", at(1), 9.0)], schema)
    assert rows(files.new_rows(source, spark.read.parquet(path)), "well_id", "value") == [(1, 2.0), (2, 5.0), (3, 9.0)]
    assert files.refresh(spark, source, path) == 3
    assert files.refresh(spark, source, path) == 0
    assert spark.read.parquet(path).count() == 5


def test_scratch_needs_a_shared_folder_off_local_masters():
    class Conf(dict):
        def get(self, k, d=None):
            return d

    for master in ("spark://host:7077", "local-cluster[3,2,1024]", "yarn"):
        fake = SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master=master, applicationId="x", getConf=lambda: Conf()))
        with pytest.raises(RuntimeError):
            session.scratch_dir(fake)


def test_shared_tables_follow_their_input(spark, tmp_path):
    p = str(tmp_path / "in")
    spark.range(3).write.parquet(p)
    count = lambda: d_segments.shared(spark, p, "follow", lambda: spark.read.parquet(p)).count()
    assert count() == 3
    spark.range(2).write.mode("append").parquet(p)
    assert count() == 5


def held_model(up, held, run, n):
    out = []
    for u in up:
        if held is None:
            held = u
        elif u == held:
            run = 0
        else:
            run += 1
            if run >= n - 1:
                held, run = u, 0
        out.append(held)
    return out, held, run


@pytest.mark.parametrize("n", [2, 3, 5])
def test_held_flags_equal_the_step_by_step_rule(n):
    rnd = random.Random(n)
    for _ in range(200):
        a, b = None, None
        ra = rb = 0
        for _ in range(4):
            up = [rnd.random() < 0.5 for _ in range(rnd.randint(1, 9))]
            want, a, ra = held_model(up, a, ra, n)
            got, b, rb = flip_after(np.array(up), b, rb, n)
            assert got.tolist() == want and (a, ra) == (b, rb)
