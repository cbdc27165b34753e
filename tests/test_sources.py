"""Dump text details, stores and live reading."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import rows
from welltide.operators import segment as G
from welltide.session import scratch_path
from welltide.sources import dumps, files
from welltide.streaming import live

DEPTH = """--
COPY public.idtable (id, witsid, mnemonic, units, bias, scale, depthoffset, logby, changelog) FROM stdin;
1\t0121\tPP\tpsi\t0\t1\t\\N\t1\t\\N
2\t0824\tGR\tgapi\t\\N\t3.45\t70.44\ttime\t{"1600000000": {"bias": 2}, "x": {"bias": 1}}
3\t0999\tNONE\t\\N\t\\N\t\\N\t\\N\t\\N\tbroken
\\.

COPY public."T0121" (id, timedate, depth, value, hide) FROM stdin;
1\t2024-01-01 00:00:00\t96.970001\t96.97\t0
2\tbad time\t97.5\tabc\t1
3\t2024-01-01 00:00:10\t\\N\tNaN\t\\N
short\tline
\\.
COPY public."T9004" (id, timedate, depth, value, hide) FROM stdin;
1\t2024-01-01 00:00:00\t1.0\t5\t0
\\.
COPY public."T0999" (id, timedate, depth, value, hide) FROM stdin;
\\.
"""
TIME = """COPY public.timedata (timedate, realtime) FROM stdin;
2024-01-01 00:00:05\t0108=100.5,0121=7,0130=12,junk
2024-01-01 00:00:05\t0108=101.5,1984=text
nonsense\t0121=1
\\.
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("dumps")
    (d / "172.0.0.1_1700000000000.sql").write_text(DEPTH)
    (d / "172.0.0.1_timedata_1700000000001.sql").write_text(TIME)
    return str(d)


def test_depth_dump(spark, folder):
    ch, s = dumps.depth_dump(spark, folder)
    got = rows(s.where("wits_id = '0121'"), "pos", "depth", "value", "hide")
    assert got == [(0, 96.970001, 96.97, 0), (1, 97.5, None, 1), (2, None, None, 0)]
    assert rows(ch, "wits_id", "is_computed", "mnemonic", "log_by") == [("0121", False, "PP", "depth"), ("9004", True, "9004", "unknown")]
    ids = {r.wits_id: r for r in dumps.id_table(dumps.dump_lines(spark, folder, False)).collect()}
    assert ids["0824"].scale == 3.45 and ids["0824"].bias == 0.0 and ids["0824"].depth_offset == 70.44 and list(ids["0824"].changelog) == ["1600000000"]
    assert ids["0999"].changelog == {} and ids["0999"].source == "WITS" and ids["0999"].dp == 2


def test_small_splits_keep_blocks(spark, folder):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    try:
        lines = dumps.dump_lines(spark, folder, False)
        assert lines.select("split").distinct().count() > 3
        assert len(rows(dumps.depth_samples(lines).where("wits_id = '0121'"), "hide")) == 3
        assert dumps.depth_samples(lines).count() == 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_time_dump_and_merge(spark, folder):
    _, t = dumps.time_dump(spark, folder)
    assert sorted((r.wits_id, str(r.value)) for r in t.collect()) == [("0108", "100.5"), ("0108", "101.5"), ("0121", "7.0"), ("0130", "12.0"), ("1984", "None")]
    ch, s = dumps.depth_dump(spark, folder)
    m = dumps.merge_companion(s, t, dumps.pairs(dumps.discover(spark, folder)))
    got = [(r.pos, r.origin, r.depth) for r in m.where("wits_id = '0121'").orderBy("pos").collect()]
    assert got == [(0, "depth", 96.970001), (1, "time", 101.5), (2, "depth", None), (3, "depth", 97.5)]
    assert [(r.ip, r.depth_epoch, r.time_epoch) for r in dumps.pairs(dumps.discover(spark, folder)).collect()] == [("172.0.0.1", 1700000000000, 1700000000001)]


def test_headers():
    n = files.canonical_names(["Dept MD", "ROP (ft/hr)", "ROP", "Date Time", "Odd Name!", "X"], {"X": "wob"})
    assert n == {"Dept MD": "depth_md", "ROP (ft/hr)": "rop", "ROP": "rop", "Date Time": "timestamp", "Odd Name!": "odd_name", "X": "wob"}
    assert files.guess_depth_column(["a", "Depth", "TVD"]) == "Depth" and files.guess_depth_column(["a", "b"]) == "a"


def test_catalogue_and_profiles(spark, folder):
    f = files.fingerprint_files(spark, folder)
    cat = files.register(f, None)
    assert cat.count() == 2 and files.register(f, cat).count() == 0
    p = scratch_path(spark, "profiles")
    a = spark.createDataFrame([("one", "rop", "0113", "ft/hr", "ROP"), ("two", "wob", "0117", "klbs", "WOB")], "profile string, canonical string, wits_id string, expected_units string, expected_mnemonic string")
    files.save_profiles(a, p)
    assert files.load_profile(spark, "one", p) == [("rop", "0113", "ft/hr")]
    files.delete_profile(spark, "one", p)
    assert files.load_profile(spark, "one", p) == [] and files.load_profile(spark, "two", p) == [("wob", "0117", "klbs")]


def test_incremental_refresh(spark):
    p = scratch_path(spark, "copy")
    rows_ = [("0113", dt.datetime(2024, 1, 1, 0, i), float(i)) for i in range(10)] + [("0117", dt.datetime(2024, 1, 1), 1.0)]
    src = spark.createDataFrame(rows_, "wits_id string, ts timestamp, value double")
    src.where("value < 4 and wits_id = '0113'").write.parquet(p)
    assert files.refresh(spark, src, p) == 7 and files.refresh(spark, src, p) == 0


def test_live_equals_batch_and_drops_late_rows(spark):
    d = scratch_path(spark, "landing")
    os.makedirs(d)
    line = lambda m, v: f"1\t2024-01-01 {m // 60:02d}:{m % 60:02d}:00\t0113={v},bad"
    with open(os.path.join(d, "a.txt"), "w") as f:
        f.write("\n".join(line(m, m % 9) for m in range(0, 300)))
    with open(os.path.join(d, "b.txt"), "w") as f:
        f.write(line(5, 100) + "\n" + line(301, 1))
    with open(os.path.join(d, "m.txt"), "w") as f:
        f.write(line(300, 2))
    # A batch filters late rows by the watermark of the batch before the last, hence a file in between.
    os.utime(os.path.join(d, "a.txt"), (1, 1))
    os.utime(os.path.join(d, "m.txt"), (1000, 1000))
    out, chk = scratch_path(spark, "out"), scratch_path(spark, "chk")
    live.run_available(live.windowed_stats(live.read_landing(spark, d, 1), "1 hour"), out, chk)
    got = {r.start.hour: (r.n, r.hi) for r in spark.read.parquet(out).collect()}
    assert got[0] == (60, 8.0) and got[1] == (60, 8.0)      # the late 100 is not counted
    h = live.held_flags(live.read_landing(spark, d, 1000), 4.0, 3)
    out, chk = scratch_path(spark, "held"), scratch_path(spark, "held-chk")
    live.run_available(h, out, chk)
    vals = sorted([(m, m % 9) for m in range(300)] + [(5, 100), (300, 2), (301, 1)], key=lambda x: x[0])
    assert spark.read.parquet(out).count() == len(vals)
    b = spark.createDataFrame([(1, i, v >= 4) for i, (_, v) in enumerate([(m, m % 9) for m in range(300)])], "well_id int, pos long, up boolean")
    assert G.hysteresis(b, ["up"], 3, 50).where("up_held").count() > 0
