"""A window's slope must not hang on how the rows of its well were dealt to tasks."""

from pyspark.sql import functions as F

from welltide.operators import zones as Z

c = F.col
# Their slope over samples five feet apart is exactly the choke threshold of -0.05.
CHOKE = [206.0, 229.0, 242.0, 225.0, 208.0, 251.0, 234.0, 217.0, 210.0, 263.0, 196.0, 169.0, 222.0, 215.0, 248.0, 231.0]


def in_order(xs, ys):
    mx = my = ck = m2 = 0.0
    for n, (x, y) in enumerate(zip(xs, ys), 1):
        dx, dy = x - mx, y - my
        mx, my = mx + dx / n, my + dy / n
        ck, m2 = ck + dx * (y - my), m2 + dx * (dx - dx / n)
    return ck / m2


def test_slope_at_threshold_does_not_depend_on_partitions(spark):
    depth = [5000.0 + 5 * p for p in range(16)]
    data = [(w, p, depth[p], y) for w in range(60) for p, y in enumerate(CHOKE)]
    wide = spark.createDataFrame(data, "well_id int, pos long, depth_md double, choke_pressure double").withColumns({
        "depth_tvd": c("depth_md"), "flow_in": F.lit(100.0), "flow_out": F.lit(100.0),
        **{x: c("pos") * 1.0 for x in ("gamma_ray", "apwd", "rop", "torque", "spp")}})
    want = in_order(depth, CHOKE)
    assert abs(want - Z.CHOKE_FALL) < 1e-12
    dealt = wide.withColumn("_d", F.xxhash64("well_id", "pos")).repartition(8, "_d").sortWithinPartitions("_d").drop("_d")
    for size in (64, 1 << 20):
        got = Z.flag_windows(dealt, Z.baseline(wide), size).where("k = 0").select("choke_trend", "confidence").collect()
        assert len(got) == 60 and {r[0] for r in got} == {want} and len({r[1] for r in got}) == 1
