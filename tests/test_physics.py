"""Published known answers of the formulas, graded by percent error."""

import math

from pyspark.sql import functions as F

from conftest import close
from welltide.functions import hydraulics as H
from welltide.functions import rock as R
from welltide.operators.stats import grade_report


def test_known_answers(spark):
    l = F.lit
    mse = 480 * 12000 * 120 / (8.75 ** 2 * 100) + 4 * 25000 / (math.pi * 8.75 ** 2)
    m = R.mse(25000.0, 12000.0, 120.0, 100.0, 8.75)
    d = math.log10(100 / 7200) / math.log10(12 * 25000 / 8750)
    cases = [
        ("hydrostatic", H.hydrostatic(12.0, 10000.0), 6240.0), ("ecd", H.ecd(12.0, 250.0, 10000.0), 12.480769),
        ("bhp_static", H.bhp_static(11.5, 10500.0, 200.0), 6479.0), ("bhp_dynamic", H.bhp_dynamic(11.5, 10500.0, 300.0, 200.0), 6779.0),
        ("velocity", H.annular_velocity(650.0, 8.75, 5.0), 308.848), ("kill", H.kill_sheet(12.0, 10000.0, 500.0, 600.0)["kill_mw"], 12.961538),
        ("mse", m, mse), ("ucs", R.ucs(m), 0.35 * mse), ("brittleness", R.brittleness(l(9000.0)), 9 / 11), ("efficiency", R.efficiency(l(35.0), l(100.0)), 0.35),
        ("overburden", R.overburden(10000.0), 8491.6), ("d_exponent", R.d_exponent(100.0, 120.0, 25000.0, 8.75), d), ("trend", R.compaction_trend(10000.0), 1.4),
        ("eaton_normal", R.eaton(l(1.4), l(1.4), l(19.2)), 8.65), ("eaton_over", R.eaton(l(0.8), l(1.4), l(19.2)), 19.2 - 10.55 * (0.8 / 1.4) ** 1.2),
        ("skin", R.skin(0.1, 0.05, 2.0, 0.354), math.log(2.0 / 0.354)),
        ("pi", R.productivity_index(0.1, 200.0, 1.35, 0.8, 660.0, 0.354, 0.0), 20 / (141.2 * 1.35 * 0.8 * math.log(660 / 0.354))),
        ("invasion", R.invasion_radius(0.354, 100.0, 200.0, 0.07), math.sqrt(0.354 ** 2 + 561.5 / (math.pi * 14))),
    ]
    df = spark.range(1).select(F.explode(F.array(*[F.struct(l(n).alias("name"), l(float(e)).alias("expected"), a.cast("double").alias("actual")) for n, a, e in cases])).alias("r")).select("r.*")
    for r in df.collect():
        assert abs(r.actual - r.expected) <= 1e-5 * max(1.0, abs(r.expected)), r
    g = grade_report(df.withColumn("module", l("physics")), ["module"]).first()
    assert g.grade == "A+" and g.n_passed == len(cases)


def test_invalid_inputs_give_null_and_reason(spark):
    k = H.kill_sheet(F.col("mw"), F.col("tvd"), 100.0, 500.0)
    d = spark.createDataFrame([(12.0, 0.0), (0.0, 100.0), (12.0, 100.0)], "mw double, tvd double").select(*[e.alias(n) for n, e in k.items()]).collect()
    assert d[0].kill_mw is None and d[0].reason and d[1].icp is None and d[1].reason and d[2].reason is None
    r = spark.range(1).select(H.annular_velocity(1.0, 5.0, 5.0).alias("a"), R.mse(1.0, 1.0, 1.0, 0.0, 8.0).alias("b"), H.annular_friction(1.0, 1.0, 0.0, 5.0, 8.0, 5.0).alias("c")).first()
    assert r.a is None and r.b is None and r.c == 0.0


def test_identities(spark):
    d = spark.range(1, 200).select((F.col("id") * 61.0).alias("tvd"), (F.lit(9.0) + F.col("id") % 7).alias("mw"), (F.col("id") * 3.0).alias("afp"))
    r = d.select((H.ecd(F.col("mw"), F.col("afp"), F.col("tvd")) * 0.052 * F.col("tvd")).alias("a"), (H.hydrostatic(F.col("mw"), F.col("tvd")) + F.col("afp")).alias("b")).collect()
    assert all(close(x.a, x.b, 1e-10) for x in r)
