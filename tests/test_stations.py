"""Depth stations: the search for a station's section stays in one place of the plan."""

from pyspark.sql import functions as F

from welltide.functions import hydraulics as H
from welltide.operators import profiles as D
from welltide.plans import b_physics as B


def test_filters_do_not_repeat_the_search(spark, sf):
    plan = D.operating_envelope(D.pressure_profile(B.design(spark, sf), **B.MUD))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("filter(sections") == 1


def test_section_edges_and_outside(spark):
    sec = "array(named_struct('md_top', 0D, 'md_bottom', 100D, 'tvd_top', 0D, 'tvd_bottom', 90D), named_struct('md_top', 100D, 'md_bottom', 200D, 'tvd_top', 80D, 'tvd_bottom', 130D))"
    d = spark.createDataFrame([(0.0,), (50.0,), (100.0,), (150.0,), (200.0,), (201.0,)], "md double").withColumn("sections", F.expr(sec))
    assert [r[0] for r in d.orderBy("md").select(H.tvd_at(F.col("sections"), F.col("md"))).collect()] == [0.0, 45.0, 90.0, 105.0, 130.0, None]
