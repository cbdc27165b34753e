"""Counts of the channel dossiers, against the lists of the whole dossiers; they need no lags or thresholds."""

from pyspark.sql import functions as F

from tests.conftest import rows
from welltide.operators import alerts as A
from welltide.operators import knowledge as K
from welltide.plans import load_all
from welltide.plans.registry import QUERIES


def test_counts_are_those_of_the_lists(spark):
    p = spark.createDataFrame([(1, "a", "s2", "normal", "flat"), (1, "a", "s1", "other", "flat"), (2, "c", "s1", "skewed", "flat")], "well_id int, channel string, state string, distribution string, trend string") \
        .withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0), "variance": F.lit(1.0), "informative": F.lit(True)})
    pairs = spark.createDataFrame([(1, "s1", "a", "b", 0.5), (1, "s2", "a", "b", -0.5), (2, "s1", "a", "b", 0.4)], "well_id int, state string, channel_a string, channel_b string, r double")
    both = pairs.select("well_id", "state", F.inline(F.array(F.struct(F.col("channel_a").alias("channel"), F.col("channel_b").alias("target")), F.struct(F.col("channel_b").alias("channel"), F.col("channel_a").alias("target")))))
    rel = both.withColumns({"relationship": F.lit("inverse"), "strength": F.lit(0.5), "lag": F.lit(None).cast("int")})
    resp = spark.createDataFrame([(1, "b", "s1", "s2", "ramp", 1.0, 1.0, 1.0), (3, "d", "s1", "s2", "step", 1.0, 1.0, 1.0)], "well_id int, channel string, from_state string, to_state string, shape string, peak double, settle_ft double, settle_samples double")
    size = lambda x: F.coalesce(F.when(F.col(x).isNotNull(), F.size(x)), F.lit(0))
    d = A.channel_dossier(p, rel, resp).select("well_id", "channel", size("profiles").alias("p"), size("relationships").alias("r"), size("responses").alias("a"))
    got = A.dossier_counts(p, pairs, resp)
    assert rows(got, "well_id", "channel", "n_profiles", "n_relationships", "n_responses") == rows(d, "well_id", "channel", "p", "r", "a")
    assert {(r.well_id, r.channel): r.summary for r in got.collect()}[1, "a"] == "s1:other:flat,s2:normal:flat"


def test_query_looks_for_no_lags(spark, sf, monkeypatch):
    def no(*a, **k):
        raise AssertionError("not needed")
    monkeypatch.setattr(K, "patterns", no)
    load_all()
    assert QUERIES["channel_dossiers"](spark, sf).count() > 0
