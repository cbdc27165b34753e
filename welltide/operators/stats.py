"""Grouped statistics over channels and wells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from welltide.operators.quantiles import exact_percentiles
from welltide.operators.series import CHUNK


def channel_census(meas: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """One row per well and channel: counts, spans by order and by extremes, assigned name."""
    c = meas.groupBy("well_id", "wits_id").agg(
        F.count("value").alias("n_points"), F.min("ts").alias("ts_min"), F.max("ts").alias("ts_max"),
        F.min_by("ts", "pos").alias("ts_first"), F.max_by("ts", "pos").alias("ts_last"),
        F.min("depth").alias("depth_min"), F.max("depth").alias("depth_max"))
    if assignments is None:
        return c
    return c.join(assignments, ["well_id", "wits_id"] if "well_id" in assignments.columns else ["wits_id"], "left")


def channel_stats(df: DataFrame, keys: list[str], v: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"),
                                 F.max(v).alias("max"), F.count(v).alias("n_points"))


def quality_summary(long: DataFrame) -> DataFrame:
    """Per well: total and missing measurements, quality score and a warning below one half."""
    per = long.groupBy("well_id", "channel").agg(F.count(F.lit(1)).alias("n_points"), F.count("v").alias("n_valid"))
    w = per.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_channels"), F.sum("n_points").alias("total_measurements"),
                                   F.sum(F.col("n_points") - F.col("n_valid")).alias("n_missing"))
    score = F.when(F.col("total_measurements") > 0, 1.0 - F.col("n_missing") / F.col("total_measurements")).otherwise(0.0)
    return w.withColumn("quality_score", F.round(score, 4)).withColumn("poor", F.col("quality_score") < 0.5)


def null_counts(long: DataFrame) -> DataFrame:
    per = long.groupBy("well_id", "channel").agg(
        F.count(F.lit(1)).alias("n_points"), F.sum(F.col("v").isNull().cast("int")).alias("n_null"))
    return per.groupBy("well_id").agg(
        F.sum((F.col("n_null") == 0).cast("int")).alias("clean_channels"),
        F.sum((F.col("n_null") > 0).cast("int")).alias("channels_with_nulls"), F.sum("n_null").alias("null_samples"))


def robust_range(df: DataFrame, keys: list[str], v: Column, size: int = CHUNK) -> DataFrame:
    """2nd and 98th percentile of channels with at least five finite values."""
    enough = df.groupBy(*keys).agg(F.count(v).alias("n_valid")).where("n_valid >= 5")
    return exact_percentiles(df, keys, v, {"p02": 0.02, "p98": 0.98}, size=size).join(enough, keys)


def stick_slip(df: DataFrame, keys: list[str]) -> DataFrame:
    """CV(torque) * CV(rpm); 0 with fewer than five samples or a non-positive mean."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("torque").alias("_mt"), F.avg("rpm").alias("_mr"),
                              F.stddev_pop("torque").alias("_st"), F.stddev_pop("rpm").alias("_sr"))
    ok = (F.col("n") >= 5) & (F.col("_mt") > 0) & (F.col("_mr") > 0)
    return g.select(*keys, "n", F.when(ok, F.col("_st") / F.col("_mt") * F.col("_sr") / F.col("_mr"))
                    .otherwise(F.lit(0.0)).alias("stick_slip"))


def grade(expected: Column, actual: Column) -> tuple[Column, Column]:
    """(error percent, letter grade) of a computed value against the expected one."""
    err = F.when((expected == 0) & (actual == 0), F.lit(0.0)).when(expected == 0, F.lit(100.0)) \
        .otherwise(F.abs(actual - expected) / F.abs(expected) * 100.0)
    letter = F.when((expected == 0) & (actual == 0), "A+").when(expected == 0, "F") \
        .when(err < 0.1, "A+").when(err < 1.0, "A").when(err < 5.0, "B").when(err < 10.0, "C").otherwise("F")
    return err, letter


def grade_report(cases: DataFrame, keys: list[str]) -> DataFrame:
    """Aggregate letter grade per key from expected/actual rows; any F fails the group."""
    err, letter = grade(F.col("expected"), F.col("actual"))
    points = F.create_map(*[F.lit(x) for kv in {"A+": 4.0, "A": 3.7, "B": 3.0, "C": 2.0, "F": 0.0}.items() for x in kv])
    g = cases.withColumn("_e", err).withColumn("_g", letter).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum((F.col("_g") != "F").cast("int")).alias("n_passed"),
        F.max("_e").alias("max_error_pct"), F.avg(points[F.col("_g")]).alias("score"),
        F.bool_or(F.col("_g") == "F").alias("_bad"))
    s = F.col("score")
    return g.withColumn("grade", F.when(F.col("_bad"), "F").when(s >= 3.9, "A+").when(s >= 3.5, "A")
                        .when(s >= 2.5, "B").when(s >= 1.5, "C").otherwise("F")).drop("_bad")
