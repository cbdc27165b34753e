"""Projections, filters and grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from welltide.operators import projections as P
from welltide.operators import stats as S
from welltide.plans.registry import query
from welltide.sources import dims
from welltide.sources.tables import (EVENT_CHANNELS, MEAS_SQL, WIDE_CHANNELS, WIDE_SQL, drill_wide, measurements, table,
                                     unpivot_channels)

# Calibration of the five recorder channels the events table stands for (id, bias, scale, depth offset, unit, target).
CALIBRATION = [("0130", 0.0, 1.0, 0.0, "gpm", "lpm"), ("0120", 0.0, 3.45, 0.0, "rpm", "rpm"),
               ("0112", 1.5, 1.0, 70.44, "ft", "m"), ("0117", 0.0, 0.5, 0.0, "psi", "kpa"),
               ("0113", -2.0, 1.0, 0.0, "ft", "m")]
CAL_SQL = dims.values_sql("cal", "wits_id, bias, scale, depth_offset, from_unit, to_unit", CALIBRATION)
DEFS_SQL = dims.values_sql("defs", "channel_id, channel, unit, low, high", dims.CHANNEL_DEFS)
WITS_SQL = dims.values_sql("wits", "wits_id, canonical, domain, index_type", dims.WITS)


def calibration(spark):
    return dims.frame(spark, CALIBRATION, "wits_id string, bias double, scale double, depth_offset double, "
                                          "from_unit string, to_unit string")


def channel_defs(spark):
    return dims.frame(spark, dims.CHANNEL_DEFS, "channel_id int, channel string, unit string, low double, high double")


def wide_long(spark, sf, channels=WIDE_CHANNELS):
    return unpivot_channels(drill_wide(spark, sf), channels)


def long_sql(channels=WIDE_CHANNELS, src="wide"):
    return "long AS (" + " UNION ALL ".join(
        f"SELECT well_id, pos, '{c}' AS channel, {c} AS v FROM {src}" for c in channels) + ")"


MEAS_CAL = f"WITH {MEAS_SQL}, {CAL_SQL}, mc AS (SELECT m.*, value * scale + bias AS calibrated, depth + depth_offset AS depth_corrected FROM meas m JOIN cal USING (wits_id))"


@query("channel_stats", f"""{MEAS_CAL} SELECT well_id, wits_id, avg(calibrated) AS mean, stddev_pop(calibrated) AS std,
 min(calibrated) AS min, max(calibrated) AS max, count(calibrated) AS n_points FROM mc WHERE hide = 0 GROUP BY 1, 2""",
       dbl="mean std min max")
def q_channel_stats(spark, sf):
    m = P.calibrate(measurements(spark, sf), calibration(spark).drop("from_unit", "to_unit"))
    return S.channel_stats(P.visible(m), ["well_id", "wits_id"], "calibrated")


@query("calibrated_values", f"{MEAS_CAL} SELECT well_id, wits_id, pos, calibrated FROM mc", dbl="calibrated:6")
def q_calibrated(spark, sf):
    return P.calibrate(measurements(spark, sf), calibration(spark).drop("from_unit", "to_unit")) \
        .select("well_id", "wits_id", "pos", "calibrated")


@query("depth_offset", f"""{MEAS_CAL} SELECT well_id, wits_id, min(depth_corrected) AS top, max(depth_corrected) AS bottom,
 avg(depth_corrected) AS mean_depth FROM mc GROUP BY 1, 2""", dbl="top bottom mean_depth")
def q_depth_offset(spark, sf):
    m = P.calibrate(measurements(spark, sf), calibration(spark).drop("from_unit", "to_unit"))
    return m.groupBy("well_id", "wits_id").agg(F.min("depth_corrected").alias("top"), F.max("depth_corrected").alias("bottom"),
                                               F.avg("depth_corrected").alias("mean_depth"))


@query("visible_samples", f"WITH {MEAS_SQL} SELECT well_id, wits_id, count(*) AS visible FROM meas WHERE hide = 0 GROUP BY 1, 2")
def q_visible(spark, sf):
    return P.visible(measurements(spark, sf)).groupBy("well_id", "wits_id").agg(F.count(F.lit(1)).alias("visible"))


@query("flow_discrepancy", f"""WITH {WIDE_SQL} SELECT well_id, pos,
 CASE WHEN flow_in > 0 THEN (flow_out - flow_in) / flow_in * 100.0::DOUBLE ELSE 0 END AS discrepancy_pct FROM wide""",
       dbl="discrepancy_pct")
def q_flow_disc(spark, sf):
    return drill_wide(spark, sf).select("well_id", "pos", P.flow_discrepancy(F.col("flow_in"), F.col("flow_out"))
                                        .alias("discrepancy_pct"))


@query("slice_depth", f"WITH {MEAS_SQL} SELECT well_id, wits_id, pos, depth, value FROM meas WHERE depth BETWEEN 5100 AND 5600",
       dbl="depth value")
def q_slice_depth(spark, sf):
    return P.slice_depth(measurements(spark, sf), 5100.0, 5600.0).select("well_id", "wits_id", "pos", "depth", "value")


@query("slice_time", f"""WITH {MEAS_SQL} SELECT well_id, wits_id, pos, value FROM meas
 WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'""", dbl="value")
def q_slice_time(spark, sf):
    return P.slice_time(measurements(spark, sf), "2024-01-05 00:00:00", "2024-01-12 12:00:00") \
        .select("well_id", "wits_id", "pos", "value")


@query("slice_channel", f"WITH {MEAS_SQL} SELECT well_id, wits_id, pos, value FROM meas WHERE wits_id IN ('0130', '0113')", dbl="value")
def q_slice_channel(spark, sf):
    return P.slice_channels(measurements(spark, sf), ["0130", "0113"]).select("well_id", "wits_id", "pos", "value")


CLOUD_COLS = WIDE_CHANNELS
IDS = list(EVENT_CHANNELS.values())


@query("point_cloud", f"""WITH {WIDE_SQL}, {DEFS_SQL}, {long_sql(CLOUD_COLS)},
 lim AS (SELECT well_id, min(depth_md) z0, max(depth_md) z1, min(pos) t0, max(pos) t1 FROM wide GROUP BY 1)
 SELECT l.well_id, l.pos, l.channel, (l.pos - t0) / (CASE WHEN t1 > t0 THEN t1 - t0 ELSE 1 END)::DOUBLE AS t,
  (depth_md - z0) / (CASE WHEN z1 > z0 THEN z1 - z0 ELSE 1.0 END) AS z, greatest(0, least(1, (v - low) / (high - low))) AS v
 FROM long l JOIN wide w USING (well_id, pos) JOIN lim ON lim.well_id = l.well_id JOIN defs ON defs.channel = l.channel""",
       dbl="t:6 z:6 v:6")
def q_cloud(spark, sf):
    return P.to_cloud(drill_wide(spark, sf), channel_defs(spark), CLOUD_COLS).select("well_id", "pos", "channel", "t", "z", "v")


@query("cloud_denormalised", f"""WITH {WIDE_SQL}, {DEFS_SQL}, {long_sql(CLOUD_COLS)}
 SELECT well_id, channel, avg(low + greatest(0, least(1, (v - low) / (high - low))) * (high - low)) AS mean_value
 FROM long JOIN defs USING (channel) GROUP BY 1, 2""", dbl="mean_value")
def q_denorm(spark, sf):
    c = P.to_cloud(drill_wide(spark, sf), channel_defs(spark), CLOUD_COLS)
    return c.groupBy("well_id", "channel").agg(F.avg(P.denormalise(F.col("v"), F.col("low"), F.col("high"))).alias("mean_value"))


@query("long_to_wide", f"WITH {MEAS_SQL} SELECT well_id, ts, depth, {', '.join(f'max_by(value, pos) FILTER (wits_id = {chr(39)}{w}{chr(39)}) AS {chr(34)}{w}{chr(34)}' for w in IDS)} FROM meas GROUP BY 1, 2, 3", dbl="depth")
def q_to_wide(spark, sf):
    return P.to_wide(measurements(spark, sf), IDS)


@query("sentinel_cleanup", """SELECT l_suppkey AS well_id, sum(CASE WHEN l_discount = 0.05 THEN 1 ELSE 0 END) AS nulled,
 avg(CASE WHEN l_discount = 0.05 THEN NULL ELSE l_quantity END) AS mean_clean FROM lineitem GROUP BY 1""", dbl="mean_clean", whole="nulled")
def q_sentinel(spark, sf):
    # A recorder writes -999.25 for a missing sample; rows with a 5 % discount play that part here.
    li = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("well_id"), F.when(
        F.col("l_discount") == 0.05, F.lit(-999.25)).otherwise(F.col("l_quantity")).alias("raw"))
    c = li.withColumn("v", P.clean_sentinel(F.col("raw")))
    return c.groupBy("well_id").agg(F.sum(F.col("v").isNull().cast("int")).alias("nulled"), F.avg("v").alias("mean_clean"))


@query("position_aligned", f"""WITH {MEAS_SQL},
 n AS (SELECT well_id, wits_id, max(pos) m FROM meas GROUP BY 1, 2), cut AS (SELECT well_id, min(m) AS cut FROM n GROUP BY 1)
 SELECT well_id, pos, {', '.join(f"max(value) FILTER (wits_id = '{w}') AS c{w}" for w in IDS)}
 FROM meas JOIN cut USING (well_id) WHERE pos <= cut GROUP BY 1, 2""", dbl=" ".join(f"c{w}" for w in IDS))
def q_aligned(spark, sf):
    return P.align_by_position(measurements(spark, sf), IDS).select("well_id", "pos", *[F.col(w).alias(f"c{w}") for w in IDS])


@query("recent_1000ft", f"""WITH {WIDE_SQL}, last AS (SELECT well_id, max_by(depth_md, pos) AS d FROM wide GROUP BY 1)
 SELECT well_id, count(*) AS n, avg(rop) AS mean_rop, min(depth_md) AS top FROM wide JOIN last USING (well_id)
 WHERE depth_md >= d - 1000 GROUP BY 1""", dbl="mean_rop top")
def q_recent(spark, sf):
    return P.recent_window(drill_wide(spark, sf)).groupBy("well_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("rop").alias("mean_rop"), F.min("depth_md").alias("top"))


@query("wob_units", f"""WITH {WIDE_SQL}, w2 AS (SELECT well_id, pos, CASE WHEN well_id % 2 = 0 THEN wob ELSE wob * 1000 END AS wob FROM wide),
 m AS (SELECT well_id, avg(wob) AS m FROM w2 GROUP BY 1)
 SELECT well_id, pos, CASE WHEN m < 100 THEN wob ELSE wob / 1000.0 END AS wob_klbs FROM w2 JOIN m USING (well_id)""", dbl="wob_klbs")
def q_wob(spark, sf):
    w = drill_wide(spark, sf).withColumn("wob", F.when(F.col("well_id") % 2 == 0, F.col("wob")).otherwise(F.col("wob") * 1000))
    return P.wob_in_klbs(w).select("well_id", "pos", "wob_klbs")


@query("downsample_50", f"""WITH {WIDE_SQL}, n AS (SELECT well_id, max(pos) + 1 AS rows_n FROM wide GROUP BY 1),
 idx AS (SELECT DISTINCT well_id, CASE WHEN rows_n <= 50 THEN i ELSE (i * (rows_n - 1)) // 49 END AS pos
         FROM n, generate_series(0, 49) g(i) WHERE i < rows_n)
 SELECT well_id, pos, depth_md, rop FROM wide JOIN idx USING (well_id, pos)""", dbl="depth_md rop")
def q_down(spark, sf):
    return P.downsample(drill_wide(spark, sf), ["well_id"], 50).select("well_id", "pos", "depth_md", "rop")


FACTOR_SQL = dims.values_sql("factors", "from_unit, to_unit, factor", dims.UNIT_FACTORS)


@query("unit_conversion", f"""WITH {MEAS_SQL}, {CAL_SQL}, {FACTOR_SQL}
 SELECT well_id, wits_id, to_unit, avg(value * coalesce(factor, 1.0)) AS mean_converted, max(value * coalesce(factor, 1.0)) AS max_converted
 FROM meas JOIN cal USING (wits_id) LEFT JOIN factors USING (from_unit, to_unit) GROUP BY 1, 2, 3""", dbl="mean_converted max_converted")
def q_units(spark, sf):
    f = dims.frame(spark, dims.UNIT_FACTORS, "from_unit string, to_unit string, factor double")
    c = P.convert_units(measurements(spark, sf), calibration(spark).select("wits_id", "from_unit", "to_unit"), f)
    return c.groupBy("well_id", "wits_id", "to_unit").agg(F.avg("converted").alias("mean_converted"),
                                                          F.max("converted").alias("max_converted"))


@query("channel_census", f"""WITH {MEAS_SQL}, {WITS_SQL}, d AS (SELECT * FROM wits)
 SELECT well_id, wits_id, canonical, domain, index_type, count(value) AS n_points, min(ts) AS ts_min, max(ts) AS ts_max,
  min_by(ts, pos) AS ts_first, max_by(ts, pos) AS ts_last, min(depth) AS depth_min, max(depth) AS depth_max
 FROM meas LEFT JOIN d USING (wits_id) GROUP BY 1, 2, 3, 4, 5""", dbl="depth_min depth_max")
def q_census(spark, sf):
    w = dims.frame(spark, dims.WITS, "wits_id string, canonical string, domain string, index_type string")
    return S.channel_census(measurements(spark, sf), w)


@query("quality_summary", f"""WITH {WIDE_SQL}, {long_sql()},
 l AS (SELECT well_id, channel, CASE WHEN v < 5 THEN NULL ELSE v END AS v FROM long),
 p AS (SELECT well_id, channel, count(*) n, count(v) nv FROM l GROUP BY 1, 2)
 SELECT well_id, count(*) AS n_channels, sum(n) AS total_measurements, sum(n - nv) AS n_missing,
  round(1.0::DOUBLE - sum(n - nv) / sum(n), 4) AS quality_score, round(1.0::DOUBLE - sum(n - nv) / sum(n), 4) < 0.5 AS poor FROM p GROUP BY 1""",
       dbl="quality_score", whole="n_missing total_measurements")
def q_quality(spark, sf):
    l = wide_long(spark, sf)
    return S.quality_summary(l.withColumn("v", F.when(F.col("v") >= 5, F.col("v"))))


@query("null_counts", f"""WITH {WIDE_SQL}, {long_sql()},
 l AS (SELECT well_id, channel, CASE WHEN v < 2 THEN NULL ELSE v END AS v FROM long),
 p AS (SELECT well_id, channel, count(*) - count(v) AS n_null FROM l GROUP BY 1, 2)
 SELECT well_id, sum((n_null = 0)::INT) AS clean_channels, sum((n_null > 0)::INT) AS channels_with_nulls, sum(n_null) AS null_samples FROM p GROUP BY 1""", whole="channels_with_nulls clean_channels null_samples")
def q_nulls(spark, sf):
    l = wide_long(spark, sf)
    return S.null_counts(l.withColumn("v", F.when(F.col("v") >= 2, F.col("v"))))


@query("robust_range", f"""WITH {MEAS_SQL} SELECT well_id, wits_id, quantile_cont(value, 0.02) AS p02, quantile_cont(value, 0.98) AS p98,
 count(value) AS n_valid FROM meas GROUP BY 1, 2 HAVING count(value) >= 5""", dbl="p02 p98")
def q_range(spark, sf):
    return S.robust_range(measurements(spark, sf), ["well_id", "wits_id"], F.col("value"))


@query("stick_slip", f"""WITH {WIDE_SQL} SELECT well_id, count(*) AS n, CASE WHEN count(*) >= 5 AND avg(torque) > 0 AND avg(rpm) > 0
 THEN stddev_pop(torque) / avg(torque) * stddev_pop(rpm) / avg(rpm) ELSE 0 END AS stick_slip FROM wide GROUP BY 1""", dbl="stick_slip")
def q_stick(spark, sf):
    return S.stick_slip(drill_wide(spark, sf), ["well_id"])


@query("grade_report", f"""WITH {WIDE_SQL}, c AS (SELECT well_id, mud_weight AS expected, mud_weight * (1 + wob / 1000) AS actual FROM wide),
 e AS (SELECT well_id, abs(actual - expected) / abs(expected) * 100 AS err FROM c),
 g AS (SELECT *, CASE WHEN err < 0.1 THEN 4.0 WHEN err < 1 THEN 3.7 WHEN err < 5 THEN 3.0 WHEN err < 10 THEN 2.0 ELSE 0 END::DOUBLE AS p FROM e)
 SELECT well_id, count(*) AS n_cases, sum((p > 0)::INT) AS n_passed, max(err) AS max_error_pct, avg(p) AS score,
  CASE WHEN min(p) = 0 THEN 'F' WHEN avg(p) >= 3.9 THEN 'A+' WHEN avg(p) >= 3.5 THEN 'A' WHEN avg(p) >= 2.5 THEN 'B' WHEN avg(p) >= 1.5 THEN 'C' ELSE 'F' END AS grade
 FROM g GROUP BY 1""", dbl="max_error_pct score", whole="n_passed")
def q_grade(spark, sf):
    w = drill_wide(spark, sf)
    c = w.select("well_id", F.col("mud_weight").alias("expected"), (F.col("mud_weight") * (1 + F.col("wob") / 1000)).alias("actual"))
    return S.grade_report(c, ["well_id"])
