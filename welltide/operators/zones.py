"""Zone flagging along a well, completion design rules and survey geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from welltide.operators.projections import flow_discrepancy
from welltide.operators.series import CHUNK, attach, bounded, carry, chunk_of, dense_positions, halo, previous
from welltide.session import stage

c = F.col

# Window, thresholds (in baseline sigmas, percent, psi/ft) and score weights.
ZONE_WINDOW, ZONE_STEP, MIN_ZONE_FT = 25, 12, 50.0
ZONE_CHUNK = 1 << 16
GAMMA_LOW, GAMMA_HIGH, APWD_HIGH, APWD_LOW, APWD_FLUCT = -1.0, 1.5, 1.5, -1.5, 2.0
ROP_SPIKE, ROP_DROP, FLOW_LOSS, FLOW_GAIN, CHOKE_RISE, CHOKE_FALL, TORQUE_SPIKE = 2.0, -1.5, -5.0, 5.0, 0.05, -0.05, 2.0
W_GAMMA, W_APWD, W_ROP, W_FLOW, W_CHOKE, W_TORQUE = 1.0, 1.5, 1.0, 1.5, 1.0, 0.8
MAX_SCORE = W_GAMMA + W_APWD * 1.5 + W_ROP + W_FLOW + W_CHOKE + W_TORQUE
BASE_CHANNELS = ["gamma_ray", "apwd", "rop", "torque", "spp", "choke_pressure"]
CLUSTERS, SPACING, PROPPANT, RATE = 5, 40.0, 50000.0, 80.0


def baseline(wide: DataFrame) -> DataFrame:
    """Mean and population deviation (0 becomes 1) of each baseline channel per well."""
    sd = lambda x: F.when(F.stddev_pop(x) == 0, F.lit(1.0)).otherwise(F.stddev_pop(x))
    return wide.groupBy("well_id").agg(*[e for x in BASE_CHANNELS for e in (F.avg(x).alias(f"{x}_mean"), sd(x).alias(f"{x}_std"))])


def flag_windows(wide: DataFrame, base: DataFrame, size: int = CHUNK) -> DataFrame:
    """Score and classify overlapping windows of 25 samples, every 12.

    Samples meet in their (well, chunk) with the 24 next to it and are added up in order along the well, so that slopes that
    reach a threshold exactly do not hang on how the rows were dealt. Every sample belongs to at most three windows.
    """
    n = wide.groupBy("well_id").agg(F.max("pos").alias("_last"), F.max("pos").alias("last_pos"))
    part = max(ZONE_WINDOW, min(size, ZONE_CHUNK))
    d = wide.select("well_id", "pos", "depth_md", "depth_tvd", "gamma_ray", "apwd", "rop", "torque", "choke_pressure", "flow_in", "flow_out")
    d = halo(d, 0, ZONE_WINDOW - 1, part).drop("_own").repartition("well_id", "_chunk").sortWithinPartitions("well_id", "_chunk", "pos")
    first = F.greatest(F.lit(0), F.ceil((c("pos") - (ZONE_WINDOW - 1)) / F.lit(ZONE_STEP)))
    d = d.withColumn("k", F.explode(F.sequence(first.cast("long"), F.floor(c("pos") / F.lit(ZONE_STEP)).cast("long"))))
    d = d.where(chunk_of(c("k") * ZONE_STEP, part) == c("_chunk"))
    g = d.groupBy("well_id", "_chunk", "k").agg(
        F.min_by("depth_md", "pos").alias("top_md"), F.max_by("depth_md", "pos").alias("bottom_md"),
        F.min_by(F.coalesce("depth_tvd", "depth_md"), "pos").alias("top_tvd"), F.max_by(F.coalesce("depth_tvd", "depth_md"), "pos").alias("bottom_tvd"),
        F.avg("gamma_ray").alias("gamma_avg"), F.avg("apwd").alias("apwd_avg"), F.avg("rop").alias("rop_avg"), F.avg("torque").alias("_tq"),
        F.stddev_pop("apwd").alias("_as"), F.avg(flow_discrepancy(c("flow_in"), c("flow_out"))).alias("flow_disc"),
        F.coalesce(F.nanvl(F.regr_slope("choke_pressure", "depth_md"), F.lit(0.0)), F.lit(0.0)).alias("choke_trend"), F.max("pos").alias("_end")).drop("_chunk")
    g = g.withColumn("pos", c("k") * ZONE_STEP)
    g = attach(g, n.join(base, "well_id", "left"), ["well_id"], size=size)
    g = g.where((c("bottom_md") - c("top_md") >= MIN_ZONE_FT) | (c("_end") == c("_last")))
    sig = lambda v, x: (c(v) - c(f"{x}_mean")) / c(f"{x}_std")
    gs, ap, rs, ts = sig("gamma_avg", "gamma_ray"), sig("apwd_avg", "apwd"), sig("rop_avg", "rop"), sig("_tq", "torque")
    g = g.withColumns({
        "gl": gs <= GAMMA_LOW, "gh": gs >= GAMMA_HIGH, "ah": ap >= APWD_HIGH, "al": ap <= APWD_LOW, "af": c("_as") / c("apwd_std") >= APWD_FLUCT,
        "rs": rs >= ROP_SPIKE, "rd": rs <= ROP_DROP, "fl": c("flow_disc") <= FLOW_LOSS, "fg": c("flow_disc") >= FLOW_GAIN,
        "cr": c("choke_trend") >= CHOKE_RISE, "cf": c("choke_trend") <= CHOKE_FALL, "ts": ts >= TORQUE_SPIKE})
    pts = lambda cond, w: F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
    score = (pts(c("gl") | c("gh"), W_GAMMA) + pts(c("ah") | c("al"), W_APWD) + pts(c("af"), W_APWD * 0.5) + pts(c("rs") | c("rd"), W_ROP)
             + pts(c("fl") | c("fg"), W_FLOW) + pts(c("cr") | c("cf"), W_CHOKE) + pts(c("ts"), W_TORQUE))
    flow = c("fl") | c("fg")
    kind = (F.when(c("gl") & ~c("al") & ~c("af"), "high_potential").when(c("ah") & c("cr"), "overpressured")
            .when(flow & (c("rs") | c("cr")), "fractured").when(c("al"), "depleted").when(c("ts"), "unstable")
            .when(c("ah"), "overpressured").otherwise("normal"))
    return g.select("well_id", "k", "top_md", "bottom_md", "top_tvd", "bottom_tvd", kind.alias("classification"),
                    F.least(F.lit(1.0), score / F.lit(MAX_SCORE)).alias("confidence"), "gamma_avg", "apwd_avg", "rop_avg", "flow_disc", "choke_trend")


HALVED = ["gamma_avg", "apwd_avg", "rop_avg", "flow_disc", "choke_trend"]


def merge_adjacent(windows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Join neighbouring windows of one class less than 50 ft apart.

    Averages are running halves ((a+b)/2 with c, and so on). That is a weighted sum with weights 1/2, 1/4, ... from
    the last window back, so it needs no ordered fold.
    """
    d = dense_positions(windows, ["well_id"], [c("k")], chunk_of("k", size), "pos")
    d = previous(d, ["well_id"], {"_pc": c("classification"), "_pb": c("bottom_md")}, size)
    start = c("_pc").isNull() | (c("_pc") != c("classification")) | (c("top_md") - c("_pb") >= MIN_ZONE_FT)
    d = stage(d.withColumn("_st", F.when(start, c("pos"))).drop("_pc", "_pb"), "zone-starts")
    last = d.groupBy("well_id").agg(F.max("pos").alias("last_pos"), (F.max("pos") + 1).alias("_n"))
    d = carry(d, ["well_id"], last={"_g": c("_st")}, following={"_nx": c("_st")}, size=size)
    d = attach(d, last, ["well_id"], size=size)
    back = F.coalesce("_nx", "_n") - 1 - c("pos")
    w = F.pow(F.lit(0.5), back + F.when(c("pos") == c("_g"), 0).otherwise(1))
    return d.groupBy("well_id", c("_g").alias("first_window")).agg(
        F.min_by("top_md", "pos").alias("top_md"), F.max_by("bottom_md", "pos").alias("bottom_md"), F.min_by("top_tvd", "pos").alias("top_tvd"),
        F.max_by("bottom_tvd", "pos").alias("bottom_tvd"), F.first("classification").alias("classification"),
        F.max("confidence").alias("confidence"), *[F.sum(c(x) * w).alias(x) for x in HALVED])


def recommend(zones: DataFrame, size: int = CHUNK) -> DataFrame:
    """Completion design per zone; stages are numbered along the well."""
    z = dense_positions(zones, ["well_id"], [c("first_window")], chunk_of("first_window", size), "_s").withColumn("stage", c("_s") + 1)
    is_ = lambda k: c("classification") == k
    length = c("bottom_md") - c("top_md")
    skip = is_("depleted") & (c("confidence") >= 0.6)
    weak = is_("depleted") & ~skip
    clusters = F.when(is_("high_potential"), CLUSTERS + 1).when(weak, max(2, CLUSTERS - 2)).when(is_("unstable"), max(3, CLUSTERS - 1)).otherwise(CLUSTERS)
    z = z.withColumn("clusters", clusters)
    return z.select(
        "well_id", "stage", "top_md", "bottom_md", "classification", "clusters",
        F.when(is_("high_potential") | weak | is_("unstable"), length / (c("clusters") + 1)).otherwise(F.lit(SPACING)).alias("spacing_ft"),
        (F.lit(PROPPANT) * F.when(is_("high_potential"), 1.15).when(weak, 0.5).when(is_("fractured"), 0.9).when(is_("unstable"), 0.85).otherwise(1.0)).alias("proppant_lbs"),
        (F.lit(RATE) * F.when(is_("high_potential"), 1.05).when(is_("overpressured"), 0.95).when(is_("fractured"), 0.9).otherwise(1.0)).alias("rate_bpm"),
        F.when(is_("fractured"), "composite").otherwise("none").alias("diversion"), skip.alias("skip"))


def zone_summary(recs: DataFrame) -> DataFrame:
    n = lambda k: F.sum((c("classification") == k).cast("int"))
    return recs.groupBy("well_id").agg(
        F.count(F.lit(1)).alias("n_zones"), n("high_potential").alias("n_high_potential"), n("fractured").alias("n_fractured"),
        n("depleted").alias("n_depleted"), (F.max("bottom_md") - F.min("top_md")).alias("lateral_ft"),
        F.sum(F.when(~c("skip"), c("clusters") * c("proppant_lbs")).otherwise(F.lit(0.0))).alias("proppant_lbs"))


# --- surveys -------------------------------------------------------------------------------------------

def survey_steps(surveys: DataFrame, size: int = CHUNK) -> DataFrame:
    """Minimum-curvature step from the previous station: north, east, tvd and dogleg severity.

    ``surveys``: well_id, pos, md, inc, azm (degrees). Steps without progress add nothing and have no severity.
    """
    s = previous(surveys, ["well_id"], {"_md": c("md"), "_i": c("inc"), "_a": c("azm")}, size, keep_chunk=True)
    i1, i2, a1, a2 = F.radians("_i"), F.radians("inc"), F.radians("_a"), F.radians("azm")
    cosd = F.cos(i2 - i1) - F.sin(i1) * F.sin(i2) * (F.lit(1.0) - F.cos(a2 - a1))
    s = s.withColumn("_dl", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosd)))).withColumn("_dm", c("md") - c("_md"))
    rf = F.when(F.abs("_dl") < 1e-7, F.lit(1.0)).otherwise(F.lit(2.0) / c("_dl") * F.tan(c("_dl") / 2.0))
    go = c("_dm") > 0
    step = lambda e: F.when(go, c("_dm") / 2.0 * e * rf).otherwise(F.lit(0.0))
    return s.withColumns({
        "d_north": step(F.sin(i1) * F.cos(a1) + F.sin(i2) * F.cos(a2)), "d_east": step(F.sin(i1) * F.sin(a1) + F.sin(i2) * F.sin(a2)),
        "d_tvd": step(F.cos(i1) + F.cos(i2)), "dls": F.when(go, F.degrees("_dl") / c("_dm") * 100.0)}).drop("_md", "_i", "_a", "_dl", "_dm")


def minimum_curvature(surveys: DataFrame, size: int = CHUNK) -> DataFrame:
    return carry(survey_steps(surveys, size), ["well_id"], total={"north": c("d_north"), "east": c("d_east"), "tvd": c("d_tvd")}, size=size) \
        .drop("d_north", "d_east", "d_tvd")


def survey_summary(path: DataFrame) -> DataFrame:
    return path.groupBy("well_id").agg(
        F.count(F.lit(1)).alias("n_stations"), F.max("inc").alias("max_inc"), F.coalesce(F.max("dls"), F.lit(0.0)).alias("max_dls"),
        F.coalesce(F.avg("dls"), F.lit(0.0)).alias("avg_dls"),
        F.max_by(F.sqrt(c("north") * c("north") + c("east") * c("east")), "pos").alias("departure"), F.max_by("tvd", "pos").alias("tvd_at_td"))
