"""Depth-profile physics over whole sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from welltide.functions import hydraulics as H
from welltide.functions import rock as R
from welltide.operators import lineage
from welltide.operators import profiles as D
from welltide.operators import projections as P
from welltide.operators import stats as S
from welltide.operators.series import CHUNK, attach
from welltide.plans.registry import query
from welltide.sources.tables import WIDE_SQL, drill_wide, table

c = F.col
W = f"WITH {WIDE_SQL}"
PI = "pi()"
MSE = "(480.0::DOUBLE * torque * rpm / (8.75::DOUBLE * 8.75 * rop) + 4.0::DOUBLE * wob * 1000 / (pi() * 8.75::DOUBLE * 8.75))"
# Mud and pumping figures used by the profile queries.
MUD = dict(mw=12.5, pv=25.0, yp=15.0, q=350.0, sbp=200.0)


def well_sections(spark, sf):
    """Three casing sections per supplier-well; the shoes move with the well number."""
    k = (c("s_suppkey") % 5) * 10.0
    rows = F.array(*[F.struct(F.lit(i).alias("seq"), t.alias("md_top"), b.alias("md_bottom"), F.lit(h).alias("hole_id"))
                     for i, t, b, h in [(0, F.lit(0.0), k + 5100.0, 12.25), (1, k + 5100.0, k + 5300.0, 9.875),
                                        (2, k + 5300.0, k + 8000.0, 8.5)]])
    s = table(spark, sf, "supplier").select(c("s_suppkey").alias("well_id"), F.explode(rows).alias("r")).select("well_id", "r.*")
    return s.withColumns({"tvd_top": c("md_top") * 0.95, "tvd_bottom": c("md_bottom") * 0.95, "pipe_od": F.lit(5.0)})


SECTIONS_SQL = """sections AS (SELECT s_suppkey AS well_id, i AS seq,
  CASE i WHEN 0 THEN 0.0 WHEN 1 THEN 5100.0 + k ELSE 5300.0 + k END::DOUBLE AS md_top,
  CASE i WHEN 0 THEN 5100.0 + k WHEN 1 THEN 5300.0 + k ELSE 8000.0 + k END::DOUBLE AS md_bottom,
  CASE i WHEN 0 THEN 12.25 WHEN 1 THEN 9.875 ELSE 8.5 END::DOUBLE AS hole_id, 5.0::DOUBLE AS pipe_od
  FROM (SELECT s_suppkey, (s_suppkey % 5) * 10.0 AS k FROM supplier), generate_series(0, 2) g(i)),
 sec AS (SELECT *, md_top * 0.95::DOUBLE AS tvd_top, md_bottom * 0.95::DOUBLE AS tvd_bottom FROM sections)"""


def formation_points(spark, sf):
    """Pore and fracture pressure at three depths per supplier-well."""
    k = (c("s_suppkey") % 7) * 5.0
    rows = F.array(*[F.struct(F.lit(t).alias("tvd"), (F.lit(p) + k).alias("pore"), (F.lit(f) + k).alias("frac"))
                     for t, p, f in [(4000.0, 2100.0, 3600.0), (5000.0, 2700.0, 4550.0), (7000.0, 4000.0, 6100.0)]])
    return table(spark, sf, "supplier").select(c("s_suppkey").alias("well_id"), F.explode(rows).alias("r")).select("well_id", "r.*")


POINTS_SQL = """points AS (SELECT s_suppkey AS well_id, v.tvd::DOUBLE AS tvd, v.p + (s_suppkey % 7) * 5.0::DOUBLE AS pore,
   v.f + (s_suppkey % 7) * 5.0::DOUBLE AS frac FROM supplier, (VALUES (4000, 2100, 3600), (5000, 2700, 4550), (7000, 4000, 6100)) v(tvd, p, f)),
 seg AS (SELECT *, lead(tvd) OVER w AS tvd2, lead(pore) OVER w AS pore2, lead(frac) OVER w AS frac2 FROM points WINDOW w AS (PARTITION BY well_id ORDER BY tvd))"""


def design(spark, sf):
    return D.well_design(well_sections(spark, sf), formation_points(spark, sf))


def interp_sql(x, f):
    """Scalar SQL for the clamped piecewise-linear value of ``f`` at depth ``x`` (columns of alias b)."""
    return (f"CASE WHEN {x} <= 4000 THEN (SELECT min({f}) FROM seg s WHERE s.well_id = b.well_id AND s.tvd = 4000)"
            f" WHEN {x} >= 7000 THEN (SELECT min({f}) FROM seg s WHERE s.well_id = b.well_id AND s.tvd = 7000)"
            f" ELSE (SELECT min({f} + ({x} - tvd) / (tvd2 - tvd) * ({f}2 - {f})) FROM seg s WHERE s.well_id = b.well_id AND s.tvd < {x} AND {x} <= s.tvd2) END")


# --- hydraulics ----------------------------------------------------------------------------------------

@query("bhp_summary", f"""{W} SELECT well_id, pos, round(0.052 * mud_weight * depth_tvd, 2) AS hydrostatic,
 round(0.052 * mud_weight * depth_tvd + choke_pressure, 2) AS bhp_static, round(0.052 * mud_weight * depth_tvd + 0.3 * spp + choke_pressure, 2) AS bhp_dynamic,
 round(mud_weight + 0.3 * spp / (0.052 * depth_tvd), 4) AS ecd, round((0.052 * mud_weight * depth_tvd + choke_pressure) / (0.052 * depth_tvd), 4) AS esd FROM wide""",
       dbl="hydrostatic:1 bhp_static:1 bhp_dynamic:1 ecd:3 esd:3")
def q_bhp(spark, sf):
    mw, tvd, sbp, afp = c("mud_weight"), c("depth_tvd"), c("choke_pressure"), F.lit(0.3) * c("spp")
    st = H.bhp_static(mw, tvd, sbp)
    return drill_wide(spark, sf).select(
        "well_id", "pos", F.round(H.hydrostatic(mw, tvd), 2).alias("hydrostatic"), F.round(st, 2).alias("bhp_static"),
        F.round(H.bhp_dynamic(mw, tvd, afp, sbp), 2).alias("bhp_dynamic"), F.round(H.ecd(mw, afp, tvd), 4).alias("ecd"),
        F.round(H.equivalent_density(st, tvd), 4).alias("esd"))


AFP = lambda length: f"(25.0::DOUBLE * {length} * (24.5::DOUBLE * 350 / (hole_id * hole_id - 25.0)) / (60000.0 * (hole_id - 5.0) * (hole_id - 5.0)) + 15.0::DOUBLE * {length} / (200.0 * (hole_id - 5.0)))"


@query("annular_friction", f"""WITH {SECTIONS_SQL} SELECT well_id, seq, 24.5::DOUBLE * 350 / (hole_id * hole_id - 25.0) AS velocity, {AFP('(md_bottom - md_top)')} AS friction FROM sec""", dbl="velocity friction")
def q_afp(spark, sf):
    s = well_sections(spark, sf)
    return s.select("well_id", "seq", H.annular_velocity(350.0, c("hole_id"), c("pipe_od")).alias("velocity"),
                    H.annular_friction(25.0, 15.0, c("md_bottom") - c("md_top"), 350.0, c("hole_id"), c("pipe_od")).alias("friction"))


@query("total_annular_friction", f"WITH {SECTIONS_SQL} SELECT well_id, sum({AFP('(md_bottom - md_top)')}) AS friction FROM sec GROUP BY 1", dbl="friction")
def q_afp_total(spark, sf):
    return design(spark, sf).select("well_id", H.friction_below(c("sections"), F.lit(0.0), 25.0, 15.0, 350.0).alias("friction"))


PROFILE_SQL = f"""{SECTIONS_SQL}, {POINTS_SQL}, td AS (SELECT well_id, max(md_bottom) td FROM sec GROUP BY 1),
 st AS (SELECT well_id, i, least(i * (td / 49.0), td) AS md FROM td, generate_series(0, 49) g(i)),
 st2 AS (SELECT st.well_id, i, md, arg_min(tvd_top + (md - md_top) / (md_bottom - md_top) * (tvd_bottom - tvd_top), seq) AS tvd
   FROM st JOIN sec ON sec.well_id = st.well_id AND md BETWEEN md_top AND md_bottom GROUP BY 1, 2, 3),
 fr AS (SELECT st.well_id, i, sum({AFP('greatest(0.0, md_bottom - greatest(md_top, md))')}) AS afp FROM st JOIN sec USING (well_id) GROUP BY 1, 2),
 b AS (SELECT st2.*, afp, 0.052 * 12.5 * tvd AS hydrostatic FROM st2 JOIN fr USING (well_id, i)),
 prof AS (SELECT well_id, i, md, tvd, hydrostatic, afp, hydrostatic + 200 AS bhp_static, hydrostatic + afp + 200 AS bhp_dynamic,
   CASE WHEN tvd <= 0 THEN 12.5 ELSE 12.5 + afp / (0.052 * tvd) END AS ecd, CASE WHEN tvd <= 0 THEN 0 ELSE (hydrostatic + 200) / (0.052 * tvd) END AS esd,
   {interp_sql('b.tvd', 'pore')} AS pore, {interp_sql('b.tvd', 'frac')} AS frac FROM b)"""


@query("pressure_profile", f"WITH {PROFILE_SQL} SELECT * FROM prof", dbl="md tvd hydrostatic afp bhp_static bhp_dynamic ecd esd pore frac")
def q_profile(spark, sf):
    return D.pressure_profile(design(spark, sf), **MUD)


ENV_SQL = f"""{PROFILE_SQL}, env AS (SELECT well_id, i, tvd, greatest(0, pore - hydrostatic) AS min_sbp_static, greatest(0, frac - hydrostatic) AS max_sbp_static,
 greatest(0, pore - hydrostatic - afp) AS min_sbp_dynamic, greatest(0, frac - hydrostatic - afp) AS max_sbp_dynamic FROM prof WHERE tvd > 0)"""


@query("operating_envelope", f"WITH {ENV_SQL} SELECT * FROM env", dbl="tvd min_sbp_static max_sbp_static min_sbp_dynamic max_sbp_dynamic")
def q_env(spark, sf):
    return D.operating_envelope(D.pressure_profile(design(spark, sf), **MUD))


@query("governing_sbp", f"""WITH {ENV_SQL} SELECT well_id, max(min_sbp_static) AS static_min, min(max_sbp_static) AS static_max,
 max(min_sbp_dynamic) AS dynamic_min, min(max_sbp_dynamic) AS dynamic_max FROM env GROUP BY 1""", dbl="static_min static_max dynamic_min dynamic_max")
def q_gov(spark, sf):
    return D.governing_range(D.operating_envelope(D.pressure_profile(design(spark, sf), **MUD)))


@query("section_lookup", f"""WITH {WIDE_SQL}, {SECTIONS_SQL} SELECT w.well_id, pos, min(seq) AS seq, arg_min(hole_id, seq) AS hole_id,
 arg_min(tvd_top + (depth_md - md_top) / (md_bottom - md_top) * (tvd_bottom - tvd_top), seq) AS tvd
 FROM wide w JOIN sec ON sec.well_id = w.well_id AND depth_md BETWEEN md_top AND md_bottom GROUP BY 1, 2""", dbl="hole_id tvd")
def q_section(spark, sf):
    d = D.on_design(drill_wide(spark, sf).select("well_id", "pos", "depth_md"), design(spark, sf))
    s = H.section_at(c("sections"), c("depth_md"))
    return d.select("well_id", "pos", s["seq"].alias("seq"), s["hole_id"].alias("hole_id"),
                    H.tvd_at(c("sections"), c("depth_md")).alias("tvd")).where("seq is not null")


@query("formation_interpolation", f"""WITH {WIDE_SQL}, {POINTS_SQL}, b AS (SELECT well_id, pos, depth_tvd FROM wide)
 SELECT well_id, pos, {interp_sql('b.depth_tvd', 'pore')} AS pore, {interp_sql('b.depth_tvd', 'frac')} AS frac FROM b""", dbl="pore frac")
def q_interp(spark, sf):
    d = D.on_design(drill_wide(spark, sf).select("well_id", "pos", "depth_tvd"), design(spark, sf))
    return d.select("well_id", "pos", H.interpolate_points(c("points"), c("depth_tvd"), "pore").alias("pore"),
                    H.interpolate_points(c("points"), c("depth_tvd"), "frac").alias("frac"))


@query("pressure_window", f"""WITH {WIDE_SQL}, {POINTS_SQL}, b AS (SELECT well_id, pos, depth_tvd, 0.052 * mud_weight * depth_tvd + 0.05 * spp AS bhp FROM wide),
 x AS (SELECT well_id, pos, bhp, {interp_sql('b.depth_tvd', 'pore')} AS pore, {interp_sql('b.depth_tvd', 'frac')} AS frac FROM b)
 SELECT well_id, pos, bhp AS bhp_dynamic, bhp - pore AS margin_pore, frac - bhp AS margin_frac, bhp >= pore AND bhp <= frac AS within_window FROM x""",
       dbl="bhp_dynamic margin_pore margin_frac")
def q_window(spark, sf):
    d = D.on_design(drill_wide(spark, sf).select("well_id", "pos", c("depth_tvd").alias("tvd"), "mud_weight", "spp"), design(spark, sf))
    d = d.withColumns({"pore": H.interpolate_points(c("points"), c("tvd"), "pore"), "frac": H.interpolate_points(c("points"), c("tvd"), "frac")})
    return D.pressure_window(d, c("mud_weight"), F.lit(0.05) * c("spp"), 0.0) \
        .select("well_id", "pos", "bhp_dynamic", "margin_pore", "margin_frac", "within_window")


@query("surge_swab", f"""{W}, s AS (SELECT well_id, pos, mud_weight, depth_tvd, 0.45 * 25 * wob * 3 * (25.0 / (8.5 * 8.5 - 25.0)) * depth_tvd / (60000.0 * 3.5 * 3.5) AS dp FROM wide)
 SELECT well_id, pos, dp AS surge, 0.052 * mud_weight * depth_tvd + dp AS bhp_surge, 0.052 * mud_weight * depth_tvd - dp AS bhp_swab,
 (0.052 * mud_weight * depth_tvd + dp) / (0.052 * depth_tvd) AS ecd_surge, (0.052 * mud_weight * depth_tvd - dp) / (0.052 * depth_tvd) AS ecd_swab FROM s""",
       dbl="surge bhp_surge bhp_swab ecd_surge ecd_swab")
def q_surge(spark, sf):
    d = drill_wide(spark, sf).withColumn("surge", H.surge_pressure(c("depth_tvd"), c("wob") * 3.0, 8.5, 5.0, 25.0))
    st = H.hydrostatic(c("mud_weight"), c("depth_tvd"))
    return d.select("well_id", "pos", "surge", (st + c("surge")).alias("bhp_surge"), (st - c("surge")).alias("bhp_swab"),
                    H.equivalent_density(st + c("surge"), c("depth_tvd")).alias("ecd_surge"),
                    H.equivalent_density(st - c("surge"), c("depth_tvd")).alias("ecd_swab"))


@query("kill_sheet", f"""{W}, k AS (SELECT well_id, pos, CASE WHEN wob < 3 THEN 0 ELSE depth_tvd END AS tvd, mud_weight AS mw, rop * 5 AS sidpp, 600.0::DOUBLE AS scrp FROM wide)
 SELECT well_id, pos, CASE WHEN tvd > 0 THEN mw + sidpp / (0.052 * tvd) END AS kill_mw, CASE WHEN tvd > 0 THEN sidpp + scrp END AS icp,
 CASE WHEN tvd > 0 THEN scrp * ((mw + sidpp / (0.052 * tvd)) / mw) END AS fcp, CASE WHEN tvd <= 0 THEN 'tvd not positive' END AS reason FROM k""", dbl="kill_mw icp fcp")
def q_kill(spark, sf):
    d = drill_wide(spark, sf).withColumn("tvd", F.when(c("wob") < 3, F.lit(0.0)).otherwise(c("depth_tvd")))
    return d.select("well_id", "pos", *[e.alias(n) for n, e in H.kill_sheet(c("mud_weight"), c("tvd"), c("rop") * 5.0, 600.0).items()])


@query("page_hydraulics", f"""{W}, p AS (SELECT well_id, 0.052 * mud_weight * depth_tvd AS hp, 0.3 * spp AS afp, mud_weight + 0.3 * spp / (0.052 * depth_tvd) AS ecd, 0.60 * depth_tvd AS pore FROM wide)
 SELECT well_id, avg(ecd) AS mean_ecd, avg(hp) AS mean_hydrostatic, avg(hp + 175) AS mean_bhp_static, avg(hp + afp + 175) AS mean_bhp_dynamic, avg(pore) AS mean_pore FROM p GROUP BY 1""",
       dbl="mean_ecd mean_hydrostatic mean_bhp_static mean_bhp_dynamic mean_pore")
def q_page_hyd(spark, sf):
    mw, tvd, afp = c("mud_weight"), c("depth_tvd"), c("spp") * 0.3
    return drill_wide(spark, sf).groupBy("well_id").agg(
        F.avg(H.ecd(mw, afp, tvd)).alias("mean_ecd"), F.avg(H.hydrostatic(mw, tvd)).alias("mean_hydrostatic"),
        F.avg(H.bhp_static(mw, tvd, 175.0)).alias("mean_bhp_static"), F.avg(H.bhp_dynamic(mw, tvd, afp, 175.0)).alias("mean_bhp_dynamic"),
        F.avg(F.lit(0.60) * tvd).alias("mean_pore"))


# --- rock ----------------------------------------------------------------------------------------------

GEO = f"""g0 AS (SELECT well_id, pos, depth_tvd, rop, rpm, wob, gamma_ray, {MSE} AS mse FROM wide), g1 AS (SELECT *, greatest(0.35 * mse, 0) AS ucs FROM g0),
 g2 AS (SELECT *, mse * 0.35 AS mse_corrected, ucs + 0.5 * depth_tvd * pow(tan(pi() / 4 + radians(30) / 2), 2) AS ccs, (ucs - ucs / 10) / (ucs + ucs / 10) AS brittleness,
  least(1, ucs / mse) AS efficiency, CASE WHEN wob > 0 THEN log10(rop / (wob * 1000 * rpm)) ELSE -99 END AS drillability FROM g1)"""


@query("lateral_geomechanics", f"{W}, {GEO} SELECT well_id, pos, mse, mse_corrected, ucs, ccs, brittleness, efficiency, drillability FROM g2",
       dbl="mse:3 mse_corrected:3 ucs:3 ccs:3 brittleness efficiency drillability")
def q_geo(spark, sf):
    lbs = c("wob") * 1000.0
    ok = (c("rop") > 0) & (c("rpm") > 0)
    d = drill_wide(spark, sf).withColumn("mse", F.when(ok, R.mse(lbs, c("torque"), c("rpm"), c("rop"), 8.75)))
    d = d.withColumn("ucs", R.ucs(c("mse")))
    return d.select("well_id", "pos", "mse", (c("mse") * 0.35).alias("mse_corrected"), "ucs",
                    R.ccs(c("ucs"), F.lit(0.5) * c("depth_tvd")).alias("ccs"), R.brittleness(c("ucs")).alias("brittleness"),
                    R.efficiency(c("ucs"), c("mse")).alias("efficiency"), R.drillability(c("rop"), lbs, c("rpm")).alias("drillability"))


@query("mse_klbs", f"{W} SELECT well_id, avg({MSE}) AS mean_mse, max({MSE}) AS max_mse FROM wide GROUP BY 1", dbl="mean_mse:3 max_mse:3")
def q_mse(spark, sf):
    m = F.coalesce(R.mse(c("wob") * 1000.0, c("torque"), c("rpm"), c("rop"), 8.75), F.lit(0.0))
    return drill_wide(spark, sf).groupBy("well_id").agg(F.avg(m).alias("mean_mse"), F.max(m).alias("max_mse"))


@query("page_geomechanics", f"""{W}, m AS (SELECT well_id, gamma_ray, least(greatest(480.0::DOUBLE * torque * rpm / (8.75 * 8.75 * rop) + 4 * wob / (pi() * 8.75 * 8.75), 0), 200000) AS mse FROM wide),
 u AS (SELECT *, least(greatest(mse * 0.35, 0), 50000) AS ucs FROM m), gm AS (SELECT well_id, max(gamma_ray) AS g FROM wide GROUP BY 1),
 b AS (SELECT u.well_id, mse, ucs, CASE WHEN ucs > 0 THEN (ucs - ucs / 10) / (ucs + ucs / 10) ELSE 0 END AS bi, gamma_ray, g FROM u JOIN gm USING (well_id))
 SELECT well_id, avg(mse) FILTER (mse > 0) AS mean_mse, avg(ucs) FILTER (ucs > 0) AS mean_ucs, avg(CASE WHEN bi > 0.5 THEN 100.0 ELSE 0 END) AS brittle_pct,
 avg(greatest(0, least(1, bi * 0.7 + (1 - gamma_ray / g) * 0.3))) AS mean_fracability FROM b GROUP BY 1""", dbl="mean_mse:3 mean_ucs:3 brittle_pct mean_fracability")
def q_page_geo(spark, sf):
    w = drill_wide(spark, sf)
    top = w.groupBy("well_id").agg(F.max("gamma_ray").alias("g"), F.max("pos").alias("last_pos"))
    clip = lambda x, a, b: F.greatest(F.lit(float(a)), F.least(x, F.lit(float(b))))
    rot = F.when((c("rop") > 0) & (c("rpm") > 0), F.lit(480.0) * c("torque") * c("rpm") / (F.lit(8.75 * 8.75) * c("rop"))).otherwise(F.lit(0.0))
    d = attach(w, top, ["well_id"]).withColumn("mse", clip(rot + F.lit(4.0) * c("wob") / F.lit(3.141592653589793 * 8.75 * 8.75), 0, 200000))
    d = d.withColumn("ucs", clip(c("mse") * 0.35, 0, 50000)).withColumn("bi", R.brittleness(c("ucs")))
    g = F.when(c("g") > 0, c("g")).otherwise(F.lit(1.0))
    return d.groupBy("well_id").agg(
        F.avg(F.when(c("mse") > 0, c("mse"))).alias("mean_mse"), F.avg(F.when(c("ucs") > 0, c("ucs"))).alias("mean_ucs"),
        F.avg(F.when(c("bi") > 0.5, 100.0).otherwise(0.0)).alias("brittle_pct"),
        F.avg(clip(c("bi") * 0.7 + (F.lit(1.0) - c("gamma_ray") / g) * 0.3, 0, 1)).alias("mean_fracability"))


@query("stability_window", f"""{W}, s AS (SELECT well_id, pos, depth_tvd, 0.052 * 16.33 * depth_tvd AS sv, 0.451237 * depth_tvd AS pp, 200.03713 * wob AS ucs FROM wide),
 h AS (SELECT *, 0.25 / 0.75 * (sv - pp) + pp AS shmin FROM s), k AS (SELECT *, (sv + shmin) / 2 AS shmax FROM h),
 p AS (SELECT *, greatest(3 * shmax - shmin - pp - ucs, pp) AS bo, 3 * shmin - shmax - pp + ucs / 10 AS fr FROM k)
 SELECT well_id, pos, shmin, round(bo, 1) AS breakout_psi, round(fr, 1) AS fracture_psi, round(greatest(bo, pp) / (0.052 * depth_tvd), 2) AS safe_mw_min,
 round(fr / (0.052 * depth_tvd), 2) AS safe_mw_max, fr - greatest(bo, pp) > 0 AS is_stable FROM p""", dbl="shmin breakout_psi:1 fracture_psi:1 safe_mw_min:2 safe_mw_max:2")
def q_stab(spark, sf):
    tvd = c("depth_tvd")
    d = drill_wide(spark, sf).withColumns({"sv": R.overburden(tvd), "pp": F.lit(0.451237) * tvd, "ucs": F.lit(200.03713) * c("wob")})
    d = d.withColumn("shmin", R.min_horizontal_stress(c("sv"), c("pp")))
    return d.withColumns(R.stability_window(tvd, c("pp"), c("sv"), c("shmin"), c("ucs"))) \
        .select("well_id", "pos", "shmin", "breakout_psi", "fracture_psi", "safe_mw_min", "safe_mw_max", "is_stable")


@query("fracability", f"""{W} SELECT well_id, avg(0.7 * least(1, wob / 50) + 0.3 * CASE WHEN rpm > 0 THEN 1 / (1 + exp(-0.5 * (rpm / 20 - 5))) ELSE 0 END) AS mean_score FROM wide GROUP BY 1""", dbl="mean_score")
def q_frac(spark, sf):
    return drill_wide(spark, sf).groupBy("well_id").agg(F.avg(R.fracability(c("wob") / 50.0, c("rpm") / 20.0)).alias("mean_score"))


PP = """pp0 AS (SELECT well_id, pos, depth_tvd, rop, rpm, wob, mud_weight, log10(rop / (60.0 * rpm)) / log10(12.0 * wob * 1000 / (1000.0 * 8.75)) AS d FROM wide),
 pp1 AS (SELECT *, d * (8.65 / mud_weight) AS dc, 1.0 + 4e-05 * depth_tvd AS dn, 19.2 + depth_tvd / 100000 * 2.0 AS sv FROM pp0),
 pp2 AS (SELECT *, CASE WHEN dc <= 0 THEN 8.65 ELSE greatest(8.65 * 0.8, least(sv - (sv - 8.65) * pow(CASE WHEN dc > 0 THEN dc / dn ELSE 1 END, 1.2), sv * 0.95)) END AS pp,
  CASE WHEN rop < 10 OR rop > 300 THEN 0.5 ELSE 1 END * CASE WHEN wob * 1000 < 5000 THEN 0.7 ELSE 1 END * CASE WHEN abs(dc) < 0.3 OR abs(dc) > 3 THEN 0.5 ELSE 1 END AS conf FROM pp1)"""


@query("pore_pressure_profile", f"{W}, {PP} SELECT well_id, pos, d AS d_exp, dc AS dc_exp, dn AS dc_normal, pp AS pp_ppg, 0.052 * pp * depth_tvd AS pp_psi, sv AS overburden_ppg, conf AS confidence FROM pp2",
       dbl="d_exp dc_exp dc_normal pp_ppg pp_psi:3 overburden_ppg confidence")
def q_pp(spark, sf):
    d = drill_wide(spark, sf)
    return d.select("well_id", "pos", *[e.alias(n) for n, e in R.pore_pressure(
        c("depth_tvd"), c("rop"), c("rpm"), c("wob"), c("mud_weight")).items()])


@query("overpressure_summary", f"""{W}, {PP} SELECT well_id, avg(CASE WHEN pp > 8.65 * 1.1 THEN 100.0 ELSE 0 END) AS overpressure_pct,
 avg(d) FILTER (d > 0 AND depth_tvd > 0) AS mean_d, avg(pp) FILTER (d > 0) AS mean_pp, count(*) FILTER (d > 0) AS n_valid FROM pp2 GROUP BY 1""", dbl="overpressure_pct mean_d mean_pp")
def q_over(spark, sf):
    d = drill_wide(spark, sf)
    d = d.withColumns(R.pore_pressure(c("depth_tvd"), c("rop"), c("rpm"), c("wob"), c("mud_weight")))
    v = (c("d_exp") > 0) & (c("depth_tvd") > 0)
    return d.groupBy("well_id").agg(F.avg(F.when(c("pp_ppg") > 8.65 * 1.1, 100.0).otherwise(0.0)).alias("overpressure_pct"),
                                    F.avg(F.when(v, c("d_exp"))).alias("mean_d"), F.avg(F.when(v, c("pp_ppg"))).alias("mean_pp"),
                                    F.count(F.when(v, 1)).alias("n_valid"))


# --- formation damage ----------------------------------------------------------------------------------

def damage_sql(dp, hours, rate, solids, wbm, spurt, src, keys):
    clay = f"greatest(0.25, least(1, 1 - CASE WHEN {wbm} THEN 0.35 * (1 - exp(-1.5 * x)) ELSE 0.08 * (1 - exp(-1.0 * x)) END))"
    return f"""d0 AS (SELECT *, {dp} / 1000.0::DOUBLE AS x, sqrt(greatest({dp}, 0) / 100.0) AS f, 2 * pi() * 0.354 * 200 AS area FROM {src}),
 d1 AS (SELECT *, {spurt} * f * area + {rate} * f * sqrt({hours}) * area AS filtrate_bbl, greatest(0.1, least(1, 1 - 0.65 * (1 - exp(-2.0 * x)) * ({solids} / 0.06::DOUBLE))) AS solids_plugging,
   {clay} AS clay_swelling, greatest(0.4, least(1, 1 - 0.2 * (1 - exp(-1.8 * x)))) AS phase_trapping FROM d0),
 d2 AS (SELECT *, sqrt(greatest(0.354 * 0.354 + filtrate_bbl * 5.615 / (pi() * 200 * 0.07), 0.354 * 0.354)) AS invasion_ft, greatest(0.05, least(1, solids_plugging * clay_swelling * phase_trapping)) AS kd_over_k FROM d1),
 d3 AS (SELECT *, CASE WHEN invasion_ft <= 0.354 THEN 0 ELSE (1 / kd_over_k - 1) * ln(invasion_ft / 0.354) END AS skin FROM d2),
 dmg AS (SELECT {keys}, filtrate_bbl, invasion_ft, solids_plugging, clay_swelling, phase_trapping, kd_over_k, skin, 0.1 * 200 / (141.2 * 1.35 * 0.8 * (ln(660 / 0.354) + skin)) AS pi FROM d3)"""


def damage_cols(dp, hours, rate, solids, mud, spurt):
    r = R.RESERVOIR
    return R.damage(dp, hours, rate, solids, mud, spurt, r["k"], r["phi"], r["r_w"], r["h"], r["r_e"], r["bo"], r["mu"])


SCEN_SQL = f"""s AS (SELECT well_id, scenario, avg(CASE scenario WHEN 'conventional' THEN 300 + 8 * wob ELSE 30 + wob END) AS dp FROM wide, (VALUES ('conventional'), ('managed')) v(scenario) GROUP BY 1, 2),
 {damage_sql('dp', "CASE scenario WHEN 'conventional' THEN 48 ELSE 24 END", "CASE scenario WHEN 'conventional' THEN 0.02 ELSE 0.005 END", "CASE scenario WHEN 'conventional' THEN 0.06 ELSE 0.03 END", "scenario = 'conventional'", "CASE scenario WHEN 'conventional' THEN 0.05 ELSE 0.01 END", 's', 'well_id, scenario, dp')}"""
DMG = "filtrate_bbl invasion_ft solids_plugging clay_swelling phase_trapping kd_over_k skin pi"


def scenario_results(spark, sf):
    """Both drilling scenarios per well; the overbalance follows the well's mean bit load."""
    w = drill_wide(spark, sf).groupBy("well_id").agg(F.avg(F.lit(300.0) + c("wob") * 8.0).alias("dp_c"), F.avg(F.lit(30.0) + c("wob")).alias("dp_m"))
    row = lambda name, p, dp: F.struct(F.lit(name).alias("scenario"), dp.alias("dp"), *[F.lit(p[k]).alias(k) for k in ("hours", "rate", "solids", "mud", "spurt")])
    s = w.select("well_id", F.explode(F.array(row("conventional", R.CONVENTIONAL, c("dp_c")), row("managed", R.MANAGED, c("dp_m")))).alias("s")).select("well_id", "s.*")
    return s.select("well_id", "scenario", "dp", *[e.alias(n) for n, e in damage_cols(c("dp"), c("hours"), c("rate"), c("solids"), c("mud"), c("spurt")).items()])


@query("formation_damage", f"{W}, {SCEN_SQL} SELECT * FROM dmg", dbl=f"dp {DMG}")
def q_damage(spark, sf):
    return scenario_results(spark, sf)


@query("scenario_comparison", f"""{W}, {SCEN_SQL}, l AS (UNPIVOT dmg ON filtrate_bbl, invasion_ft, kd_over_k, solids_plugging, clay_swelling, phase_trapping, skin, pi INTO NAME measure VALUE v),
 p AS (SELECT well_id, measure, max(v) FILTER (scenario = 'conventional') AS conventional, max(v) FILTER (scenario = 'managed') AS managed FROM l GROUP BY 1, 2)
 SELECT *, CASE WHEN conventional = 0 THEN 0 ELSE CASE WHEN measure IN ('filtrate_bbl', 'invasion_ft', 'skin') THEN conventional - managed ELSE managed - conventional END / abs(conventional) * 100 END AS improvement_pct FROM p""",
       dbl="conventional managed improvement_pct")
def q_scen(spark, sf):
    return D.compare_scenarios(scenario_results(spark, sf))


@query("overbalance_sweep", f"""WITH s AS (SELECT s_suppkey AS well_id, i, 25.0 + (1500.0 - 25.0) / 59 * i AS dp, 24 + s_suppkey % 48 AS hours FROM supplier, generate_series(0, 59) g(i)),
 {damage_sql('dp', 'hours', '0.02', '0.06', 'true', '0.05', 's', 'well_id, i, dp')} SELECT well_id, i, dp, skin, kd_over_k, invasion_ft, pi FROM dmg""", dbl="dp skin kd_over_k invasion_ft pi")
def q_sweep(spark, sf):
    s = table(spark, sf, "supplier").select(c("s_suppkey").alias("well_id"), (F.lit(24) + c("s_suppkey") % 48).alias("hours"),
                                            F.explode(F.sequence(F.lit(0), F.lit(59))).alias("i"))
    s = s.withColumn("dp", F.lit(25.0) + F.lit((1500.0 - 25.0) / 59) * c("i"))
    d = s.withColumns(damage_cols(c("dp"), c("hours"), 0.02, 0.06, "WBM", 0.05))
    return d.select("well_id", "i", "dp", "skin", "kd_over_k", "invasion_ft", "pi")


# --- optimisation --------------------------------------------------------------------------------------

WELLS_SQL = """wells AS (SELECT s_suppkey AS well_id, 9000.0 + 10 * (s_suppkey % 150) AS tvd, 9.0 + (s_suppkey % 9) * 0.5 AS pore_ppg, 13.5 + (s_suppkey % 4) * 0.7 AS frac_ppg,
  10.0 + (s_suppkey % 5) * 0.4 AS mw, 12.0::DOUBLE AS current_ecd, 6000.0 + (s_suppkey % 11) * 40 AS current_bhp, 100.0 + (s_suppkey % 3) * 50 AS current_sbp FROM supplier)"""


def opt_wells(spark, sf):
    k = c("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.alias("well_id"), (F.lit(9000.0) + k % 150 * 10).alias("tvd"), (F.lit(9.0) + k % 9 * 0.5).alias("pore_ppg"),
        (F.lit(13.5) + k % 4 * 0.7).alias("frac_ppg"), (F.lit(10.0) + k % 5 * 0.4).alias("mw"), F.lit(12.0).alias("current_ecd"),
        (F.lit(6000.0) + k % 11 * 40).alias("current_bhp"), (F.lit(100.0) + k % 3 * 50).alias("current_sbp"))


@query("parameter_optimum", f"""WITH {WELLS_SQL}, w AS (SELECT *, 0.052 * pore_ppg * tvd AS pp, 0.052 * frac_ppg * tvd AS fg, 0.052 * 0.3 * tvd AS safety FROM wells),
 g AS (SELECT w.*, wi, ri, fi, si, 15 + 5.0 * wi AS wob, 80 + 20.0 * ri AS rpm, 400 + 100.0 * fi AS flow, 125.0 * si AS sbp FROM w, generate_series(0,5) a(wi), generate_series(0,5) b(ri), generate_series(0,4) c(fi), generate_series(0,4) d(si)),
 e AS (SELECT *, mw + (15.0 * (tvd + 10000) * (24.5 * flow / (8.75 * 8.75 - 25.0)) / (60000 * 3.75 * 3.75) + 10.0 * (tvd + 10000) / (200 * 3.75)) / (0.052 * tvd) AS ecd FROM g),
 b AS (SELECT *, 0.052 * ecd * tvd + sbp AS bhp FROM e), f AS (SELECT * FROM b WHERE bhp >= pp + safety AND bhp <= fg - safety),
 r AS (SELECT *, 50.0 * (wob * 1000 / 8.75 / 3000) * pow(rpm / 120, 0.6) * exp(-0.0001 * greatest(bhp - pp, 0)) AS rop FROM f),
 best AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY well_id ORDER BY rop DESC, wi, ri, fi, si) = 1),
 j AS (SELECT w.well_id, w.pp, w.fg, w.safety, best.well_id IS NULL AS none, coalesce(best.wob, 25) AS wob_klbs, coalesce(best.rpm, 120) AS rpm, coalesce(best.flow, 650) AS flow_gpm, coalesce(best.sbp, 150) AS sbp_psi,
   coalesce(best.rop, 0) AS predicted_rop, coalesce(best.ecd, w.current_ecd) AS predicted_ecd, coalesce(best.bhp, w.current_bhp) AS predicted_bhp FROM w LEFT JOIN best USING (well_id))
 SELECT well_id, wob_klbs, rpm, flow_gpm, sbp_psi, predicted_rop, predicted_ecd, predicted_bhp, predicted_bhp - pp AS overbalance, fg - predicted_bhp AS margin_to_frac,
  CASE WHEN none THEN 0 ELSE least(1.0, 0.5 + 0.5 * least(least((predicted_bhp - pp) / greatest(safety, 1), (fg - predicted_bhp) / greatest(safety, 1)), 1)) END AS confidence,
  CASE WHEN none THEN 'no feasible point' ELSE concat_ws(';', CASE WHEN predicted_bhp - pp < 100 THEN 'near balance' END, CASE WHEN fg - predicted_bhp < safety * 2 THEN 'tight fracture margin' END,
   CASE WHEN wob_klbs > 35 THEN 'high wob' END, CASE WHEN rpm > 160 THEN 'high rpm' END) END AS notes FROM j""",
       dbl="wob_klbs rpm flow_gpm sbp_psi predicted_rop predicted_ecd predicted_bhp overbalance margin_to_frac confidence")
def q_opt(spark, sf):
    return D.optimise(opt_wells(spark, sf))


@query("connection_plan", f"""WITH {WELLS_SQL}, b AS (SELECT *, current_bhp - 250 - current_sbp AS base, 0.052 * pore_ppg * tvd AS pp, 0.052 * frac_ppg * tvd AS fg FROM wells),
 s AS (SELECT *, least(greatest(current_bhp - base, greatest(pp + 50 - base, 0)), (fg - base) * 0.95) AS static_sbp FROM b) SELECT well_id, static_sbp, base + static_sbp AS bhp_during FROM s""", dbl="static_sbp bhp_during")
def q_conn(spark, sf):
    return D.connection_plan(opt_wells(spark, sf)).select("well_id", "static_sbp", "bhp_during")


@query("sensitivity_sweep", f"""WITH {WELLS_SQL}, ax(parameter, lo, step) AS (VALUES ('wob', 10.0, 35.0::DOUBLE / 19), ('rpm', 60.0, 140.0::DOUBLE / 19), ('overbalance', 0.0, 1000.0::DOUBLE / 19), ('mud_weight', 9.0, 6.0::DOUBLE / 19)),
 x AS (SELECT *, lo + step * i AS x, 0.052 * pore_ppg * tvd AS pp FROM wells, ax, generate_series(0, 19) g(i)),
 y AS (SELECT *, CASE parameter WHEN 'overbalance' THEN x WHEN 'mud_weight' THEN 0.052 * x * tvd + current_sbp - pp ELSE current_bhp - pp END AS dp FROM x)
 SELECT well_id, parameter, i, x, 50.0 * (CASE parameter WHEN 'wob' THEN x ELSE 25 END * 1000 / 8.75 / 3000) * pow(CASE parameter WHEN 'rpm' THEN x ELSE 120 END / 120, 0.6) * exp(-0.0001 * greatest(dp, 0)) AS rop FROM y""", dbl="x rop")
def q_sens(spark, sf):
    return D.sensitivity(opt_wells(spark, sf))


@query("layer1_derived", f"""{W}, {GEO} SELECT w.well_id, avg(depth_md / w.depth_tvd) AS mean_md_tvd, avg(w.wob / w.rop) AS mean_wob_rop, avg(0.052 * 10 * w.depth_tvd) AS mean_hydrostatic,
 avg(480.0 * torque * w.rpm / (8.5 * 8.5 * w.rop) + 4.0 * w.wob * 1000 / (pi() * 8.5 * 8.5)) AS mse_mean, stddev_pop(480.0 * torque * w.rpm / (8.5 * 8.5 * w.rop) + 4.0 * w.wob * 1000 / (pi() * 8.5 * 8.5)) AS mse_std
 FROM wide w JOIN g2 USING (well_id, pos) GROUP BY 1""", dbl="mean_md_tvd mean_wob_rop mean_hydrostatic mse_mean:3 mse_std:3")
def q_layer1(spark, sf):
    ok = (c("wob") > 0) & (c("rop") > 0) & (c("rpm") > 0)
    m = F.when(ok, R.mse(c("wob") * 1000.0, c("torque"), c("rpm"), c("rop"), 8.5))
    return drill_wide(spark, sf).groupBy("well_id").agg(
        F.avg(F.when(c("depth_tvd") > 0, c("depth_md") / c("depth_tvd")).otherwise(1.0)).alias("mean_md_tvd"),
        F.avg(F.when(c("rop") > 0, c("wob") / c("rop"))).alias("mean_wob_rop"),
        F.avg(H.hydrostatic(10.0, c("depth_tvd"))).alias("mean_hydrostatic"), F.avg(m).alias("mse_mean"), F.stddev_pop(m).alias("mse_std"))


@query("ecd_with_provenance", f"""{W} SELECT well_id, pos, mud_weight + 0.3 * spp / (0.052 * depth_tvd) AS value, 'ppg' AS unit, 'equivalent circulating density' AS method, 3 AS n_inputs, mud_weight AS input_mw FROM wide""",
       dbl="value input_mw", whole="n_inputs")
def q_prov(spark, sf):
    d = drill_wide(spark, sf)
    r = D.with_provenance(H.ecd(c("mud_weight"), c("spp") * 0.3, c("depth_tvd")), "ppg", "equivalent circulating density", [
        ("MW", c("mud_weight"), "ppg", "measured"), ("AFP", c("spp") * 0.3, "psi", "modelled"), ("TVD", c("depth_tvd"), "ft", "survey")])
    d = d.select("well_id", "pos", r.alias("r"))
    return d.select("well_id", "pos", c("r.value").alias("value"), c("r.unit").alias("unit"), c("r.method").alias("method"),
                    F.size("r.inputs").alias("n_inputs"), c("r.inputs")[0]["value"].alias("input_mw"))


KPI = "ecd target_bhp pp_ppg fg_ppg flow_ratio recommended_sbp min_sbp max_sbp overbalance"


@query("supervisory_kpis", f"""{W}, l AS (SELECT well_id, max_by(depth_md, pos) AS md, max_by(depth_tvd, pos) AS tvd, max_by(choke_pressure, pos) AS sbp, max_by(flow_in, pos) AS flow_in, max_by(flow_out, pos) AS flow_out, max_by(mud_weight, pos) AS mw FROM wide GROUP BY 1),
 a AS (SELECT *, greatest(sbp * 0.6, 80) AS afp, 0.465 + (tvd - 5000) / 20000 * 0.20 AS pg, 0.75 + (tvd - 3000) / 15000 * 0.15 AS fg, CASE WHEN flow_out <= 2 THEN flow_out * flow_in ELSE flow_out END AS fo FROM l),
 b AS (SELECT *, mw + afp / (0.052 * tvd) AS ecd, pg / 0.052 AS pp_ppg, CASE WHEN flow_in > 0 THEN fo / flow_in ELSE 1 END AS flow_ratio, greatest(pg * tvd + 50 - 0.052 * 11.5 * tvd, 0) AS min_sbp FROM a)
 SELECT well_id, ecd, 0.052 * mw * tvd + sbp AS target_bhp, pp_ppg, fg / 0.052 AS fg_ppg, flow_ratio, flow_ratio < 0.95 OR flow_ratio > 1.05 AS flow_alarm, greatest(pg * tvd + 50 - 0.052 * mw * tvd, 50) AS recommended_sbp, min_sbp,
  greatest(fg * tvd - 50 - 0.052 * 11.5 * tvd, min_sbp + 50) AS max_sbp, (ecd - pp_ppg) * 0.052 * tvd AS overbalance, CASE WHEN (ecd - pp_ppg) * 0.052 * tvd < 100 THEN 'LOW' WHEN (ecd - pp_ppg) * 0.052 * tvd < 300 THEN 'MODERATE' ELSE 'HIGH' END AS damage_risk,
  CASE WHEN md < 9500 THEN 'Vertical' WHEN md < 11200 THEN 'Build' ELSE 'Lateral' END AS phase FROM b""", dbl=KPI)
def q_kpi(spark, sf):
    l = D.latest_by_well(drill_wide(spark, sf), ["depth_md", "depth_tvd", "choke_pressure", "flow_in", "flow_out", "mud_weight"])
    l = l.select("well_id", c("depth_md").alias("md"), c("depth_tvd").alias("tvd"), c("choke_pressure").alias("sbp"), "flow_in", "flow_out",
                 c("mud_weight").alias("mw"), F.lit(None).cast("double").alias("afp"))
    return D.supervisory_kpis(l).select("well_id", *KPI.split(), "flow_alarm", "damage_risk", "phase")


@query("decline_forecast", """WITH w AS (SELECT s_suppkey AS well_id, 300.0 + s_suppkey % 50 AS qi, 0.02 + (s_suppkey % 5) * 0.01 AS di, (s_suppkey % 3) * 0.5 AS b FROM supplier),
 q AS (SELECT well_id, CASE WHEN b = 0 THEN qi * exp(-di * m) ELSE qi / pow(1 + b * di * m, 1 / CASE WHEN b = 0 THEN 1 ELSE b END) END AS rate, m FROM w, generate_series(0, 120) g(m))
 SELECT well_id, sum(rate) AS eur, min(rate) AS final_rate, max(rate) AS initial_rate FROM q GROUP BY 1""", dbl="eur final_rate initial_rate")
def q_decline(spark, sf):
    k = c("s_suppkey")
    w = table(spark, sf, "supplier").select(k.alias("well_id"), (F.lit(300.0) + k % 50).alias("qi"), (F.lit(0.02) + k % 5 * 0.01).alias("di"), (k % 3 * 0.5).alias("b"))
    return D.decline_forecast(w, 120).groupBy("well_id").agg(F.sum("rate").alias("eur"), F.min("rate").alias("final_rate"), F.max("rate").alias("initial_rate"))


LAST_SQL = "la AS (SELECT well_id, max_by(mud_weight, pos) AS mw, max_by(spp, pos) * 0.3 AS afp, max_by(depth_tvd, pos) AS tvd, max_by(choke_pressure, pos) AS sbp, max_by(flow_in, pos) AS q, max_by(wob, pos) * 1000 AS wob, max_by(torque, pos) AS torque, max_by(rpm, pos) AS rpm, max_by(rop, pos) AS rop FROM wide GROUP BY 1)"
RESULT_SQL = f"""{W}, {LAST_SQL}, r1 AS (SELECT *, 480.0::DOUBLE * torque * rpm / (8.75::DOUBLE * 8.75 * rop) + 4.0::DOUBLE * wob / (pi() * 8.75::DOUBLE * 8.75) AS mse, log10(rop / (60.0 * rpm)) / log10(12.0 * wob / (1000.0 * 8.75)) AS dx, (100.0::DOUBLE / 40 - 1) * ln(3.0::DOUBLE / 0.36) AS skin FROM la),
 r2 AS (SELECT *, 0.35 * mse AS ucs FROM r1),
 rx AS (SELECT well_id, unnest(['ecd', 'hydrostatic', 'bhp_static', 'bhp_dynamic', 'annular_velocity', 'mse', 'ucs', 'brittleness', 'd_exponent', 'eaton_pp', 'skin', 'productivity_index']) AS result,
  unnest([mw + afp / (0.052 * tvd), 0.052 * mw * tvd, 0.052 * mw * tvd + sbp, 0.052 * mw * tvd + afp + sbp, 24.5 * q / (8.75 * 8.75 - 25.0), mse, ucs, (ucs - ucs / 10) / (ucs + ucs / 10), dx,
   CASE WHEN dx <= 0 THEN 8.65 ELSE greatest(8.65 * 0.8, least(19.2 - (19.2 - 8.65) * pow(dx / 1.2, 1.2), 19.2 * 0.95)) END, skin, 100.0 * 50 / (141.2 * 1.2 * 0.8 * (ln(1490.0 / 0.36) + skin))]) AS value,
  unnest([3, 2, 3, 4, 3, 5, 1, 1, 4, 3, 4, 7]) AS n_inputs FROM r2)"""


def latest_results(spark, sf):
    """The twelve results at each well's latest sample, with their inputs."""
    last = D.latest_by_well(drill_wide(spark, sf), ["mud_weight", "spp", "depth_tvd", "choke_pressure", "flow_in", "wob", "torque", "rpm", "rop"])
    fixed = {"hole": 8.75, "pipe": 5.0, "bit": 8.75, "d_normal": 1.2, "overburden": 19.2, "k": 100.0, "kd": 40.0, "rd": 3.0, "rw": 0.36, "h": 50.0, "bo": 1.2, "mu": 0.8, "re": 1490.0}
    d = last.select("well_id", c("mud_weight").alias("mw"), (c("spp") * 0.3).alias("afp"), c("depth_tvd").alias("tvd"), c("choke_pressure").alias("sbp"), c("flow_in").alias("q"), (c("wob") * 1000.0).alias("wob"),
                    "torque", "rpm", "rop", *[F.lit(v).alias(n) for n, v in fixed.items()])
    return D.named_results(d, ["well_id"])


@query("results_with_provenance", f"{RESULT_SQL} SELECT well_id, result, value, n_inputs FROM rx", dbl="value:6", whole="n_inputs")
def q_results(spark, sf):
    """All twelve results at each well's latest sample."""
    return latest_results(spark, sf).select("well_id", "result", "value", F.size("inputs").alias("n_inputs"))


# The recorded channel that each measured or modelled input is taken from.
FEEDS = [("mw", "mud_weight"), ("afp", "spp"), ("tvd", "depth_tvd"), ("sbp", "choke_pressure"), ("q", "flow_in"), ("wob", "wob"), ("torque", "torque"), ("rpm", "rpm"), ("rop", "rop")]
_FED = [x for _, x in FEEDS]
LINEAGE_SQL = f"""WITH RECURSIVE {WIDE_SQL}, k AS (SELECT well_id, unnest({_FED}) AS ch, unnest([{", ".join(f"count({x})" for x in _FED)}]) AS n_samples, unnest([{", ".join(f"max(CASE WHEN {x} IS NOT NULL THEN pos END)" for x in _FED)}]) AS last_pos FROM wide GROUP BY well_id),
 m(node, parent, kind) AS (VALUES {", ".join(f"('{r}', '{n}', '{p}')" for r, _, _, inputs in D.METHODS for n, _, p in inputs)}),
 f(node, ch) AS (VALUES {", ".join(f"('{a}', '{b}')" for a, b in FEEDS)}),
 e AS (SELECT well_id, node, parent, kind FROM (SELECT DISTINCT well_id FROM wide), m UNION ALL SELECT well_id, node, 'channel:' || ch, 'recorded' FROM f JOIN k USING (ch) WHERE n_samples > 0),
 t AS (SELECT well_id, node AS result, parent AS ancestor, kind, 1 AS steps FROM e WHERE node IN (SELECT node FROM m) UNION SELECT t.well_id, result, e.parent, e.kind, steps + 1 FROM t JOIN e ON e.well_id = t.well_id AND e.node = t.ancestor)
 SELECT t.well_id, result, ancestor, min(kind) AS kind, min(steps) AS steps, any_value(n_samples) AS n_samples, any_value(last_pos) AS last_pos FROM t LEFT JOIN k ON k.well_id = t.well_id AND 'channel:' || k.ch = t.ancestor GROUP BY 1, 2, 3"""


@query("result_lineage", LINEAGE_SQL, whole="steps n_samples last_pos")
def q_lineage(spark, sf):
    """What each well's results rest on, down to the recorded channels with their coverage."""
    return lineage.result_lineage(latest_results(spark, sf), drill_wide(spark, sf), FEEDS)
