"""Depth profiles per well: pressure stations, envelopes, scenario sweeps and parameter searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from welltide.functions import hydraulics as H
from welltide.functions import rock as R
from welltide.operators.series import CHUNK, attach


def well_design(sections: DataFrame, points: DataFrame) -> DataFrame:
    """One row per well: its sections and formation control points as short arrays.

    A well design has a handful of casing sections and control points, so the arrays stay small whatever the
    number of samples.
    """
    s = sections.groupBy("well_id").agg(F.sort_array(F.collect_list(F.struct(
        "seq", "md_top", "md_bottom", "tvd_top", "tvd_bottom", "hole_id", "pipe_od"))).alias("sections"))
    p = points.groupBy("well_id").agg(F.sort_array(F.collect_list(F.struct("tvd", "pore", "frac"))).alias("points"))
    return s.join(p, "well_id", "left")


def stations(design: DataFrame, n: int = 50) -> DataFrame:
    """``n`` depths per well from surface to TD. They come out of the generator, so no filter on ``tvd`` or on what follows
    from it puts the search for the section in place of the column. Designs are small, their stations are not, so they are
    dealt to all cores by number and not by size."""
    n = max(n, 2)
    design = design.repartition(2 * design.sparkSession.sparkContext.defaultParallelism, "well_id")
    td = F.array_max(F.transform("sections", lambda s: s["md_bottom"]))
    md = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(i.alias("i"), F.least(i * (F.col("td") / F.lit(float(n - 1))), F.col("td")).alias("md")))
    at = F.transform(md, lambda m: F.struct(m["i"].alias("i"), m["md"].alias("md"), H.tvd_at(F.col("sections"), m["md"]).alias("tvd")))
    return design.withColumn("td", td).select("*", F.inline(at)).where("tvd is not null")


def pressure_profile(design: DataFrame, mw: float, pv: float, yp: float, q: float, sbp: float, n: int = 50) -> DataFrame:
    st = stations(design, n)
    tvd = F.col("tvd")
    afp = H.friction_below(F.col("sections"), F.col("md"), pv, yp, q)
    st = st.withColumn("afp", afp)
    return st.select(
        "well_id", "i", "md", "tvd", H.hydrostatic(mw, tvd).alias("hydrostatic"), "afp",
        H.bhp_static(mw, tvd, sbp).alias("bhp_static"), H.bhp_dynamic(mw, tvd, F.col("afp"), sbp).alias("bhp_dynamic"),
        H.ecd(mw, F.col("afp"), tvd).alias("ecd"), H.equivalent_density(H.bhp_static(mw, tvd, sbp), tvd).alias("esd"),
        H.interpolate_points(F.col("points"), tvd, "pore").alias("pore"),
        H.interpolate_points(F.col("points"), tvd, "frac").alias("frac"))


def operating_envelope(profile: DataFrame) -> DataFrame:
    """Surface back pressure limits per station, with and without circulation."""
    f = lambda c: F.greatest(F.lit(0.0), c)
    hp, afp = F.col("hydrostatic"), F.col("afp")
    return profile.where("tvd > 0 and pore is not null and frac is not null").select(
        "well_id", "i", "tvd", f(F.col("pore") - hp).alias("min_sbp_static"), f(F.col("frac") - hp).alias("max_sbp_static"),
        f(F.col("pore") - hp - afp).alias("min_sbp_dynamic"), f(F.col("frac") - hp - afp).alias("max_sbp_dynamic"))


def governing_range(envelope: DataFrame) -> DataFrame:
    return envelope.groupBy("well_id").agg(
        F.max("min_sbp_static").alias("static_min"), F.min("max_sbp_static").alias("static_max"),
        F.max("min_sbp_dynamic").alias("dynamic_min"), F.min("max_sbp_dynamic").alias("dynamic_max"))


def on_design(wide: DataFrame, design: DataFrame, size: int = CHUNK) -> DataFrame:
    """Samples with their well's design arrays beside them, spread by chunk."""
    last = wide.groupBy("well_id").agg(F.max("pos").alias("last_pos"))
    return attach(wide, design.join(last, "well_id"), ["well_id"], size=size)


def pressure_window(df: DataFrame, mw, afp, sbp) -> DataFrame:
    tvd = F.col("tvd")
    d = H.bhp_dynamic(mw, tvd, afp, sbp)
    return df.withColumns({"bhp_dynamic": d, "margin_pore": d - F.col("pore"), "margin_frac": F.col("frac") - d,
                           "within_window": (d >= F.col("pore")) & (d <= F.col("frac"))})


def compare_scenarios(results: DataFrame) -> DataFrame:
    """Two scenario rows per well side by side, with relative changes, one row per measure."""
    measures = {"filtrate_bbl": True, "invasion_ft": True, "kd_over_k": False, "solids_plugging": False,
                "clay_swelling": False, "phase_trapping": False, "skin": True, "pi": False}
    long = results.unpivot(["well_id", "scenario"], list(measures), "measure", "v")
    side = long.groupBy("well_id", "measure").pivot("scenario", ["conventional", "managed"]).agg(F.first("v"))
    lower = F.col("measure").isin([m for m, lo in measures.items() if lo])
    c, m = F.col("conventional"), F.col("managed")
    gain = F.when(c == 0, F.lit(0.0)).otherwise(F.when(lower, c - m).otherwise(m - c) / F.abs(c) * 100.0)
    return side.withColumn("improvement_pct", gain)


def optimise(wells: DataFrame, bit=8.75, pipe=5.0, pv=15.0, yp=10.0, lateral=10000.0, margin_ppg=0.3) -> DataFrame:
    """Best feasible (wob, rpm, flow, back pressure) on a 6 x 6 x 5 x 5 grid per well; first best in grid order wins.

    ``wells``: well_id, tvd, pore_ppg, frac_ppg, mw, current_ecd, current_bhp. Only the flow and back-pressure
    part of the grid (25 rows) decides feasibility and only wob and rpm (36) differ within it.
    """
    lin = lambda a, b, n: [a + (b - a) / (n - 1) * i for i in range(n)]
    arr = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    w = wells.withColumns({
        "pp": F.lit(0.052) * F.col("pore_ppg") * F.col("tvd"), "fg": F.lit(0.052) * F.col("frac_ppg") * F.col("tvd"),
        "safety": F.lit(0.052) * F.lit(margin_ppg) * F.col("tvd")})
    g = (w.select("*", F.posexplode(arr(lin(400, 800, 5))).alias("fi", "flow"))
         .select("*", F.posexplode(arr(lin(0, 500, 5))).alias("si", "sbp")))
    v = F.lit(24.5) * F.col("flow") / F.lit(bit * bit - pipe * pipe)
    length = F.col("tvd") + F.lit(lateral)
    afp = F.lit(pv) * length * v / F.lit(60000 * (bit - pipe) ** 2) + F.lit(yp) * length / F.lit(200 * (bit - pipe))
    e = F.when(F.col("tvd") <= 0, F.col("mw")).otherwise(F.col("mw") + afp / (F.lit(0.052) * F.col("tvd")))
    g = g.withColumn("ecd", e).withColumn("bhp", F.lit(0.052) * F.col("ecd") * F.col("tvd") + F.col("sbp"))
    g = g.where((F.col("bhp") >= F.col("pp") + F.col("safety")) & (F.col("bhp") <= F.col("fg") - F.col("safety")))
    g = (g.select("*", F.posexplode(arr(lin(15, 40, 6))).alias("wi", "wob"))
         .select("*", F.posexplode(arr(lin(80, 180, 6))).alias("ri", "rpm")))
    g = g.withColumn("rop", R.penetration_rate(F.col("wob"), F.col("rpm"), F.col("bhp") - F.col("pp"), bit)).where("rop > 0")
    order = F.struct(F.col("rop"), (-F.col("wi")).alias("a"), (-F.col("ri")).alias("b"), (-F.col("fi")).alias("c"),
                     (-F.col("si")).alias("d"))
    best = g.groupBy("well_id").agg(F.max_by(F.struct("wob", "rpm", "flow", "sbp", "rop", "ecd", "bhp"), order).alias("b"))
    j = w.join(best, "well_id", "left")
    none = F.col("b").isNull()
    pick = lambda f, fallback: F.when(none, fallback).otherwise(F.col("b")[f])
    j = j.select("well_id", "pp", "fg", "safety", none.alias("infeasible"),
                 pick("wob", F.lit(25.0)).alias("wob_klbs"), pick("rpm", F.lit(120.0)).alias("rpm"),
                 pick("flow", F.lit(650.0)).alias("flow_gpm"), pick("sbp", F.lit(150.0)).alias("sbp_psi"),
                 pick("rop", F.lit(0.0)).alias("predicted_rop"), pick("ecd", F.col("current_ecd")).alias("predicted_ecd"),
                 pick("bhp", F.col("current_bhp")).alias("predicted_bhp"))
    over, room = F.col("predicted_bhp") - F.col("pp"), F.col("fg") - F.col("predicted_bhp")
    ratio = F.least(over / F.greatest("safety", F.lit(1.0)), room / F.greatest("safety", F.lit(1.0)))
    note = lambda c, t: F.when(c, F.lit(t))
    notes = F.when(F.col("infeasible"), "no feasible point").otherwise(F.concat_ws(
        ";", note(over < 100, "near balance"), note(room < F.col("safety") * 2, "tight fracture margin"),
        note(F.col("wob_klbs") > 35, "high wob"), note(F.col("rpm") > 160, "high rpm")))
    return j.select("well_id", "wob_klbs", "rpm", "flow_gpm", "sbp_psi", "predicted_rop", "predicted_ecd", "predicted_bhp",
                    over.alias("overbalance"), room.alias("margin_to_frac"),
                    F.when(F.col("infeasible"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.lit(0.5) + F.lit(0.5) * F.least(
                        ratio, F.lit(1.0)))).alias("confidence"), notes.alias("notes"))


def connection_plan(wells: DataFrame, afp_loss=250.0, swab=50.0) -> DataFrame:
    """Static back pressure that keeps the circulating bottom-hole pressure, kept inside the window."""
    base = F.col("current_bhp") - afp_loss - F.col("current_sbp")
    pp, fg = F.lit(0.052) * F.col("pore_ppg") * F.col("tvd"), F.lit(0.052) * F.col("frac_ppg") * F.col("tvd")
    top = (fg - base) * F.lit(0.95)
    low = F.greatest(pp + swab - base, F.lit(0.0))
    want = F.col("current_bhp") - base
    return wells.withColumn("static_sbp", F.least(F.greatest(want, low), top)) \
        .withColumn("bhp_during", base + F.col("static_sbp"))


def sensitivity(wells: DataFrame, n: int = 20) -> DataFrame:
    """Penetration rate along each parameter, others at their defaults; one row per well, parameter and step."""
    ranges = {"wob": (10, 45), "rpm": (60, 200), "overbalance": (0, 1000), "mud_weight": (9, 15)}
    axes = F.array(*[F.struct(F.lit(k).alias("parameter"), F.lit(float(a)).alias("lo"), F.lit((b - a) / (n - 1)).alias("step"))
                     for k, (a, b) in ranges.items()])
    d = (wells.select("*", F.explode(axes).alias("ax")).select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
         .withColumn("x", F.col("ax.lo") + F.col("ax.step") * F.col("i")).withColumn("parameter", F.col("ax.parameter")))
    pp = F.lit(0.052) * F.col("pore_ppg") * F.col("tvd")
    is_ = lambda p: F.col("parameter") == p
    dp = F.when(is_("overbalance"), F.col("x")) \
        .when(is_("mud_weight"), F.lit(0.052) * F.col("x") * F.col("tvd") + F.col("current_sbp") - pp) \
        .otherwise(F.col("current_bhp") - pp)
    # The overbalance axis runs at the default bit load and speed.
    return d.withColumn("rop", R.penetration_rate(F.when(is_("wob"), F.col("x")).otherwise(F.lit(25.0)),
                                                  F.when(is_("rpm"), F.col("x")).otherwise(F.lit(120.0)), dp)) \
        .select("well_id", "parameter", "i", "x", "rop")


def decline_forecast(wells: DataFrame, months: int) -> DataFrame:
    """Arps rate by month: exponential where b = 0, hyperbolic otherwise. Columns qi, di, b."""
    d = wells.withColumn("month", F.explode(F.sequence(F.lit(0), F.lit(months))))
    q = F.when(F.col("b") == 0, F.col("qi") * F.exp(-F.col("di") * F.col("month"))) \
        .otherwise(F.col("qi") / F.pow(F.lit(1.0) + F.col("b") * F.col("di") * F.col("month"), F.lit(1.0) / F.col("b")))
    return d.withColumn("rate", q)


def with_provenance(value, unit: str, method: str, inputs: list[tuple[str, object, str, str]]):
    """Value with its unit, method and inputs as one struct column."""
    return F.struct(value.alias("value"), F.lit(unit).alias("unit"), F.lit(method).alias("method"),
                    F.array(*[F.struct(F.lit(n).alias("name"), v.alias("value"), F.lit(u).alias("unit"),
                                       F.lit(p).alias("provenance")) for n, v, u, p in inputs]).alias("inputs"))


# Result, unit, method, and name, unit and source of each input in the order the functions take them.
METHODS = [
    ("ecd", "ppg", "equivalent circulating density", [("mw", "ppg", "measured"), ("afp", "psi", "modelled"), ("tvd", "ft", "survey")]),
    ("hydrostatic", "psi", "hydrostatic pressure", [("mw", "ppg", "measured"), ("tvd", "ft", "survey")]),
    ("bhp_static", "psi", "static bottom-hole pressure", [("mw", "ppg", "measured"), ("tvd", "ft", "survey"), ("sbp", "psi", "measured")]),
    ("bhp_dynamic", "psi", "dynamic bottom-hole pressure", [("mw", "ppg", "measured"), ("tvd", "ft", "survey"), ("afp", "psi", "modelled"), ("sbp", "psi", "measured")]),
    ("annular_velocity", "ft/min", "annular velocity", [("q", "gpm", "measured"), ("hole", "in", "record"), ("pipe", "in", "record")]),
    ("mse", "psi", "mechanical specific energy", [("wob", "lbs", "measured"), ("torque", "ft-lbs", "measured"), ("rpm", "rev/min", "measured"), ("rop", "ft/hr", "measured"), ("bit", "in", "record")]),
    ("ucs", "psi", "strength from specific energy", [("mse", "psi", "derived")]),
    ("brittleness", "fraction", "brittleness index", [("ucs", "psi", "derived")]),
    ("d_exponent", "dimensionless", "drilling exponent", [("rop", "ft/hr", "measured"), ("rpm", "rev/min", "measured"), ("wob", "lbs", "measured"), ("bit", "in", "record")]),
    ("eaton_pp", "ppg", "pore pressure from the corrected exponent", [("d_exponent", "dimensionless", "derived"), ("d_normal", "dimensionless", "trend"), ("overburden", "ppg", "gradient")]),
    ("skin", "dimensionless", "skin factor", [("k", "mD", "core"), ("kd", "mD", "modelled"), ("rd", "ft", "modelled"), ("rw", "ft", "record")]),
    ("productivity_index", "stb/d/psi", "productivity index", [("k", "mD", "core"), ("h", "ft", "logs"), ("bo", "rb/stb", "analysis"), ("mu", "cP", "analysis"), ("re", "ft", "spacing"), ("rw", "ft", "record"), ("skin", "dimensionless", "derived")]),
]


def named_results(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per result of METHODS: keys, result, value, unit, method, inputs (name, value, unit, provenance).

    ``rows`` has the columns that METHODS names as inputs and that no other result gives (wob in lbs).
    """
    formula = {"ecd": H.ecd, "hydrostatic": H.hydrostatic, "bhp_static": H.bhp_static, "bhp_dynamic": H.bhp_dynamic, "annular_velocity": H.annular_velocity, "mse": R.mse, "ucs": R.ucs,
               "brittleness": R.brittleness, "d_exponent": R.d_exponent, "eaton_pp": R.eaton, "skin": R.skin, "productivity_index": R.productivity_index}
    d, out = rows, []
    for name, unit, method, inputs in METHODS:  # a result may be an input of a later one
        d = d.withColumn(name, formula[name](*[F.col(n) for n, _, _ in inputs]).cast("double"))
        out.append(F.struct(F.lit(name).alias("result"), with_provenance(F.col(name), unit, method, [(n, F.col(n).cast("double"), u, p) for n, u, p in inputs]).alias("r")))
    return d.select(*keys, F.explode(F.array(*out)).alias("_r")).select(*keys, "_r.result", "_r.r.*")


def latest_by_well(wide: DataFrame, columns: list[str]) -> DataFrame:
    """Last recorded value of each channel."""
    return wide.groupBy("well_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("pos"))).alias(c) for c in columns])


def supervisory_kpis(last: DataFrame) -> DataFrame:
    """Key figures of each well from its latest values.

    Expects md, tvd, sbp, flow_in, flow_out, mw, afp; missing values take the defaults.
    """
    # Defaults of a missing channel.
    d = last.withColumns({"md": F.coalesce("md", F.lit(19800.0)), "tvd": F.coalesce("tvd", F.lit(10300.0)),
                          "sbp": F.coalesce("sbp", F.lit(140.0)), "flow_in": F.coalesce("flow_in", F.lit(720.0)),
                          "flow_raw": F.coalesce("flow_out", F.lit(98.5)), "mw": F.coalesce("mw", F.lit(11.5))})
    d = d.withColumn("afp", F.coalesce("afp", F.greatest(F.col("sbp") * 0.6, F.lit(80.0))))
    tvd, mw = F.col("tvd"), F.col("mw")
    out = F.when(F.col("flow_raw") <= 2.0, F.col("flow_raw") * F.col("flow_in")).otherwise(F.col("flow_raw"))
    ppg = F.lit(0.465) + (tvd - 5000.0) / 20000.0 * 0.20
    fgg = F.lit(0.75) + (tvd - 3000.0) / 15000.0 * 0.15
    d = d.withColumns({"ecd": H.ecd(mw, F.col("afp"), tvd), "target_bhp": H.bhp_static(mw, tvd, F.col("sbp")),
                       "pp_ppg": ppg / 0.052, "fg_ppg": fgg / 0.052,
                       "flow_ratio": F.when(F.col("flow_in") > 0, out / F.col("flow_in")).otherwise(F.lit(1.0))})
    over = (F.col("ecd") - F.col("pp_ppg")) * 0.052 * tvd
    lo = F.greatest(ppg * tvd + 50.0 - F.lit(0.052) * 11.5 * tvd, F.lit(0.0))
    return d.withColumns({
        "flow_alarm": (F.col("flow_ratio") < 0.95) | (F.col("flow_ratio") > 1.05),
        "recommended_sbp": F.greatest(ppg * tvd + 50.0 - F.lit(0.052) * mw * tvd, F.lit(50.0)), "min_sbp": lo,
        "max_sbp": F.greatest(fgg * tvd - 50.0 - F.lit(0.052) * 11.5 * tvd, lo + 50.0), "overbalance": over,
        "damage_risk": F.when(over < 100, "LOW").when(over < 300, "MODERATE").otherwise("HIGH"),
        "phase": F.when(F.col("md") < 9500, "Vertical").when(F.col("md") < 11200, "Build").otherwise("Lateral")})
