"""How well neighbouring depth bins agree with simple physical rules.

A rule predicts the next bin's channel vector from the current one. Rules are data: for each changed channel, the
weights of the channels it is predicted from; channels not named carry over. The weight "coupling" stands for
0.052 * mud weight * |depth step| / span of the annular pressure, at most one half.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from welltide.operators.alerts import in_intervals
from welltide.operators.series import CHUNK, attach
from welltide.session import stage
from welltide.sources import dims

c = F.col
Rules = dict[str, dict[str, dict[str, float | str]]]

# Transport rules and their weights in the composite.
RULES: Rules = {
    "smoothness": {},
    "flow_conservation": {"flow_out": {"flow_in": 1.0}},
    "hydraulics": {"apwd": {"apwd": 1.0, "choke_pressure": "coupling"}},
    "rop_mse": {"rop": {"rop": 1.0, "wob": 0.1, "torque": 0.05, "rpm": 0.03},
                "mse": {"mse": 1.0, "wob": 0.1, "rpm": 0.05, "torque": 0.05, "rop": -0.1}},
    "gamma_rop": {"rop": {"rop": 1.0, "gamma_ray": -0.15}, "gamma_ray": {"gamma_ray": 1.0, "rop": -0.075}},
}
NEEDS = {"flow_conservation": ["flow_in", "flow_out"], "hydraulics": ["apwd", "choke_pressure"],
         "rop_mse": ["rop", "wob", "torque", "rpm"], "gamma_rop": ["gamma_ray", "rop"]}
WEIGHTS = {"smoothness": 0.30, "flow_conservation": 0.20, "hydraulics": 0.20, "rop_mse": 0.15, "gamma_rop": 0.15}
# Anomaly class of each dominant rule.
ANOMALY_CLASS = {"flow_conservation": "FLOW_ANOMALY", "hydraulics": "LOSS", "rop_mse": "FORMATION_CHANGE",
                 "gamma_rop": "FORMATION_CHANGE", "smoothness": "EQUIPMENT"}
_RANGE = {n: (lo, hi) for _, n, _, lo, hi in dims.CHANNEL_DEFS}


def fibers(wide: DataFrame, channels: Sequence[str], n_bins: int, keys: Sequence[str] = ("well_id",), depth: str = "depth_md",
           limits: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """Normalised channel means of equal-width depth bins; a missing channel is 0.5, empty bins are left out.

    ``limits`` (keys, lo, hi, n) may be given for keys finer than the well, or stand in the rows.
    """
    keys = list(keys)
    if {"lo", "hi", "n"} <= set(wide.columns):
        d = wide.select(*keys, "pos", c(depth).alias("_d"), *channels, "lo", "hi", "n")
    elif limits is None:
        lim = wide.groupBy(*keys).agg(F.min(depth).alias("lo"), F.max(depth).alias("hi"), F.count(F.lit(1)).alias("n"), F.max("pos").alias("last_pos"))
        d = attach(wide.select(*keys, "pos", c(depth).alias("_d"), *channels), lim, keys, size=size)
    else:
        d = wide.select(*keys, "pos", c(depth).alias("_d"), *channels).join(limits, keys)
    nb = F.greatest(F.lit(2), F.least(F.lit(n_bins), c("n") * len(channels)))
    span = F.when(c("hi") > c("lo"), c("hi") - c("lo")).otherwise(F.lit(1.0))
    d = d.withColumns({"_w": span / nb, "bin": F.least(nb - 1, F.floor((c("_d") - c("lo")) / (span / nb))).cast("int")})
    g = d.groupBy(*keys, "bin").agg(F.first("lo").alias("_lo"), F.first("_w").alias("_w"), *[F.avg(x).alias(x) for x in channels])

    def unit(x):
        lo, hi = _RANGE[x]
        v = (c(x) - F.lit(lo)) / F.lit(hi - lo)
        return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)), F.lit(0.5))

    return g.select(*keys, "bin", (c("_lo") + (c("bin") + 0.5) * c("_w")).alias("centre"), *[unit(x).alias(x) for x in channels])


def _prediction(channel: str, spec: dict, coupling: Column) -> Column:
    if channel not in spec:
        return c(channel)
    total = F.lit(0.0)
    for src, w in spec[channel].items():
        total = total + c(src) * (coupling if w == "coupling" else F.lit(float(w)))
    return total


def residuals(fib: DataFrame, channels: Sequence[str], keys: Sequence[str] = ("well_id",), mud_weight: float = 10.0,
              rules: Rules | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Norm of prediction minus next bin, per rule and for the weighted composite; one row per pair of bins."""
    rules, weights = rules or RULES, weights or WEIGHTS
    w = Window.partitionBy(*keys).orderBy("bin")
    nxt = {f"_n_{x}": F.lead(x).over(w) for x in channels}
    d = fib.withColumns({**nxt, "_nc": F.lead("centre").over(w)}).where(c("_nc").isNotNull())
    lo, hi = _RANGE["apwd"]
    d = d.withColumn("_cp", F.least(F.lit(0.5), F.lit(0.052 * mud_weight) * F.abs(c("_nc") - c("centre")) / F.lit(hi - lo)))
    active = {r: spec if all(x in channels for x in NEEDS.get(r, [])) else {} for r, spec in rules.items()}
    active = {r: {t: s for t, s in spec.items() if t in channels} for r, spec in active.items()}
    norm = lambda es: F.sqrt(sum((e * e for e in es[1:]), es[0] * es[0]))
    out = {f"r_{r}": norm([_prediction(x, spec, c("_cp")) - c(f"_n_{x}") for x in channels]) for r, spec in active.items()}
    total = sum(weights.values())
    mix = lambda x: sum((_prediction(x, spec, c("_cp")) * F.lit(weights[r] / total) for r, spec in active.items()), F.lit(0.0))
    out["r_composite"] = norm([mix(x) - c(f"_n_{x}") for x in channels])
    return d.select(*keys, c("bin").alias("edge"), ((c("centre") + c("_nc")) / 2.0).alias("mid"), c("centre").alias("from_centre"), c("_nc").alias("to_centre"),
                    *[e.alias(n) for n, e in out.items()])


def defects(res: DataFrame, fib: DataFrame, keys: Sequence[str] = ("well_id",)) -> DataFrame:
    """Squared residuals of the edges on both sides of each bin."""
    sq = c("r_composite") * c("r_composite")
    ends = res.select(*keys, F.explode(F.array(F.struct(c("from_centre").alias("centre"), sq.alias("v")), F.struct(c("to_centre").alias("centre"), sq.alias("v")))).alias("_e"))
    g = ends.groupBy(*keys, c("_e.centre").alias("centre")).agg(F.sum("_e.v").alias("defect"))
    return fib.select(*keys, "bin", "centre").join(g, [*keys, "centre"], "left").withColumn("defect", F.coalesce("defect", F.lit(0.0)))


def anomalies(dfc: DataFrame, keys: Sequence[str] = ("well_id",), sigmas: float = 2.0) -> DataFrame:
    """Bins whose defect exceeds mean + 2 deviations of the well's (at most a few hundred) bins."""
    w = Window.partitionBy(*keys)
    d = dfc.withColumns({"_m": F.avg("defect").over(w), "_s": F.stddev_pop("defect").over(w)})
    return d.where((c("_s") >= 1e-12) & (c("defect") > c("_m") + sigmas * c("_s"))).select(
        *keys, "bin", c("centre").alias("depth"), ((c("defect") - c("_m")) / c("_s")).alias("severity"))


def dominant(values: dict[str, Column]) -> Column:
    """Name of the largest value; the first listed wins ties."""
    arr = F.array(*[F.struct(v.alias("v"), F.lit(-i).alias("o"), F.lit(n).alias("name")) for i, (n, v) in enumerate(values.items())])
    return F.array_max(arr)["name"]


def classify_anomalies(anom: DataFrame, res: DataFrame, wide: DataFrame, depth: str = "depth_md") -> DataFrame:
    """Class of each anomaly from the rule most violated at the nearest edge; flow cases become KICK or LOSS."""
    j = anom.join(res, "well_id").where((c("edge") == c("bin")) | (c("to_centre") == c("depth")))
    pick = F.struct(F.abs(c("mid") - c("depth")).alias("d"), c("edge").alias("e"))
    j = j.groupBy("well_id", "bin", "depth", "severity").agg(F.min_by(dominant({r: c(f"r_{r}") for r in RULES}), pick).alias("dominant"))
    iv = j.where("dominant = 'flow_conservation'").select("well_id", c("bin").alias("interval_id"), (c("depth") - 200.0).alias("a"), (c("depth") + 200.0).alias("b"))
    near = in_intervals(wide.select("well_id", depth, "flow_in", "flow_out"), iv, depth).where((c(depth) > c("a")) & (c(depth) < c("b")))
    fl = near.groupBy("well_id", c("interval_id").alias("bin")).agg(F.avg("flow_in").alias("_in"), F.avg("flow_out").alias("_out"))
    m = F.create_map(*[F.lit(x) for kv in ANOMALY_CLASS.items() for x in kv])[c("dominant")]
    flow = F.when(c("_out") > c("_in") * 1.02, "KICK").when(c("_out") < c("_in") * 0.98, "LOSS").otherwise("UNKNOWN")
    return j.join(fl, ["well_id", "bin"], "left").select("well_id", "bin", "depth", "severity", "dominant",
                                                         F.when(c("dominant") == "flow_conservation", flow).otherwise(m).alias("classification"))


# --- windows along depth -------------------------------------------------------------------------------

def _in_windows(d: DataFrame, window_ft: float, stride_ft: float, depth: str) -> DataFrame:
    """Samples with their well's depth range (_a, _b), repeated once per overlapping window they fall in, with its ends."""
    short = c("_b") - c("_a") < window_ft
    n = F.floor((c("_b") + stride_ft * 0.5 - window_ft - c("_a")) / stride_ft)
    lo = F.greatest(F.lit(0), F.ceil((c(depth) - window_ft - c("_a")) / stride_ft))
    hi = F.least(n, F.floor((c(depth) - c("_a")) / stride_ft))
    one = F.array(F.lit(0).cast("long"))
    ids = F.when(short, one).when(hi >= lo, F.sequence(lo.cast("long"), hi.cast("long")))
    d = d.withColumn("window", F.explode(ids))
    top = c("_a") + c("window") * stride_ft
    return d.withColumns({"w_top": F.when(short, c("_a")).otherwise(top), "w_bottom": F.when(short, c("_b")).otherwise(F.least(top + window_ft, c("_b")))})


def window_rows(wide: DataFrame, window_ft: float = 500.0, stride_ft: float = 100.0, depth: str = "depth_md", size: int = CHUNK) -> DataFrame:
    """Samples repeated once per overlapping depth window they fall in (window_ft / stride_ft + 1 at most)."""
    lim = wide.groupBy("well_id").agg(F.min(depth).alias("_a"), F.max(depth).alias("_b"), F.max("pos").alias("last_pos"))
    return _in_windows(attach(wide, lim, ["well_id"], size=size), window_ft, stride_ft, depth).drop("_a", "_b")


def window_coherence(wide: DataFrame, channels: Sequence[str], n_bins: int = 20, mud_weight: float = 10.0, depth: str = "depth_md",
                     window_ft: float = 500.0, stride_ft: float = 100.0, size: int = CHUNK) -> DataFrame:
    """Residual coherence exp(-mean r^2) and the most violated rule per window with at least ten values.

    The limits of a well's windows (one per ``stride_ft``) reach its samples as one map by (well, chunk), and samples are
    repeated for their windows only where they are summed up, so no sample is shuffled once per window.
    """
    keys = ["well_id", "window"]
    rows = wide.select("well_id", "pos", depth, *channels)
    wells = stage(rows.groupBy("well_id").agg(F.min(depth).alias("_a"), F.max(depth).alias("_b"), F.max("pos").alias("last_pos")), "well-depths")
    # Rows of a (well, chunk) lie side by side after a hash join, so tasks sum up whole bins before they shuffle.
    near = attach(rows.select("well_id", "pos", depth), wells.hint("shuffle_hash"), ["well_id"], size=size)
    lim = _in_windows(near, window_ft, stride_ft, depth).groupBy(*keys).agg(
        F.min(depth).alias("lo"), F.max(depth).alias("hi"), F.count(F.lit(1)).alias("n"),
        F.first("w_top").alias("w_top"), F.first("w_bottom").alias("w_bottom")).where(c("n") * len(channels) >= 10)
    lim = stage(lim, "windows")
    listed = lim.groupBy("well_id").agg(F.map_from_entries(F.collect_list(F.struct("window", F.struct("lo", "hi", "n")))).alias("_ws"))
    each = _in_windows(attach(rows, listed.join(wells, "well_id").hint("shuffle_hash"), ["well_id"], size=size, how="inner"), window_ft, stride_ft, depth)
    each = each.withColumn("_l", c("_ws")[c("window")]).where("_l is not null").select(*keys, "pos", depth, *channels, "_l.*")
    fib = fibers(each, channels, n_bins, keys, depth)
    res = residuals(fib, channels, keys, mud_weight)
    g = res.groupBy(*keys).agg(F.exp(-F.avg(c("r_composite") * c("r_composite"))).alias("coherence"), *[F.sum(f"r_{r}").alias(f"_t_{r}") for r in RULES],
                               (F.count(F.lit(1)) + 1).alias("n_bins"))
    return g.join(lim.select(*keys, "w_top", "w_bottom"), keys).select(
        *keys, ((c("w_top") + c("w_bottom")) / 2.0).alias("centre"), c("w_top").alias("top"), c("w_bottom").alias("bottom"), "coherence", "n_bins",
        dominant({r: c(f"_t_{r}") for r in RULES}).alias("dominant"))


def coherence_zones(windows: DataFrame, threshold: float = 0.5, min_points: int = 3) -> DataFrame:
    """Runs of at least three windows on one side of the threshold. A well has a few hundred windows at most."""
    w = Window.partitionBy("well_id").orderBy("window")
    d = windows.withColumn("_l", (c("coherence") >= threshold).cast("int")).withColumn("_ch", F.coalesce((c("_l") != F.lag("_l").over(w)).cast("int"), F.lit(0)))
    d = d.withColumn("run", F.sum("_ch").over(w)).withColumn("_i", F.row_number().over(w))
    r = Window.partitionBy("well_id", "run").orderBy("window")
    dip = (c("coherence") < F.lag("coherence").over(r)) & (c("coherence") < F.lead("coherence").over(r))
    d = d.withColumn("_dip", F.coalesce(dip.cast("int"), F.lit(0)))
    g = d.groupBy("well_id", "run").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("centre", "window").alias("top"), F.max_by("centre", "window").alias("bottom"),
        F.avg("coherence").alias("coherence_mean"), F.first("_l").alias("_l"), F.sum("_dip").alias("waypoints"), F.regr_slope("coherence", "_i").alias("_s"))
    g = g.where(c("n") >= min_points)
    kind = F.when((c("_l") == 1) & (c("waypoints") > 2), "TRANSITIONAL").when(c("_l") == 1, "STABLE").otherwise("ANOMALOUS")
    trend = F.when(c("_s") > 0.005, "HIERARCHIFYING").when(c("_s") < -0.005, "FLATTENING").otherwise("NEUTRAL")
    return g.select("well_id", "top", "bottom", "n", "coherence_mean", kind.alias("character"), "waypoints", trend.alias("trend"))


def fingerprints(windows: DataFrame, anoms: DataFrame, zones: DataFrame, spans: DataFrame) -> DataFrame:
    """Ten-bin coherence histogram, mean, anomaly rate, zone count and most frequent anomaly class per well."""
    b = F.least(F.lit(9), F.floor(c("coherence") * 10)).cast("int")
    h = windows.groupBy("well_id").agg(F.count(F.lit(1)).alias("_n"), F.avg("coherence").alias("mean_coherence"),
                                       *[F.sum((b == i).cast("int")).alias(f"_h{i}") for i in range(10)])
    h = h.select("well_id", "mean_coherence", F.array(*[c(f"_h{i}") / c("_n") for i in range(10)]).alias("histogram"))
    a = anoms.groupBy("well_id", "classification").agg(F.count(F.lit(1)).alias("_k")).groupBy("well_id").agg(
        F.sum("_k").alias("_na"), F.min_by("classification", F.struct((-c("_k")).alias("k"), "classification")).alias("_cls"))
    z = zones.groupBy("well_id").agg(F.count(F.lit(1)).alias("_nz"))
    j = h.join(a, "well_id", "left").join(z, "well_id", "left").join(spans, "well_id")
    return j.select("well_id", "mean_coherence", "histogram", F.least(F.lit(1.0), F.coalesce("_na", F.lit(0)) * 100.0 / F.greatest("span", F.lit(1.0))).alias("anomaly_rate"),
                    F.coalesce("_nz", F.lit(0)).alias("zone_count"), F.coalesce("_cls", F.lit("NONE")).alias("dominant_anomaly"))


def compare_wells(fp: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similarity of the wells named in ``pairs`` (well_a, well_b)."""
    side = lambda s: fp.select(*[c(x).alias(f"{x}_{s}" if x != "well_id" else f"well_{s}") for x in ("well_id", "mean_coherence", "histogram", "anomaly_rate")])
    j = pairs.join(side("a"), "well_a").join(side("b"), "well_b")
    dist = F.sqrt(F.aggregate(F.zip_with("histogram_a", "histogram_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return j.select("well_a", "well_b", (c("mean_coherence_a") / F.greatest("mean_coherence_b", F.lit(1e-6))).alias("coherence_contrast"),
                    (c("anomaly_rate_a") / F.greatest("anomaly_rate_b", F.lit(1e-6))).alias("anomaly_rate_ratio"),
                    F.greatest(F.lit(0.0), F.lit(1.0) - dist / F.sqrt(F.lit(2.0))).alias("similarity"))


def similar_wells(fp: DataFrame, least: float, pivots: int = 4, members: int = 512, part: int = 64) -> DataFrame:
    """well_a, well_b, similarity of all pairs of wells whose similarity is ``least`` or more, without the table of all pairs.

    Wells of equal histograms stand together in blocks of about ``members``, so histograms are compared once per pair of blocks and a pair of
    wells costs no more than its row. Distances to a few pivot wells bound a pair's distance from below (triangle inequality). Blocks are put
    in cells of the distances to the first two pivots, as wide as the largest distance that counts, so a pair lies in neighbouring cells; the
    other pivots are compared before the histograms are. A cell's blocks are dealt in parts, and pairs of parts to all tasks.
    """
    reach = max((1.0 - least) * 2.0 ** 0.5, 1e-9)
    apart = lambda x, y: F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    far = fp.orderBy(F.xxhash64("well_id"), "well_id").select("histogram").limit(pivots).collect()
    to = [apart(c("histogram"), F.array(*[F.lit(x) for x in r["histogram"]])) for r in far]
    w = fp.where("well_id is not null").select("well_id", "histogram")
    n = w.groupBy("histogram").agg(F.ceil(F.count(F.lit(1)) / F.lit(members)).alias("_n"))
    w = w.join(n, "histogram").groupBy("histogram", F.pmod(F.xxhash64("well_id"), "_n").alias("_i")).agg(F.collect_list("well_id").alias("_ids"))
    cell = lambda i: F.coalesce(F.floor(F.get("to", i) / reach), F.lit(0).cast("bigint"))
    w = w.withColumn("to", F.array(*to).cast("array<double>")).withColumns({"_g": cell(0), "_h": cell(1), "_at": F.xxhash64("histogram", "_i")})
    w = stage(w, "well-blocks")
    # Blocks that meet in a cell; cells of few blocks are one part, others have more parts the more blocks they have.
    near = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    around = w.withColumn("_x", F.explode(near)).withColumn("_y", F.explode(near)).withColumns({"_g": c("_g") + c("_x"), "_h": c("_h") + c("_y")}).drop("_x", "_y")
    parts = F.greatest(F.least(F.ceil(F.count(F.lit(1)) / F.lit(part)), F.lit(16)), F.ceil(F.count(F.lit(1)) / F.lit(16 * part)))
    parts = around.groupBy("_g", "_h").agg(parts.alias("_parts")).join(w.select("_g", "_h").distinct(), ["_g", "_h"])
    own, every = F.pmod(c("_at"), c("_parts")), F.explode(F.sequence(F.lit(0).cast("bigint"), c("_parts") - 1))
    side = lambda d, s: d.join(parts, ["_g", "_h"]).select(
        "_g", "_h", own.alias(f"_p{s}"), F.col("_ids").alias(f"_i{s}"), F.col("histogram").alias(f"_h{s}"), F.col("to").alias(f"_t{s}"),
        F.struct("_at", "_i", "histogram").alias(f"_k{s}"), every.alias("_pb" if s == "a" else "_pa"))
    possible = F.forall(F.zip_with("_ta", "_tb", lambda x, y: F.abs(x - y)), lambda d: d <= reach * (1 + 1e-9) + 1e-12)
    similarity = F.greatest(F.lit(0.0), F.lit(1.0) - apart(c("_ha"), c("_hb")) / F.sqrt(F.lit(2.0)))
    j = side(w, "a").join(side(around, "b").hint("shuffle_hash"), ["_g", "_h", "_pa", "_pb"]).where("_ka <= _kb").where(possible)
    j = j.select("_ia", "_ib", (c("_ka") == c("_kb")).alias("_same"), similarity.alias("similarity")).where(c("similarity") >= least)
    j = j.select(F.explode("_ia").alias("_a"), "_ib", "_same", "similarity").select("_a", F.explode("_ib").alias("_b"), "_same", "similarity")
    # Within a block each pair comes in both orders.
    return j.where("_a <> _b and (not _same or _a < _b)").select(F.least("_a", "_b").alias("well_a"), F.greatest("_a", "_b").alias("well_b"), "similarity")


def baseline_contrast(current: DataFrame, baseline: DataFrame, pairs: DataFrame, stride: float = 100.0) -> DataFrame:
    """Coherence of one well over another's on a common depth grid: mean ratio and counts below 0.8 and above 1.2.

    A well's windows (a few hundred) travel as one sorted array, so the interpolation needs no further join.
    """
    arr = lambda df, n: df.groupBy("well_id").agg(F.sort_array(F.collect_list(F.struct(c("centre").alias("x"), c("coherence").alias("v")))).alias(n))
    j = pairs.join(arr(current, "_a").withColumnRenamed("well_id", "well_a"), "well_a").join(arr(baseline, "_b").withColumnRenamed("well_id", "well_b"), "well_b")
    lo = F.greatest(F.get("_a", 0)["x"], F.get("_b", 0)["x"])
    hi = F.least(F.element_at("_a", -1)["x"], F.element_at("_b", -1)["x"])
    steps = F.ceil((hi - lo) / F.lit(stride)).cast("int")
    j = j.withColumn("_lo", lo).where(hi > lo).withColumn("k", F.explode(F.sequence(F.lit(0), steps - 1))).withColumn("x", c("_lo") + c("k") * stride)

    def at(a):
        before = F.element_at(F.filter(a, lambda p: p["x"] <= c("x")), -1)
        after = F.get(F.filter(a, lambda p: p["x"] > c("x")), 0)
        return F.when(after.isNull(), before["v"]).otherwise(before["v"] + (c("x") - before["x"]) / (after["x"] - before["x"]) * (after["v"] - before["v"]))

    j = j.withColumns({"_c": at("_a"), "_d": at("_b")})
    ratio = F.when(c("_d") > 1e-6, c("_c") / c("_d")).when(c("_c") > 1e-6, F.lit(2.0)).otherwise(F.lit(1.0))
    return j.withColumn("_r", ratio).groupBy("well_a", "well_b").agg(
        F.count(F.lit(1)).alias("n_stations"), F.avg("_r").alias("mean_contrast"), F.sum((c("_r") < 0.8).cast("int")).alias("n_worse"),
        F.sum((c("_r") > 1.2).cast("int")).alias("n_better"))


def coherence_label(mean: Column) -> Column:
    return F.when(mean > 0.8, "excellent").when(mean > 0.6, "good").when(mean > 0.4, "fair").otherwise("poor")


def layer_rows(tables: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """Tables of layers (name, table, item columns) as (well_id, layer, item, value)."""
    long = [d.select("well_id", *[c(x).cast("double").alias(x) for x in items]).unpivot(["well_id"], list(items), "item", "value").withColumn("layer", F.lit(n)) for n, d, items in tables]
    return reduce(DataFrame.unionByName, long).select("well_id", "layer", "item", "value")
