"""Depth-bin graphs, bars, curves and coherence along depth."""

from __future__ import annotations

from pyspark.sql import functions as F

from welltide.operators import coherence as C
from welltide.operators import topology as T
from welltide.operators.joins import around_nearest
from welltide.operators.series import bounded
from welltide.operators.stats import quality_summary
from welltide.plans.a_basic import CLOUD_COLS, DEFS_SQL, long_sql, channel_defs, wide_long
from welltide.plans.d_segments import shared, wide_table
from welltide.plans.f_alerts_zones import ZW, zone_wide
from welltide.plans.registry import query
from welltide.operators.projections import to_cloud
from welltide.sources import dims
from welltide.sources.tables import MEAS_SQL, WIDE_CHANNELS, WIDE_SQL, drill_wide, samples, table

c = F.col
BIN_CH = ["gamma_ray", "rop", *[x for x in WIDE_CHANNELS if x not in ("gamma_ray", "rop")]]
N_BINS = 30
STEPS = 50


def vectors(spark, sf):
    return shared(spark, sf, "bin-vectors", lambda: T.bin_vectors(wide_table(spark, sf), BIN_CH, N_BINS))


def distances(spark, sf):
    return shared(spark, sf, "bin-distances", lambda: T.bin_distances(vectors(spark, sf)))


def tree(spark, sf):
    return shared(spark, sf, "spanning-tree", lambda: T.spanning_tree(vectors(spark, sf), distances(spark, sf)))


def curves(spark, sf):
    return shared(spark, sf, "well-curves", lambda: T.well_curves(vectors(spark, sf), distances(spark, sf), tree(spark, sf), STEPS))


def _z(x):
    return f"({x} - avg({x}) OVER w) / CASE WHEN stddev_pop({x}) OVER w = 0 THEN 1 ELSE stddev_pop({x}) OVER w END"


VEC = f"""{WIDE_SQL}, bl AS (SELECT well_id, min(depth_md) AS a, (max(depth_md) - min(depth_md)) / {N_BINS - 1}.0::DOUBLE AS st FROM wide GROUP BY 1),
 br AS (SELECT wide.*, a, st, (depth_md - a) / st AS rel FROM wide JOIN bl USING (well_id)),
 bm AS (SELECT well_id, g.bin, any_value(a) AS a, any_value(st) AS st, {', '.join(f'avg({x}) AS {x}' for x in BIN_CH)} FROM br JOIN generate_series(0, {N_BINS - 1}) g(bin) ON g.bin BETWEEN ceil(rel - 0.5) AND floor(rel + 0.5) GROUP BY 1, 2),
 vec AS (SELECT well_id, bin, a + bin * st AS centre, [{', '.join(_z(x) for x in BIN_CH)}] AS v FROM bm WINDOW w AS (PARTITION BY well_id))"""
DIST = f"{VEC}, dist AS MATERIALIZED (SELECT x.well_id, x.bin AS i, y.bin AS j, list_distance(x.v, y.v) AS d FROM vec x JOIN vec y ON x.well_id = y.well_id AND x.bin < y.bin)"


def closure_sql():
    """Smallest possible largest step between any two bins, by repeated squaring; tree edges equal it."""
    s = "mm0 AS MATERIALIZED (SELECT well_id, i, j, d AS m FROM dist UNION ALL SELECT well_id, j, i, d FROM dist)"
    for r in range(5):
        s += f", mm{r + 1} AS MATERIALIZED (SELECT well_id, i, j, min(m) AS m FROM (SELECT * FROM mm{r} UNION ALL SELECT a.well_id, a.i, b.j, min(greatest(a.m, b.m)) FROM mm{r} a JOIN mm{r} b ON a.well_id = b.well_id AND a.j = b.i AND a.i <> b.j GROUP BY 1, 2, 3) GROUP BY 1, 2, 3)"
    return s + ", tree AS (SELECT dist.well_id, dist.i, dist.j, d AS w FROM dist JOIN mm5 ON mm5.well_id = dist.well_id AND mm5.i = dist.i AND mm5.j = dist.j WHERE d <= m)"


TREE = f"{DIST}, {closure_sql()}"


@query("depth_bin_vectors", f"WITH {VEC} SELECT well_id, bin, centre, v[1] AS gamma_z, v[2] AS rop_z FROM vec", dbl="centre gamma_z rop_z")
def q_vec(spark, sf):
    return vectors(spark, sf).select("well_id", "bin", "centre", c("vec")[0].alias("gamma_z"), c("vec")[1].alias("rop_z"))


@query("weighted_distance", f"""WITH {WIDE_SQL}, {DEFS_SQL}, {long_sql(CLOUD_COLS)}, lim AS (SELECT well_id, min(depth_md) z0, max(depth_md) z1, max(pos) t1 FROM wide GROUP BY 1),
 p AS (SELECT l.well_id, l.pos, l.channel, l.pos / greatest(t1, 1)::DOUBLE AS t, (depth_md - z0) / (z1 - z0) AS z, greatest(0, least(1, (v - low) / (high - low))) AS v FROM long l JOIN wide w USING (well_id, pos) JOIN lim ON lim.well_id = l.well_id JOIN defs ON defs.channel = l.channel),
 q AS (SELECT *, lag(t) OVER w AS t0, lag(z) OVER w AS zz, lag(v) OVER w AS v0 FROM p WINDOW w AS (PARTITION BY well_id, channel ORDER BY pos)) SELECT well_id, channel, avg(sqrt((t - t0) * (t - t0) + (z - zz) * (z - zz) + (v - v0) * (v - v0))) AS mean_step FROM q GROUP BY 1, 2""", dbl="mean_step:6")
def q_wdist(spark, sf):
    p = to_cloud(drill_wide(spark, sf), channel_defs(spark), CLOUD_COLS).select("well_id", "channel", "pos", F.array("t", "z", c("channel_id").cast("double"), "v").alias("p"))
    p = bounded(p, ["well_id", "channel"], 1, 0, lambda w: {"q": F.lag("p").over(w)})
    return p.groupBy("well_id", "channel").agg(F.avg(T.euclidean(c("p"), c("q"), [1.0, 1.0, 0.0, 1.0])).alias("mean_step"))


@query("bin_distances", f"WITH {DIST} SELECT * FROM dist", dbl="d")
def q_dist(spark, sf):
    return distances(spark, sf)


EPS = "eps AS (SELECT well_id, quantile_cont(d, 0.1) AS eps FROM dist GROUP BY 1), ed AS (SELECT dist.* FROM dist JOIN eps USING (well_id) WHERE d <= eps)"


@query("density_epsilon", f"WITH {DIST}, {EPS} SELECT * FROM eps", dbl="eps")
def q_eps(spark, sf):
    return T.epsilon_for_density(distances(spark, sf))


def edges(spark, sf):
    return shared(spark, sf, "edges", lambda: T.edges_within(distances(spark, sf), T.epsilon_for_density(distances(spark, sf))))


@query("threshold_edges", f"WITH {DIST}, {EPS} SELECT * FROM ed", dbl="d")
def q_edges(spark, sf):
    return edges(spark, sf)


@query("nearest_neighbours", f"""WITH {DIST}, b AS (SELECT * FROM dist UNION ALL SELECT well_id, j, i, d FROM dist), k AS (SELECT *, row_number() OVER (PARTITION BY well_id, i ORDER BY d, j) AS r FROM b)
 SELECT well_id, least(i, j) AS i, greatest(i, j) AS j, sum(d) AS weight, count(*) = 2 AS mutual FROM k WHERE r <= 5 GROUP BY 1, 2, 3""", dbl="weight")
def q_knn(spark, sf):
    return T.nearest_bins(distances(spark, sf), 5)


@query("connected_components", f"WITH {DIST}, {EPS}, {closure_sql()} SELECT v.well_id, v.bin AS i, least(v.bin, coalesce(min(m.j), v.bin)) AS label FROM vec v JOIN eps USING (well_id) LEFT JOIN mm5 m ON m.well_id = v.well_id AND m.i = v.bin AND m.m <= eps GROUP BY 1, 2")
def q_cc(spark, sf):
    return T.connected_components(vectors(spark, sf).select("well_id", "bin"), edges(spark, sf))


DEG = "bo AS (SELECT well_id, i, j FROM ed UNION ALL SELECT well_id, j, i FROM ed), dg AS (SELECT v.well_id, v.bin AS i, count(bo.j) AS deg FROM vec v LEFT JOIN bo ON bo.well_id = v.well_id AND bo.i = v.bin GROUP BY 1, 2)"


@query("graph_laplacian", f"WITH {DIST}, {EPS}, {DEG} SELECT well_id, i, i AS j, deg::DOUBLE AS value FROM dg UNION ALL SELECT well_id, i, j, -1.0 FROM bo", dbl="value")
def q_lap(spark, sf):
    return T.graph_laplacian(vectors(spark, sf), edges(spark, sf))


@query("normalised_laplacian", f"WITH {DIST}, {EPS}, {DEG} SELECT well_id, i, i AS j, 1.0::DOUBLE AS value FROM dg UNION ALL SELECT bo.well_id, bo.i, bo.j, -1.0 / sqrt(a.deg * b.deg) FROM bo JOIN dg a ON a.well_id = bo.well_id AND a.i = bo.i JOIN dg b ON b.well_id = bo.well_id AND b.i = bo.j", dbl="value")
def q_nlap(spark, sf):
    return T.graph_laplacian(vectors(spark, sf), edges(spark, sf), True)


@query("component_persistence", f"WITH {TREE} SELECT * FROM tree", dbl="w")
def q_tree(spark, sf):
    return tree(spark, sf).select("well_id", "i", "j", "w")


CURVE = f"""{TREE}, pa AS (SELECT well_id, quantile_cont(d, 0.95) AS eps_max, max(d) AS d_max FROM dist GROUP BY 1), nn AS (SELECT well_id, count(*) AS n FROM vec GROUP BY 1),
 gr AS (SELECT well_id, k, k * (eps_max / {STEPS - 1}.0::DOUBLE) AS eps, eps_max, d_max, n FROM pa JOIN nn USING (well_id), generate_series(0, {STEPS - 1}) g(k)),
 cv AS (SELECT *, n - (SELECT count(*) FROM tree t WHERE t.well_id = gr.well_id AND w > 0 AND w <= eps) AS b0, (SELECT count(*) FROM dist t WHERE t.well_id = gr.well_id AND d > 0 AND d <= eps) AS e FROM gr),
 cu AS (SELECT *, greatest(0, e - n + b0) AS b1 FROM cv)"""


@query("betti_curves", f"WITH {CURVE} SELECT well_id, k, eps, b0, b1 FROM cu", dbl="eps")
def q_betti(spark, sf):
    z = curves(spark, sf).select("well_id", F.posexplode(F.arrays_zip("eps", "b0", "b1")).alias("k", "z"))
    return z.select("well_id", "k", "z.eps", "z.b0", "z.b1")


@query("barcodes", f"WITH {CURVE} SELECT well_id, row_number() OVER (PARTITION BY well_id ORDER BY w) - 1 AS bar, 0.0::DOUBLE AS birth, w AS death, false AS endless FROM tree UNION ALL SELECT well_id, any_value(n) - 1, 0.0, any_value(d_max) * 1.1, true FROM gr GROUP BY 1", dbl="birth death")
def q_bars(spark, sf):
    return T.bars(curves(spark, sf))


@query("bar_betti_curve", f"WITH {CURVE}, g2 AS (SELECT well_id, k, k * d_max / 199.0::DOUBLE AS eps FROM pa, generate_series(0, 199) g(k)) SELECT well_id, k, eps, 1 + (SELECT count(*) FROM tree t WHERE t.well_id = g2.well_id AND w > eps) AS alive FROM g2", dbl="eps")
def q_barcurve(spark, sf):
    return T.bar_curves(curves(spark, sf))


@query("persistence_landscape", f"""WITH {CURVE}, g2 AS (SELECT well_id, k, k * d_max / 49.0::DOUBLE AS t FROM pa, generate_series(0, 49) g(k)),
 tt AS (SELECT g2.well_id, k, CASE WHEN t <= w THEN least(t, w - t) ELSE 0 END AS h, i, j FROM g2 JOIN tree USING (well_id)) SELECT well_id, k, row_number() OVER (PARTITION BY well_id, k ORDER BY h DESC, i, j) - 1 AS level, h AS height FROM tt QUALIFY level < 5""", dbl="height")
def q_land(spark, sf):
    return T.landscapes(curves(spark, sf), 5, 50)


@query("persistence_curve", f"WITH {CURVE} SELECT well_id, k, eps_max + coalesce((SELECT sum(w) FROM tree t WHERE t.well_id = gr.well_id AND w > eps), 0) AS persistence FROM gr", dbl="persistence")
def q_pcurve(spark, sf):
    return T.persistence_curve(curves(spark, sf))


WAY = f"""{CURVE}, dv AS (SELECT well_id, k, abs((b1 - lag(b1) OVER w) / CASE WHEN eps = lag(eps) OVER w THEN 1e-10 ELSE eps - lag(eps) OVER w END) AS dv FROM cu WINDOW w AS (PARTITION BY well_id ORDER BY k)),
 ds AS (SELECT well_id, avg(dv) AS mu, stddev_pop(dv) AS sd, max(dv) AS mx FROM dv GROUP BY 1), wp AS (SELECT well_id, CASE WHEN any_value(mx) = 0 THEN 0 ELSE count(*) FILTER (dv > mu + sd) END AS n_waypoints FROM dv JOIN ds USING (well_id) GROUP BY 1),
 os AS (SELECT well_id, coalesce(min(k) FILTER (b1 > 0), {STEPS - 1}) AS o FROM cu GROUP BY 1), lf AS (SELECT gr.well_id, gr.k, w AS l FROM gr JOIN tree USING (well_id) WHERE w > eps UNION ALL SELECT well_id, k, eps_max FROM gr),
 lr AS (SELECT *, row_number() OVER (PARTITION BY well_id, k ORDER BY l) AS r FROM lf), gi AS (SELECT well_id, k, CASE WHEN count(*) >= 2 AND sum(l) > 0 THEN 2 * sum(r * l) / (count(*) * sum(l)) - (count(*) + 1) / count(*) ELSE 0 END AS g FROM lr GROUP BY 1, 2),
 sg AS (SELECT os.well_id, c.eps AS onset_scale, g0.g AS gini_at_onset, CASE WHEN o > 0 AND o < {STEPS - 1} THEN (g2.g - g1.g) / (c2.eps - c1.eps) ELSE 0 END AS gini_slope FROM os JOIN cu c ON c.well_id = os.well_id AND c.k = o JOIN gi g0 ON g0.well_id = os.well_id AND g0.k = o
   LEFT JOIN gi g1 ON g1.well_id = os.well_id AND g1.k = o - 1 LEFT JOIN gi g2 ON g2.well_id = os.well_id AND g2.k = o + 1 LEFT JOIN cu c1 ON c1.well_id = os.well_id AND c1.k = o - 1 LEFT JOIN cu c2 ON c2.well_id = os.well_id AND c2.k = o + 1),
 way AS (SELECT *, CASE WHEN n_waypoints > 3 THEN 'SPLIT' WHEN gini_slope > 0.01 THEN 'ASCEND' WHEN gini_slope < -0.01 THEN 'REPROBE' ELSE 'HOLD' END AS routing FROM sg JOIN wp USING (well_id))"""


@query("waypoint_routing", f"WITH {WAY} SELECT well_id, onset_scale, n_waypoints, gini_at_onset, gini_slope, routing FROM way", dbl="onset_scale gini_at_onset gini_slope")
def q_way(spark, sf):
    return T.waypoints(curves(spark, sf))


def _members_sql(end):
    """The component of one end of a tree edge before the merge: all bins whose smallest largest step to it is below the edge."""
    return f"SELECT t.well_id, t.i, t.j, t.w, count(m.j) + 1 AS n, least(t.{end}, coalesce(min(m.j), t.{end})) AS lo, greatest(t.{end}, coalesce(max(m.j), t.{end})) AS hi FROM tree t LEFT JOIN mm5 m ON m.well_id = t.well_id AND m.i = t.{end} AND m.j <> t.{end} AND m.m < t.w GROUP BY 1, 2, 3, 4"


@query("regime_boundaries", f"""WITH {TREE}, ri AS ({_members_sql('i')}), rj AS ({_members_sql('j')}), rc AS (SELECT well_id, quantile_cont(w, 0.75) FILTER (w > 0) AS cut FROM tree GROUP BY 1),
 rd AS (SELECT ri.well_id, ri.i, ri.j, ri.w, CASE WHEN ri.n < rj.n THEN ri.n ELSE rj.n END AS n, CASE WHEN ri.n < rj.n THEN ri.lo ELSE rj.lo END AS lo, CASE WHEN ri.n < rj.n THEN ri.hi ELSE rj.hi END AS hi FROM ri JOIN rj USING (well_id, i, j))
 SELECT rd.well_id, rd.i, rd.j, rd.w AS persistence, a.centre AS top, b.centre AS bottom, rd.n AS n_bins FROM rd JOIN rc USING (well_id) JOIN vec a ON a.well_id = rd.well_id AND a.bin = rd.lo JOIN vec b ON b.well_id = rd.well_id AND b.bin = rd.hi WHERE rd.w >= rc.cut""", dbl="persistence top bottom", whole="i j n_bins")
def q_regime(spark, sf):
    return T.regime_boundaries(tree(spark, sf), vectors(spark, sf))


# --- coherence -----------------------------------------------------------------------------------------

FIB = ["gamma_ray", "rop", "wob", "torque", "flow_in", "flow_out", "rpm", "apwd", "choke_pressure", "spp"]
FIB_BINS = 50
_RANGE = {n: (lo, hi) for _, n, _, lo, hi in dims.CHANNEL_DEFS}


def _unit(x):
    lo, hi = _RANGE[x]
    return f"greatest(0, least(1, (avg({x}) - {lo!r}::DOUBLE) / {hi - lo!r}::DOUBLE)) AS {x}"


def res_sql(keys: str) -> str:
    """CTE ``res`` with one row per pair of neighbouring bins from ``fib`` (keys, bin, centre, channels)."""
    on = f"PARTITION BY {keys} ORDER BY bin"
    base = {x: x for x in FIB}
    flow = base | {"flow_out": "flow_in"}
    hyd = base | {"apwd": "apwd + cp * choke_pressure"}
    mse = base | {"rop": "rop + 0.1 * wob + 0.05 * torque + 0.03 * rpm"}
    gam = base | {"rop": "rop - 0.15 * gamma_ray", "gamma_ray": "gamma_ray - 0.075 * rop"}
    rules = {"smoothness": base, "flow_conservation": flow, "hydraulics": hyd, "rop_mse": mse, "gamma_rop": gam}
    comp = {x: " + ".join(f"{w} * ({rules[r][x]})" for r, w in C.WEIGHTS.items()) for x in FIB}
    norm = lambda m: "sqrt(" + " + ".join(f"pow({m[x]} - n_{x}, 2)" for x in FIB) + ")"
    return f"""fl AS (SELECT *, lead(centre) OVER w AS nc, {', '.join(f'lead({x}) OVER w AS n_{x}' for x in FIB)} FROM fib WINDOW w AS ({on})),
 fc AS (SELECT *, least(0.5, 0.052 * 10 * abs(nc - centre) / 15000.0) AS cp FROM fl WHERE nc IS NOT NULL),
 res AS (SELECT {keys}, bin AS edge, (centre + nc) / 2 AS mid, centre AS from_centre, nc AS to_centre, {', '.join(f'{norm(m)} AS r_{r}' for r, m in rules.items())}, {norm(comp)} AS r_composite FROM fc)"""


FIB_SQL = f"""fm AS (SELECT well_id, min(depth_md) AS lo, (max(depth_md) - min(depth_md)) / {FIB_BINS} AS bw FROM zw GROUP BY 1), fr AS (SELECT zw.*, lo, bw, least({FIB_BINS - 1}, floor((depth_md - lo) / bw))::INT AS bin FROM zw JOIN fm USING (well_id)),
 fib AS (SELECT well_id, bin, any_value(lo) + (bin + 0.5) * any_value(bw) AS centre, {', '.join(_unit(x) for x in FIB)} FROM fr GROUP BY 1, 2)"""
RES = f"{WIDE_SQL}, {ZW}, {FIB_SQL}, {res_sql('well_id')}"


def fibers(spark, sf):
    return shared(spark, sf, "fibers", lambda: C.fibers(zone_wide(spark, sf), FIB, FIB_BINS))


def residuals(spark, sf):
    return shared(spark, sf, "residuals", lambda: C.residuals(fibers(spark, sf), FIB))


@query("fiber_bins", f"WITH {WIDE_SQL}, {ZW}, {FIB_SQL} SELECT well_id, bin, centre, {', '.join(FIB)} FROM fib", dbl="centre " + " ".join(FIB), whole="bin")
def q_fib(spark, sf):
    return fibers(spark, sf)


RCOLS = [f"r_{r}" for r in C.RULES] + ["r_composite"]


@query("transport_residuals", f"WITH {RES} SELECT well_id, edge, mid, {', '.join(RCOLS)} FROM res", dbl="mid " + " ".join(RCOLS), whole="edge")
def q_res(spark, sf):
    return residuals(spark, sf).drop("from_centre", "to_centre")


DEF_SQL = """df AS (SELECT f.well_id, f.bin, f.centre, coalesce((SELECT sum(r_composite * r_composite) FROM res r WHERE r.well_id = f.well_id AND (r.from_centre = f.centre OR r.to_centre = f.centre)), 0) AS defect FROM fib f),
 am AS (SELECT *, avg(defect) OVER w AS mu, stddev_pop(defect) OVER w AS sd FROM df WINDOW w AS (PARTITION BY well_id)), an AS (SELECT well_id, bin, centre AS depth, (defect - mu) / sd AS severity FROM am WHERE sd >= 1e-12 AND defect > mu + 2 * sd)"""


@query("vertex_defects", f"WITH {RES}, {DEF_SQL} SELECT well_id, bin, centre, defect FROM df", dbl="centre defect", whole="bin")
def q_def(spark, sf):
    return C.defects(residuals(spark, sf), fibers(spark, sf))


def anoms(spark, sf):
    return C.anomalies(C.defects(residuals(spark, sf), fibers(spark, sf)))


@query("coherence_anomalies", f"WITH {RES}, {DEF_SQL} SELECT * FROM an", dbl="depth severity", whole="bin")
def q_anom(spark, sf):
    return anoms(spark, sf)


def dom_sql(agg="{}"):
    names = list(C.RULES)
    v = [agg.format(f"r_{r}") for r in names]
    return "CASE greatest(" + ", ".join(v) + ") " + " ".join(f"WHEN {x} THEN '{r}'" for r, x in zip(names, v)) + " END"


CLS = f"""ae AS (SELECT an.*, res.*  EXCLUDE (well_id) FROM an JOIN res ON res.well_id = an.well_id QUALIFY row_number() OVER (PARTITION BY an.well_id, an.bin ORDER BY abs(mid - depth), edge) = 1),
 ad AS (SELECT well_id, bin, depth, severity, {dom_sql()} AS dominant FROM ae),
 af AS (SELECT ad.*, (SELECT avg(flow_in) FROM zw WHERE zw.well_id = ad.well_id AND abs(depth_md - depth) < 200) AS fi, (SELECT avg(flow_out) FROM zw WHERE zw.well_id = ad.well_id AND abs(depth_md - depth) < 200) AS fo FROM ad),
 ac AS (SELECT well_id, bin, depth, severity, dominant, CASE dominant WHEN 'flow_conservation' THEN CASE WHEN fo > fi * 1.02 THEN 'KICK' WHEN fo < fi * 0.98 THEN 'LOSS' ELSE 'UNKNOWN' END WHEN 'hydraulics' THEN 'LOSS' WHEN 'smoothness' THEN 'EQUIPMENT' ELSE 'FORMATION_CHANGE' END AS classification FROM af)"""


def classified(spark, sf):
    return shared(spark, sf, "classified", lambda: C.classify_anomalies(anoms(spark, sf), residuals(spark, sf), zone_wide(spark, sf)))


@query("classified_anomalies", f"WITH {RES}, {DEF_SQL}, {CLS} SELECT * FROM ac", dbl="depth severity", whole="bin")
def q_cls(spark, sf):
    return classified(spark, sf)


WB = 20
WIN = f"""{WIDE_SQL}, {ZW}, wl AS (SELECT well_id, min(depth_md) AS a, max(depth_md) AS b FROM zw GROUP BY 1),
 wt AS (SELECT well_id, k AS "window", CASE WHEN b - a < 500 THEN a ELSE a + 100.0 * k END AS w_top, CASE WHEN b - a < 500 THEN b ELSE least(a + 100.0 * k + 500, b) END AS w_bottom FROM wl, generate_series(0, 2000) g(k) WHERE (b - a < 500 AND k = 0) OR (b - a >= 500 AND a + 100.0 * k + 500 <= b + 50)),
 wr AS (SELECT zw.*, "window", w_top, w_bottom, min(depth_md) OVER q AS lo, max(depth_md) OVER q AS hi, count(*) OVER q AS np FROM zw JOIN wt ON wt.well_id = zw.well_id AND depth_md BETWEEN w_top AND w_bottom WINDOW q AS (PARTITION BY zw.well_id, "window")),
 wb AS (SELECT *, (hi - lo) / {WB} AS bw FROM wr WHERE np * {len(FIB)} >= 10), wx AS (SELECT *, least({WB - 1}, floor((depth_md - lo) / bw))::INT AS bin FROM wb),
 fib AS (SELECT well_id, "window", bin, any_value(lo) + (bin + 0.5) * any_value(bw) AS centre, {', '.join(_unit(x) for x in FIB)} FROM wx GROUP BY 1, 2, 3), {res_sql('well_id, "window"')},
 wc AS (SELECT res.well_id, res."window", (any_value(w_top) + any_value(w_bottom)) / 2 AS centre, any_value(w_top) AS top, any_value(w_bottom) AS bottom, exp(-avg(r_composite * r_composite)) AS coherence, count(*) + 1 AS n_bins, {dom_sql('sum({})')} AS dominant
   FROM res JOIN wt ON wt.well_id = res.well_id AND wt."window" = res."window" GROUP BY 1, 2)"""


def windows(spark, sf):
    return shared(spark, sf, "coherence-windows", lambda: C.window_coherence(zone_wide(spark, sf), FIB, WB))


@query("window_coherence", f"WITH {WIN} SELECT * FROM wc", dbl="centre top bottom coherence")
def q_win(spark, sf):
    return windows(spark, sf)


# Threshold near the middle of these wells' coherence, so that both kinds of zone occur.
LEVEL = 0.82
ZON = f"""z1 AS (SELECT *, coherence >= {LEVEL} AS l, row_number() OVER w AS i, CASE WHEN (coherence >= {LEVEL}) IS DISTINCT FROM lag(coherence >= {LEVEL}) OVER w THEN 1 ELSE 0 END AS ch FROM wc WINDOW w AS (PARTITION BY well_id ORDER BY "window")),
 z2 AS (SELECT *, sum(ch) OVER (PARTITION BY well_id ORDER BY "window") AS run FROM z1), z3 AS (SELECT *, (coherence < lag(coherence) OVER r AND coherence < lead(coherence) OVER r)::INT AS dip FROM z2 WINDOW r AS (PARTITION BY well_id, run ORDER BY "window")),
 cz AS (SELECT well_id, min_by(centre, "window") AS top, max_by(centre, "window") AS bottom, count(*) AS n, avg(coherence) AS coherence_mean, CASE WHEN any_value(l) AND coalesce(sum(dip), 0) > 2 THEN 'TRANSITIONAL' WHEN any_value(l) THEN 'STABLE' ELSE 'ANOMALOUS' END AS character, coalesce(sum(dip), 0) AS waypoints,
   CASE WHEN regr_slope(coherence, i) > 0.005 THEN 'HIERARCHIFYING' WHEN regr_slope(coherence, i) < -0.005 THEN 'FLATTENING' ELSE 'NEUTRAL' END AS trend FROM z3 GROUP BY well_id, run HAVING count(*) >= 3)"""


def zones(spark, sf):
    return C.coherence_zones(windows(spark, sf), LEVEL)


@query("coherence_zones", f"WITH {WIN}, {ZON} SELECT * FROM cz", dbl="top bottom coherence_mean", whole="waypoints")
def q_zones(spark, sf):
    return zones(spark, sf)


FPCLS = f"""{FIB_SQL.replace('fib AS', 'fibw AS')}"""
FP = f"""{WIN}, {ZON}, fh AS (SELECT well_id, avg(coherence) AS mean_coherence, [{', '.join(f'sum((least(9, floor(coherence * 10)) = {i})::INT) / count(*)' for i in range(10))}] AS histogram FROM wc GROUP BY 1), fz AS (SELECT well_id, count(*) AS zone_count FROM cz GROUP BY 1),
 fp AS (SELECT fh.well_id, mean_coherence, histogram, coalesce(zone_count, 0) AS zone_count FROM fh LEFT JOIN fz USING (well_id))"""


def prints(spark, sf):
    spans = zone_wide(spark, sf).groupBy("well_id").agg((F.max("depth_md") - F.min("depth_md")).alias("span"))
    return shared(spark, sf, "fingerprints", lambda: C.fingerprints(windows(spark, sf), classified(spark, sf), zones(spark, sf), spans))


@query("well_fingerprints", f"WITH {FP} SELECT well_id, mean_coherence, zone_count, histogram[8] AS share_70_80, histogram[9] AS share_80_90 FROM fp", dbl="mean_coherence share_70_80 share_80_90")
def q_fp(spark, sf):
    return prints(spark, sf).select("well_id", "mean_coherence", "zone_count", c("histogram")[7].alias("share_70_80"), c("histogram")[8].alias("share_80_90"))


@query("anomaly_rates", f"WITH {RES}, {DEF_SQL}, {CLS}, s AS (SELECT well_id, max(depth_md) - min(depth_md) AS span FROM zw GROUP BY 1), k AS (SELECT well_id, classification, count(*) AS k FROM ac GROUP BY 1, 2) SELECT s.well_id, least(1, coalesce((SELECT sum(k) FROM k WHERE k.well_id = s.well_id), 0) * 100.0 / greatest(span, 1)) AS anomaly_rate, coalesce((SELECT classification FROM k WHERE k.well_id = s.well_id ORDER BY k DESC, classification LIMIT 1), 'NONE') AS dominant_anomaly FROM s", dbl="anomaly_rate")
def q_rates(spark, sf):
    return prints(spark, sf).select("well_id", "anomaly_rate", "dominant_anomaly")


def neighbours_of(spark, sf):
    """Each well paired with the next one."""
    w = table(spark, sf, "supplier").select(c("s_suppkey").alias("well_a"))
    return w.withColumn("well_b", c("well_a") + 1)


@query("well_comparison", f"WITH {FP} SELECT a.well_id AS well_a, b.well_id AS well_b, a.mean_coherence / greatest(b.mean_coherence, 1e-6) AS coherence_contrast, greatest(0, 1 - list_distance(a.histogram, b.histogram) / sqrt(2)) AS similarity FROM fp a JOIN fp b ON b.well_id = a.well_id + 1", dbl="coherence_contrast similarity")
def q_cmp(spark, sf):
    return C.compare_wells(prints(spark, sf), neighbours_of(spark, sf)).drop("anomaly_rate_ratio")


@query("well_similarity", f"WITH {FP}, sm AS (SELECT a.well_id AS well_a, b.well_id AS well_b, greatest(0, 1 - list_distance(a.histogram, b.histogram) / sqrt(2)) AS similarity FROM fp a JOIN fp b ON a.well_id < b.well_id) SELECT * FROM sm WHERE similarity >= 0.93", dbl="similarity")
def q_similar(spark, sf):
    """All pairs of wells with fingerprints of similarity 0.93 or more."""
    return C.similar_wells(prints(spark, sf), 0.93)


@query("baseline_contrast", f"""WITH {WIN}, pr AS (SELECT s_suppkey AS wa, s_suppkey + 1 AS wb FROM supplier), li AS (SELECT well_id, min(centre) AS a, max(centre) AS b FROM wc GROUP BY 1),
 g AS (SELECT wa, wb, greatest(x.a, y.a) + 100.0 * k AS x FROM pr JOIN li x ON x.well_id = wa JOIN li y ON y.well_id = wb, generate_series(0, 2000) g(k) WHERE greatest(x.a, y.a) + 100.0 * k < least(x.b, y.b)),
 ip AS (SELECT g.*, w AS side, (SELECT max_by(coherence, centre) FROM wc WHERE well_id = w AND centre <= x) AS v0, (SELECT max(centre) FROM wc WHERE well_id = w AND centre <= x) AS x0, (SELECT min_by(coherence, centre) FROM wc WHERE well_id = w AND centre > x) AS v1, (SELECT min(centre) FROM wc WHERE well_id = w AND centre > x) AS x1
   FROM g, (SELECT unnest([0, 1]) AS s) s, LATERAL (SELECT CASE s WHEN 0 THEN wa ELSE wb END AS w)),
 iv AS (SELECT wa, wb, x, max(CASE WHEN side = wa THEN CASE WHEN x1 IS NULL THEN v0 ELSE v0 + (x - x0) / (x1 - x0) * (v1 - v0) END END) AS ca, max(CASE WHEN side = wb THEN CASE WHEN x1 IS NULL THEN v0 ELSE v0 + (x - x0) / (x1 - x0) * (v1 - v0) END END) AS cb FROM ip GROUP BY 1, 2, 3)
 SELECT wa AS well_a, wb AS well_b, count(*) AS n_stations, avg(ca / cb) AS mean_contrast, sum((ca / cb < 0.8)::INT) AS n_worse, sum((ca / cb > 1.2)::INT) AS n_better FROM iv GROUP BY 1, 2""", dbl="mean_contrast", whole="n_better n_worse")
def q_contrast(spark, sf):
    return C.baseline_contrast(windows(spark, sf), windows(spark, sf), neighbours_of(spark, sf))


PV = "pv AS (SELECT o_custkey % 150 AS well_id, o_orderkey AS probe_id, 5000.05::DOUBLE + o_orderkey % 1000 AS depth FROM orders)"


@query("channel_vectors_at", f"""WITH {MEAS_SQL}, {PV}, s AS (SELECT well_id, depth, value, wits_id FROM meas),
 b AS (SELECT p.*, s.depth AS bd FROM pv p ASOF LEFT JOIN s ON p.well_id = s.well_id AND p.depth >= s.depth), f AS (SELECT b.*, s.depth AS fd FROM b ASOF LEFT JOIN s ON b.well_id = s.well_id AND b.depth <= s.depth),
 n AS (SELECT *, least(coalesce(depth - bd, 1e18), coalesce(fd - depth, 1e18)) AS gap FROM f) SELECT n.well_id, probe_id, wits_id, avg(value) AS value, count(*) AS n FROM n JOIN s ON s.well_id = n.well_id AND abs(s.depth - n.depth) <= gap + 0.5 GROUP BY 1, 2, 3""", dbl="value")
def q_vector_at(spark, sf):
    m = samples(spark, sf).select("well_id", "depth", "value", "wits_id")
    o = table(spark, sf, "orders")
    p = o.select((c("o_custkey") % 150).alias("well_id"), c("o_orderkey").alias("probe_id"), (F.lit(5000.05) + c("o_orderkey") % 1000).alias("depth"))
    j = around_nearest(p, m, ["well_id"], "probe_id", "depth", F.floor(c("depth") / F.lit(50.0)), 0.5)
    return j.groupBy("well_id", "probe_id", "wits_id").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))


@query("layered_summary", f"""WITH {FP}, q AS (SELECT well_id, count(*) AS n, avg(0.052 * 10 * depth_tvd) AS hp, avg(480.0 * torque * rpm / (8.5 * 8.5 * rop) + 4.0 * wob * 1000 / (pi() * 8.5 * 8.5)) AS mse FROM zw GROUP BY 1)
 SELECT fp.well_id, 1.0::DOUBLE AS quality_score, hp AS mean_hydrostatic, mse AS mean_mse, mean_coherence, zone_count, CASE WHEN mean_coherence > 0.8 THEN 'excellent' WHEN mean_coherence > 0.6 THEN 'good' WHEN mean_coherence > 0.4 THEN 'fair' ELSE 'poor' END AS label FROM fp JOIN q USING (well_id)""", dbl="quality_score mean_hydrostatic mean_mse:3 mean_coherence")
def q_layers(spark, sf):
    """Measurement, physics, coherence and zone layers side by side, one row per well."""
    from welltide.functions import hydraulics as H
    from welltide.functions import rock as R
    w = zone_wide(spark, sf)
    l0 = quality_summary(w.unpivot(["well_id", "pos"], FIB, "channel", "v")).select("well_id", "quality_score")
    l1 = w.groupBy("well_id").agg(F.avg(H.hydrostatic(10.0, c("depth_tvd"))).alias("mean_hydrostatic"),
                                  F.avg(R.mse(c("wob") * 1000.0, c("torque"), c("rpm"), c("rop"), 8.5)).alias("mean_mse"))
    l2 = prints(spark, sf).select("well_id", "mean_coherence", "zone_count")
    return l0.join(l1, "well_id").join(l2, "well_id").withColumn("label", C.coherence_label(c("mean_coherence")))


@query("layer_tables", f"""WITH {FP}, q AS (SELECT well_id, avg(0.052 * 10 * depth_tvd) AS hp, avg(480.0 * torque * rpm / (8.5 * 8.5 * rop) + 4.0 * wob * 1000 / (pi() * 8.5 * 8.5)) AS mse, count(*) AS n FROM zw GROUP BY 1)
 SELECT fp.well_id, unnest(['measurement', 'measurement', 'physics', 'physics', 'coherence', 'coherence', 'label']) AS layer, unnest(['quality_score', 'n_channels', 'mean_hydrostatic', 'mean_mse', 'mean_coherence', 'zone_count', 'coherence_label']) AS item,
  unnest([1.0::DOUBLE, {len(FIB)}.0::DOUBLE, hp, mse, mean_coherence, zone_count::DOUBLE, CASE WHEN mean_coherence > 0.8 THEN 4.0 WHEN mean_coherence > 0.6 THEN 3.0 WHEN mean_coherence > 0.4 THEN 2.0 ELSE 1.0 END]) AS value FROM fp JOIN q USING (well_id)""", dbl="value:3")
def q_layer_tables(spark, sf):
    """The four layers as one long table; labels by grade (4 excellent, 1 poor)."""
    from welltide.functions import hydraulics as H
    from welltide.functions import rock as R
    w = zone_wide(spark, sf)
    grade = F.create_map(*[F.lit(x) for x in ("excellent", 4.0, "good", 3.0, "fair", 2.0, "poor", 1.0)])
    measured = quality_summary(w.unpivot(["well_id", "pos"], FIB, "channel", "v"))
    physics = w.groupBy("well_id").agg(F.avg(H.hydrostatic(10.0, c("depth_tvd"))).alias("mean_hydrostatic"), F.avg(R.mse(c("wob") * 1000.0, c("torque"), c("rpm"), c("rop"), 8.5)).alias("mean_mse"))
    fp = prints(spark, sf)
    tables = [("measurement", measured, ["quality_score", "n_channels"]), ("physics", physics, ["mean_hydrostatic", "mean_mse"]), ("coherence", fp, ["mean_coherence", "zone_count"]),
              ("label", fp.select("well_id", grade[C.coherence_label(c("mean_coherence"))].alias("coherence_label")), ["coherence_label"])]
    return C.layer_rows(tables)
