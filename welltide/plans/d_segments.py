"""Rig states, runs, transitions and stands."""

from __future__ import annotations

from pyspark.sql import functions as F

from welltide.operators import segment as G
from welltide.operators import stats as S
from welltide.operators.quantiles import exact_percentiles
from welltide.operators.series import bounded, carry
from welltide.plans.registry import query
from welltide.session import input_mark, stage
from welltide.sources.tables import WIDE_SQL, drill_wide

c = F.col
MIN_SAMPLES = 10
HOLD = max(3, MIN_SAMPLES // 10)

_tables: dict[tuple, object] = {}


def shared(spark, sf, label, build):
    """A staged table several queries read, written once per application and state of the data folder."""
    key = (spark.sparkContext.applicationId, sf, input_mark(spark, sf), label)
    if key not in _tables:
        _tables[key] = stage(build(), label)
    return _tables[key]


def wide_table(spark, sf):
    return shared(spark, sf, "drill-wide", lambda: drill_wide(spark, sf))


def states(spark, sf):
    return shared(spark, sf, "rig-states", lambda: G.detect_states(wide_table(spark, sf), MIN_SAMPLES, keep=["depth_md"]))


STEP_SQL = f"""{WIDE_SQL}, base AS (SELECT *, coalesce(CASE WHEN pos = 0 THEN lead(block_position) OVER w - block_position ELSE block_position - lag(block_position) OVER w END, 0) AS step
  FROM wide WINDOW w AS (PARTITION BY well_id ORDER BY pos))"""


def bimodal_sql(src: str, p: str = "") -> str:
    """CTEs ending in ``{p}thr(well_id, ch, threshold)`` from ``src(well_id, ch, v)``."""
    return f"""{p}h0 AS (SELECT well_id, ch, count(v) AS n, min(v) AS mn, max(v) AS mx, least(100, greatest(10, ceil(log2(count(v))) + 1))::INT AS nb, quantile_cont(v, 0.5) AS med FROM {src} GROUP BY 1, 2),
 {p}h1 AS (SELECT well_id, ch, CASE WHEN mx > mn THEN least(nb - 1, floor((v - mn) / (mx - mn) * nb))::INT ELSE 0 END AS b, count(*) AS k FROM {src} JOIN {p}h0 USING (well_id, ch) GROUP BY 1, 2, 3),
 {p}h2 AS (SELECT d.well_id, d.ch, d.nb, d.mn, d.mx, g.b, coalesce(k, 0) AS k FROM {p}h0 d JOIN generate_series(0, 99) g(b) ON g.b < d.nb LEFT JOIN {p}h1 USING (well_id, ch, b)),
 {p}h3 AS (SELECT *, (coalesce(lag(k) OVER w, 0) + 2 * k + coalesce(lead(k) OVER w, 0)) / 4.0::DOUBLE AS s FROM {p}h2 WINDOW w AS (PARTITION BY well_id, ch ORDER BY b)),
 {p}h4 AS (SELECT *, s >= lag(s) OVER w AND s >= lead(s) OVER w AS pk FROM {p}h3 WINDOW w AS (PARTITION BY well_id, ch ORDER BY b)),
 {p}h5 AS (SELECT well_id, ch, b, row_number() OVER (PARTITION BY well_id, ch ORDER BY s DESC, b DESC) AS rn FROM {p}h4 WHERE pk AND b BETWEEN 1 AND nb - 2),
 {p}h6 AS (SELECT well_id, ch, min(b) AS p1, max(b) AS p2 FROM {p}h5 WHERE rn <= 2 GROUP BY 1, 2 HAVING count(*) = 2 AND max(b) - min(b) >= 2),
 {p}h7 AS (SELECT h.well_id, h.ch, mn + (b + 0.5) * (mx - mn) / nb AS cut FROM {p}h3 h JOIN {p}h6 USING (well_id, ch) WHERE b BETWEEN p1 AND p2 AND mx > mn QUALIFY row_number() OVER (PARTITION BY h.well_id, h.ch ORDER BY s, b) = 1),
 {p}h8 AS (SELECT l.well_id, l.ch, any_value(cut) AS cut, least(sum((v < cut)::INT), sum((v >= cut)::INT)) / count(*) AS mi FROM {src} l JOIN {p}h7 USING (well_id, ch) GROUP BY 1, 2),
 {p}thr AS (SELECT well_id, ch, CASE WHEN mx = mn THEN mn WHEN mi >= 0.05 THEN cut ELSE med END AS threshold FROM {p}h0 LEFT JOIN {p}h8 USING (well_id, ch))"""


THR_SQL = f"""{STEP_SQL}, l3 AS (SELECT well_id, 'pump' AS ch, flow_in AS v FROM base UNION ALL SELECT well_id, 'rot', rpm FROM base UNION ALL SELECT well_id, 'load', abs(wob) FROM base), {bimodal_sql('l3')}"""


def held_sql(x):
    return f"coalesce(last_value(CASE WHEN pos = 0 OR ({x}1 = {x}2 AND pos >= {HOLD - 2}) THEN {x} END IGNORE NULLS) OVER u)"


RAW_SQL = f"""{THR_SQL}, db AS (SELECT well_id, quantile_cont(abs(step), 0.25) * 0.5 AS dead FROM base WHERE abs(step) > 0 GROUP BY 1),
 r0 AS (SELECT b.*, CASE WHEN a.threshold = 0 THEN flow_in > 0 ELSE flow_in >= a.threshold END AS pu, CASE WHEN r.threshold = 0 THEN rpm > 0 ELSE rpm >= r.threshold END AS ro, w.threshold AS load_thr,
   CASE WHEN step > coalesce(dead, 0) THEN 'UP' WHEN step < -coalesce(dead, 0) THEN 'DOWN' ELSE 'STATIC' END AS motion
  FROM base b LEFT JOIN db USING (well_id) JOIN thr a ON a.well_id = b.well_id AND a.ch = 'pump' JOIN thr r ON r.well_id = b.well_id AND r.ch = 'rot' JOIN thr w ON w.well_id = b.well_id AND w.ch = 'load'),
 r1 AS (SELECT *, min(pu) OVER f AS pu1, max(pu) OVER f AS pu2, min(ro) OVER f AS ro1, max(ro) OVER f AS ro2 FROM r0 WINDOW f AS (PARTITION BY well_id ORDER BY pos ROWS BETWEEN {HOLD - 2} PRECEDING AND CURRENT ROW)),
 held AS (SELECT *, {held_sql('pu')} AS p, {held_sql('ro')} AS r FROM r1 WINDOW u AS (PARTITION BY well_id ORDER BY pos)),
 raw AS (SELECT *, CASE WHEN p AND r THEN CASE motion WHEN 'DOWN' THEN 'drilling' WHEN 'UP' THEN 'reaming' ELSE 'circulating' END WHEN p THEN CASE motion WHEN 'DOWN' THEN 'sliding' ELSE 'circulating' END
   WHEN NOT r THEN CASE motion WHEN 'STATIC' THEN 'static' ELSE 'tripping' END ELSE 'unknown' END AS st FROM held)"""
CONN_SQL = f"""{RAW_SQL}, c0 AS (SELECT *, st IN ('tripping', 'static') AS idle FROM raw), c1 AS (SELECT *, CASE WHEN idle IS DISTINCT FROM lag(idle) OVER (PARTITION BY well_id ORDER BY pos) THEN 1 ELSE 0 END AS ch FROM c0),
 c2 AS (SELECT *, sum(ch) OVER (PARTITION BY well_id ORDER BY pos) AS grp FROM c1),
 c3 AS (SELECT well_id, grp, bool_or(st = 'tripping') AND min(pos) FILTER (motion = 'UP') < max(pos) FILTER (motion = 'DOWN') AS conn FROM c2 WHERE idle GROUP BY 1, 2),
 conn AS (SELECT c2.*, CASE WHEN idle AND coalesce(c3.conn, false) THEN 'connection' ELSE st END AS s5 FROM c2 LEFT JOIN c3 USING (well_id, grp))"""
FINE_SQL = f"""{CONN_SQL}, slow AS (SELECT well_id, quantile_cont(abs(step), 0.25) AS slow FROM raw WHERE st = 'drilling' AND abs(step) > 0 GROUP BY 1),
 fine AS (SELECT conn.*, CASE WHEN s5 = 'sliding' AND abs(wob) < load_thr THEN 'washing' WHEN s5 = 'drilling' AND abs(step) < slow THEN 'backreaming_down' ELSE s5 END AS s7 FROM conn LEFT JOIN slow USING (well_id))"""
STATES_SQL = f"""{FINE_SQL}, d1 AS (SELECT *, CASE WHEN s7 IS DISTINCT FROM lag(s7) OVER (PARTITION BY well_id ORDER BY pos) THEN 1 ELSE 0 END AS c7 FROM fine),
 d2 AS (SELECT *, sum(c7) OVER (PARTITION BY well_id ORDER BY pos) AS rn7 FROM d1),
 d3 AS (SELECT well_id, rn7, any_value(s7) AS s7, min(pos) AS a, count(*) AS len FROM d2 GROUP BY 1, 2),
 d4 AS (SELECT *, last_value(CASE WHEN len >= {MIN_SAMPLES} THEN s7 END IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY rn7) AS kept,
   min(CASE WHEN len >= {MIN_SAMPLES} THEN a END) OVER (PARTITION BY well_id) AS lp, min_by(s7, CASE WHEN len >= {MIN_SAMPLES} THEN a END) OVER (PARTITION BY well_id) AS ls, max(CASE WHEN rn7 = 2 THEN s7 END) OVER (PARTITION BY well_id) AS second FROM d3),
 states AS (SELECT d2.* EXCLUDE (s7), d2.s7 AS before_debounce, CASE WHEN kept IS NOT NULL THEN kept WHEN lp IS NOT NULL AND lp < {MIN_SAMPLES} THEN ls ELSE coalesce(second, d4.s7) END AS state FROM d2 JOIN d4 USING (well_id, rn7))"""


@query("bimodal_thresholds", f"WITH {THR_SQL} SELECT * FROM thr", dbl="threshold")
def q_thr(spark, sf):
    w = drill_wide(spark, sf).select("well_id", "pos", c("flow_in").alias("pump"), c("rpm").alias("rot"), F.abs("wob").alias("load"))
    return G.bimodal_thresholds(w.unpivot(["well_id", "pos"], ["pump", "rot", "load"], "ch", "v"), ["well_id", "ch"], "v").drop("last_pos")


@query("block_motion", f"WITH {RAW_SQL} SELECT well_id, pos, step, motion FROM raw", dbl="step:6")
def q_motion(spark, sf):
    s = G.block_steps(wide_table(spark, sf).select("well_id", "pos", "block_position"))
    par = s.groupBy("well_id").agg(F.max("pos").alias("last_pos")).join(G.motion_dead_band(s), "well_id", "left")
    return G.attach(s, par, ["well_id"]).select("well_id", "pos", "step", G.block_motion(c("step"), c("dead_band")).alias("motion"))


@query("hysteresis", f"""WITH {WIDE_SQL}, h0 AS (SELECT well_id, pos, wob > 25 AS hi, min(wob > 25) OVER f AS a, max(wob > 25) OVER f AS b FROM wide WINDOW f AS (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
 SELECT well_id, pos, hi, last_value(CASE WHEN pos = 0 OR (a = b AND pos >= 1) THEN hi END IGNORE NULLS) OVER (PARTITION BY well_id ORDER BY pos) AS hi_held FROM h0""")
def q_hyst(spark, sf):
    return G.hysteresis(drill_wide(spark, sf).select("well_id", "pos", (c("wob") > 25).alias("hi")), ["hi"], 3)


@query("sample_states", f"WITH {WIDE_SQL} SELECT well_id, p, r, m, CASE WHEN p AND r THEN CASE m WHEN 'DOWN' THEN 'drilling' WHEN 'UP' THEN 'reaming' ELSE 'circulating' END WHEN p THEN CASE m WHEN 'DOWN' THEN 'sliding' ELSE 'circulating' END WHEN NOT r THEN CASE m WHEN 'STATIC' THEN 'static' ELSE 'tripping' END ELSE 'unknown' END AS state, count(*) AS n FROM (SELECT well_id, flow_in > 100 AS p, rpm > 10 AS r, CASE WHEN wob < 15 THEN 'UP' WHEN wob > 35 THEN 'DOWN' ELSE 'STATIC' END AS m FROM wide) GROUP BY 1, 2, 3, 4, 5")
def q_sample(spark, sf):
    d = drill_wide(spark, sf).select("well_id", (c("flow_in") > 100).alias("p"), (c("rpm") > 10).alias("r"),
                                     F.when(c("wob") < 15, "UP").when(c("wob") > 35, "DOWN").otherwise("STATIC").alias("m"))
    return d.groupBy("well_id", "p", "r", "m", G.sample_state(c("p"), c("r"), c("m")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("rig_states", f"WITH {STATES_SQL} SELECT well_id, pos, state FROM states")
def q_states(spark, sf):
    return states(spark, sf).select("well_id", "pos", "state")


@query("connection_reclass", f"WITH {WIDE_SQL}, raw AS (SELECT well_id, pos, CASE WHEN wob < 20 THEN 'UP' WHEN wob > 30 THEN 'DOWN' ELSE 'STATIC' END AS motion, CASE WHEN pos % 40 < 25 THEN 'drilling' WHEN wob BETWEEN 20 AND 30 THEN 'static' ELSE 'tripping' END AS st FROM wide)," + CONN_SQL.split("raw AS (SELECT *, CASE WHEN p AND r", 1)[1].split("FROM held),", 1)[1] + " SELECT well_id, pos, s5 AS state FROM conn")
def q_conn(spark, sf):
    d = drill_wide(spark, sf).select("well_id", "pos", F.when(c("wob") < 20, "UP").when(c("wob") > 30, "DOWN").otherwise("STATIC").alias("motion"),
                                     F.when(c("pos") % 40 < 25, "drilling").when(c("wob").between(20, 30), "static").otherwise("tripping").alias("state"))
    return G.reclassify_connections(stage(d, "conn")).select("well_id", "pos", "state")


@query("debounced_states", f"""WITH {WIDE_SQL}, fine AS (SELECT well_id, pos, CASE WHEN wob < 25 OR pos % 50 > 30 THEN 'a' ELSE 'b' END AS s7 FROM wide), {STATES_SQL.split(" d1 AS", 1)[1].replace("(SELECT *, CASE", "d1 AS (SELECT *, CASE", 1)} SELECT well_id, pos, state FROM states""")
def q_debounce(spark, sf):
    d = drill_wide(spark, sf).select("well_id", "pos", F.when((c("wob") < 25) | (c("pos") % 50 > 30), "a").otherwise("b").alias("state"))
    return G.debounce(stage(d, "deb"), MIN_SAMPLES)


@query("sliding_washing", f"WITH {FINE_SQL} SELECT well_id, s7 AS state, count(*) AS n FROM fine WHERE s5 = 'sliding' GROUP BY 1, 2")
def q_washing(spark, sf):
    w = stage(G.block_steps(wide_table(spark, sf).select("well_id", "pos", c("flow_in").alias("pump"), c("rpm").alias("rot"), "block_position", F.abs("wob").alias("load"))), "wash")
    t = G.bimodal_thresholds(w.unpivot(["well_id", "pos"], ["pump", "rot", "load"], "ch", "v"), ["well_id", "ch"], "v")
    par = t.groupBy("well_id").pivot("ch", ["pump", "rot", "load"]).agg(F.first("threshold")).select(
        "well_id", c("pump").alias("tp"), c("rot").alias("tr"), c("load").alias("tl"))
    par = par.join(w.groupBy("well_id").agg(F.max("pos").alias("last_pos")), "well_id").join(G.motion_dead_band(w), "well_id")
    d = G.attach(w, par, ["well_id"])
    d = d.withColumns({"pumps": c("pump") >= c("tp"), "rotating": c("rot") >= c("tr"), "motion": G.block_motion(c("step"), c("dead_band"))})
    d = G.hysteresis(d, ["pumps", "rotating"], HOLD)
    d = d.withColumn("state", G.sample_state(c("pumps_held"), c("rotating_held"), c("motion"))).where("state = 'sliding'")
    return d.groupBy("well_id", F.when(c("load") < c("tl"), "washing").otherwise("sliding").alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("slow_descent", f"WITH {FINE_SQL} SELECT well_id, slow AS slow_step, (SELECT count(*) FROM fine f WHERE f.well_id = slow.well_id AND s7 = 'backreaming_down') AS n_slow FROM slow", dbl="slow_step:6")
def q_slow(spark, sf):
    w = stage(G.block_steps(wide_table(spark, sf).select("well_id", "pos", c("flow_in").alias("pump"), c("rpm").alias("rot"), "block_position")), "slow")
    t = G.bimodal_thresholds(w.unpivot(["well_id", "pos"], ["pump", "rot"], "ch", "v"), ["well_id", "ch"], "v")
    par = t.groupBy("well_id").pivot("ch", ["pump", "rot"]).agg(F.first("threshold")).select("well_id", c("pump").alias("tp"), c("rot").alias("tr"))
    par = par.join(w.groupBy("well_id").agg(F.max("pos").alias("last_pos")), "well_id").join(G.motion_dead_band(w), "well_id")
    on = lambda x, t: F.when(c(t) == 0.0, c(x) > 0.0).otherwise(c(x) >= c(t))
    d = G.attach(w, par, ["well_id"]).withColumns({"pumps": on("pump", "tp"), "rotating": on("rot", "tr"), "motion": G.block_motion(c("step"), c("dead_band"))})
    d = G.hysteresis(d, ["pumps", "rotating"], HOLD)
    d = stage(d.where((c("pumps_held") & c("rotating_held") & (c("motion") == "DOWN"))).select("well_id", "pos", "step"), "descent")
    slow = exact_percentiles(d.where("abs(step) > 0"), ["well_id"], F.abs("step"), {"slow_step": 0.25})
    last = d.groupBy("well_id").agg(F.max("pos").alias("last_pos"))
    n = G.attach(d, slow.join(last, "well_id"), ["well_id"]).groupBy("well_id").agg(F.sum((F.abs("step") < c("slow_step")).cast("int")).alias("n_slow"))
    return slow.join(n, "well_id")


RUNS_SQL = f"{STATES_SQL}, t1 AS (SELECT *, CASE WHEN state IS DISTINCT FROM lag(state) OVER (PARTITION BY well_id ORDER BY pos) THEN 1 ELSE 0 END AS ct, lag(state) OVER (PARTITION BY well_id ORDER BY pos) AS prev_state FROM states), t2 AS (SELECT *, sum(ct) OVER (PARTITION BY well_id ORDER BY pos) AS run FROM t1)"


@query("state_timeline", f"WITH {RUNS_SQL} SELECT well_id, min(pos) AS run_start, any_value(state) AS state, max(pos) AS run_end, count(*) AS n_samples, min(depth_md) AS depth_top, max(depth_md) AS depth_bottom FROM t2 GROUP BY well_id, run", dbl="depth_top depth_bottom")
def q_timeline(spark, sf):
    return G.timeline(states(spark, sf))


@query("state_transitions", f"WITH {RUNS_SQL} SELECT well_id, pos, prev_state AS from_state, state AS to_state, depth_md AS depth FROM t2 WHERE ct = 1 AND prev_state IS NOT NULL", dbl="depth")
def q_trans(spark, sf):
    return G.transitions(states(spark, sf))


@query("connection_times", f"WITH {RUNS_SQL}, r AS (SELECT well_id, run, count(*)::DOUBLE AS n FROM t2 WHERE state = 'connection' GROUP BY 1, 2) SELECT well_id, count(*) AS n_connections, avg(n) AS mean_samples, min(n) AS min_samples, max(n) AS max_samples, stddev_pop(n) AS std_samples FROM r GROUP BY 1", dbl="mean_samples min_samples max_samples std_samples")
def q_conn_time(spark, sf):
    n = c("n_samples").cast("double")
    return G.timeline(states(spark, sf)).where("state = 'connection'").groupBy("well_id").agg(
        F.count(F.lit(1)).alias("n_connections"), F.avg(n).alias("mean_samples"), F.min(n).alias("min_samples"),
        F.max(n).alias("max_samples"), F.stddev_pop(n).alias("std_samples"))


STAND_SQL = f"""{STEP_SQL}, v1 AS (SELECT *, sign(sum(step) OVER (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7.0::DOUBLE) AS sg FROM base),
 v2 AS (SELECT *, sg - lag(sg) OVER (PARTITION BY well_id ORDER BY pos) AS turn FROM v1), v3 AS (SELECT well_id, max(pos) AS lastp, min(pos) FILTER (turn >= 1.5) AS e0, min(pos) FILTER (turn <= -1.5) AS s0 FROM v2 GROUP BY 1),
 v4 AS (SELECT v2.*, lastp, e0, s0, min(CASE WHEN turn >= 1.5 THEN pos END) OVER (PARTITION BY v2.well_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM v2 JOIN v3 USING (well_id) WHERE lastp >= 9 AND e0 IS NOT NULL),
 v5 AS (SELECT *, coalesce(nxt, lastp) AS ep FROM v4 WHERE turn <= -1.5 OR (pos = 0 AND (s0 IS NULL OR e0 < s0))),
 stands AS (SELECT s.well_id, s.pos AS index_start, ep AS index_end, s.depth_md AS depth_start, e.depth_md AS depth_end, s.block_position AS block_start, e.block_position AS block_end, ep - s.pos AS duration_samples
   FROM v5 s JOIN base e ON e.well_id = s.well_id AND e.pos = s.ep WHERE abs(e.depth_md - s.depth_md) >= 20 AND abs(s.block_position - e.block_position) >= 5)"""


@query("stands", f"WITH {STAND_SQL} SELECT *, row_number() OVER (PARTITION BY well_id ORDER BY index_start) AS stand_number FROM stands", dbl="depth_start depth_end block_start block_end")
def q_stands(spark, sf):
    return G.numbered_stands(stage(G.stands(wide_table(spark, sf)), "stands"))


@query("rolling_means", f"""WITH {WIDE_SQL}, m AS (SELECT well_id, pos, rop, 480.0::DOUBLE * torque * rpm / (8.75 * 8.75 * greatest(rop, 1)) + 4 * wob * 1000 / (pi() * 8.75 * 8.75) AS mse FROM wide)
 SELECT well_id, pos, avg(rop) OVER w AS rop_avg, avg(mse / 1000) OVER w AS mse_avg FROM m WINDOW w AS (PARTITION BY well_id ORDER BY pos ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""", dbl="rop_avg mse_avg")
def q_rolling(spark, sf):
    m = F.lit(480.0) * c("torque") * c("rpm") / (F.lit(8.75 * 8.75) * F.greatest("rop", F.lit(1.0))) + F.lit(4000.0) * c("wob") / F.lit(3.141592653589793 * 8.75 * 8.75)
    d = drill_wide(spark, sf).select("well_id", "pos", "rop", (m / 1000.0).alias("mse"))
    return bounded(d, ["well_id"], 9, 0, lambda w: {"rop_avg": F.avg("rop").over(w.rowsBetween(-9, 0)), "mse_avg": F.avg("mse").over(w.rowsBetween(-9, 0))}).drop("rop", "mse")


@query("overburden_integral", f"""WITH {WIDE_SQL}, d AS (SELECT well_id, pos, depth_tvd, 0.052 * (16 + wob / 25) AS g FROM wide), t AS (SELECT *, 0.5 * (g + lag(g) OVER w) * (depth_tvd - lag(depth_tvd) OVER w) AS inc FROM d WINDOW w AS (PARTITION BY well_id ORDER BY pos))
 SELECT well_id, pos, coalesce(sum(inc) OVER (PARTITION BY well_id ORDER BY pos), 0) AS overburden FROM t""", dbl="overburden")
def q_integral(spark, sf):
    d = drill_wide(spark, sf).select("well_id", "pos", "depth_tvd", (F.lit(0.052) * (F.lit(16.0) + c("wob") / 25.0)).alias("g"))
    d = bounded(d, ["well_id"], 1, 0, lambda w: {"inc": F.lit(0.5) * (c("g") + F.lag("g").over(w)) * (c("depth_tvd") - F.lag("depth_tvd").over(w))})
    return carry(d, ["well_id"], total={"overburden": c("inc")}).select("well_id", "pos", "overburden")
