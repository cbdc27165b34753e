"""Order joins, file merges and channel identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from welltide.operators import identify as I
from welltide.operators import joins as J
from welltide.operators.quantiles import exact_percentiles
from welltide.operators.series import dense_positions
from welltide.plans.registry import query
from welltide.sources import dims
from welltide.sources.tables import EVENT_CHANNELS, MEAS_SQL, WIDE_SQL, drill_wide, measurements, samples, table

c = F.col
M = f"WITH {MEAS_SQL}"


def seconds():
    return F.unix_micros("ts") / F.lit(1e6)


def day_bucket():
    return F.floor(c("t") / F.lit(86400.0))


def depth_bucket():
    return F.floor(c("depth") / F.lit(50.0))


HALF_DAY = 43200.0

ASOF = f"""{M}, l AS (SELECT well_id, wits_id, pos, epoch_us(ts) / 1e6::DOUBLE AS t, value FROM meas),
 r AS (SELECT well_id, epoch_us(ts) / 1e6::DOUBLE AS t, depth FROM meas WHERE wits_id = '0120'),
 bk AS (SELECT l.well_id, l.wits_id, l.pos, r.t AS bt, r.depth AS bd FROM l ASOF LEFT JOIN r ON l.well_id = r.well_id AND l.t >= r.t),
 fw AS (SELECT l.well_id, l.wits_id, l.pos, r.t AS ft, r.depth AS fd FROM l ASOF LEFT JOIN r ON l.well_id = r.well_id AND l.t <= r.t),
 n AS (SELECT l.well_id, l.wits_id, l.pos, l.value, l.t, CASE WHEN ft IS NULL OR (bt IS NOT NULL AND l.t - bt <= ft - l.t) THEN bt ELSE ft END AS near_t,
   CASE WHEN ft IS NULL OR (bt IS NOT NULL AND l.t - bt <= ft - l.t) THEN bd ELSE fd END AS nd FROM l JOIN bk USING (well_id, wits_id, pos) JOIN fw USING (well_id, wits_id, pos))"""


@query("asof_nearest", f"{ASOF} SELECT well_id, wits_id, pos, CASE WHEN abs(near_t - t) <= {HALF_DAY} THEN nd END AS depth, CASE WHEN abs(near_t - t) <= {HALF_DAY} THEN abs(near_t - t) END AS gap_s FROM n",
       dbl="depth gap_s:3")
def q_asof(spark, sf):
    """A depth for every sample of every channel, from the channel that stands in for the recorder's depth source."""
    m = measurements(spark, sf).withColumn("t", seconds())
    r = m.where("wits_id = '0120'").select("well_id", "t", "depth")
    n = J.nearest(m.select("well_id", "t", "wits_id", "pos", "value"), r, ["well_id"], "t", "depth", day_bucket(), HALF_DAY)
    return n.select("well_id", "wits_id", "pos", c("near.value").alias("depth"), c("distance").alias("gap_s"))


def probes(spark, sf):
    """Probe depths from orders: one per order, spread over the sampled depth range and the wells."""
    o = table(spark, sf, "orders")
    return o.select((c("o_custkey") % 150).alias("well_id"), c("o_orderkey").alias("probe_id"),
                    (F.lit(5000.05) + c("o_orderkey") % 1000).alias("depth"))


PROBE_SQL = "probes AS (SELECT o_custkey % 150 AS well_id, o_orderkey AS probe_id, 5000.05::DOUBLE + o_orderkey % 1000 AS depth FROM orders)"


@query("nearest_depth", f"""{M}, {PROBE_SQL}, s AS (SELECT well_id, wits_id, depth, value FROM meas), pc AS (SELECT probes.*, wits_id FROM probes JOIN (SELECT DISTINCT well_id, wits_id FROM meas) USING (well_id)),
 b AS (SELECT p.well_id, p.wits_id, probe_id, s.depth bd, s.value bv FROM pc p ASOF LEFT JOIN s ON p.well_id = s.well_id AND p.wits_id = s.wits_id AND p.depth >= s.depth),
 f AS (SELECT p.well_id, p.wits_id, probe_id, s.depth fd, s.value fv FROM pc p ASOF LEFT JOIN s ON p.well_id = s.well_id AND p.wits_id = s.wits_id AND p.depth <= s.depth)
 SELECT p.well_id, p.probe_id, p.wits_id, CASE WHEN fd IS NULL OR (bd IS NOT NULL AND p.depth - bd <= fd - p.depth) THEN bd ELSE fd END AS at_depth,
  CASE WHEN fd IS NULL OR (bd IS NOT NULL AND p.depth - bd <= fd - p.depth) THEN bv ELSE fv END AS value FROM pc p JOIN b USING (well_id, probe_id, wits_id) JOIN f USING (well_id, probe_id, wits_id)""",
       dbl="at_depth value")
def q_nearest_depth(spark, sf):
    """For each probe the nearest sample of each channel of its well."""
    s = samples(spark, sf).select("well_id", "wits_id", "depth", "value")
    n = J.nearest_each(probes(spark, sf), s, ["well_id"], "depth", "value", "wits_id", list(EVENT_CHANNELS.values()), depth_bucket())
    return n.select("well_id", "probe_id", "wits_id", c("near.at").alias("at_depth"), c("near.value").alias("value"))


@query("depth_grid_resample", f"""{M}, s AS (SELECT well_id, wits_id, depth, value FROM meas), lim AS (SELECT well_id, wits_id, min(depth) a, max(depth) b FROM s GROUP BY 1, 2),
 g AS (SELECT well_id, wits_id, k * 10.0::DOUBLE AS depth FROM lim, generate_series(0, 20000) x(k) WHERE k BETWEEN floor(a / 10) AND ceil(b / 10)),
 lo AS (SELECT g.*, s.depth x0, s.value v0 FROM g ASOF LEFT JOIN s ON g.well_id = s.well_id AND g.wits_id = s.wits_id AND g.depth >= s.depth),
 hi AS (SELECT lo.*, s.depth x1, s.value v1 FROM lo ASOF LEFT JOIN s ON lo.well_id = s.well_id AND lo.wits_id = s.wits_id AND lo.depth < s.depth)
 SELECT well_id, wits_id, depth, CASE WHEN x0 = depth THEN v0 WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN v0 + (depth - x0) / (x1 - x0) * (v1 - v0) END AS value FROM hi""", dbl="depth value")
def q_resample(spark, sf):
    # Measurements have a well, a channel and a time, or no position.
    s = samples(spark, sf).where("well_id is not null and wits_id is not null and ts is not null").select("well_id", "wits_id", "depth", "value")
    return J.resample_evenly(s, ["well_id", "wits_id"], "depth", "value", 10.0, F.floor(c("depth") / F.lit(5000.0)))


CH = [("0130", "flow_in"), ("0120", "rpm"), ("0113", "rop"), ("0112", "block_position"), ("0117", "wob")]
PAIRS = [(a, b) for i, (_, a) in enumerate(CH) for _, b in CH[i + 1:]]


def _interp_sql(w):
    return f"""lo{w} AS (SELECT g.well_id, g.depth, s.depth x0, s.value v0 FROM g ASOF LEFT JOIN (SELECT * FROM meas WHERE wits_id = '{w}') s ON g.well_id = s.well_id AND g.depth >= s.depth),
 hi{w} AS (SELECT l.*, s.depth x1, s.value v1 FROM lo{w} l ASOF LEFT JOIN (SELECT * FROM meas WHERE wits_id = '{w}') s ON l.well_id = s.well_id AND l.depth < s.depth),
 i{w} AS (SELECT well_id, depth, CASE WHEN x0 = depth THEN v0 WHEN x0 IS NOT NULL AND x1 IS NOT NULL THEN v0 + (depth - x0) / (x1 - x0) * (v1 - v0) END AS v FROM hi{w})"""


@query("correlation_matrix", f"""{M}, g AS (SELECT well_id, depth FROM meas), {', '.join(_interp_sql(w) for w, _ in CH)},
 j AS (SELECT i0130.well_id, {', '.join(f'i{w}.v AS {n}' for w, n in CH)} FROM i0130 {' '.join(f'JOIN i{w} USING (well_id, depth)' for w, _ in CH[1:])} WHERE {' AND '.join(f'i{w}.v IS NOT NULL' for w, _ in CH)})
 {' UNION ALL '.join(f"SELECT well_id, '{a}' AS channel_a, '{b}' AS channel_b, count(*) AS n, corr({a}, {b}) AS r FROM j GROUP BY 1 HAVING count(*) > 1" for a, b in PAIRS)}""", dbl="r:6")
def q_corr(spark, sf):
    m = measurements(spark, sf)
    w = m.select("well_id", "depth", *[F.when(c("wits_id") == i, c("value")).alias(n) for i, n in CH]).where(
        " or ".join(f"{n} is not null" for _, n in CH))
    return J.depth_correlations(w, "well_id", "depth", [n for _, n in CH], depth_bucket()).where("n > 1")


@query("outer_merge", f"""WITH {WIDE_SQL.replace("wide AS (", "wide AS MATERIALIZED (", 1)}, a AS (SELECT well_id, depth_md, rop, wob FROM wide WHERE pos % 3 <> 0), b AS (SELECT well_id, depth_md, rop + 1000 AS rop, torque FROM wide WHERE pos % 2 = 0)
 SELECT coalesce(a.well_id, b.well_id) AS well_id, coalesce(a.depth_md, b.depth_md) AS depth_md, coalesce(a.rop, b.rop) AS rop, wob, torque FROM a FULL JOIN b ON a.well_id = b.well_id AND a.depth_md = b.depth_md""", dbl="depth_md rop wob torque")
def q_merge(spark, sf):
    w = drill_wide(spark, sf)
    a = w.where("pos % 3 <> 0").select("well_id", "depth_md", "rop", "wob")
    b = w.where("pos % 2 = 0").select("well_id", "depth_md", (c("rop") + 1000).alias("rop"), "torque")
    return J.merge_files(a, b, ["well_id", "depth_md"])


@query("positional_merge", f"""{M}, a AS (SELECT well_id, pos, value AS flow_in FROM meas WHERE wits_id = '0130'), b AS (SELECT well_id, pos, value AS rop FROM meas WHERE wits_id = '0113')
 SELECT coalesce(a.well_id, b.well_id) AS well_id, coalesce(a.pos, b.pos) AS pos, flow_in, rop FROM a FULL JOIN b ON a.well_id = b.well_id AND a.pos = b.pos""", dbl="flow_in rop")
def q_posmerge(spark, sf):
    m = measurements(spark, sf)
    a = m.where("wits_id = '0130'").select("well_id", "pos", c("value").alias("flow_in"))
    b = m.where("wits_id = '0113'").select("well_id", "pos", c("value").alias("rop"))
    return J.merge_files(a, b, ["well_id", "pos"])


WITS_SQL = dims.values_sql("wits", "wits_id, canonical, domain, index_type", dims.WITS)
# Channels each analysis needs (a channel counts with at least ``MIN_POINTS`` samples).
REQUIRED = [("rig_state", "flow_in"), ("rig_state", "rotary_speed"), ("rig_state", "block_position"), ("energy", "rop"),
            ("energy", "wob"), ("energy", "rotary_torque")]
MIN_POINTS = 13
REQ_SQL = dims.values_sql("req", "analysis, canonical", REQUIRED)
ASSIGNED = f"""{M}, {WITS_SQL}, {REQ_SQL}, n AS (SELECT well_id, wits_id, count(*) n FROM meas GROUP BY 1, 2), asg AS (SELECT well_id, canonical, min(wits_id) AS wits_id FROM n JOIN wits USING (wits_id) WHERE n >= {MIN_POINTS} GROUP BY 1, 2)"""


def present_channels(spark, sf):
    return measurements(spark, sf).groupBy("well_id", "wits_id").agg(F.count(F.lit(1)).alias("n")).where(c("n") >= MIN_POINTS)


@query("suggested_assignments", f"{ASSIGNED} SELECT * FROM asg")
def q_suggest(spark, sf):
    return I.suggest_assignments(present_channels(spark, sf))


@query("missing_requirements", f"{ASSIGNED} SELECT w.well_id, analysis, canonical FROM (SELECT DISTINCT well_id FROM meas) w, req WHERE NOT EXISTS (SELECT 1 FROM asg a WHERE a.well_id = w.well_id AND a.canonical = req.canonical)")
def q_missing(spark, sf):
    return J.missing_requirements(measurements(spark, sf), REQUIRED, I.suggest_assignments(present_channels(spark, sf)))


@query("runnable_analyses", f"""{ASSIGNED} SELECT w.well_id, analysis FROM (SELECT DISTINCT well_id FROM meas) w, (SELECT DISTINCT analysis FROM req) q
 WHERE NOT EXISTS (SELECT 1 FROM req r WHERE r.analysis = q.analysis AND NOT EXISTS (SELECT 1 FROM asg a WHERE a.well_id = w.well_id AND a.canonical = r.canonical))""")
def q_runnable(spark, sf):
    return J.runnable(measurements(spark, sf), REQUIRED, I.suggest_assignments(present_channels(spark, sf)))


PROFILE = [("flow_in", "0130", "gpm"), ("rop", "0113", "ft/hr"), ("wob", "0117", ""), ("rotary_speed", "0120", "rpm"), ("gamma_ray", "0722", "API")]
PROFILE_SQL = dims.values_sql("prof", "canonical, wits_id, expected_units", PROFILE)
UNITS_SQL = "CASE WHEN (well_id + CAST(wits_id AS INT)) % 3 = 0 THEN 'lpm' WHEN wits_id = '0130' THEN 'gpm' WHEN wits_id = '0113' THEN 'ft/hr' ELSE 'rpm' END"


@query("profile_validation", f"""{M}, {PROFILE_SQL}, n AS (SELECT well_id, wits_id, {UNITS_SQL} AS units FROM meas GROUP BY 1, 2 HAVING count(*) >= {MIN_POINTS}),
 w AS (SELECT DISTINCT well_id FROM n) SELECT w.well_id, canonical, p.wits_id, expected_units, n.units,
  CASE WHEN n.wits_id IS NULL THEN 'red' WHEN expected_units <> '' AND n.units <> expected_units THEN 'yellow' ELSE 'green' END AS status
 FROM w CROSS JOIN prof p LEFT JOIN n ON n.well_id = w.well_id AND n.wits_id = p.wits_id""")
def q_profile(spark, sf):
    ch = present_channels(spark, sf).withColumn("units", F.expr(UNITS_SQL))
    return J.validate_profile(PROFILE, ch).select("well_id", "canonical", "wits_id", "expected_units", "units", "status")


# --- identification ------------------------------------------------------------------------------------

# Recorder headers the part table stands for.
NAMES = ["GR", "Hole.ft", "SPP I", "xyz", "surf torq", "", "DTF", "ch 7", "flow in", "QQQ"]
UNITS = ["psi", "gpm", "ft", "API", "kft-lbs", "", "ohm-m", "widgets", "degF", "psi (abs)", "m/hr", "klbs"]
IDS = ["0113", "0130", "0722", "0836"]
TEXTS = ["", "average hook load", "mud weight in at pump", "hookload of the rig", "bit depth log"]


def part_channels(spark, sf):
    """Channels of 40 wells from the part table, with the robust range of the part's line quantities."""
    p = table(spark, sf, "part")
    k = c("p_partkey")
    arr = lambda xs: F.array(*[F.lit(x) for x in xs])
    ch = p.select((k % 40).alias("well_id"), k.alias("part"),
                  F.when(k % 7 == 0, F.get(arr(IDS), (F.floor(k / 7) % 4).cast("int"))).otherwise(F.lpad((k + 100000).cast("string"), 7, "0")).alias("wits_id"),
                  F.get(arr(NAMES), (F.floor(k / 40) % len(NAMES)).cast("int")).alias("mnemonic"),
                  F.get(arr(UNITS), (F.floor(k / 3) % len(UNITS)).cast("int")).alias("units"),
                  F.get(arr(TEXTS), (k % len(TEXTS)).cast("int")).alias("description"))
    li = table(spark, sf, "lineitem").select(c("l_partkey").alias("part"), "l_orderkey", "l_linenumber", "l_suppkey",
                                             (c("l_quantity") * (c("l_partkey") % 5 + 1) * 2.0).alias("v"))
    li = dense_positions(li, ["part"], [c("l_orderkey"), c("l_linenumber"), c("l_suppkey"), c("v")], F.floor(c("l_orderkey") / F.lit(1 << 17)))
    obs = exact_percentiles(li, ["part"], c("v"), {"obs_lo": 0.02, "obs_hi": 0.98})
    n = li.groupBy("part").agg(F.count("v").alias("n_points"))
    j = ch.join(n, "part", "left").join(obs, "part", "left")
    few = F.coalesce("n_points", F.lit(0)) < 20
    return j.withColumns({"n_points": F.coalesce("n_points", F.lit(0)), "obs_lo": F.when(~few, c("obs_lo")), "obs_hi": F.when(~few, c("obs_hi"))})


def _pick(xs, i):
    return f"list_extract([{', '.join(repr(x) for x in xs)}], CAST({i} AS INT) + 1)"


DEF_ROWS = [(i, n, dims.unit_domain(u), lo, hi) for i, n, u, lo, hi in dims.CHANNEL_DEFS if dims.unit_domain(u)]


def _first_rows(rows):
    seen = {}
    for k, v in rows:
        seen.setdefault(k, v)
    return list(seen.items())


PART_SQL = f"""{dims.values_sql('wits', 'wits_id, canonical, domain, index_type', dims.WITS)}, {dims.values_sql('defs', 'id, name, domain, lo, hi', DEF_ROWS)},
 {dims.values_sql('al', 'k, canon', _first_rows(dims.alias_rows()))}, {dims.values_sql('mn', 'k, canon', _first_rows(dims.MNEMONICS))},
 {dims.values_sql('ud', 'i, frag, domain', [(i, f, d) for i, (f, d) in enumerate(dims.UNIT_DOMAIN.items())])},
 q AS (SELECT l_partkey AS part, count(*) AS n_points, quantile_cont(l_quantity * (l_partkey % 5 + 1) * 2.0, 0.02) AS obs_lo, quantile_cont(l_quantity * (l_partkey % 5 + 1) * 2.0, 0.98) AS obs_hi FROM lineitem GROUP BY 1),
 ch0 AS (SELECT p_partkey % 40 AS well_id, p_partkey AS part, CASE WHEN p_partkey % 7 = 0 THEN {_pick(IDS, '(p_partkey // 7) % 4')} ELSE lpad((p_partkey + 100000)::VARCHAR, 7, '0') END AS wits_id,
   {_pick(NAMES, f'(p_partkey // 40) % {len(NAMES)}')} AS mnemonic, {_pick(UNITS, f'(p_partkey // 3) % {len(UNITS)}')} AS units, {_pick(TEXTS, f'p_partkey % {len(TEXTS)}')} AS description FROM part),
 ch AS (SELECT ch0.*, coalesce(q.n_points, 0) AS n_points, CASE WHEN n_points >= 20 THEN obs_lo END AS obs_lo, CASE WHEN n_points >= 20 THEN obs_hi END AS obs_hi FROM ch0 LEFT JOIN q USING (part)),
 r1 AS (SELECT ch.*, (SELECT canonical FROM wits WHERE wits.wits_id = ch.wits_id) AS w,
   CASE WHEN mnemonic <> '' THEN coalesce((SELECT canon FROM mn WHERE k = upper(mnemonic)), (SELECT canon FROM al WHERE k = lower(trim(mnemonic))), (SELECT canon FROM al WHERE k = lower(replace(mnemonic, ' ', ''))), (SELECT canon FROM al WHERE k = lower(replace(mnemonic, ' ', '_')))) END AS m,
   CASE WHEN units <> '' THEN (SELECT arg_min(domain, i + CASE WHEN frag = lower(trim(units)) THEN -1000 ELSE 0 END) FROM ud WHERE contains(lower(trim(units)), frag)) END AS d FROM ch),
 sc AS (SELECT part, name, id, CASE WHEN least(obs_hi, hi) <= greatest(obs_lo, lo) THEN 0 WHEN obs_hi <= obs_lo THEN 1 ELSE (least(obs_hi, hi) - greatest(obs_lo, lo)) / (obs_hi - obs_lo) END AS s FROM r1 JOIN defs ON defs.domain = r1.d WHERE obs_lo IS NOT NULL),
 cand AS (SELECT part, count(*) AS n, list(name ORDER BY s DESC, id) AS names, list(s ORDER BY s DESC, id) AS ss FROM sc WHERE s > 0.3 GROUP BY 1),
 nd AS (SELECT domain, count(*) AS n, arg_min(name, id) AS first FROM defs GROUP BY 1),
 res AS (SELECT r1.well_id, r1.part, r1.wits_id, coalesce(w, m, names[1], CASE WHEN d IS NOT NULL AND obs_lo IS NULL THEN nd.first END) AS canonical,
   CASE WHEN w IS NOT NULL OR m IS NOT NULL THEN 'high' WHEN cand.n > 0 AND ss[1] > 0.8 AND (cand.n = 1 OR ss[2] < 0.5) THEN 'medium' ELSE 'low' END AS confidence,
   CASE WHEN w IS NOT NULL THEN 'wits_id' WHEN m IS NOT NULL THEN 'mnemonic' WHEN cand.n > 0 THEN 'unit+range' WHEN d IS NOT NULL AND obs_lo IS NULL THEN 'unit_only' ELSE 'unresolved' END AS method,
   CASE WHEN w IS NOT NULL OR m IS NOT NULL THEN 0 WHEN cand.n > 0 THEN cand.n - 1 WHEN d IS NOT NULL AND obs_lo IS NULL THEN coalesce(nd.n, 1) - 1 ELSE 0 END AS n_candidates
  FROM r1 LEFT JOIN cand USING (part) LEFT JOIN nd ON nd.domain = r1.d)"""


@query("channel_resolution", f"WITH {PART_SQL} SELECT well_id, wits_id, canonical, confidence, method, n_candidates FROM res")
def q_resolve(spark, sf):
    return I.resolve(part_channels(spark, sf))


@query("unit_domains", f"WITH {PART_SQL} SELECT units, d AS domain, count(*) AS n_channels FROM r1 GROUP BY 1, 2")
def q_domains(spark, sf):
    ch = part_channels(spark, sf)
    return ch.groupBy("units").agg(F.count(F.lit(1)).alias("n_channels")).withColumn("domain", I.unit_domain(c("units")))


@query("range_candidates", f"WITH {PART_SQL} SELECT sc.part, name, s AS score FROM sc WHERE s > 0.3", dbl="score")
def q_cand(spark, sf):
    ch = part_channels(spark, sf).withColumn("d", I.unit_domain(c("units"))).where("d is not null and obs_lo is not null")
    return ch.select("part", F.explode(I.range_candidates(c("d"), c("obs_lo"), c("obs_hi"))).alias("x")) \
        .select("part", c("x.name").alias("name"), (-c("x.neg")).alias("score"))


EXIST = "SELECT DISTINCT well_id, 'rop' AS canonical, '0113' AS wits_id FROM res WHERE well_id % 4 = 0"


@query("auto_assignment", f"""WITH {PART_SQL}, ex AS ({EXIST}), k AS (SELECT well_id, wits_id, canonical, CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS rk FROM res WHERE canonical IS NOT NULL)
 SELECT well_id, canonical, wits_id FROM (SELECT DISTINCT well_id, wits_id, canonical, rk FROM k) k WHERE rk >= 1 AND NOT EXISTS (SELECT 1 FROM ex WHERE ex.well_id = k.well_id AND (ex.canonical = k.canonical OR ex.wits_id = k.wits_id))
 QUALIFY row_number() OVER (PARTITION BY well_id, canonical ORDER BY rk DESC, CAST(wits_id AS BIGINT)) = 1""")
def q_assign(spark, sf):
    r = I.resolve(part_channels(spark, sf))
    ex = table(spark, sf, "part").select((c("p_partkey") % 40).alias("well_id")).where("well_id % 4 = 0").distinct() \
        .withColumns({"canonical": F.lit("rop"), "wits_id": F.lit("0113")})
    return I.auto_assign(r, ex, "medium").select("well_id", "canonical", "wits_id")


TEXT_SQL = "list_filter([" + ", ".join(f"'{k}'" for k in sorted({x[1] for x in dims.WITS})) + "], lambda z: contains(lower(trim(description)), replace(z, '_', ' ')))[1]"
TIER = f"""tier AS (SELECT part, well_id, coalesce(w, m, {TEXT_SQL}) AS canonical, CASE WHEN coalesce(w, m, {TEXT_SQL}) IS NOT NULL THEN 'core'
  WHEN len(list_filter([{', '.join(repr(x) for x in dims.SUGGESTED_FRAGMENTS)}], lambda z: contains(lower(trim(units)), z))) > 0 THEN 'suggested' ELSE 'parked' END AS tier FROM r1)"""


@query("channel_tiers", f"WITH {PART_SQL}, {TIER} SELECT part, canonical, tier FROM tier")
def q_tiers(spark, sf):
    can, tier = I.tier(c("wits_id"), c("mnemonic"), c("description"), c("units"))
    return part_channels(spark, sf).select("part", can.alias("canonical"), tier.alias("tier"))


INTENT_SQL = dims.values_sql("it", "intent, canonical", dims.intent_rows())


OWN_SET = ["flow_in", "rop"]


@query("intent_selection", f"WITH {PART_SQL}, {TIER}, {INTENT_SQL}, every AS (SELECT intent, canonical FROM it UNION ALL SELECT 'Custom', unnest({OWN_SET!r})) SELECT part, well_id, intent, canonical FROM tier JOIN every USING (canonical)")
def q_intent(spark, sf):
    """Channels of every intent, and of a caller's own set."""
    can, _ = I.tier(c("wits_id"), c("mnemonic"), c("description"), c("units"))
    it = dims.frame(spark, dims.intent_rows() + [("Custom", x) for x in OWN_SET], "intent string, canonical string")
    channels = part_channels(spark, sf).select("part", "well_id", can.alias("canonical"))
    return I.select_for_intents(channels, it).select("part", "well_id", "intent", "canonical")


@query("description_match", f"WITH {PART_SQL} SELECT part, description, {TEXT_SQL} AS canonical FROM r1")
def q_desc(spark, sf):
    none = F.lit(None).cast("string")
    can, _ = I.tier(none, none, c("description"), none)
    return part_channels(spark, sf).select("part", "description", can.alias("canonical"))


@query("domain_channels", f"""WITH {PART_SQL}, {dims.values_sql('dm', 'canonical, domain', dims.OPERATIONAL_DOMAINS)} SELECT res.well_id, coalesce(dm.domain, '{dims.DEFAULT_DOMAIN}') AS domain, count(*) AS n_channels
 FROM res LEFT JOIN dm USING (canonical) WHERE canonical IS NOT NULL GROUP BY 1, 2""")
def q_opdomain(spark, sf):
    r = I.resolve(part_channels(spark, sf)).where("canonical is not null")
    return r.groupBy("well_id", I.operational_domain(c("canonical")).alias("domain")).agg(F.count(F.lit(1)).alias("n_channels"))


@query("dossier_census", f"""WITH {PART_SQL}, x AS (SELECT ch.*, wits.canonical, wits.domain, wits.index_type FROM ch LEFT JOIN wits USING (wits_id) WHERE n_points > 0 AND NOT starts_with(wits_id, '900'))
 SELECT part, n_points, coalesce(canonical, CASE WHEN mnemonic <> '' THEN lower(mnemonic) ELSE wits_id END) AS canonical, coalesce(domain, 'mechanical') AS domain, coalesce(index_type, 'time_only') AS index_type FROM x""")
def q_dossier_census(spark, sf):
    p = part_channels(spark, sf)
    # The part number rides along in place of the well, so every channel keeps its own row.
    return I.dossiers(p.drop("well_id").withColumnRenamed("part", "well_id")).drop("wits_id").withColumnRenamed("well_id", "part")
