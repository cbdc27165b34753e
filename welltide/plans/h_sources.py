"""Sources and sinks, exercised on dumps, logs and stores that Spark writes from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from welltide.functions import rock as R
from welltide.operators import identify as I
from welltide.operators.projections import to_cloud
from welltide.operators.series import dense_positions
from welltide.plans.a_basic import CLOUD_COLS, DEFS_SQL, channel_defs, long_sql
from welltide.plans.b_physics import MSE
from welltide.plans.c_joins import MIN_POINTS, present_channels
from welltide.plans.d_segments import shared, wide_table
from welltide.plans.registry import query
from welltide.session import input_mark, scratch_path
from welltide.sources import dims, dumps, files
from welltide.sources.tables import EVENT_CHANNELS, MEAS_SQL, WIDE_CHANNELS, WIDE_SQL, measurements, table

c = F.col
RIGS = 24
EPOCH = 1700000000000
OLDER, LATER = EPOCH - 1000, EPOCH + 5
SETTINGS = [("0108", "Hole Depth"), ("0130", "Flow In"), ("1984", "")]
_folders: dict[tuple, str] = {}


def folder(spark, sf, label, write):
    """A folder written once per application and state of the data folder."""
    key = (spark.sparkContext.applicationId, sf, input_mark(spark, sf), label)
    if key not in _folders:
        path = scratch_path(spark, label)
        write(path)
        _folders[key] = path
    return _folders[key]


def rig(k):
    return F.concat(F.lit("10.0.0."), (k % RIGS).cast("string"))


def rig_samples(spark, sf, epoch=EPOCH):
    """The events table as one recorder per rig (24 rigs share the wells)."""
    e = table(spark, sf, "events")
    wits = F.create_map(*[F.lit(x) for kv in EVENT_CHANNELS.items() for x in kv])[c("event_type")]
    d = e.select(rig(c("user_id")).alias("ip"), F.lit(epoch).alias("epoch_ms"), wits.alias("wits_id"), c("ts").cast("timestamp").alias("ts"), "event_id",
                 (F.lit(5000.0) + c("event_id") * F.lit(0.1)).alias("depth"), F.when(c("event_id") % 50 > 0, c("value")).alias("value"), (c("event_id") % 2).alias("hide"))
    return dense_positions(d, ["ip", "epoch_ms", "wits_id"], [c("ts"), c("event_id")], F.unix_date(F.to_date("ts")).cast("long"))


def rig_ids(spark, sf):
    """Channel descriptions from the part table."""
    k = c("p_partkey")
    ev = F.array(*[F.lit(x) for x in EVENT_CHANNELS.values()])
    wid = F.when(F.floor(k / RIGS) < 5, F.get(ev, F.floor(k / RIGS).cast("int"))).otherwise(F.lpad((k + 10000).cast("string"), 6, "0"))
    return table(spark, sf, "part").select(
        rig(k).alias("ip"), F.lit(EPOCH).alias("epoch_ms"), k.alias("id"), wid.alias("witsid"), wid.alias("wits_id"),
        F.when(k % 3 > 0, F.concat(F.lit("M"), k.cast("string"))).alias("mnemonic"), F.when(k % 4 > 0, c("p_type")).alias("description"), F.lit("psi").alias("units"),
        F.when(k % 5 == 0, "").otherwise("WITS").alias("source"), F.when(k % 6 > 0, c("p_size") * 0.5).alias("bias"), F.when(k % 7 > 0, "1.5").otherwise("abc").alias("scale"),
        F.lit(70.44).alias("depthoffset"), F.get(F.array(*[F.lit(x) for x in ("depth", "Time ", "0", "1", "junk")]), (k % 5).cast("int")).alias("logby"),
        F.when(k % 8 == 0, F.lit('{"1600000000": {"bias": 1.0, "scale": 2.0}, "note": {"bias": 3.0}, "1700000000": {"depthoffset": 4.0}}')).alias("changelog"))


def depth_folder(spark, sf):
    """Two dumps per recorder: an older one with a tenth of the samples, then the one that counts."""
    def write(p):
        dumps.write_depth_dump(rig_samples(spark, sf, OLDER).where("event_id % 10 = 0"), rig_ids(spark, sf).where("false"), p)
        dumps.write_depth_dump(rig_samples(spark, sf), rig_ids(spark, sf), p)
    return folder(spark, sf, "depth-dumps", write)


def time_rows(spark, sf):
    """The orders table as time rows; several fall on the same instant, text values and stray tokens included."""
    o = table(spark, sf, "orders")
    k = c("o_orderkey")
    line = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"), F.lit("\t0108="), (k * 0.5).cast("string"), F.lit(",0130="), c("o_totalprice").cast("string"),
                    F.lit(",1984="), c("o_orderpriority"), F.lit(",stray"))
    d = o.select(rig(c("o_custkey")).alias("ip"), F.lit(EPOCH + 1).alias("epoch_ms"), "o_orderdate", k, F.when(k % 40 == 0, F.lit("not a time\t0108=1")).otherwise(line).alias("value"))
    return dense_positions(d, ["ip", "epoch_ms"], [c("o_orderdate"), k], F.unix_date(F.to_date("o_orderdate")).cast("long"))


def time_folder(spark, sf):
    """The time dump beside each depth dump, with settings, and a later one with a seventh of its rows."""
    def write(p):
        rows = time_rows(spark, sf)
        cfg = rows.select("ip", "epoch_ms").distinct().withColumn("s", F.explode(F.array(*[F.struct(F.lit(w).alias("witsid"), F.lit(d).alias("description")) for w, d in SETTINGS])))
        dumps.write_time_dump(rows, p, settings=cfg.select("ip", "epoch_ms", "s.*", F.lit(0.0).alias("min"), F.lit(100.0).alias("max")))
        dumps.write_time_dump(rows.where("o_orderkey % 7 = 0").withColumn("epoch_ms", F.lit(LATER)), p)
    return folder(spark, sf, "time-dumps", write)


def chosen_pairs(spark, sf):
    return dumps.pairs(dumps.discover(spark, depth_folder(spark, sf)).unionByName(dumps.discover(spark, time_folder(spark, sf))))


def depth_tables(spark, sf):
    ch = shared(spark, sf, "dump-channels", lambda: dumps.depth_dump(spark, depth_folder(spark, sf))[0])
    return ch, shared(spark, sf, "dump-samples", lambda: dumps.depth_dump(spark, depth_folder(spark, sf))[1])


def time_table(spark, sf):
    return shared(spark, sf, "time-samples", lambda: dumps.time_dump(spark, time_folder(spark, sf))[1])


def time_settings(spark, sf):
    return dumps.time_dump(spark, time_folder(spark, sf))[0]


IP = lambda k: f"'10.0.0.' || ({k} % {RIGS})"
WID = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{w}'" for e, w in EVENT_CHANNELS.items()) + " END"
RIG_SQL = f"rs AS (SELECT {IP('user_id')} AS ip, {WID} AS wits_id, ts, event_id, 5000.0::DOUBLE + event_id * 0.1::DOUBLE AS depth, CASE WHEN event_id % 50 > 0 THEN value END AS value, event_id % 2 AS hide FROM events)"
TIME_SQL = f"""tr AS (SELECT {IP('o_custkey')} AS ip, o_orderdate AS ts, o_orderkey, row_number() OVER (PARTITION BY o_custkey % {RIGS} ORDER BY o_orderdate, o_orderkey) AS r, o_totalprice FROM orders),
 tg AS (SELECT * FROM tr WHERE o_orderkey % 40 <> 0), ts AS (SELECT ip, ts, r, o_orderkey, '0108' AS wits_id, o_orderkey * 0.5 AS value FROM tg UNION ALL SELECT ip, ts, r, o_orderkey, '0130', o_totalprice FROM tg UNION ALL SELECT ip, ts, r, o_orderkey, '1984', NULL FROM tg)"""


@query("depth_dump_scan", f"WITH {RIG_SQL}, ds AS (SELECT {EPOCH}::BIGINT AS epoch_ms, * FROM rs UNION ALL SELECT {OLDER}, * FROM rs WHERE event_id % 10 = 0) SELECT ip, epoch_ms, wits_id, count(*) AS n, count(value) AS n_valid, avg(value) AS mean, max(depth) AS bottom, min(ts) AS first_ts, sum(hide) AS hidden, count(*) - 1 AS last_pos FROM ds GROUP BY 1, 2, 3", dbl="mean bottom", whole="hidden")
def q_depth(spark, sf):
    _, s = depth_tables(spark, sf)
    return s.groupBy("ip", "epoch_ms", "wits_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.max("depth").alias("bottom"),
                                          F.min("ts").alias("first_ts"), F.sum("hide").alias("hidden"), F.max("pos").alias("last_pos"))


@query("time_dump_scan", f"WITH {TIME_SQL}, ds AS (SELECT {EPOCH + 1}::BIGINT AS epoch_ms, * FROM ts UNION ALL SELECT {LATER}, * FROM ts WHERE o_orderkey % 7 = 0) SELECT ip, epoch_ms, wits_id, count(*) AS n, count(value) AS n_valid, avg(value) AS mean, max(ts) AS last_ts FROM ds GROUP BY 1, 2, 3", dbl="mean:2")
def q_time(spark, sf):
    return time_table(spark, sf).groupBy("ip", "epoch_ms", "wits_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.max("ts").alias("last_ts"))


@query("companion_merge", f"""WITH {RIG_SQL}, {TIME_SQL}, dl AS (SELECT ip, ts, max_by(value, r) AS depth FROM ts WHERE wits_id = '0108' GROUP BY 1, 2),
 u AS (SELECT ip, wits_id, ts, depth, value, 'depth' AS origin FROM rs UNION ALL SELECT t.ip, t.wits_id, t.ts, a.depth, t.value, 'time' FROM ts t LEFT JOIN dl a ON a.ip = t.ip AND a.ts = t.ts)
 SELECT ip, wits_id, origin, count(*) AS n, avg(depth) AS mean_depth, avg(value) AS mean_value FROM u GROUP BY 1, 2, 3""", dbl="mean_depth:2 mean_value:2")
def q_merge(spark, sf):
    m = dumps.merge_companion(depth_tables(spark, sf)[1], time_table(spark, sf), chosen_pairs(spark, sf))
    return m.groupBy("ip", "wits_id", "origin").agg(F.count(F.lit(1)).alias("n"), F.avg("depth").alias("mean_depth"), F.avg("value").alias("mean_value"))


@query("merged_order", f"""WITH {RIG_SQL}, {TIME_SQL}, u AS (SELECT ip, wits_id, ts, event_id AS k, value, 0 AS s FROM rs UNION ALL SELECT ip, wits_id, ts, r, value, 1 FROM ts)
 SELECT ip, wits_id, row_number() OVER (PARTITION BY ip, wits_id ORDER BY ts, s, k) - 1 AS pos, value FROM u""", dbl="value")
def q_order(spark, sf):
    return dumps.merge_companion(depth_tables(spark, sf)[1], time_table(spark, sf), chosen_pairs(spark, sf)).select("ip", "wits_id", "pos", "value")


@query("dump_pairs", f"SELECT DISTINCT {IP('user_id')} AS ip, {EPOCH}::BIGINT AS depth_epoch, {EPOCH + 1}::BIGINT AS time_epoch FROM events")
def q_pairs(spark, sf):
    return chosen_pairs(spark, sf)


ID_SQL = f"""SELECT {IP('p_partkey')} AS ip, CASE WHEN p_partkey // {RIGS} < 5 THEN list_extract({list(EVENT_CHANNELS.values())}, (p_partkey // {RIGS})::INT + 1) ELSE lpad((p_partkey + 10000)::VARCHAR, 6, '0') END AS wits_id,
 coalesce(CASE WHEN p_partkey % 3 > 0 THEN 'M' || p_partkey END, CASE WHEN p_partkey // {RIGS} < 5 THEN list_extract({list(EVENT_CHANNELS.values())}, (p_partkey // {RIGS})::INT + 1) ELSE lpad((p_partkey + 10000)::VARCHAR, 6, '0') END) AS mnemonic,
 coalesce(CASE WHEN p_partkey % 4 > 0 THEN trim(p_type) END, '') AS description, 'WITS' AS source, CASE WHEN p_partkey % 6 > 0 THEN p_size * 0.5 ELSE 0 END AS bias, CASE WHEN p_partkey % 7 > 0 THEN 1.5 ELSE 1 END AS scale,
 list_extract(['depth', 'time', 'unknown', 'depth', 'unknown'], (p_partkey % 5)::INT + 1) AS log_by, CASE WHEN p_partkey % 8 = 0 THEN 2 ELSE 0 END AS n_changes FROM part"""


@query("dump_id_table", ID_SQL, dbl="bias scale", whole="n_changes")
def q_ids(spark, sf):
    ids = dumps.id_table(dumps.dump_lines(spark, depth_folder(spark, sf), False))
    return ids.select("ip", "wits_id", "mnemonic", "description", "source", "bias", "scale", "log_by", F.size("changelog").alias("n_changes"))


@query("merged_channels", f"""WITH {RIG_SQL}, {TIME_SQL}, d AS (SELECT DISTINCT ip, wits_id FROM rs), t AS (SELECT DISTINCT ip, wits_id FROM ts) SELECT ip, wits_id, false AS time_only, NULL AS mnemonic FROM d UNION ALL SELECT ip, wits_id, true, coalesce(nullif(CASE wits_id {' '.join(f"WHEN '{w}' THEN '{d}'" for w, d in SETTINGS)} END, ''), wits_id) FROM t WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.ip = t.ip AND d.wits_id = t.wits_id)""")
def q_channels(spark, sf):
    m = dumps.merged_channels(depth_tables(spark, sf)[0], time_table(spark, sf), time_settings(spark, sf), chosen_pairs(spark, sf))
    only = c("source") == "TIMEONLY"
    return m.select("ip", "wits_id", only.alias("time_only"), F.when(only, c("mnemonic")).alias("mnemonic"))


# --- delimited logs ------------------------------------------------------------------------------------

def log_folder(spark, sf):
    """Wide samples as logs of three vendors: other delimiters, other headers, other column order."""
    def write(p):
        w = wide_table(spark, sf)
        t = F.when(c("pos") % 25 == 0, F.lit("n/a")).otherwise(F.date_format("ship_ts", "yyyy-MM-dd HH:mm:ss"))
        wob = F.when(c("pos") % 10 > 0, c("wob").cast("string")).otherwise("bad")
        one = [c("well_id").alias("Well No"), c("pos").alias("Row"), c("depth_md").alias("Dept MD"), c("depth_tvd").alias("True Vert Depth"), c("rop").alias("ROP (ft/hr)"),
               wob.alias("Weight on Bit"), c("spp").alias("Standpipe"), c("flow_in").alias("Flow In"), c("gamma_ray").alias("GR"), t.alias("Date Time"), c("choke_pressure").alias("My Extra!")]
        two = [wob.alias("SWOB"), c("gamma_ray").alias("SGR"), c("well_id").alias("Well No"), c("rop").alias("ROP"), c("depth_md").alias("DEPTH"), c("pos").alias("Row"), c("depth_tvd").alias("TVD"),
               c("choke_pressure").alias("My Extra!"), t.alias("Time"), c("flow_in").alias("MFIA"), c("spp").alias("SPPA")]
        three = [*reversed(two)]
        for k, (cols, sep) in enumerate([(one, ";"), (two, ","), (three, "\t")]):
            w.where(c("well_id") % 3 == k).select(*cols).write.option("header", "true").option("sep", sep).csv(f"{p}/vendor{k}")
    return folder(spark, sf, "logs", write)


LOG_SQL = f"WITH {WIDE_SQL} SELECT well_id::VARCHAR AS well_no, count(*) AS n, avg(depth_md) AS depth_md, avg(depth_tvd) AS depth_tvd, avg(rop) AS rop, count(CASE WHEN pos % 10 > 0 THEN wob END) AS n_wob, avg(gamma_ray) AS gamma_ray, count(CASE WHEN pos % 25 > 0 THEN ship_ts END) AS n_times, avg(choke_pressure) AS my_extra FROM wide GROUP BY 1"


@query("delimited_scan", LOG_SQL, dbl="depth_md depth_tvd rop gamma_ray my_extra")
def q_log(spark, sf):
    d = files.read_delimited(spark, log_folder(spark, sf))
    return d.groupBy("well_no").agg(F.count(F.lit(1)).alias("n"), F.avg("depth_md").alias("depth_md"), F.avg("depth_tvd").alias("depth_tvd"), F.avg("rop").alias("rop"),
                                    F.count("wob").alias("n_wob"), F.avg("gamma_ray").alias("gamma_ray"), F.count("timestamp").alias("n_times"), F.avg(c("my_extra").cast("double")).alias("my_extra"))


LOGGED = {"depth_tvd": "depth_tvd", "rop": "rop", "wob": "CASE WHEN pos % 10 > 0 THEN wob END", "spp": "spp", "flow_in": "flow_in", "gamma_ray": "gamma_ray"}


@query("log_samples", f"WITH {WIDE_SQL}, l AS ({' UNION ALL '.join(f"SELECT well_id, '{n}' AS channel, {v} AS v, depth_md AS d FROM wide" for n, v in LOGGED.items())}) SELECT well_id::VARCHAR AS well_no, channel, count(*) AS n, avg(v) AS mean, avg(d) AS mean_depth FROM l WHERE v IS NOT NULL GROUP BY 1, 2", dbl="mean mean_depth:2")
def q_logsamples(spark, sf):
    d = files.ingest(spark, log_folder(spark, sf), "csv")
    return files.to_samples(d.withColumnRenamed("depth_md", "DEPTH"), None, ["well_no", "row"]).groupBy("well_no", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.avg("depth").alias("mean_depth"))


@query("directory_ingest", f"WITH {WIDE_SQL} SELECT count(*) AS n_rows, count(DISTINCT well_id) AS n_wells, sum(rop) AS total_rop FROM wide", dbl="total_rop:2")
def q_dir(spark, sf):
    d = files.read_delimited(spark, log_folder(spark, sf), pattern="*.csv")
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("well_no").alias("n_wells"), F.sum("rop").alias("total_rop"))


# --- catalogue, stores, exports ------------------------------------------------------------------------

@query("file_catalogue", f"""WITH {RIG_SQL}, f AS (SELECT DISTINCT ip, wits_id, 0 AS older FROM rs UNION ALL SELECT DISTINCT ip, wits_id, 1 FROM rs WHERE event_id % 10 = 0 UNION ALL SELECT DISTINCT {IP('p_partkey')}, 'idtable', 0 FROM part)
 SELECT ip, count(*) AS n_files, count(*) AS n_registered, 0 AS n_again FROM f GROUP BY 1""", whole="n_again")
def q_catalogue(spark, sf):
    """Files of the dump folder per recorder (one per block), how many of them are new to an empty catalogue and to a filled one."""
    found = files.fingerprint_files(spark, depth_folder(spark, sf)).withColumn("ip", F.regexp_extract("original_path", dumps.NAME, 1))
    first = files.register(found, None)
    again = files.register(found, first)
    count = lambda d, n: d.groupBy("ip").agg(F.count(F.lit(1)).alias(n))
    return count(found, "n_files").join(count(first, "n_registered"), "ip").join(count(again, "n_again"), "ip", "left").na.fill(0, ["n_again"])


@query("file_ranges", f"""WITH {RIG_SQL}, f AS (SELECT DISTINCT ip, wits_id, 0 AS older FROM rs UNION ALL SELECT DISTINCT ip, wits_id, 1 FROM rs WHERE event_id % 10 = 0 UNION ALL SELECT DISTINCT {IP('p_partkey')}, 'idtable', 0 FROM part)
 SELECT ip, count(*) AS n_files, count(*) AS n_hashes, 0 AS n_unlike FROM f GROUP BY 1""", whole="n_unlike")
def q_ranges(spark, sf):
    """Files of the dump folder per recorder, their different hashes from ranges of 16 KiB, and how many of the groups of equal
    hashes are not those of hashes over whole files."""
    path = depth_folder(spark, sf)
    few = files.file_roots(files.range_hashes(spark, path, 16 << 10)).select("original_path", c("root").alias("few"))
    one = files.file_roots(files.range_hashes(spark, path)).select("original_path", c("root").alias("one"))
    both = few.join(one, "original_path").withColumn("ip", F.regexp_extract("original_path", dumps.NAME, 1))
    return both.groupBy("ip").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct("few").alias("n_hashes"),
                                  (2 * F.countDistinct("few", "one") - F.countDistinct("few") - F.countDistinct("one")).alias("n_unlike"))


@query("computed_round_trip", f"WITH {WIDE_SQL}, m AS (SELECT {IP('well_id')} AS ip, {MSE} AS v FROM wide) SELECT ip, '9004' AS wits_id, true AS is_computed, count(*) AS n, avg(v) AS mean, max(v) AS top FROM m GROUP BY 1", dbl="mean:3 top:3")
def q_computed(spark, sf):
    def write(p):
        w = wide_table(spark, sf).select(rig(c("well_id")).alias("ip"), "well_id", c("pos").alias("p"), c("ship_ts").alias("ts"), c("depth_md").alias("depth"),
                                         R.mse(c("wob") * 1000.0, c("torque"), c("rpm"), c("rop"), 8.75).alias("value"))
        w = dense_positions(w, ["ip"], [c("well_id"), c("p")], c("well_id"))
        ch = dumps.computed_channel(w, "mse").withColumn("epoch_ms", F.lit(EPOCH))
        ids = ch.select("ip", "epoch_ms", "wits_id").distinct().withColumns({"witsid": c("wits_id"), "mnemonic": F.lit("MSE"), "units": F.lit("psi"), "source": F.lit("COMPUTED")})
        dumps.write_depth_dump(ch, ids, p)
    ch, s = dumps.depth_dump(spark, folder(spark, sf, "computed-dumps", write))
    return s.join(ch.select("ip", "wits_id", "is_computed"), ["ip", "wits_id"]).groupBy("ip", "wits_id", "is_computed").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))


@query("csv_export", f"WITH {WIDE_SQL} SELECT well_id::VARCHAR AS well_id, count(*) AS n, {', '.join(f'avg({x}) AS {x}' for x in WIDE_CHANNELS)} FROM wide GROUP BY 1", dbl=" ".join(WIDE_CHANNELS))
def q_export(spark, sf):
    from welltide.sources.tables import unpivot_channels
    p = folder(spark, sf, "export", lambda path: files.export_csv(unpivot_channels(wide_table(spark, sf), WIDE_CHANNELS), WIDE_CHANNELS, path))
    return files.read_delimited(spark, p).groupBy("well_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(x) for x in WIDE_CHANNELS])


@query("cloud_round_trip", f"WITH {WIDE_SQL}, {DEFS_SQL}, {long_sql(CLOUD_COLS)}, k AS (SELECT well_id, count(*) AS n_points FROM long GROUP BY 1) SELECT l.well_id, l.channel, n_points, avg(greatest(0, least(1, (v - low) / (high - low)))) AS mean_v FROM long l JOIN defs ON defs.channel = l.channel JOIN k ON k.well_id = l.well_id GROUP BY 1, 2, 3", dbl="mean_v:6")
def q_cloud(spark, sf):
    p = folder(spark, sf, "cloud", lambda path: files.save_cloud(to_cloud(wide_table(spark, sf), channel_defs(spark), CLOUD_COLS), path))
    pts, wells = files.load_cloud(spark, p)
    return pts.groupBy("well_id", "channel").agg(F.avg("v").alias("mean_v")).join(wells.select("well_id", "n_points"), "well_id")


@query("profile_store", f"WITH {MEAS_SQL}, {dims.values_sql('wits', 'wits_id, canonical, domain, index_type', dims.WITS)} SELECT 'well-' || well_id AS profile, canonical, wits_id, 'psi' AS expected_units FROM (SELECT well_id, wits_id FROM meas GROUP BY 1, 2 HAVING count(*) >= {MIN_POINTS}) JOIN wits USING (wits_id)")
def q_store(spark, sf):
    def write(path):
        a = I.suggest_assignments(present_channels(spark, sf))
        files.save_profiles(a.select(F.concat(F.lit("well-"), c("well_id").cast("string")).alias("profile"), "canonical", "wits_id", F.lit("psi").alias("expected_units"),
                                     F.lit("").alias("expected_mnemonic")).repartition("profile"), path)
    return spark.read.parquet(folder(spark, sf, "profiles", write)).select("profile", "canonical", "wits_id", "expected_units")


@query("incremental_refresh", f"WITH {MEAS_SQL}, cp AS (SELECT well_id, wits_id, max(ts) AS mark FROM meas WHERE ts < TIMESTAMP '2024-01-20 00:00:00' AND well_id % 5 > 0 GROUP BY 1, 2) SELECT m.well_id, m.wits_id, count(*) AS n_new FROM meas m LEFT JOIN cp USING (well_id, wits_id) WHERE mark IS NULL OR ts > mark GROUP BY 1, 2")
def q_refresh(spark, sf):
    m = measurements(spark, sf)
    copy = m.where("ts < timestamp'2024-01-20 00:00:00' and well_id % 5 > 0")
    return files.new_rows(m, copy, ["well_id", "wits_id"]).groupBy("well_id", "wits_id").agg(F.count(F.lit(1)).alias("n_new"))


@query("profile_edits", f"WITH {MEAS_SQL}, {dims.values_sql('wits', 'wits_id, canonical, domain, index_type', dims.WITS)} SELECT 'well-' || well_id AS profile, canonical, wits_id, CASE WHEN well_id = 2 THEN 'kpa' ELSE 'psi' END AS expected_units FROM (SELECT well_id, wits_id FROM meas GROUP BY 1, 2 HAVING count(*) >= {MIN_POINTS}) JOIN wits USING (wits_id) WHERE well_id <> 1")
def q_store_edits(spark, sf):
    """The profile store after one profile was deleted and another saved again; the second one as ``load_profile`` gives it."""
    name = F.concat(F.lit("well-"), c("well_id").cast("string"))
    def write(path):
        a = I.suggest_assignments(present_channels(spark, sf)).select("well_id", name.alias("profile"), "canonical", "wits_id", F.lit("psi").alias("expected_units"), F.lit("").alias("expected_mnemonic"))
        files.save_profiles(a.drop("well_id").repartition("profile"), path)
        files.delete_profile(spark, "well-1", path)
        files.save_profiles(a.where("well_id = 2").drop("well_id").withColumn("expected_units", F.lit("kpa")), path)
    path = folder(spark, sf, "profile-edits", write)
    rest = spark.read.parquet(path).where("profile <> 'well-2'").select("profile", "canonical", "wits_id", "expected_units")
    one = spark.createDataFrame([("well-2", *r) for r in files.load_profile(spark, "well-2", path)], "profile string, canonical string, wits_id string, expected_units string")
    return rest.union(one)
