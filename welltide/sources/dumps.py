"""Recorder dumps (text exports of a rig database) as tables, for all files of a folder at once.

A depth dump holds an ``idtable`` block and one ``"T<id>"`` block per channel; a time dump holds ``witsidcfg`` and
``timedata``. Files are read line by line in splits, so one huge file or block spreads over many tasks: which block a
line belongs to is found from the last header before it, carried across splits.

The recorder and dump time come from the path: ``<ip>_<epoch ms>.sql`` or ``<ip>_timedata_<epoch ms>.sql``, as a file
or as a folder of part files that each repeat their block header.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.operators.joins import neighbours
from welltide.operators.series import dense_positions
from welltide.session import stage

c = F.col
NAME = r"(\d+(?:\.\d+){3})_(timedata_)?(\d+)\.sql"
HEADER = r'^COPY public\."?(\w+)"? \(([^)]*)\)'
FIRST_COMPUTED = 9001


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """Dump files below ``folder``: recorder, dump time, kind, size and modification time. File contents are not read."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length"))
    m = lambda g: F.regexp_extract("path", NAME, g)
    f = f.withColumns({"ip": m(1), "is_time": m(2) != "", "epoch_ms": F.expr(f"try_cast(regexp_extract(path, '{NAME}', 3) AS BIGINT)".replace("\\", "\\\\"))})
    return f.where("ip <> ''").withColumn("dump_ts", F.timestamp_millis("epoch_ms"))


def pairs(files: DataFrame, newest_only: bool = True) -> DataFrame:
    """Newest depth dump per recorder with its first time dump; recorders with time dumps only keep the newest."""
    f = files.groupBy("ip", "is_time", "epoch_ms").agg(F.max("modificationTime").alias("modified"), F.sum("length").alias("bytes"))
    order = F.struct("modified", "epoch_ms")
    d = f.where("not is_time").groupBy("ip").agg(F.max_by("epoch_ms", order).alias("depth_epoch"), F.count(F.lit(1)).alias("n_depth")) if newest_only \
        else f.where("not is_time").select("ip", c("epoch_ms").alias("depth_epoch"), F.lit(1).alias("n_depth"))
    t = f.where("is_time").groupBy("ip").agg(F.min("epoch_ms").alias("first_time"), F.max_by("epoch_ms", order).alias("newest_time"))
    j = d.join(t, "ip", "full_outer")
    return j.select("ip", "depth_epoch", F.when(c("depth_epoch").isNotNull(), c("first_time")).otherwise(c("newest_time")).alias("time_epoch"))


def dump_lines(spark: SparkSession, folder: str, time_dumps: bool) -> DataFrame:
    """Data lines with their block: ip, epoch_ms, block, columns, split, line, value. Lines keep file order."""
    raw = spark.read.option("recursiveFileLookup", "true").text(folder).select(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    m = lambda g: F.regexp_extract("file", NAME, g)
    raw = raw.withColumns({"ip": m(1), "_t": m(2) != "", "epoch_ms": m(3).cast("long")}).where((c("ip") != "") & (c("_t") == time_dumps)).drop("_t")
    # Line numbers depend on how the scan is split, so they are fixed in a table before anything joins on them.
    raw = stage(raw.withColumn("value", F.rtrim("value")).where("value <> ''"), "dump-lines")
    head = F.regexp_extract("value", HEADER, 1)
    mark = F.when(head != "", F.struct(head.alias("block"), F.split(F.regexp_extract("value", HEADER, 2), r"\s*,\s*").alias("columns"))) \
        .when(c("value") == "\\.", F.struct(F.lit("").alias("block"), F.array().cast("array<string>").alias("columns")))
    d = raw.withColumn("_mark", mark)
    n = neighbours(d, ["file"], c("split"), ["line"], ["_mark"])
    return n.where("_mark is null and _mark_prev.block <> ''").select(
        "ip", "epoch_ms", "file", "split", "line", c("_mark_prev.block").alias("block"), c("_mark_prev.columns").alias("columns"), "value")


def field(parts: Column, columns: Column, name: str) -> Column:
    """Text of a named column of a tab-split line; null for \\N or a short line."""
    i = F.array_position(columns, F.lit(name)).cast("int")
    v = F.when(i > 0, F.get(parts, i - 1))
    return F.when(v != "\\N", v)


def number(v: Column) -> Column:
    """Number from text; anything else, and not-a-number, is null."""
    d = v.try_cast("double")
    return F.when(~F.isnan(d), d)


def log_by(raw: Column) -> Column:
    t = F.lower(F.trim(raw))
    return F.when(t.isin("depth", "time"), t).when(t.try_cast("double") > 0, "depth").otherwise("unknown")


def changelog(raw: Column) -> Column:
    """Calibration history: entries with a whole-number key and at least one number."""
    m = F.from_json(raw, "map<string, struct<bias: double, scale: double, depthoffset: double>>")
    keep = lambda k, v: k.rlike(r"^\s*-?\d+\s*$") & (v["bias"].isNotNull() | v["scale"].isNotNull() | v["depthoffset"].isNotNull())
    return F.coalesce(F.map_filter(m, keep), F.create_map().cast("map<string, struct<bias: double, scale: double, depthoffset: double>>"))


def id_table(lines: DataFrame) -> DataFrame:
    """Channel descriptions of the depth dumps with defaults filled in."""
    d = lines.where("block = 'idtable'").withColumn("_p", F.split("value", "\t"))
    f = lambda n: field(c("_p"), c("columns"), n)
    txt = lambda n, dflt: F.trim(F.coalesce(F.when(f(n) != "", f(n)), dflt))
    wid = F.trim(f("witsid"))
    return d.where(wid != "").select(
        "ip", "epoch_ms", wid.alias("wits_id"), F.coalesce(f("id").try_cast("int"), F.lit(0)).alias("db_id"), txt("mnemonic", wid).alias("mnemonic"),
        txt("description", F.lit("")).alias("description"), txt("units", F.lit("")).alias("units"), txt("source", F.lit("WITS")).alias("source"),
        F.coalesce(number(f("bias")), F.lit(0.0)).alias("bias"), F.coalesce(number(f("scale")), F.lit(1.0)).alias("scale"),
        F.coalesce(number(f("depthoffset")), F.lit(0.0)).alias("depth_offset"), log_by(f("logby")).alias("log_by"), changelog(f("changelog")).alias("changelog"),
        F.coalesce(number(f("miny")), F.lit(0.0)).alias("min_y"), F.coalesce(number(f("maxy")), F.lit(0.0)).alias("max_y"),
        F.coalesce(f("dp").try_cast("int"), F.lit(2)).alias("dp"))


def is_computed(wits: Column) -> Column:
    return F.coalesce(wits.try_cast("bigint") >= FIRST_COMPUTED, F.lit(False))


def depth_samples(lines: DataFrame) -> DataFrame:
    """Samples of the channel blocks in file order; lines with fewer than five fields are dropped."""
    d = lines.where(c("block").rlike(r"^T\d+$")).withColumn("_p", F.split("value", "\t")).where(F.size("_p") >= 5)
    p = lambda i: F.when(F.get("_p", i) != "\\N", F.get("_p", i))
    return d.select("ip", "epoch_ms", F.expr("substring(block, 2)").alias("wits_id"), F.try_to_timestamp(p(1)).alias("ts"), number(p(2)).alias("depth"),
                    number(p(3)).alias("value"), F.coalesce(p(4).try_cast("int"), F.lit(0)).alias("hide"), "file", "split", "line")


def numbered(samples: DataFrame) -> DataFrame:
    """Add ``pos`` in file order per dump and channel. Splits bound the numbering tasks."""
    key = F.concat(c("file"), F.lit("#"), F.lpad(c("split").cast("string"), 15, "0"))
    order = [c("line"), *([c("_i")] if "_i" in samples.columns else [])]
    return dense_positions(samples, ["ip", "epoch_ms", "wits_id"], order, key).drop("file", "split", "line", "_i")


def depth_dump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(channels, samples) of all depth dumps; channels without samples are dropped."""
    lines = dump_lines(spark, folder, False)
    s = numbered(depth_samples(lines))
    have = s.select("ip", "epoch_ms", "wits_id").distinct()
    ch = have.join(id_table(lines), ["ip", "epoch_ms", "wits_id"], "left").withColumn("is_computed", is_computed(c("wits_id")))
    return ch.withColumns({"mnemonic": F.coalesce("mnemonic", "wits_id"), "bias": F.coalesce("bias", F.lit(0.0)), "scale": F.coalesce("scale", F.lit(1.0)),
                           "source": F.coalesce("source", F.lit("WITS")), "log_by": F.coalesce("log_by", F.lit("unknown"))}), s


def time_samples(lines: DataFrame) -> DataFrame:
    """Samples of the timedata blocks: one per id=value token; other tokens and lines without a time are skipped."""
    d = lines.where("block = 'timedata'").withColumn("ts", F.try_to_timestamp(F.trim(F.split_part("value", F.lit("\t"), F.lit(1))), F.lit("yyyy-MM-dd HH:mm:ss")))
    rest = F.when(F.instr("value", "\t") > 0, F.expr("substring(value, instr(value, '\t') + 1)"))
    d = d.where("ts is not null").select("ip", "epoch_ms", "file", "split", "line", "ts", F.posexplode(F.split(rest, ",")).alias("_i", "_tok")).where(F.contains("_tok", F.lit("=")))
    eq = F.instr("_tok", "=")
    return d.select("ip", "epoch_ms", F.trim(F.substring_index("_tok", "=", 1)).alias("wits_id"), "ts",
                    number(F.trim(F.substr("_tok", eq + 1))).alias("value"), "file", "split", "line", "_i")


def time_dump(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(channel settings, samples) of all time dumps."""
    lines = dump_lines(spark, folder, True)
    d = lines.where("block = 'witsidcfg'").withColumn("_p", F.split("value", "\t"))
    f = lambda n: field(c("_p"), c("columns"), n)
    cfg = d.where(F.trim(f("witsid")) != "").select("ip", "epoch_ms", F.trim(f("witsid")).alias("wits_id"), F.coalesce(f("description"), F.lit("")).alias("description"),
                                                     F.coalesce(number(f("min")), F.lit(0.0)).alias("min_y"), F.coalesce(number(f("max")), F.lit(0.0)).alias("max_y"))
    return cfg, numbered(time_samples(lines))


def of_pairs(rows: DataFrame, chosen: DataFrame, kind: str) -> DataFrame:
    """The rows of each recorder's chosen dump; ``kind``: depth or time."""
    keep = chosen.select("ip", c(f"{kind}_epoch").alias("epoch_ms")).where("epoch_ms is not null").distinct()
    return rows.join(keep, ["ip", "epoch_ms"], "left_semi")


def merge_companion(depth: DataFrame, time: DataFrame, chosen: DataFrame, depth_wits: str = "0108") -> DataFrame:
    """Time samples beside the depth samples of the same recorder and channel, in time order.

    Only the dumps that ``pairs`` has chosen are merged. A time sample's depth is the hole-depth channel at the same
    instant (the last one written); none leaves it null.
    """
    depth, time = of_pairs(depth, chosen, "depth"), of_pairs(time, chosen, "time")
    at = time.where(c("wits_id") == depth_wits).groupBy("ip", "ts").agg(F.max_by("value", "pos").alias("depth"))
    t = time.drop("epoch_ms").join(at, ["ip", "ts"], "left").select("ip", "wits_id", "ts", "depth", "value", F.lit(0).alias("hide"), "pos", F.lit(1).alias("_src"))
    d = depth.select("ip", "wits_id", "ts", "depth", "value", "hide", "pos", F.lit(0).alias("_src"))
    u = d.unionByName(t)
    # Rows without a time come last, in pieces of their file order (depth rows before time rows).
    loose = F.lit(1 << 40) + c("_src") * F.lit(1 << 45) + F.floor(c("pos") / F.lit(1 << 20))
    day = F.coalesce(F.unix_date(F.to_date("ts")).cast("long"), loose.cast("long"))
    return dense_positions(u.withColumn("_day", day).withColumnRenamed("pos", "_p"), ["ip", "wits_id"], [c("ts").asc_nulls_last(), c("_src"), c("_p")], c("_day")) \
        .select("ip", "wits_id", "pos", "ts", "depth", "value", "hide", F.when(c("_src") == 1, "time").otherwise("depth").alias("origin"))


def merged_channels(depth_channels: DataFrame, time: DataFrame, cfg: DataFrame, chosen: DataFrame) -> DataFrame:
    """Channel table after the merge of the chosen dumps; channels only in the time dump get neutral calibration."""
    depth_channels, time, cfg = of_pairs(depth_channels, chosen, "depth"), of_pairs(time, chosen, "time"), of_pairs(cfg, chosen, "time")
    new = time.select("ip", "wits_id").distinct().join(depth_channels.select("ip", "wits_id"), ["ip", "wits_id"], "left_anti")
    n = new.join(cfg.drop("epoch_ms"), ["ip", "wits_id"], "left").select(
        "ip", "wits_id", F.coalesce(F.when(c("description") != "", c("description")), c("wits_id")).alias("mnemonic"), F.lit("TIMEONLY").alias("source"),
        F.lit(0.0).alias("bias"), F.lit(1.0).alias("scale"), F.lit("time").alias("log_by"))
    return depth_channels.select("ip", "wits_id", "mnemonic", "source", "bias", "scale", "log_by").unionByName(n)


# --- writers -------------------------------------------------------------------------------------------

# Reserved ids of computed channels (name, id, unit).
COMPUTED = [("ecd_computed", "9001", "ppg"), ("pore_pressure_grad", "9002", "ppg"), ("frac_gradient", "9003", "ppg"), ("mse", "9004", "psi"),
            ("fd_index", "9005", "ratio"), ("swab_surge", "9006", "ppg"), ("hole_cleaning", "9007", "ratio")]


def computed_channel(samples: DataFrame, name: str) -> DataFrame:
    """Samples (ip, pos, ts, depth, value) as a computed channel under its reserved id."""
    wits = {n: w for n, w, _ in COMPUTED}[name]
    return samples.select("ip", F.lit(wits).alias("wits_id"), "pos", "ts", "depth", "value", F.lit(0).alias("hide"), F.lit("COMPUTED").alias("source"))


def _text(v: Column) -> Column:
    return F.coalesce(v.cast("string"), F.lit("\\N"))


def write_depth_dump(samples: DataFrame, channels: DataFrame, folder: str, rows_per_file: int = 1 << 20) -> None:
    """Write samples (ip, epoch_ms, wits_id, pos, ts, depth, value, hide) as dump folders.

    Each (channel, chunk of positions) becomes its own file with its own block header, so no well is written by one
    task. ``channels`` may carry witsid fields of the idtable.
    """
    s = samples.select("ip", "epoch_ms", "wits_id", F.floor(c("pos") / rows_per_file).alias("part"), c("pos").alias("_o"), F.concat_ws(
        "\t", (c("pos") + 1).cast("string"), _text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")), _text(c("depth")), _text(c("value")), _text(c("hide"))).alias("value"))
    head = s.select("ip", "epoch_ms", "wits_id", "part").distinct()
    top = head.select("*", F.lit(-1).cast("long").alias("_o"), F.concat(F.lit('COPY public."T'), c("wits_id"), F.lit('" (id, timedate, depth, value, hide) FROM stdin;')).alias("value"))
    end = head.select("*", F.lit(1 << 62).alias("_o"), F.lit("\\.").alias("value"))
    cols = ["id", "witsid", "mnemonic", "description", "units", "source", "bias", "scale", "depthoffset", "logby", "changelog", "miny", "maxy", "dp", "linecolor"]
    ids = channels.select("ip", "epoch_ms", F.lit("idtable").alias("wits_id"), F.lit(0).cast("long").alias("part"), F.xxhash64("wits_id").alias("_h"), F.concat_ws(
        "\t", *[_text(c(x)) if x in channels.columns else F.lit("\\N") for x in cols]).alias("value")).select("ip", "epoch_ms", "wits_id", "part", F.abs("_h").alias("_o"), "value")
    idh = channels.select("ip", "epoch_ms").distinct().select("ip", "epoch_ms", F.lit("idtable").alias("wits_id"), F.lit(0).cast("long").alias("part"))
    idt = idh.select("*", F.lit(-1).cast("long").alias("_o"), F.lit(f"COPY public.idtable ({', '.join(cols)}) FROM stdin;").alias("value"))
    ide = idh.select("*", F.lit((1 << 63) - 1).alias("_o"), F.lit("\\.").alias("value"))
    _write(s.unionByName(top).unionByName(end).unionByName(ids).unionByName(idt).unionByName(ide), folder, "")


def write_time_dump(rows: DataFrame, folder: str, rows_per_file: int = 1 << 20, settings: DataFrame | None = None) -> None:
    """Write time rows (ip, epoch_ms, pos, value = finished line) as time-dump folders, with channel settings (ip, epoch_ms, witsid,
    description, min, max) if given."""
    s = rows.select("ip", "epoch_ms", F.lit("timedata").alias("wits_id"), F.floor(c("pos") / rows_per_file).alias("part"), c("pos").alias("_o"), "value")
    head = s.select("ip", "epoch_ms", "wits_id", "part").distinct()
    top = head.select("*", F.lit(-1).cast("long").alias("_o"), F.lit("COPY public.timedata (timedate, realtime) FROM stdin;").alias("value"))
    end = head.select("*", F.lit((1 << 63) - 1).alias("_o"), F.lit("\\.").alias("value"))
    every = s.unionByName(top).unionByName(end)
    if settings is not None:
        cols = ["witsid", "description", "min", "max"]
        own = settings.select("ip", "epoch_ms", F.lit("witsidcfg").alias("wits_id"), F.lit(0).cast("long").alias("part"), F.abs(F.xxhash64("witsid")).alias("_o"),
                              F.concat_ws("\t", *[_text(c(x)) for x in cols]).alias("value"))
        hd = settings.select("ip", "epoch_ms").distinct().select("ip", "epoch_ms", F.lit("witsidcfg").alias("wits_id"), F.lit(0).cast("long").alias("part"))
        every = every.unionByName(own).unionByName(hd.select("*", F.lit(-1).cast("long").alias("_o"), F.lit(f"COPY public.witsidcfg ({', '.join(cols)}) FROM stdin;").alias("value"))) \
            .unionByName(hd.select("*", F.lit((1 << 63) - 1).alias("_o"), F.lit("\\.").alias("value")))
    _write(every, folder, "timedata_")


def _write(lines: DataFrame, folder: str, kind: str) -> None:
    d = lines.withColumn("dump", F.concat(c("ip"), F.lit("_" + kind), c("epoch_ms").cast("string"), F.lit(".sql"))).withColumn("block", F.concat_ws("-", "wits_id", "part"))
    (d.repartition("dump", "block").sortWithinPartitions("dump", "block", "_o").select("dump", "block", "value")
     .write.mode("append").partitionBy("dump", "block").text(folder))
