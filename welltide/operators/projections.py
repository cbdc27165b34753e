"""Calibration, slicing and reshaping of sample tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from welltide.operators.series import CHUNK, attach, chunk_of


def calibrate(meas: DataFrame, channels: DataFrame) -> DataFrame:
    """Linear calibration and depth offset from the channel table, which belongs to (well, channel).

    A table without ``well_id`` holds for all wells. Spark's size checks choose the join.
    """
    return meas.join(channels, _channel_key(channels), "left").withColumns({
        "calibrated": F.col("value") * F.coalesce("scale", F.lit(1.0)) + F.coalesce("bias", F.lit(0.0)),
        "depth_corrected": F.col("depth") + F.coalesce("depth_offset", F.lit(0.0))})


def _channel_key(channels: DataFrame) -> list[str]:
    return ["well_id", "wits_id"] if "well_id" in channels.columns else ["wits_id"]


def visible(meas: DataFrame) -> DataFrame:
    return meas.where(F.col("hide") == 0)


def flow_discrepancy(flow_in: Column, flow_out: Column) -> Column:
    return F.when(flow_in > 0, (flow_out - flow_in) / flow_in * 100.0).otherwise(F.lit(0.0))


def slice_depth(df: DataFrame, top: float, bottom: float, depth: str = "depth") -> DataFrame:
    return df.where(F.col(depth).between(top, bottom))


def slice_time(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    return df.where(F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def slice_channels(df: DataFrame, channels: list[str], col: str = "wits_id") -> DataFrame:
    return df.where(F.col(col).isin(channels))


def clean_sentinel(v: Column, sentinel: float = -999.25, tol: float = 0.01) -> Column:
    return F.when(F.abs(v - sentinel) < tol, F.lit(None)).otherwise(v)


def normalise(v: Column, low: Column, high: Column) -> Column:
    span = high - low
    return F.when(span == 0, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / span)))


def denormalise(v: Column, low: Column, high: Column) -> Column:
    return low + v * (high - low)


def to_cloud(wide: DataFrame, channel_defs: DataFrame, columns: list[str], depth: str = "depth_md",
             size: int = CHUNK) -> DataFrame:
    """Wide rows to the normalised long form (t, z, channel, v); time is the row position."""
    limits = wide.groupBy("well_id").agg(
        F.min(depth).alias("_z0"), F.max(depth).alias("_z1"), F.min("pos").alias("_t0"), F.max("pos").alias("_t1"),
        F.max("pos").alias("last_pos"))
    w = attach(wide.select("well_id", "pos", depth, *columns), limits, ["well_id"], size=size)
    span = lambda a, b: F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)).otherwise(F.lit(1.0))
    w = w.withColumns({"t": (F.col("pos") - F.col("_t0")) / span("_t0", "_t1"),
                       "z": (F.col(depth) - F.col("_z0")) / span("_z0", "_z1")})
    long = w.unpivot(["well_id", "pos", "t", "z", F.col(depth).alias("depth")], columns, "channel", "raw_value")
    return (long.where(F.col("raw_value").isNotNull() & ~F.isnan("raw_value"))
            .join(F.broadcast(channel_defs), "channel")
            .withColumn("v", normalise(F.col("raw_value"), F.col("low"), F.col("high"))))


def to_wide(meas: DataFrame, channels: list[str]) -> DataFrame:
    """Long to wide by (well, ts, depth); the last sample of a key wins."""
    return (meas.groupBy("well_id", "ts", "depth").pivot("wits_id", channels)
            .agg(F.max_by("value", "pos")))


def align_by_position(meas: DataFrame, channels: list[str], size: int = CHUNK) -> DataFrame:
    """Channels side by side by sample position, cut at each well's shortest channel."""
    wide = meas.groupBy("well_id", "pos").pivot("wits_id", channels).agg(F.first("value"))
    shortest = (meas.where(F.col("wits_id").isin(channels)).groupBy("well_id", "wits_id").agg(F.max("pos").alias("_m"))
                .groupBy("well_id").agg(F.min("_m").alias("_cut"), F.max("_m").alias("last_pos")))
    return attach(wide, shortest, ["well_id"], size=size, how="inner").where(F.col("pos") <= F.col("_cut")).drop("_cut")


def recent_window(wide: DataFrame, back_ft: float = 1000.0, depth: str = "depth_md", size: int = CHUNK) -> DataFrame:
    """Rows within ``back_ft`` of the well's last recorded depth."""
    last = wide.groupBy("well_id").agg(F.max_by(depth, "pos").alias("_last"), F.max("pos").alias("last_pos"))
    return attach(wide, last, ["well_id"], size=size).where(F.col(depth) >= F.col("_last") - back_ft).drop("_last")


def wob_in_klbs(wide: DataFrame, size: int = CHUNK) -> DataFrame:
    """A mean below 100 means the well reports thousands of pounds already."""
    mean = wide.groupBy("well_id").agg(F.avg("wob").alias("_m"), F.max("pos").alias("last_pos"))
    return attach(wide, mean, ["well_id"], size=size).withColumn(
        "wob_klbs", F.when(F.col("_m") < 100, F.col("wob")).otherwise(F.col("wob") / 1000.0)).drop("_m")


def downsample(df: DataFrame, keys: list[str], n: int, size: int = CHUNK) -> DataFrame:
    """At most ``n`` rows per key, evenly spaced by position (first and last kept); the sampling operator."""
    last = df.groupBy(*keys).agg(F.max("pos").alias("last_pos"), (F.max("pos") + 1).alias("_rows"))
    d = attach(df, last, keys, size=size)
    # Row p is the floor of i*(rows-1)/(n-1) for some i iff the smallest candidate i maps back onto p.
    i = F.ceil(F.col("pos") * F.lit(n - 1) / (F.col("_rows") - 1))
    hit = (F.floor(i * (F.col("_rows") - 1) / F.lit(n - 1)) == F.col("pos")) & (i <= n - 1)
    return d.where((F.col("_rows") <= n) | hit).drop("_rows")


def convert_units(meas: DataFrame, channel_units: DataFrame, factors: DataFrame, size: int = CHUNK) -> DataFrame:
    """Value in the target unit of its channel of its well (or of all wells); unknown pairs stay as they are."""
    plan = channel_units.join(factors, ["from_unit", "to_unit"], "left")
    return meas.join(plan, _channel_key(channel_units), "left").withColumn(
        "converted", F.col("value") * F.coalesce("factor", F.lit(1.0)))
