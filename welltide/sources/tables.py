"""Adapters that put the drilling data model on the given tables.

``measurements``: one row per (well, channel, pos), from ``events``.
``drill_wide``:   one row per (well, pos) with the wide recorder columns, from ``lineitem``.
The same rules are stated as SQL in MEAS_SQL and WIDE_SQL for the checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.operators.series import dense_positions

# Event type -> recorder channel id.
EVENT_CHANNELS = {"click": "0130", "view": "0120", "purchase": "0112", "signup": "0117", "error": "0113"}

ORDER_RANGE = 1 << 17   # order keys per numbering bucket of drill_wide

WIDE_CHANNELS = ["flow_in", "rpm", "block_position", "wob", "rop", "torque", "spp", "flow_out", "gamma_ray",
                 "apwd", "choke_pressure"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """``measurements`` without positions, for queries that need none: numbering shuffles and sorts all rows."""
    e = table(spark, sf, "events")
    wits = F.create_map(*[F.lit(x) for kv in EVENT_CHANNELS.items() for x in kv])[F.col("event_type")]
    return e.select(
        F.col("user_id").alias("well_id"), wits.alias("wits_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        (F.lit(5000.0) + F.col("event_id") * F.lit(0.1)).alias("depth"), "value",
        (F.get_json_object("props", "$.k").cast("int") % 10 == 0).cast("int").alias("hide"))


def measurements(spark: SparkSession, sf: str) -> DataFrame:
    m = samples(spark, sf)
    # A recorder writes a bounded number of samples a day, so a day bounds the numbering task.
    return dense_positions(m, ["well_id", "wits_id"], [F.col("ts"), F.col("event_id")],
                           F.unix_date(F.to_date("ts")).cast("long"))


MEAS_SQL = """meas AS (
  SELECT user_id AS well_id,
    CASE event_type WHEN 'click' THEN '0130' WHEN 'view' THEN '0120' WHEN 'purchase' THEN '0112'
                    WHEN 'signup' THEN '0117' WHEN 'error' THEN '0113' END AS wits_id,
    ts, event_id, 5000.0::DOUBLE + event_id * 0.1::DOUBLE AS depth, value,
    CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 0 THEN 1 ELSE 0 END AS hide,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS pos
  FROM events)"""


def drill_wide(spark: SparkSession, sf: str, ordered_by: int = ORDER_RANGE, wells: DataFrame | None = None) -> DataFrame:
    """``wells`` (well_id): only rows of these wells, which are numbered as among all."""
    li = table(spark, sf, "lineitem").select(
        "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity",
        "l_discount", "l_tax")
    if wells is not None:
        li = li.join(F.broadcast(wells.select(F.col("well_id").alias("l_suppkey"))), "l_suppkey", "left_semi")
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate",
                                "l_quantity", "l_discount", "l_tax")]
    d = dense_positions(li, ["l_suppkey"], order, F.floor(F.col("l_orderkey") / F.lit(ordered_by)))
    d = d.withColumnRenamed("l_suppkey", "well_id")
    p = F.col("pos")
    stroke = p % 60
    block = F.when(stroke < 40, F.lit(90.0) - F.lit(90.0) * stroke / F.lit(40.0)) \
        .otherwise(F.lit(90.0) * (stroke - 40) / F.lit(20.0))
    d = d.select(
        "well_id", "pos", F.col("l_shipdate").cast("timestamp").alias("ship_ts"),
        (F.lit(5000.0) + p).alias("depth_md"), (F.lit(4800.0) + p * F.lit(0.9)).alias("depth_tvd"),
        F.when(p % 120 < 80, F.lit(780.0) + F.col("l_discount") * F.lit(400.0))
         .otherwise(F.col("l_tax") * F.lit(100.0)).alias("flow_in"),
        F.when(p % 90 < 55, F.lit(60.0) + F.col("l_linenumber") * F.lit(20.0))
         .otherwise(F.col("l_linenumber") * F.lit(0.5)).alias("rpm"),
        (block + F.col("l_quantity") * F.lit(0.01)).alias("block_position"),
        F.col("l_quantity").alias("wob"), (F.col("l_extendedprice") / F.lit(1000.0)).alias("rop"),
        (F.col("l_extendedprice") / F.lit(5.0)).alias("torque"),
        (F.lit(2000.0) + F.col("l_quantity") * F.lit(20.0)).alias("spp"),
        (F.lit(800.0) * (F.lit(0.95) + F.col("l_discount"))).alias("flow_out"),
        (F.lit(10.0) + F.col("l_tax") * F.lit(20.0)).alias("mud_weight"),
        (F.col("l_quantity") * F.lit(3.0)).alias("gamma_ray"),
        (F.lit(100.0) + F.col("l_discount") * F.lit(1000.0)).alias("choke_pressure"))
    return d.withColumn("apwd", F.lit(0.052) * F.col("mud_weight") * F.col("depth_tvd") + F.col("wob"))


WIDE_SQL = """wide0 AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey,
    l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS pos FROM lineitem),
wide1 AS (
  SELECT l_suppkey AS well_id, pos, l_shipdate AS ship_ts,
    5000.0::DOUBLE + pos AS depth_md, 4800.0::DOUBLE + pos * 0.9::DOUBLE AS depth_tvd,
    CASE WHEN pos % 120 < 80 THEN 780.0::DOUBLE + l_discount * 400.0::DOUBLE ELSE l_tax * 100.0::DOUBLE END AS flow_in,
    CASE WHEN pos % 90 < 55 THEN 60.0::DOUBLE + l_linenumber * 20.0::DOUBLE ELSE l_linenumber * 0.5::DOUBLE END AS rpm,
    (CASE WHEN pos % 60 < 40 THEN 90.0::DOUBLE - 90.0::DOUBLE * (pos % 60) / 40.0::DOUBLE
      ELSE 90.0::DOUBLE * (pos % 60 - 40) / 20.0::DOUBLE END) + l_quantity * 0.01::DOUBLE AS block_position,
    l_quantity AS wob, l_extendedprice / 1000.0::DOUBLE AS rop, l_extendedprice / 5.0::DOUBLE AS torque,
    2000.0::DOUBLE + l_quantity * 20.0::DOUBLE AS spp, 800.0::DOUBLE * (0.95::DOUBLE + l_discount) AS flow_out,
    10.0::DOUBLE + l_tax * 20.0::DOUBLE AS mud_weight, l_quantity * 3.0::DOUBLE AS gamma_ray,
    100.0::DOUBLE + l_discount * 1000.0::DOUBLE AS choke_pressure FROM wide0),
wide AS (SELECT *, 0.052::DOUBLE * mud_weight * depth_tvd + wob AS apwd FROM wide1)"""


def unpivot_channels(wide: DataFrame, channels: list[str], extra: list[str] | None = None) -> DataFrame:
    """Wide rows to (keys, channel, v)."""
    ids = ["well_id", "pos", *(extra or [])]
    return wide.unpivot(ids, channels, "channel", "v")
