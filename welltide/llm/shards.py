"""Contiguous shards of nearly equal bytes.

Rows are put in a global order, each partition sums its own sizes, and the totals of the partitions before it turn them into global
prefix sums. The line of bytes is cut at equal targets; a row goes where its middle byte falls, so a shard is off its target by at most one
row's size. Only key, size and checksum move; texts stay where they are.

Cases: a null text has no bytes and the checksum of the empty text; rows with equal keys are ordered by checksum and size, and fully equal
rows may take each other's places; null keys come first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from welltide.llm.common import table
from welltide.session import stage


def contiguous_shards(rows: DataFrame, n_shards: int, key: str, size: str, order: list[str] | None = None, label: str = "shards") -> DataFrame:
    """``rows`` with shard (0 to n_shards - 1) and slot (0-based, gapless within a shard), in the order of ``order`` (``key`` if none).

    The ordered rows are written to the shared folder once, with the number of their partition, so the totals and the shards come from the
    same partitioning even if executors are lost. The driver sends back one offset row per partition and per shard.
    """
    order = order or [key]
    clash = {"_part", "_upto", "_rn", "_before", "_first", "shard", "slot"} & set(rows.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way")
    names = rows.columns

    def running(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = 0, 0
        for f in frames:
            upto = total + np.cumsum(f[size].to_numpy(dtype="int64"))
            yield f.assign(_upto=upto, _rn=np.arange(count, count + len(f), dtype="int64"))
            if len(f):
                total, count = int(upto[-1]), count + len(f)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(running, f"{schema}, _upto long, _rn long")
    local = stage(local.withColumn("_part", F.spark_partition_id()), label)

    # One row per partition: the window over all of them sees as many rows as there are partitions.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = local.groupBy("_part").agg(F.max("_upto").alias("_b"), F.count(F.lit(1)).alias("_n"))
    offsets = parts.select("_part", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_bytes_before"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows_before"),
                           F.sum("_b").over(Window.partitionBy()).alias("_total"))
    middle = F.col("_bytes_before") + F.col("_upto") - F.col(size) / 2
    cut = F.when(F.col("_total") > 0, F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / F.col("_total")))).otherwise(F.lit(0))
    placed = (local.join(F.broadcast(offsets), "_part")
              .withColumn("shard", cut.cast("int"))
              .withColumn("_row", F.col("_rows_before") + F.col("_rn")))
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select(*names, "shard", (F.col("_row") - F.col("_first")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", overhead: int = 16) -> DataFrame:
    """Key, size (UTF-8 bytes plus ``overhead``), text_crc32, shard and slot of every document, contiguous in key order."""
    body = F.coalesce(F.col(text), F.lit(""))
    light = docs.select(F.col(key), (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    return contiguous_shards(light, n_shards, key, "size", [key, "text_crc32", "size"])


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards of nearly equal bytes."""
    out = shard_documents(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
