"""Connected components of links between long identifiers, as rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from welltide.session import release, stage_path


def _large(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node, root (smallest identifier reachable) for every node that occurs in a link to another node.

    Stars are merged until they no longer change. A round is written to the shared folder; the driver sees a count and a checksum. Minima are
    combined before they are shuffled, and the joins split hot nodes, so a node may have any number of links. Null ends are no links.
    """
    spark = links.sparkSession
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    edges, path = stage_path(pairs.distinct(), "links")
    before = None
    for _ in range(max_rounds):
        nxt, nxt_path = stage_path(_small(_large(edges).distinct()), "links")
        mark = nxt.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v, u) as decimal(38, 0)))")).first()
        release(spark, path)
        edges, path = nxt, nxt_path
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root")).distinct())
        before = mark
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
