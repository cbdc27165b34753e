"""Lineage of results: edges from a result to its inputs and on to raw channels, and everything a result rests on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from welltide.session import release, stage_path

c = F.col
CHANNEL = "channel:"


def input_edges(results: DataFrame, keys: Sequence[str] = ("well_id",)) -> DataFrame:
    """keys, node, parent, kind: one edge per result and input of ``named_results`` rows; kind is the input's provenance."""
    return results.select(*keys, c("result").alias("node"), F.explode("inputs").alias("_i")).select(*keys, "node", c("_i.name").alias("parent"), c("_i.provenance").alias("kind")).distinct()


def channel_coverage(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """well_id, channel, n_samples, last_pos of the channels side by side in ``wide``, from one aggregation; channels without a sample are left out."""
    own = [F.struct(F.lit(x).alias("channel"), F.count(x).alias("n_samples"), F.max(F.when(c(x).isNotNull(), c("pos"))).alias("last_pos")) for x in channels]
    return wide.groupBy("well_id").agg(F.array(*own).alias("_c")).select("well_id", F.inline("_c")).where("n_samples > 0")


def channel_edges(coverage: DataFrame, feeds: Sequence[tuple[str, str]]) -> DataFrame:
    """Edges from an input's name to the recorded channel it is taken from, where the well has samples of it. ``feeds``: (input, channel)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("node"), F.lit(b).alias("_channel")) for a, b in feeds]))
    return coverage.select("well_id", "channel", pairs.alias("_f")).where("channel = _f._channel") \
        .select("well_id", c("_f.node").alias("node"), F.concat(F.lit(CHANNEL), "channel").alias("parent"), F.lit("recorded").alias("kind"))


def ancestry(edges: DataFrame, start: DataFrame | None = None, keys: Sequence[str] = ("well_id",)) -> DataFrame:
    """keys, node, ancestor, steps: all that each node rests on, with the fewest edges between them.

    Every round joins only the pairs found in the last one to the edges, so the rounds are the longest of the shortest ways, and a cycle ends
    (a node in a cycle is its own ancestor). ``start`` (keys, node) limits the nodes that are followed; repeated edges count once, edges
    with a null end are left out.
    """
    spark, keys = edges.sparkSession, list(keys)
    e, edge_path = stage_path(edges.where("node is not null and parent is not null").select(*keys, "node", "parent").distinct(), "lineage-edges")
    new = e if start is None else e.join(start.select(*keys, "node").distinct(), [*keys, "node"], "left_semi")
    step = e.select(*keys, c("node").alias("ancestor"), c("parent").alias("_next"))
    paths, found, n = [edge_path], None, 1
    new, path = stage_path(new.select(*keys, "node", c("parent").alias("ancestor"), F.lit(n).alias("steps")), "lineage-round")
    while not new.isEmpty():
        paths.append(path)
        found = new if found is None else found.unionByName(new)
        n += 1
        ahead = new.join(step, [*keys, "ancestor"]).select(*keys, "node", c("_next").alias("ancestor")).distinct()
        new, path = stage_path(ahead.join(found, [*keys, "node", "ancestor"], "left_anti").select(*keys, "node", "ancestor", F.lit(n).alias("steps")), "lineage-round")
    out, _ = stage_path(new if found is None else found, "lineage")
    release(spark, *paths, path)
    return out


def result_lineage(results: DataFrame, wide: DataFrame, feeds: Sequence[tuple[str, str]]) -> DataFrame:
    """well_id, result, ancestor, kind, steps, n_samples, last_pos: every input, direct or not, of every result down to the recorded channels.

    ``results`` comes from ``named_results``. Only channels have n_samples and last_pos: how much of the channel the well has, and up to where.
    """
    coverage = channel_coverage(wide, sorted({x for _, x in feeds}))
    edges = input_edges(results).unionByName(channel_edges(coverage, feeds))
    kinds = edges.groupBy("well_id", c("parent").alias("ancestor")).agg(F.min("kind").alias("kind"))
    up = ancestry(edges, results.select("well_id", c("result").alias("node"))).withColumnRenamed("node", "result")
    raw = coverage.select("well_id", F.concat(F.lit(CHANNEL), "channel").alias("ancestor"), "n_samples", "last_pos")
    return up.join(kinds, ["well_id", "ancestor"]).join(raw, ["well_id", "ancestor"], "left").select("well_id", "result", "ancestor", "kind", "steps", "n_samples", "last_pos")
