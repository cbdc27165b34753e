"""The scan of a recording: census, rig states, profiles, relationships, transition responses and stands in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from welltide.operators import knowledge as K
from welltide.operators import segment as G
from welltide.operators.series import CHUNK, chunk_of
from welltide.operators.stats import channel_stats
from welltide.session import stage

c = F.col


def scan(wide: DataFrame, channels: Sequence[str], min_samples: int = 30, depth: str = "depth_md", size: int = CHUNK) -> dict[str, DataFrame]:
    """Tables of all stages of a scan of ``wide`` (well_id, pos, depth, channels), in the order in which they build on each other.

    The states and the rows with their state are written to the shared folder, as every later stage reads them.
    """
    states = stage(G.detect_states(wide, min_samples, size, keep=[depth]), "scan-states")
    # Rows of a (well, chunk) side by side, so that tasks sum up whole groups before they shuffle.
    rows = wide.select("well_id", "pos", *channels).join(states.select("well_id", "pos", "state"), ["well_id", "pos"])
    rows = stage(rows.repartition("well_id", chunk_of("pos", size)).sortWithinPartitions("well_id", "state", "pos"), "scan-rows")
    long = lambda d, keep: d.select("well_id", "pos", *keep, *channels).unpivot(["well_id", "pos", *keep], list(channels), "channel", "v")
    moves = G.transitions(states, depth, size)
    return {
        "census": channel_stats(long(wide, []), ["well_id", "channel"], "v"),
        "states": states,
        "timeline": G.timeline(states, depth, size),
        "profiles": K.profiles_in_states(rows, channels, size),
        "relationships": K.relationships(rows, channels, size=size),
        "transitions": moves,
        "responses": K.transition_responses(moves, wide, channels, depth),
        "stands": G.stands(wide, depth, size=size),
    }


def scan_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each stage's table per well: (well_id, stage, n_rows)."""
    out = None
    for name, d in tables.items():
        n = d.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_rows")).select("well_id", F.lit(name).alias("stage"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out
