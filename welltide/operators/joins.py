"""Joins along an order: nearest in time or depth, interpolation onto a grid, file merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from welltide.operators.correlations import pair_correlations


def neighbours(df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str],
               payloads: Sequence[str]) -> DataFrame:
    """For each payload column: ``<p>_prev`` (latest non-null at or before the row) and ``<p>_next`` (first after).

    ``bucket`` is any non-decreasing function of ``order``. Frames run inside (key, bucket); one summary row per
    bucket carries values across bucket edges, so a dense key is spread over its buckets.
    """
    keys = list(keys)
    d = df.withColumn("_bk", bucket)
    o = F.struct(*order)
    aggs = []
    for p in payloads:
        have = F.when(F.col(p).isNotNull(), o)
        aggs += [F.max_by(p, have).alias(f"_l_{p}"), F.min_by(p, have).alias(f"_f_{p}")]
    # Frames that end at the last row are computed anew for every row; backwards they are running frames.
    before = lambda *o: Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, -1)
    prev, nxt = before("_bk"), before(F.desc("_bk"))
    edge = d.groupBy(*keys, "_bk").agg(*aggs).select(
        *keys, "_bk", *[F.last(f"_l_{p}", ignorenulls=True).over(prev).alias(f"_a_{p}") for p in payloads],
        *[F.last(f"_f_{p}", ignorenulls=True).over(nxt).alias(f"_b_{p}") for p in payloads])
    inside = Window.partitionBy(*keys, "_bk")
    upto = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    after = inside.orderBy(*[F.desc(x) for x in order]).rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(edge.hint("shuffle_hash"), [*keys, "_bk"])
    cols = {}
    for p in payloads:
        cols[f"{p}_prev"] = F.coalesce(F.last(p, ignorenulls=True).over(upto), F.col(f"_a_{p}"))
        cols[f"{p}_next"] = F.coalesce(F.last(p, ignorenulls=True).over(after), F.col(f"_b_{p}"))
    return out.withColumns(cols).drop("_bk", *[f"_a_{p}" for p in payloads], *[f"_b_{p}" for p in payloads])


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, value: str, bucket: Column,
            tolerance: float | None = None) -> DataFrame:
    """Each left row with the right row nearest on ``on``; equal distances take the earlier one.

    ``on`` must be numeric. Left rows keep their columns; ``near`` (struct of on, value) and ``distance`` are added,
    null where nothing lies within ``tolerance``. The bucket expression is over ``on``.
    """
    keys = list(keys)
    mine = [c for c in left.columns if c not in keys and c != on]
    r = right.select(*keys, F.col(on).alias("_x"), F.struct(F.col(on).alias("at"), F.col(value).alias("value")).alias("near"))
    l = left.withColumn("_row", F.struct(*[F.col(c) for c in mine])).select(*keys, F.col(on).alias("_x"), "_row")
    # The right side sorts first at equal positions, so an exact match counts as "before".
    both = (r.withColumn("_side", F.lit(0)).unionByName(l.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    n = neighbours(both.withColumnRenamed("_x", on), keys, bucket, [on, "_side"], ["near"]).where("_side = 1")
    back, fwd = F.col(on) - F.col("near_prev.at"), F.col("near_next.at") - F.col(on)
    take_prev = F.col("near_next").isNull() | (F.col("near_prev").isNotNull() & (back <= fwd))
    n = n.withColumn("near", F.when(take_prev, F.col("near_prev")).otherwise(F.col("near_next")))
    n = n.withColumn("distance", F.abs(F.col("near.at") - F.col(on)))
    if tolerance is not None:
        n = n.withColumn("near", F.when(F.col("distance") <= tolerance, F.col("near"))) \
             .withColumn("distance", F.when(F.col("distance") <= tolerance, F.col("distance")))
    return n.select(*keys, on, "_row.*", "near", "distance")


def nearest_each(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, value: str, by: str, kinds: Sequence[str], bucket: Column) -> DataFrame:
    """Each left row with the right row nearest on ``on`` of every kind (values of ``by``) its key has; ties as in ``nearest``.

    A left row is sorted once for all kinds and repeated for them only after the last shuffle.
    """
    keys = list(keys)
    mine = [c for c in left.columns if c not in keys and c != on]
    near = [f"_n{i}" for i in range(len(kinds))]
    r = right.select(*keys, on, F.lit(0).alias("_side"), *[F.when(F.col(by) == k, F.struct(F.col(on).alias("at"), F.col(value).alias("value"))).alias(n) for n, k in zip(near, kinds)])
    l = left.select(*keys, on, F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in mine]).alias("_row"))
    n = neighbours(r.unionByName(l, allowMissingColumns=True), keys, bucket, [on, "_side"], near).where("_side = 1")

    def pick(p: str) -> Column:
        prev, nxt = F.col(f"{p}_prev"), F.col(f"{p}_next")
        return F.when(nxt.isNull() | (prev.isNotNull() & (F.col(on) - prev["at"] <= nxt["at"] - F.col(on))), prev).otherwise(nxt)

    each = F.array(*[F.struct(F.lit(k).alias(by), pick(p).alias("near")) for p, k in zip(near, kinds)])
    return n.select(*keys, on, "_row.*", F.explode(each).alias("_e")).select(*keys, on, *mine, "_e.*").where("near is not null")


def around_nearest(probes: DataFrame, samples: DataFrame, keys: Sequence[str], probe: str, on: str, bucket: Column, slack: float) -> DataFrame:
    """Samples not farther from a probe than its nearest one plus ``slack``; sample columns and ``probe``.

    Nothing lies nearer than the nearest sample, so only stretches of ``slack`` on either side of that gap are joined, by
    equal join on buckets of their length, and none on a side whose first sample lies beyond. ``probes``: keys, probe, on.
    """
    keys = list(keys)
    s = samples.select(*keys, on, F.col(on).alias("at"), F.lit(0).alias("_side"))
    p = probes.select(*keys, on, probe, F.lit(1).alias("_side"))
    n = neighbours(s.unionByName(p, allowMissingColumns=True), keys, bucket, [on, "_side"], ["at"]).where("_side = 1")
    n = n.select(*keys, probe, F.col(on).alias("_x"), (F.col(on) - F.col("at_prev")).alias("_b"), (F.col("at_next") - F.col(on)).alias("_f"))
    n = n.withColumn("_far", F.least("_b", "_f") + F.lit(slack)).where("_far is not null")
    x, far, back, fwd = (F.col(e) for e in ("_x", "_far", "_b", "_f"))
    of = lambda e: F.floor(e / F.lit(slack)).cast("long")
    # Buckets reach a little beyond the ends; the condition of the join decides.
    pad = slack / 1000
    stretch = lambda gap, down, a, b: F.when(gap <= far, F.transform(F.sequence(of(a - pad), of(b + pad)), lambda k: F.struct(F.lit(down).alias("_down"), k.alias("_k")))).otherwise(
        F.array().cast("array<struct<_down:boolean,_k:bigint>>"))
    n = n.select(*keys, probe, "_x", "_far", F.inline(F.concat(stretch(back, True, x - far, x - back), stretch(fwd, False, x + fwd, x + far))))
    j = samples.withColumn("_k", of(F.col(on))).join(n, [*keys, "_k"])
    return j.where((F.abs(F.col(on) - x) <= far) & ((F.col(on) <= x) == F.col("_down"))).drop("_k", "_x", "_far", "_down")


def resample(grid: DataFrame, samples: DataFrame, keys: Sequence[str], x: str, v: str, bucket: Column) -> DataFrame:
    """Linear interpolation of samples onto grid points; null outside the sampled span."""
    keys = list(keys)
    s = samples.select(*keys, x, F.struct(F.col(x).alias("x"), F.col(v).alias("v")).alias("s")).withColumn("_g", F.lit(0))
    g = grid.select(*keys, x).withColumn("_g", F.lit(1))
    n = neighbours(s.unionByName(g, allowMissingColumns=True), keys, bucket, [x, "_g"], ["s"]).where("_g = 1")
    return n.select(*keys, x, interpolated(F.col(x), F.col("s_prev"), F.col("s_next")).alias(v))


def resample_evenly(samples: DataFrame, keys: Sequence[str], x: str, v: str, step: float, bucket: Column) -> DataFrame:
    """Like ``resample``, onto all multiples of ``step`` from at or below the first sample to at or above the last.

    A point is made by the last sample at or before it, which knows the next one, so points are never shuffled.
    """
    keys = list(keys)
    s = samples.select(*keys, F.col(x).alias("_x"), F.col(v).alias("_v"), bucket.alias("_bk"))
    inside = Window.partitionBy(*keys, "_bk").orderBy("_x")
    s = s.withColumn("_i", F.row_number().over(inside))
    # A bucket's first sample, read from the same shuffle, is what the last one of the bucket before it lacks.
    heads = s.where("_i = 1").select(*keys, "_bk", "_x", F.struct(F.col("_x").alias("x"), F.col("_v").alias("v")).alias("_head"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_bk")).rowsBetween(-1, -1)
    n = s.withColumn("_b", F.lead(F.struct(F.col("_x").alias("x"), F.col("_v").alias("v"))).over(inside))
    n = n.join(heads.select(*keys, "_bk", F.first("_head").over(later).alias("_on")).hint("shuffle_hash"), [*keys, "_bk"])
    n = n.withColumn("_b", F.coalesce("_b", "_on"))
    here, at = F.ceil(F.col("_x") / step), F.when(F.col("_b").isNull(), F.ceil(F.col("_x") / step)).otherwise(F.ceil(F.col("_b.x") / step) - 1)
    points = F.when(here <= at, F.sequence(here, at)).otherwise(F.array().cast("array<bigint>"))
    n = n.select(*keys, "_x", "_v", "_b", F.explode(points).alias("_k")).select(
        *keys, (F.col("_k") * F.lit(step)).alias(x), F.struct(F.col("_x").alias("x"), F.col("_v").alias("v")).alias("s"), "_b")
    # A group's first sample also makes the point below it, its last one the point above.
    first = heads.groupBy(*keys).agg(F.min("_x").alias("_first"))
    below = first.where(F.floor(F.col("_first") / step) < F.ceil(F.col("_first") / step)).select(
        *keys, (F.floor(F.col("_first") / step) * F.lit(step)).alias(x), F.lit(None).cast("double").alias(v))
    return n.select(*keys, x, interpolated(F.col(x), F.col("s"), F.col("_b")).alias(v)).unionByName(below)


def interpolated(x: Column, a: Column, b: Column) -> Column:
    return F.when(a["x"] == x, a["v"]).when(
        a.isNotNull() & b.isNotNull(), a["v"] + (x - a["x"]) / (b["x"] - a["x"]) * (b["v"] - a["v"]))


def depth_correlations(wide: DataFrame, key: str, x: str, channels: list[str], bucket: Column) -> DataFrame:
    """Pairwise correlation with every channel interpolated onto the union of all sampled depths."""
    d = wide.withColumns({f"s_{c}": F.when(F.col(c).isNotNull(), F.struct(F.col(x).alias("x"), F.col(c).alias("v"))) for c in channels})
    n = neighbours(d.drop(*channels), [key], bucket, [x], [f"s_{c}" for c in channels])
    n = n.select(key, *[interpolated(F.col(x), F.col(f"s_{c}_prev"), F.col(f"s_{c}_next")).alias(c) for c in channels]).na.drop()
    return pair_correlations(n, [key], channels)


def merge_files(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer merge of two logs; where both carry a column the left value wins."""
    on = list(on)
    both = [c for c in left.columns if c in right.columns and c not in on]
    r = right.select(*on, *[F.col(c).alias(f"_dup_{c}") if c in both else F.col(c) for c in right.columns if c not in on])
    j = left.join(r, on, "full_outer")
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_dup_{c}")) for c in both}).drop(*[f"_dup_{c}" for c in both])


def _each(df: DataFrame, rows: Sequence[tuple], names: Sequence[str]) -> DataFrame:
    """Repeat each row for every entry of a short constant list."""
    lits = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return df.withColumn("_e", F.explode(lits)).select(*df.columns, "_e.*")


def missing_requirements(wells: DataFrame, required: Sequence[tuple[str, str]], assigned: DataFrame) -> DataFrame:
    """(well, analysis, canonical) rows whose required channel is not assigned."""
    need = _each(wells.select("well_id").distinct(), required, ["analysis", "canonical"])
    return need.join(assigned, ["well_id", "canonical"], "left_anti")


def runnable(wells: DataFrame, required: Sequence[tuple[str, str]], assigned: DataFrame) -> DataFrame:
    """(well, analysis) pairs with nothing missing."""
    need = _each(wells.select("well_id").distinct(), sorted({(a,) for a, _ in required}), ["analysis"])
    return need.join(missing_requirements(wells, required, assigned), ["well_id", "analysis"], "left_anti")


def validate_profile(profile: Sequence[tuple[str, str, str]], channels: DataFrame) -> DataFrame:
    """Check a saved assignment set (canonical, wits_id, expected units) against each well's channels.

    green: units agree; yellow: units differ; red: the channel is missing from the well.
    """
    rows = _each(channels.select("well_id").distinct(), profile, ["canonical", "wits_id", "expected_units"])
    j = rows.join(channels.select("well_id", "wits_id", "units", F.lit(True).alias("_found")), ["well_id", "wits_id"], "left")
    status = F.when(F.col("_found").isNull(), "red") \
        .when((F.col("expected_units") != "") & (F.col("units") != F.col("expected_units")), "yellow").otherwise("green")
    return j.withColumn("status", status).drop("_found")


def apply_profile(profile: Sequence[tuple[str, str, str]], channels: DataFrame) -> DataFrame:
    """Assignments a profile yields; channels missing from the well are skipped."""
    return validate_profile(profile, channels).where("status <> 'red'").select("well_id", "canonical", "wits_id")
