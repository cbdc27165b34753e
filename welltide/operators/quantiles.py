"""Exact percentiles of groups of any size.

``percentile_approx`` only narrows the search: it gives a bracket that must hold the wanted rank. Rows
inside the bracket are counted per distinct value, and ranks are found from counts, so no group is ever
gathered into one task. The interpolation is linear between the two neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from welltide.operators.series import CHUNK, attach
from welltide.session import stage

SUB_BUCKETS = 256
SMALL = 1 << 16   # positions below which a group is taken in one buffer


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float],
                      size: int = CHUNK, pos: str = "pos", accuracy: int = 10000, small: int = SMALL) -> DataFrame:
    """keys + one column per entry of ``probs``; nulls are ignored. Rows need a position column.

    Groups whose positions stay below ``small`` come straight from one aggregation, whose buffers never hold more
    than ``small`` values; larger groups take the bracket search in the same plan.
    """
    keys = list(keys)
    v = df.select(*keys, pos, value.cast("double").alias("_v")).where("_v is not null")
    ps = list(probs.items())
    k = len(ps)
    step = 4.0 / accuracy
    wanted = [max(0.0, p - step) for _, p in ps] + [min(1.0, p + step) for _, p in ps]
    few = F.when(F.col(pos) < small, F.col("_v"))
    g = stage(v.groupBy(*keys).agg(
        F.count("_v").alias("_n"), F.max(pos).alias("last_pos"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.sort_array(F.collect_list(few)).alias("_exact"),
        F.percentile_approx("_v", [float(w) for w in wanted], accuracy).alias("_q")), "percentiles")
    # The same sum as below and in the SQL: neighbours one rounding step apart must not depend on the group's size.
    def between(p: float) -> Column:
        at = F.lit(float(p)) * (F.col("_n") - 1)
        lower, upper = F.get("_exact", F.floor(at).cast("int")), F.get("_exact", F.ceil(at).cast("int"))
        return lower + (upper - lower) * (at - F.floor(at))

    done = g.where(F.col("last_pos") < small).select(*keys, *[between(p).alias(n) for n, p in ps])
    g = g.where(F.col("last_pos") >= small).drop("_exact")
    # Sparse groups take all their values; at the very ends the exact extremes bound the bracket.
    sparse = F.col("_n") <= 2 * accuracy
    lo = [F.when(sparse | F.lit(wanted[i] == 0.0), F.col("_min")).otherwise(F.col("_q")[i]) for i in range(k)]
    hi = [F.when(sparse | F.lit(wanted[k + i] == 1.0), F.col("_max")).otherwise(F.col("_q")[k + i]) for i in range(k)]
    g = g.withColumn("_br", F.array(*[F.struct(lo[i].alias("lo"), hi[i].alias("hi")) for i in range(k)])) \
        .drop("_q", "_min", "_max")
    rows = attach(v, g, keys, size=size, pos=pos, how="inner")
    r, low = F.col("_r"), F.col("_v") < F.col("_r.lo")
    sub = F.when(low, F.lit(-1)).when(r["hi"] > r["lo"], F.least(F.lit(SUB_BUCKETS - 1), F.floor(
        (F.col("_v") - r["lo"]) / (r["hi"] - r["lo"]) * SUB_BUCKETS))).otherwise(F.lit(0)).cast("int")
    # Everything below the bracket collapses into one count; values above it are not needed.
    inside = (rows.select(*keys, "_v", "_n", F.posexplode("_br").alias("_i", "_r")).where(F.col("_v") <= F.col("_r.hi"))
              .select(*keys, "_i", "_n", sub.alias("_sub"), F.when(~low, F.col("_v")).alias("_v"))
              .groupBy(*keys, "_i", "_sub", "_v").agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n")))
    per_sub = inside.groupBy(*keys, "_i", "_sub").agg(F.sum("_c").alias("_t"))
    prev = Window.partitionBy(*keys, "_i").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    per_sub = per_sub.withColumn("_off", F.coalesce(F.sum("_t").over(prev), F.lit(0))).drop("_t")
    run = Window.partitionBy(*keys, "_i", "_sub").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    prob = F.array(*[F.lit(p) for _, p in ps])[F.col("_i")]
    ranked = (inside.withColumn("_cum", F.sum("_c").over(run)).join(per_sub.hint("shuffle_hash"), [*keys, "_i", "_sub"])
              .withColumn("_end", F.col("_cum") + F.col("_off")).withColumn("_beg", F.col("_end") - F.col("_c"))
              .withColumn("_at", prob * (F.col("_n") - 1)))
    holds = lambda rank: (F.col("_beg") <= rank) & (rank < F.col("_end"))
    value_at = lambda i, rank: F.max(F.when((F.col("_i") == i) & holds(rank), F.col("_v")))
    per = ranked.groupBy(*keys).agg(*[x for i in range(k) for x in (
        value_at(i, F.floor("_at")).alias(f"_lo{i}"), value_at(i, F.ceil("_at")).alias(f"_hi{i}"),
        F.max(F.when(F.col("_i") == i, F.col("_at"))).alias(f"_at{i}"))])
    at = lambda i: F.col(f"_at{i}") - F.floor(f"_at{i}")
    return done.unionByName(per.select(*keys, *[(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * at(i)).alias(n)
                               for i, (n, _) in enumerate(ps)]))
