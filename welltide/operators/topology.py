"""Depth-bin vectors, their distances and what follows from them: graphs, components, bars and curves.

Everything pairwise works on depth bins, never on samples. A well has as many bins as the caller asks for, so its
pairs are bounded by n_bins * (n_bins - 1) / 2 whatever the number of samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from welltide.operators.series import CHUNK, attach
from welltide.session import release, stage, stage_path

c = F.col


def bin_vectors(wide: DataFrame, channels: Sequence[str], n_bins: int = 100, depth: str = "depth_md", size: int = CHUNK) -> DataFrame:
    """Mean of each channel around evenly spaced bin centres, z-scored per well: (well_id, bin, centre, vec).

    A bin reaches half a step to both sides, ends included, so a sample on an edge counts in two bins. Bins missing
    a channel are dropped and the rest keep their numbers.
    """
    if n_bins < 2:
        raise ValueError("at least two bins")
    lim = wide.groupBy("well_id").agg(F.min(depth).alias("_a"), F.max(depth).alias("_b"), F.max("pos").alias("last_pos"))
    lim = lim.withColumn("_st", (c("_b") - c("_a")) / F.lit(float(n_bins - 1)))
    d = attach(wide.select("well_id", "pos", c(depth).alias("_d"), *channels), lim, ["well_id"], size=size)
    rel = (c("_d") - c("_a")) / c("_st")
    lo, hi = F.greatest(F.lit(0), F.ceil(rel - 0.5)), F.least(F.lit(n_bins - 1), F.floor(rel + 0.5))
    d = d.where("_st > 0").withColumn("bin", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    g = d.groupBy("well_id", "bin").agg(*[F.avg(x).alias(x) for x in channels], F.first("_a").alias("_a"), F.first("_st").alias("_st")).na.drop()
    w = Window.partitionBy("well_id")
    z = lambda x: (c(x) - F.avg(x).over(w)) / F.when(F.stddev_pop(x).over(w) == 0, F.lit(1.0)).otherwise(F.stddev_pop(x).over(w))
    return g.select("well_id", "bin", (c("_a") + c("bin") * c("_st")).alias("centre"), F.array(*[z(x) for x in channels]).alias("vec"))


def euclidean(a: Column, b: Column, weights: Sequence[float] | None = None) -> Column:
    """Distance of two array columns, optionally weighted by coordinate."""
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    if weights is not None:
        sq = F.zip_with(sq, F.array(*[F.lit(float(w)) for w in weights]), lambda s, w: s * w)
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def bin_distances(vectors: DataFrame) -> DataFrame:
    """Distances of all bin pairs i < j of a well."""
    a = vectors.select("well_id", c("bin").alias("i"), c("vec").alias("_va"))
    b = vectors.select("well_id", c("bin").alias("j"), c("vec").alias("_vb"))
    return a.join(b, "well_id").where("i < j").select("well_id", "i", "j", euclidean(c("_va"), c("_vb")).alias("d"))


def edges_within(dist: DataFrame, eps: DataFrame) -> DataFrame:
    return dist.join(eps, "well_id").where(c("d") <= c("eps")).select("well_id", "i", "j", "d")


def epsilon_for_density(dist: DataFrame, target: float = 0.1) -> DataFrame:
    """Threshold that keeps the target share of pairs (pairs per well are bounded, so the exact percentile is cheap)."""
    return dist.groupBy("well_id").agg(F.percentile("d", F.lit(target)).alias("eps"))


def nearest_bins(dist: DataFrame, k: int = 10) -> DataFrame:
    """k nearest neighbours made symmetric; a pair found from both ends has twice its distance as weight."""
    both = dist.unionByName(dist.select("well_id", c("j").alias("i"), c("i").alias("j"), "d"))
    w = Window.partitionBy("well_id", "i").orderBy("d", "j")
    near = both.withColumn("_k", F.row_number().over(w)).where(c("_k") <= k)
    pair = near.select("well_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "d")
    return pair.groupBy("well_id", "i", "j").agg(F.sum("d").alias("weight"), (F.count(F.lit(1)) == 2).alias("mutual"))


def graph_laplacian(nodes: DataFrame, edges: DataFrame, normalised: bool = False) -> DataFrame:
    """Non-zero Laplacian entries (well_id, i, j, value) of the unweighted graph."""
    both = edges.select("well_id", "i", "j").unionByName(edges.select("well_id", c("j").alias("i"), c("i").alias("j")))
    deg = nodes.select("well_id", c("bin").alias("i")).join(both.groupBy("well_id", "i").agg(F.count(F.lit(1)).alias("deg")), ["well_id", "i"], "left")
    deg = deg.select("well_id", "i", F.coalesce("deg", F.lit(0)).alias("deg"))
    if not normalised:
        off = both.select("well_id", "i", "j", F.lit(-1.0).alias("value"))
        return deg.select("well_id", "i", c("i").alias("j"), c("deg").cast("double").alias("value")).unionByName(off)
    dj = deg.select("well_id", c("i").alias("j"), c("deg").alias("_dj"))
    off = both.join(deg, ["well_id", "i"]).join(dj, ["well_id", "j"]).select("well_id", "i", "j", (F.lit(-1.0) / F.sqrt(c("deg") * c("_dj"))).alias("value"))
    return deg.select("well_id", "i", c("i").alias("j"), F.lit(1.0).alias("value")).unionByName(off)


def connected_components(nodes: DataFrame, edges: DataFrame, key: str = "well_id", max_rounds: int = 60) -> DataFrame:
    """Smallest node number reachable from each node, for graphs of any size.

    Rounds of minimum-label exchange with pointer jumping; each round is written to the shared scratch folder, and
    the driver only sees the number of changed labels.
    """
    both = stage(edges.select(key, "i", "j").unionByName(edges.select(key, c("j").alias("i"), c("i").alias("j"))), "cc-edges")
    lab = stage(nodes.select(key, c("bin").alias("i"), c("bin").alias("label")), "cc-labels")
    for _ in range(max_rounds):
        other = lab.select(key, c("i").alias("j"), c("label").alias("_l"))
        best = both.join(other, [key, "j"]).groupBy(key, "i").agg(F.min("_l").alias("_b"))
        step = lab.join(best, [key, "i"], "left").select(key, "i", F.least("label", F.coalesce("_b", "label")).alias("_n"), c("label").alias("_old"))
        step = stage(step, "cc-step")
        jump = step.select(key, c("i").alias("_n"), c("_n").alias("_jump"))
        nxt = stage(step.join(jump, [key, "_n"], "left").select(key, "i", F.least("_n", F.coalesce("_jump", "_n")).alias("label"), "_old"), "cc-next")
        changed = nxt.where(c("label") != c("_old")).limit(1).count()
        lab = nxt.select(key, "i", "label")
        if changed == 0:
            return lab
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


# --- spanning trees and what they give -----------------------------------------------------------------

def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), 0)


def _contracted(best: DataFrame) -> DataFrame:
    """well_id, part, root: where each component of a well ends up when all follow their lightest edges (part, other).

    Of the two components that chose the same edge the one of the smaller bin is the root. Pointers are doubled on one array per well, which
    has an entry per component.
    """
    g = best.groupBy("well_id").agg(F.sort_array(F.collect_list(F.struct("part", "other"))).alias("_e"))
    g = g.select("well_id", F.transform("_e", lambda x: x["part"]).alias("_parts"), "_e")
    g = g.withColumn("_to", F.transform("_e", lambda x: (F.array_position("_parts", x["other"]) - 1).cast("int")))
    g = g.withColumn("_to", F.transform("_to", lambda x, i: F.when((F.get("_to", x) == i) & (i < x), i).otherwise(x)))
    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size("_to") + 1)).cast("int"))
    g = g.withColumn("_root", F.aggregate(turns, c("_to"), lambda to, _: F.transform(to, lambda x: F.get(to, x))))
    g = g.select("well_id", F.explode(F.zip_with("_parts", "_root", lambda p, r: F.struct(p.alias("part"), r.alias("r")))).alias("_x"), "_parts")
    return g.select("well_id", "_x.part", F.get("_parts", c("_x.r")).alias("root"))


def tree_edges(dist: DataFrame) -> DataFrame:
    """well_id, i, j, w: the minimum spanning tree of each well's weighted edges (i, j, d), by Boruvka's rounds.

    In a round every component takes its lightest edge (ties: the smaller bins), components that are joined become one, edges inside of a
    component go, and of the edges between two components the lightest stays. Components at least halve in a round, so their number is the
    logarithm of the bins; edges stay rows that are grouped by (well, component), never by well.
    """
    spark = dist.sparkSession
    edges, path = stage_path(dist.select("well_id", c("i").alias("a"), c("j").alias("b"), F.struct(c("d").alias("w"), "i", "j").alias("e")), "tree-edges")
    found = []
    while not edges.isEmpty():
        both = edges.select("well_id", c("a").alias("part"), c("b").alias("other"), "e").union(edges.select("well_id", "b", "a", "e"))
        best, best_path = stage_path(both.groupBy("well_id", "part").agg(F.min(F.struct("e", "other")).alias("m")).select("well_id", "part", "m.e", "m.other"), "tree-lightest")
        found.append(best)
        to = _contracted(best)
        at = lambda x: to.select("well_id", c("part").alias(x), c("root").alias(f"_{x}"))
        moved = edges.join(at("a"), ["well_id", "a"]).join(at("b"), ["well_id", "b"]).where("_a <> _b")
        less = moved.groupBy("well_id", F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e"))
        nxt, nxt_path = stage_path(less, "tree-edges")
        release(spark, path)
        edges, path = nxt, nxt_path
    if not found:
        return edges.select("well_id", "e.i", "e.j", "e.w")
    return reduce(DataFrame.union, [b.select("well_id", "e.i", "e.j", "e.w") for b in found]).distinct()


def merges(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """Tree edges with the bins of the component that each one ends, when edges are added in order of weight.

    The smaller component ends; on equal sizes the one of the later bin. One array of labels and one of edges per well, as long as its bins.
    """
    n = nodes.groupBy("well_id").agg(F.sort_array(F.collect_set("bin")).alias("_bins"))
    e = tree.groupBy("well_id").agg(F.sort_array(F.collect_list(F.struct("w", "i", "j"))).alias("_e"))
    g = n.join(e, "well_id").withColumn("_places", F.sequence(F.lit(0), F.size("_bins") - 1))
    g = g.withColumn("_e", F.transform("_e", lambda x: F.struct(x["w"].alias("w"), x["i"].alias("i"), x["j"].alias("j"), (F.array_position("_bins", x["i"]) - 1).cast("int").alias("a"),
                                                               (F.array_position("_bins", x["j"]) - 1).cast("int").alias("b"))))
    kind = f"array<struct<i:{dict(nodes.dtypes)['bin']},j:{dict(nodes.dtypes)['bin']},w:double,lo:int,hi:int,n:int>>"
    size = lambda labels, x: F.size(F.filter(labels, lambda y: y == x))

    def add(state: Column, x: Column) -> Column:
        labels = state["labels"]
        sides = F.struct(F.get(labels, x["a"]).alias("a"), F.get(labels, x["b"]).alias("b"))
        sized = lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), (size(labels, t["a"]) < size(labels, t["b"])).alias("first"))
        ends = lambda t: F.struct(F.when(t["first"], t["a"]).otherwise(t["b"]).alias("ends"), F.when(t["first"], t["b"]).otherwise(t["a"]).alias("stays"))
        placed = lambda t: F.struct(t["ends"].alias("ends"), t["stays"].alias("stays"), F.filter("_places", lambda k: F.get(labels, k) == t["ends"]).alias("at"))
        done = lambda t: F.struct(
            F.transform(labels, lambda y: F.when(y == t["ends"], t["stays"]).otherwise(y)).alias("labels"),
            F.concat(state["out"], F.array(F.struct(x["i"].alias("i"), x["j"].alias("j"), x["w"].alias("w"), F.get(t["at"], 0).alias("lo"), F.element_at(t["at"], -1).alias("hi"),
                                                    F.size(t["at"]).alias("n")))).cast(kind).alias("out"))
        return _let(sides, lambda s: _let(sized(s), lambda z: _let(ends(z), lambda y: _let(placed(y), done))))

    start = F.struct(c("_places").alias("labels"), F.array().cast(kind).alias("out"))
    g = g.select("well_id", "_bins", F.explode(F.aggregate("_e", start, add)["out"]).alias("_o"))
    return g.select("well_id", "_o.i", "_o.j", "_o.w", F.get("_bins", c("_o.lo")).alias("dying_lo"), F.get("_bins", c("_o.hi")).alias("dying_hi"), c("_o.n").alias("dying_n"))


def spanning_tree(vectors: DataFrame, dist: DataFrame | None = None) -> DataFrame:
    """Tree edges (well_id, i, j, w) with the bins of the component each merge ends (dying_lo, dying_hi, dying_n)."""
    return merges(vectors, tree_edges(bin_distances(vectors) if dist is None else dist))


def well_curves(vectors: DataFrame, dist: DataFrame, tree: DataFrame, n_steps: int = 50) -> DataFrame:
    """Per well as arrays of ``n_steps``: thresholds eps, components b0, cycles b1 (edges of distance 0 do not count).

    b0 falls by one at every tree edge, so no component search per threshold is needed; b1 = edges - nodes + b0.
    """
    top = dist.groupBy("well_id").agg(F.percentile("d", F.lit(0.95)).alias("eps_max"), F.max("d").alias("d_max"))
    n = vectors.groupBy("well_id").agg(F.count(F.lit(1)).alias("n"))
    par = top.join(n, "well_id").withColumn("step", c("eps_max") / F.lit(float(n_steps - 1)))
    # First grid index at or above a distance, corrected for rounding of the division.
    k0 = F.ceil(c("d") / c("step"))
    k = F.when((k0 - 1) * c("step") >= c("d"), k0 - 1).when(k0 * c("step") < c("d"), k0 + 1).otherwise(k0).cast("int")
    slot = lambda df: df.join(par.select("well_id", "step"), "well_id").where("d > 0").withColumn("k", k).where(c("k") < n_steps) \
        .groupBy("well_id", "k").agg(F.count(F.lit(1)).alias("m")).groupBy("well_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("m"))
    e = slot(dist.select("well_id", "d")).withColumnRenamed("m", "_e")
    t = slot(tree.select("well_id", c("w").alias("d"))).withColumnRenamed("m", "_t")
    bars = tree.groupBy("well_id").agg(F.sort_array(F.collect_list("w")).alias("deaths"))
    j = par.join(e, "well_id", "left").join(t, "well_id", "left").join(bars, "well_id", "left")
    grid = F.sequence(F.lit(0), F.lit(n_steps - 1))
    upto = lambda m, i: F.aggregate(F.filter(F.map_entries(F.coalesce(c(m), F.create_map().cast("map<int,bigint>"))), lambda x: x["key"] <= i),
                                    F.lit(0).cast("bigint"), lambda s, x: s + x["value"])
    j = j.withColumns({"eps": F.transform(grid, lambda i: i * c("step")), "b0": F.transform(grid, lambda i: c("n") - upto("_t", i)),
                       "_ne": F.transform(grid, lambda i: upto("_e", i))})
    b1 = F.zip_with("_ne", "b0", lambda a, b: F.greatest(F.lit(0).cast("bigint"), a - c("n") + b))
    return j.withColumn("b1", b1).select("well_id", "n", "eps_max", "d_max", "eps", "b0", "b1", "deaths")


def bars(curves: DataFrame) -> DataFrame:
    """One bar per tree edge plus the one that never ends, drawn to 1.1 times the largest distance."""
    rows = F.concat(F.transform("deaths", lambda x: F.struct(x.alias("death"), F.lit(False).alias("endless"))),
                    F.array(F.struct((c("d_max") * 1.1).alias("death"), F.lit(True).alias("endless"))))
    return curves.select("well_id", F.posexplode(rows).alias("bar", "_b")).select("well_id", "bar", F.lit(0.0).alias("birth"), "_b.*")


def bar_curves(curves: DataFrame, n_steps: int = 200) -> DataFrame:
    """Bars alive on an even grid up to the largest distance."""
    g = curves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1)))).withColumn("eps", c("k") * c("d_max") / F.lit(float(n_steps - 1)))
    return g.select("well_id", "k", "eps", (F.size(F.filter("deaths", lambda d: d > c("eps"))) + 1).alias("alive"))


def landscapes(curves: DataFrame, top: int = 5, n_steps: int = 50) -> DataFrame:
    """The ``top`` highest tents over each grid value (one tent per finite bar)."""
    g = curves.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1)))).withColumn("t", c("k") * c("d_max") / F.lit(float(n_steps - 1)))
    tents = F.sort_array(F.transform("deaths", lambda d: F.when(c("t") <= d, F.least(c("t"), d - c("t"))).otherwise(F.lit(0.0))), asc=False)
    return g.select("well_id", "k", F.posexplode(F.slice(tents, 1, top)).alias("level", "height"))


def persistence_curve(curves: DataFrame) -> DataFrame:
    """Total persistence of the bars alive at each threshold."""
    g = curves.select("well_id", "eps_max", "deaths", F.posexplode("eps").alias("k", "e"))
    alive = F.aggregate(F.filter("deaths", lambda d: d > c("e")), F.lit(0.0), lambda s, d: s + d)
    return g.select("well_id", "k", (alive + c("eps_max")).alias("persistence"))


def gini(values: Column) -> Column:
    """Gini coefficient of an array; 0 when it is empty or sums to 0."""
    s = F.sort_array(values)
    n, total = F.size(s), F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
    ranked = F.aggregate(F.transform(s, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when((n == 0) | (total == 0), F.lit(0.0)).otherwise(F.lit(2.0) * ranked / (n * total) - (n + 1) / n)


def waypoints(curves: DataFrame) -> DataFrame:
    """Onset scale, number of waypoints, Gini at onset with its slope, and the routing decision.

    Cycles come from b1; the Gini trajectory runs over the component bars.
    """
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    steps = F.transform(F.slice("b1", 2, F.size("b1") - 1), lambda x, i: (x - F.get(c("b1"), i)) / F.when(
        F.get(c("eps"), i + 1) == F.get(c("eps"), i), F.lit(1e-10)).otherwise(F.get(c("eps"), i + 1) - F.get(c("eps"), i)))
    d = curves.withColumn("_dv", F.transform(steps, F.abs)).withColumn("_mu", mean(c("_dv")))
    d = d.withColumn("_sd", F.sqrt(mean(F.transform("_dv", lambda x: (x - c("_mu")) * (x - c("_mu"))))))
    flat = F.array_max("_dv") == 0
    d = d.withColumn("n_waypoints", F.when(flat, F.lit(0)).otherwise(F.size(F.filter("_dv", lambda x: x > c("_mu") + c("_sd")))))
    first = F.array_min(F.transform("b1", lambda x, i: F.when(x > 0, i)))
    last = F.size("eps") - 1
    d = d.withColumn("_o", F.coalesce(first, last))
    life = lambda e: F.concat(F.filter("deaths", lambda x: x > e), F.array(c("eps_max")))
    at = lambda i: F.when(F.size(life(F.get("eps", i))) >= 2, gini(life(F.get("eps", i)))).otherwise(F.lit(0.0))
    inner = (c("_o") > 0) & (c("_o") < last)
    slope = F.when(inner, (at(c("_o") + 1) - at(c("_o") - 1)) / (F.get("eps", c("_o") + 1) - F.get("eps", c("_o") - 1))).otherwise(F.lit(0.0))
    d = d.select("well_id", F.get("eps", c("_o")).alias("onset_scale"), "n_waypoints", at(c("_o")).alias("gini_at_onset"), slope.alias("gini_slope"))
    g = c("gini_slope")
    return d.withColumn("routing", F.when(c("n_waypoints") > 3, "SPLIT").when(g > 0.01, "ASCEND").when(g < -0.01, "REPROBE").otherwise("HOLD"))


def regime_boundaries(tree: DataFrame, vectors: DataFrame, percentile: float = 0.75) -> DataFrame:
    """Merges at or above the persistence percentile: the depth range of the component that ends there."""
    cut = tree.where("w > 0").groupBy("well_id").agg(F.percentile("w", F.lit(percentile)).alias("_c"))
    lo = vectors.select("well_id", c("bin").alias("dying_lo"), c("centre").alias("top"))
    hi = vectors.select("well_id", c("bin").alias("dying_hi"), c("centre").alias("bottom"))
    t = tree.join(cut, "well_id").where(c("w") >= c("_c"))
    return t.join(lo, ["well_id", "dying_lo"]).join(hi, ["well_id", "dying_hi"]).select(
        "well_id", "i", "j", c("w").alias("persistence"), "top", "bottom", c("dying_n").alias("n_bins"))
