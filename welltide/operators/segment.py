"""Segmentation of a well's samples: thresholds, rig states, runs, transitions and stands."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from welltide.operators.blocks import blocks, joined, numbers
from welltide.operators.quantiles import SMALL, exact_percentiles
from welltide.operators.series import CHUNK, attach, bounded, carry, chunk_of, chunk_window, halo, previous, runs, with_chunk
from welltide.session import stage

c = F.col


def histogram(long: DataFrame, keys: Sequence[str], v: str, n_bins: Column, size: int = CHUNK, pos: str = "pos") -> DataFrame:
    """Equal-width counts per key as an array of ``nb`` (at most 100) entries, with n, mn, mx and last_pos.

    ``n_bins`` is an expression over ``n``, the number of non-null values.
    """
    keys = list(keys)
    rows = long.select(*keys, pos, c(v).alias("_v")).where("_v is not null")
    st = rows.groupBy(*keys).agg(F.count("_v").alias("n"), F.min("_v").alias("mn"), F.max("_v").alias("mx"),
                                 F.max(pos).alias("last_pos")).withColumn("nb", n_bins.cast("int"))
    b = F.least(c("nb") - 1, F.floor((c("_v") - c("mn")) / (c("mx") - c("mn")) * c("nb"))).cast("int")
    counts = (attach(rows, st.select(*keys, "mn", "mx", "nb", "last_pos"), keys, size=size, pos=pos)
              .groupBy(*keys, F.when(c("mx") > c("mn"), b).otherwise(F.lit(0)).alias("b")).agg(F.count(F.lit(1)).alias("k")))
    bins = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "k"))).alias("_m"))
    dense = F.transform(F.sequence(F.lit(0), c("nb") - 1), lambda i: F.coalesce(c("_m")[i], F.lit(0)))
    return st.join(bins, keys).withColumn("counts", dense).drop("_m")


def smoothed_peaks(hist: DataFrame, positive_only: bool = False) -> DataFrame:
    """Add the smoothed counts ``s``, the two highest peaks p1 < p2 and the first valley bin between them."""
    at = lambda a, i: F.coalesce(F.get(a, i), F.lit(0))
    h = hist.withColumn("s", F.transform("counts", lambda k, i: (at(c("counts"), i - 1) + k * 2 + at(c("counts"), i + 1)) / F.lit(4.0)))
    s = c("s")
    is_peak = lambda i: (F.get(s, i) >= F.get(s, i - 1)) & (F.get(s, i) >= F.get(s, i + 1)) & ((F.get(s, i) > 0) if positive_only else F.lit(True))
    h = h.withColumn("_pk", F.sort_array(F.transform(F.filter(F.sequence(F.lit(1), c("nb") - 2), is_peak),
                                                     lambda i: F.struct(F.get(s, i).alias("h"), i.alias("i"))), asc=False))
    a, b = F.get("_pk", 0)["i"], F.get("_pk", 1)["i"]
    h = h.withColumns({"p1": F.least(a, b), "p2": F.greatest(a, b), "n_peaks": F.size("_pk")})
    usable = (c("n_peaks") >= 2) & (c("p2") - c("p1") >= 2)
    valley = F.array_min(F.transform(F.sequence("p1", "p2"), lambda i: F.struct(F.get(s, i).alias("h"), i.alias("i"))))
    h = h.withColumn("_va", F.when(usable, valley)).withColumn("valley", c("_va")["i"]).withColumn("valley_height", c("_va")["h"])
    centre = c("mn") + (c("valley") + 0.5) * (c("mx") - c("mn")) / c("nb")
    return h.withColumn("cut", F.when(usable & (c("mx") > c("mn")), centre)).drop("_pk", "_va")


def minority_share(rows: DataFrame, cuts: DataFrame, keys: Sequence[str], v: str, size: int, pos: str = "pos") -> DataFrame:
    """Share of the smaller side of each key's cut."""
    j = attach(rows.where(c(v).isNotNull()), cuts.select(*keys, "cut", "last_pos").where("cut is not null"), keys, size=size, pos=pos, how="inner")
    g = j.groupBy(*keys).agg(F.sum((c(v) < c("cut")).cast("int")).alias("_lo"), F.count(F.lit(1)).alias("_all"))
    return g.select(*keys, (F.least(c("_lo"), c("_all") - c("_lo")) / c("_all")).alias("minority"))


def bimodal_thresholds(long: DataFrame, keys: Sequence[str], v: str, size: int = CHUNK, pos: str = "pos") -> DataFrame:
    """Valley between the two main histogram peaks per key; the median where there is no clear valley."""
    keys = list(keys)
    nb = F.least(F.lit(100), F.greatest(F.lit(10), F.ceil(F.log2(c("n"))) + 1))
    h = smoothed_peaks(histogram(long, keys, v, nb, size, pos))
    h = stage(h.select(*keys, "n", "mn", "mx", "cut", "last_pos"), "cuts")
    h = h.join(minority_share(long, h, keys, v, size, pos), keys, "left")
    # Wells without a clear valley are few; only their values go through the exact median.
    clear = c("cut").isNotNull() & (c("minority") >= 0.05)
    h = stage(h, "shares")
    need = h.where(~F.coalesce(clear, F.lit(False)) & (c("mx") > c("mn")))
    med = exact_percentiles(attach(long, need.select(*keys, "last_pos"), keys, size=size, pos=pos, how="inner"),
                            keys, c(v), {"_median": 0.5}, size=size, pos=pos)
    return h.join(med, keys, "left").select(
        *keys, "last_pos", F.when(c("mx") == c("mn"), c("mn")).when(clear, c("cut")).otherwise(c("_median")).alias("threshold"))


def block_steps(wide: DataFrame, size: int = CHUNK) -> DataFrame:
    """Step of the block position per sample; the first sample takes the second one's step."""
    return bounded(wide, ["well_id"], 1, 1, lambda w: {"step": F.coalesce(F.when(
        c("pos") == 0, F.lead("block_position").over(w) - c("block_position")).otherwise(
        c("block_position") - F.lag("block_position").over(w)), F.lit(0.0))}, size)


def motion_dead_band(steps: DataFrame, size: int = CHUNK) -> DataFrame:
    p = exact_percentiles(steps.where(F.abs("step") > 0), ["well_id"], F.abs("step"), {"_p": 0.25}, size=size)
    return p.select("well_id", (c("_p") * 0.5).alias("dead_band"))


def block_motion(step: Column, dead_band: Column) -> Column:
    d = F.coalesce(dead_band, F.lit(0.0))
    return F.when(step > d, "UP").when(step < -d, "DOWN").otherwise("STATIC")


def confirmed(raw: str, n: int, w) -> Column:
    """The raw flag where it has held for ``n - 1`` samples (or at the first sample), else null."""
    span = w.rowsBetween(-(n - 2), 0)
    held = (F.count(F.lit(1)).over(span) == n - 1) & (F.min(raw).over(span) == F.max(raw).over(span))
    return F.when((c("pos") == 0) | held, c(raw))


def hysteresis(df: DataFrame, flags: Sequence[str], n: int, size: int = CHUNK) -> DataFrame:
    """Flags that flip only after ``n - 1`` samples of the new value."""
    d = bounded(df, ["well_id"], n - 2, 0, lambda w: {f"_ok_{f}": confirmed(f, n, w) for f in flags}, size, keep_chunk=True)
    return carry(d, ["well_id"], last={f"{f}_held": c(f"_ok_{f}") for f in flags}, size=size).drop(*[f"_ok_{f}" for f in flags])


def sample_state(pumps: Column, rotating: Column, motion: Column) -> Column:
    return (F.when(pumps & rotating, F.when(motion == "DOWN", "drilling").when(motion == "UP", "reaming").otherwise("circulating"))
            .when(pumps, F.when(motion == "DOWN", "sliding").otherwise("circulating"))
            .when(~rotating, F.when(motion == "STATIC", "static").otherwise("tripping")).otherwise("unknown"))


def reclassify_connections(df: DataFrame, size: int = CHUNK) -> DataFrame:
    """Idle stretches (tripping or static) that trip and move up before moving down become connections."""
    d = runs(df.withColumn("_idle", c("state").isin("tripping", "static")), ["well_id"], "_idle", size)
    g = d.where("_idle").groupBy("well_id", "run_start").agg(
        F.bool_or(c("state") == "tripping").alias("_trip"), F.min(F.when(c("motion") == "UP", c("pos"))).alias("_up"),
        F.max(F.when(c("motion") == "DOWN", c("pos"))).alias("_down"), F.max("pos").alias("_end"))
    g = g.where("_trip and _up < _down").select("well_id", "run_start", F.explode(F.sequence(
        chunk_of("run_start", size), chunk_of("_end", size))).alias("_chunk"), F.lit(True).alias("_conn"))
    j = with_chunk(d, size).join(g, ["well_id", "_chunk", "run_start"], "left")
    return j.withColumn("state", F.when(c("_idle") & c("_conn").isNotNull(), "connection").otherwise(c("state"))) \
        .drop("_idle", "_conn", "run_start", "_chunk")


def debounce(df: DataFrame, min_samples: int, size: int = CHUNK) -> DataFrame:
    """Absorb runs shorter than ``min_samples`` into their neighbour, in one pass over run boundaries.

    After the first long run, short runs take the last long run's state. A leading block of short runs takes the
    first long run's state when the block itself is short, else the second run's state; if no run is long,
    everything becomes the second run's state.
    """
    if min_samples <= 1:
        return df
    p = previous(df, ["well_id"], {"_prev": c("state")}, size, keep_chunk=True)
    start = F.when(c("_prev").isNull() | (c("_prev") != c("state")), c("pos"))
    p = p.withColumn("_start", start).drop("_prev")
    p = carry(p, ["well_id"], last={"_first": c("_start")}, following={"_next": c("_start")}, size=size)
    p = stage(p, "runs")
    ends = p.groupBy("well_id").agg(F.max("pos").alias("last_pos"))
    p = attach(p, ends.withColumn("_n", c("last_pos") + 1), ["well_id"], size=size)
    p = p.withColumn("_long", F.coalesce("_next", "_n") - c("_first") >= min_samples)
    lead = p.groupBy("well_id").agg(
        F.max("pos").alias("last_pos"), F.min(F.when(c("_long"), c("pos"))).alias("_lp"),
        F.min_by("state", F.when(c("_long"), c("pos"))).alias("_ls"),
        F.min_by("state", F.when(c("_start") > 0, c("pos"))).alias("_second"))
    p = carry(p, ["well_id"], last={"_kept": F.when(c("_long"), c("state"))}, size=size)
    p = attach(p, lead, ["well_id"], size=size)
    final = F.when(c("_kept").isNotNull(), c("_kept")).when(c("_lp").isNotNull() & (c("_lp") < min_samples), c("_ls")) \
        .otherwise(F.coalesce("_second", "state"))
    return p.withColumn("state", final).select(*df.columns)


def detect_states(wide: DataFrame, min_samples: int = 30, size: int = CHUNK, keep: Sequence[str] = (), moves: bool = False, small: int = SMALL) -> DataFrame:
    """Rig state per sample: (well_id, pos, state, motion, *keep).

    Needs flow_in (or spp), rpm (or torque), block_position and optionally wob. A missing channel counts as off.
    ``moves`` adds the state one sample earlier, from_state, and the well's last_pos.

    The samples of a well of fewer than ``small`` positions (and fewer than a chunk) meet in one task, which goes through all steps
    with them, so they are shuffled once. Larger wells, and those with values that are missing or not finite, take the chunked way.
    """
    cols = wide.columns
    pump = "flow_in" if "flow_in" in cols else "spp"
    rot = "rpm" if "rpm" in cols else "torque"
    used = [pump, rot, "block_position", *(["wob"] if "wob" in cols else [])]
    names = [f"_u{i}" for i in range(len(used))]
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = wide.where("well_id is not null and pos is not null").select("well_id", c("pos").cast("long").alias("pos"), *[c(x).cast("double").alias(n) for x, n in zip(used, names)],
                                                                        *[c(x).alias(n) for x, n in zip(keep, kept)])
    odd = F.greatest(*[(c(n).isNull() | F.isnan(n) | (F.abs(n) == float("inf"))).cast("int") for n in names])
    n = F.count(F.lit(1))
    loose = (F.min("pos") != 0) | (F.max("pos") != n - 1) | (F.sum("pos") * 2 != n * (n - 1))
    far = rows.groupBy("well_id").agg(F.max("pos").alias("_last"), F.max(odd).alias("_odd"), loose.alias("_loose"))
    far = stage(far.where((c("_last") >= min(small, size)) | (c("_odd") == 1) | c("_loose")).select("well_id"), "large-wells")
    types, some = dict(rows.dtypes), not far.isEmpty()
    few = rows.join(F.broadcast(far), "well_id", "left_anti") if some else rows
    few = few.withColumn("_g", F.xxhash64("well_id")).repartition("well_id").sortWithinPartitions("well_id", "pos")
    schema = [f"well_id {types['well_id']}", "pos long", "state string", "motion string", *[f"{k} {types[k]}" for k in kept], *(["from_state string", "last_pos long"] if moves else [])]
    out = few.mapInArrow(_states(names, kept, min_samples, moves), ", ".join(schema))
    out = out.withColumnsRenamed(dict(zip(kept, keep)))
    if not some:
        return out
    d = _detect_chunked(wide.join(F.broadcast(far), "well_id", "left_semi"), min_samples, size, keep)
    if moves:
        d = previous(stage(d, "large-states"), ["well_id"], {"from_state": c("state")}, size)
        d = attach(d, d.groupBy("well_id").agg(F.max("pos").alias("last_pos"), F.max("pos").alias("_last")), ["well_id"], size=size).withColumnRenamed("_last", "last_pos")
    return out.unionByName(d.withColumn("pos", c("pos").cast("long")))


#: States in the order of their numbers.
STATES = np.array(["drilling", "reaming", "circulating", "sliding", "static", "tripping", "unknown", "connection", "washing", "backreaming_down"], object)
MOTIONS = np.array(["STATIC", "UP", "DOWN"], object)


def _states(names: list[str], kept: list[str], min_samples: int, moves: bool):
    """Sorted samples of wells to their states."""

    def one(block: pa.Table) -> pa.RecordBatch:
        x, _ = numbers(block, names)
        state, motion = states_of_well(x[:, 0], x[:, 1], x[:, 2], np.abs(x[:, 3]) if x.shape[1] > 3 else None, min_samples)
        label = pa.array(STATES, pa.string()).take(pa.array(state))
        out = {"well_id": block["well_id"].combine_chunks(), "pos": block["pos"].combine_chunks(), "state": label, "motion": pa.array(MOTIONS, pa.string()).take(pa.array(motion)),
               **{k: block[k].combine_chunks() for k in kept}}
        if moves:
            out |= {"from_state": pa.concat_arrays([pa.nulls(1, pa.string()), label[:-1]]), "last_pos": pa.repeat(block["pos"][-1], block.num_rows)}
        return pa.record_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(one(block) for block in blocks(batches))

    return run


def _percentile(v: np.ndarray, p: float) -> float:
    """As ``exact_percentiles``; NaN of nothing."""
    if not len(v):
        return math.nan
    at = p * (len(v) - 1)
    low, high = math.floor(at), math.ceil(at)
    v = np.partition(v, (low, high))
    return float(v[low] + (v[high] - v[low]) * (at - low))


def _threshold(v: np.ndarray) -> float:
    """As ``bimodal_thresholds``, of one group."""
    n, lo, hi = len(v), v.min(), v.max()
    if lo == hi:
        return float(lo)
    nb = int(min(100, max(10, math.ceil(math.log(n) / math.log(2)) + 1)))
    k = np.bincount(np.minimum(nb - 1, np.floor((v - lo) / (hi - lo) * nb)).astype(np.int64), minlength=nb)
    padded = np.concatenate([[0], k, [0]])
    s = (padded[:-2] + k * 2 + padded[2:]) / 4.0
    peaks = np.flatnonzero((s[1:-1] >= s[:-2]) & (s[1:-1] >= s[2:])) + 1
    if len(peaks) >= 2:
        a, b = np.sort(peaks[np.lexsort((peaks, s[peaks]))[-2:]])
        if b - a >= 2:
            cut = lo + (a + s[a:b + 1].argmin() + 0.5) * (hi - lo) / nb
            below = int((v < cut).sum())
            if min(below, n - below) / n >= 0.05:
                return float(cut)
    return _percentile(v, 0.5)


def _held(raw: np.ndarray, n: int) -> np.ndarray:
    """As ``hysteresis``: a flag flips once its new value has held for ``n - 1`` samples."""
    at = np.arange(len(raw))
    flips = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1])
    since = flips[np.searchsorted(flips, at, "right") - 1]
    sure = (at == 0) | ((at - since >= n - 2) & (at >= n - 2))
    return raw[np.maximum.accumulate(np.where(sure, at, 0))]


def states_of_well(pump: np.ndarray, rot: np.ndarray, block: np.ndarray, load: np.ndarray | None, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of state and motion of one well's samples in order, by the steps of the chunked way."""
    n = len(block)
    step = np.zeros(n)
    step[1:] = np.diff(block)
    step[:1] = step[1:2] if n > 1 else 0.0
    size = np.abs(step)
    on = lambda x, t: x > 0.0 if t == 0.0 else x >= t
    pumps, rotating = (_held(on(x, _threshold(x)), max(3, min_samples // 10)) for x in (pump, rot))
    dead = _percentile(size[size > 0], 0.25) * 0.5
    dead = 0.0 if math.isnan(dead) else dead
    motion = np.where(step > dead, 1, np.where(step < -dead, 2, 0))
    up, down = motion == 1, motion == 2
    state = np.select([pumps & rotating & down, pumps & rotating & up, pumps & down & ~rotating, pumps, ~rotating & (motion == 0), ~rotating], [0, 1, 3, 2, 4, 5], 6)
    slow = _percentile(size[(state == 0) & (size > 0)], 0.25)
    washed, slowed = (state == 3) & (load < _threshold(load)) if load is not None else np.zeros(n, bool), (state == 0) & (size < slow)
    # Idle stretches that trip and move up before they move down.
    idle = (state == 4) | (state == 5)
    starts = np.concatenate([[0], np.flatnonzero(idle[1:] != idle[:-1]) + 1])
    at = np.arange(n)
    first_up, last_down = np.minimum.reduceat(np.where(up, at, n), starts), np.maximum.reduceat(np.where(down, at, -1), starts)
    linked = idle[starts] & np.logical_or.reduceat(state == 5, starts) & (first_up < last_down)
    state[np.repeat(linked, np.diff(np.append(starts, n)))] = 7
    state[washed], state[slowed] = 8, 9
    return _debounced(state, min_samples), motion


def _debounced(state: np.ndarray, min_samples: int) -> np.ndarray:
    """As ``debounce``, of one well."""
    if min_samples <= 1:
        return state
    n = len(state)
    starts = np.concatenate([[0], np.flatnonzero(state[1:] != state[:-1]) + 1])
    sizes = np.diff(np.append(starts, n))
    long, of = sizes >= min_samples, state[starts]
    last = np.maximum.accumulate(np.where(long, np.arange(len(starts)), -1))
    lead = of.copy()
    if long.any() and starts[long.argmax()] < min_samples:
        lead[:] = of[long.argmax()]
    elif len(of) > 1:
        lead[:] = of[1]
    return np.repeat(np.where(last >= 0, of[last], lead), sizes)


def _detect_chunked(wide: DataFrame, min_samples: int, size: int, keep: Sequence[str]) -> DataFrame:
    cols = wide.columns
    pump = "flow_in" if "flow_in" in cols else "spp"
    rot = "rpm" if "rpm" in cols else "torque"
    has_wob = "wob" in cols
    held = ["_keep"] if keep else []
    base = wide.select("well_id", "pos", c(pump).alias("pump"), c(rot).alias("rot"), "block_position",
                       *([F.abs("wob").alias("load")] if has_wob else []), *([F.struct(*keep).alias("_keep")] if keep else []))
    base = stage(block_steps(base, size), "steps")
    chans = ["pump", "rot"] + (["load"] if has_wob else [])
    thr = bimodal_thresholds(base.unpivot(["well_id", "pos"], chans, "ch", "v"), ["well_id", "ch"], "v", size)
    last = base.groupBy("well_id").agg(F.max("pos").alias("last_pos"))
    par = thr.groupBy("well_id").pivot("ch", chans).agg(F.first("threshold"))
    par = par.select("well_id", *[c(x).alias(f"{x}_thr") for x in chans])
    par = stage(last.join(par, "well_id", "left").join(motion_dead_band(base, size), "well_id", "left"), "well-parameters")
    rows = attach(base, par, ["well_id"], size=size)
    on = lambda x: F.coalesce(F.when(c(f"{x}_thr") == 0.0, c(x) > 0.0).otherwise(c(x) >= c(f"{x}_thr")), F.lit(False))
    rows = rows.withColumns({"pumps": on("pump"), "rotating": on("rot"), "motion": block_motion(c("step"), c("dead_band"))})
    rows = rows.drop("pump", "rot", "pump_thr", "rot_thr", "dead_band", "block_position")
    rows = hysteresis(rows, ["pumps", "rotating"], max(3, min_samples // 10), size)
    rows = rows.withColumn("state", sample_state(c("pumps_held"), c("rotating_held"), c("motion")))
    rows = stage(rows.drop("pumps", "rotating", "pumps_held", "rotating_held"), "raw-states")
    descent = exact_percentiles(rows.where("state = 'drilling' and abs(step) > 0"), ["well_id"], F.abs("step"), {"_slow": 0.25}, size=size)
    d = reclassify_connections(rows, size)
    d = attach(d, last.join(descent, "well_id"), ["well_id"], size=size)
    wash = (c("state") == "sliding") & (c("load") < c("load_thr")) if has_wob else F.lit(False)
    slow = (c("state") == "drilling") & (F.abs("step") < c("_slow"))
    d = d.withColumn("state", F.when(wash, "washing").when(slow, "backreaming_down").otherwise(c("state")))
    d = stage(d.select("well_id", "pos", "state", "motion", *held), "states")
    return debounce(d, min_samples, size).select("well_id", "pos", "state", "motion", *([f"_keep.{k}" for k in keep]))


def timeline(states: DataFrame, depth: str = "depth_md", size: int = CHUNK) -> DataFrame:
    """Runs of equal state: one row per run with its span."""
    r = runs(states, ["well_id"], "state", size)
    return r.groupBy("well_id", "run_start").agg(
        F.first("state").alias("state"), F.max("pos").alias("run_end"), F.count(F.lit(1)).alias("n_samples"),
        F.min(depth).alias("depth_top"), F.max(depth).alias("depth_bottom"))


def transitions(states: DataFrame, depth: str = "depth_md", size: int = CHUNK, keep: Sequence[str] = ()) -> DataFrame:
    """Samples whose state differs from the one before; states that came with ``moves`` need no window for it."""
    p = states if "from_state" in states.columns else previous(states, ["well_id"], {"from_state": c("state")}, size)
    return p.where("from_state is not null and from_state <> state").select(
        "well_id", "pos", "from_state", c("state").alias("to_state"), c(depth).alias("depth"), *keep)


def stands(wide: DataFrame, depth: str = "depth_md", min_length: float = 20.0, min_travel: float = 5.0,
           size: int = CHUNK) -> DataFrame:
    """Down-strokes of the block: smoothed velocity turning negative opens a stand, turning positive closes it."""
    v = block_steps(wide.select("well_id", "pos", "block_position", c(depth).alias("depth")), size)
    v = halo(v, 4, 3, size)
    w = chunk_window(["well_id"])
    v = v.withColumn("_sign", F.signum(F.sum("step").over(w.rowsBetween(-3, 3)) / F.lit(7.0)))
    v = v.withColumn("_turn", c("_sign") - F.lag("_sign").over(w)).where("_own").drop("_own", "_chunk", "_sign", "step")
    v = stage(v, "turns")
    here = F.struct("pos", "depth", "block_position")
    par = v.groupBy("well_id").agg(
        F.max("pos").alias("last_pos"), F.min(F.when(c("_turn") >= 1.5, c("pos"))).alias("_e0"),
        F.min(F.when(c("_turn") <= -1.5, c("pos"))).alias("_s0"), F.max_by(here, "pos").alias("_tail"))
    d = carry(v, ["well_id"], following={"_end": F.when(c("_turn") >= 1.5, here)}, size=size)
    d = attach(d, par.where("last_pos >= 9 and _e0 is not null"), ["well_id"], size=size, how="inner")
    opened = (c("_turn") <= -1.5) | ((c("pos") == 0) & (c("_s0").isNull() | (c("_e0") < c("_s0"))))
    d = d.where(opened).withColumn("e", F.coalesce("_end", "_tail"))
    d = d.where((F.abs(c("e.depth") - c("depth")) >= min_length) & (F.abs(c("block_position") - c("e.block_position")) >= min_travel))
    return d.select("well_id", c("pos").alias("index_start"), c("e.pos").alias("index_end"), c("depth").alias("depth_start"),
                    c("e.depth").alias("depth_end"), c("block_position").alias("block_start"),
                    c("e.block_position").alias("block_end"), (c("e.pos") - c("pos")).alias("duration_samples"))


def numbered_stands(found: DataFrame) -> DataFrame:
    """Stand numbers from 1 in depth order, counted per chunk of samples."""
    from welltide.operators.series import dense_positions
    d = dense_positions(found, ["well_id"], [c("index_start")], chunk_of("index_start", CHUNK), "_k")
    return d.withColumn("stand_number", c("_k") + 1).drop("_k")
