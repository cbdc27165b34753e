"""What channels do in each rig state: profiles, pairwise relationships and transition responses."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from welltide.operators.blocks import blocks, joined, numbers
from welltide.operators.correlations import N, correlation, moments, undefined
from welltide.operators.joins import neighbours, pair_correlations
from welltide.operators.quantiles import SMALL
from welltide.operators.segment import histogram, minority_share, smoothed_peaks
from welltide.operators.series import CHUNK, attach, chunk_of, dense_positions, halo
from welltide.session import stage

c = F.col
MIN_RELATED = 30      # samples a relationship needs
MIN_STRENGTH = 0.3
MAX_LAG = 100
WINDOW = 50           # samples before and after a transition


# --- per-state profiles --------------------------------------------------------------------------------

def ranked_in_state(long: DataFrame, size: int = CHUNK) -> DataFrame:
    """Non-null samples of (well, channel, state) numbered in order as ``rn``."""
    return dense_positions(long.where("v is not null"), ["well_id", "channel", "state"], [c("pos")], chunk_of("pos", size), "rn")


def state_profiles(long: DataFrame, size: int = CHUNK) -> DataFrame:
    """Range, variance, distribution class, trend and informativeness per (well, channel, state), five samples up.

    ``long``: well_id, pos, channel, state, v.
    """
    keys = ["well_id", "channel", "state"]
    r = stage(ranked_in_state(long, size).select(*keys, "rn", "v"), "ranked")
    nb = F.least(F.lit(100), F.greatest(F.lit(50), F.floor(F.sqrt(c("n")))))
    h = smoothed_peaks(histogram(r, keys, "v", nb, size, "rn"), positive_only=True)
    low_peak = F.least(F.get(c("s"), c("p1")), F.get(c("s"), c("p2")))
    deep = (c("n") >= 10) & c("cut").isNotNull() & (low_peak > 0) & (c("valley_height") < low_peak * 0.7)
    h = stage(h.select(*keys, "last_pos", F.when(deep, c("cut")).alias("cut")), "valleys")
    mi = minority_share(r, h, keys, "v", size, "rn")
    g = r.groupBy(*keys).agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.var_pop("v").alias("variance"),
                             F.skewness("v").alias("_sk"), F.kurtosis("v").alias("_ku"), F.regr_slope("v", "rn").alias("_sl")).where("n >= 5")
    g = g.join(mi, keys, "left")
    spread = c("hi") - c("lo")
    varied = spread > 0
    kind = (F.when(c("n") < 10, "other").when(F.coalesce(c("minority") >= 0.05, F.lit(False)), "bimodal").when(~varied, "other")
            .when((F.abs("_sk") < 0.5) & (F.abs("_ku") < 1.0), "normal").when(F.abs("_sk") > 1.0, "skewed")
            .when(c("_ku") > 2.0, "heavy_tailed").otherwise("other"))
    move = c("_sl") * c("n") / spread
    trend = F.when(~varied, "flat").when(move > 0.1, "increasing").when(move < -0.1, "decreasing").otherwise("flat")
    return g.select(*keys, "n", "lo", "hi", "variance", kind.alias("distribution"), trend.alias("trend"),
                    F.when(varied, F.sqrt("variance") / spread > 0.01).otherwise(F.lit(False)).alias("informative"))


def profiles_in_states(wide: DataFrame, channels: Sequence[str], size: int = CHUNK, small: int = SMALL) -> DataFrame:
    """``state_profiles`` of rows (well_id, pos, state, channels) that keep their channels side by side.

    The rows of a (well, state) of fewer than ``small`` rows meet in one task, which makes the profiles of all channels
    from them, so a sample is shuffled once and not once per channel and step. Larger groups, and those with values
    that are not finite, take the chunked way. Both are branches of one plan.
    """
    keys = ["well_id", "state"]
    rows = wide.select(*keys, "pos", *[c(x).cast("double").alias(x) for x in channels])
    few, far = small_groups(rows, channels, small)
    near = few.drop("pos").mapInArrow(_profiles(list(channels)), f"well_id {dict(rows.dtypes)['well_id']}, channel string, state string, n long, lo double, hi double, "
                                      "variance double, distribution string, trend string, informative boolean")
    long = rows.join(F.broadcast(far), keys, "left_semi").unpivot(["well_id", "pos", "state"], list(channels), "channel", "v")
    return near.unionByName(state_profiles(long, size))


def small_groups(rows: DataFrame, channels: Sequence[str], small: int) -> tuple[DataFrame, DataFrame]:
    """The rows of the (well, state) groups of fewer than ``small`` rows with finite values, each group in one task and in order; and the
    names of the other groups."""
    keys = ["well_id", "state"]
    odd = F.max(F.greatest(*[F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False)).cast("int") for x in channels], F.lit(0)))
    far = stage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), odd.alias("_odd")).where((c("_n") >= small) | (c("_odd") == 1)).select(*keys), "large-states")
    # At most one in ``small`` rows, unless values are not finite.
    few = rows.join(F.broadcast(far), keys, "left_anti").where("well_id is not null and state is not null")
    return few.withColumn("_g", F.xxhash64(*keys)).repartition(*keys).sortWithinPartitions(*keys, "pos"), far


def _profiles(channels: list[str]):
    """Sorted rows of (well, state) groups to one row per channel with at least five samples."""
    names = np.array(channels, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            if block.num_rows < 5:
                continue
            x, present = numbers(block, channels)
            n = present.sum(axis=0)
            at = np.flatnonzero(n >= 5)
            if len(at):
                p = described(x[:, at], present[:, at], n[at])
                yield pa.record_batch({
                    "well_id": pa.repeat(block["well_id"][0], len(at)), "channel": pa.array(names[at], pa.string()), "state": pa.repeat(block["state"][0], len(at)),
                    **{k: pa.array(v, pa.string()) if v.dtype == object else pa.array(v) for k, v in p.items()}})

    return run


def described(x: np.ndarray, present: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Range, variance, distribution class, trend and informativeness per column of ``x``, of which ``present`` values count."""
    lo, hi = np.where(present, x, np.inf).min(axis=0), np.where(present, x, -np.inf).max(axis=0)
    mean = np.where(present, x, 0.0).sum(axis=0) / n
    d = np.where(present, x - mean, 0.0)
    d2 = d * d
    m2 = d2.sum(axis=0)
    rn = np.cumsum(present, axis=0) - 1.0
    slope_n, slope_d = (d * (rn - (n - 1) / 2)).sum(axis=0), n * (n * n - 1.0) / 12
    spread, variance = hi - lo, m2 / n
    varied = spread > 0
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        skew, excess = np.sqrt(n) * (d2 * d).sum(axis=0) / np.sqrt(m2 * m2 * m2), n * (d2 * d2).sum(axis=0) / (m2 * m2) - 3.0
        move = slope_n / slope_d * n / spread
        informative = varied & (np.sqrt(variance) / spread > 0.01)
        two = minority(x, present, n, lo, hi) >= 0.05
    # A skewness that is not a number ranks above all numbers, as Spark orders them.
    kind = np.select([n < 10, two, ~varied, (np.abs(skew) < 0.5) & (np.abs(excess) < 1.0), (np.abs(skew) > 1.0) | np.isnan(skew), (excess > 2.0) | np.isnan(excess)],
                     ["other", "bimodal", "other", "normal", "skewed", "heavy_tailed"], "other")
    trend = np.where(~varied, "flat", np.where(move > 0.1, "increasing", np.where(move < -0.1, "decreasing", "flat")))
    return {"n": n.astype(np.int64), "lo": lo, "hi": hi, "variance": variance, "distribution": kind.astype(object), "trend": trend.astype(object), "informative": informative}


def minority(x: np.ndarray, present: np.ndarray, n: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Share of the smaller side of the valley between each column's two highest histogram peaks; -1 where there is no deep valley."""
    out, span = np.full(len(n), -1.0), hi - lo
    bins = np.minimum(100, np.maximum(50, np.floor(np.sqrt(n)))).astype(np.int64)
    for j in np.flatnonzero((n >= 10) & (span > 0)):
        v, nb = x[present[:, j], j], bins[j]
        k = np.bincount(np.minimum(nb - 1, np.floor((v - lo[j]) / span[j] * nb)).astype(np.int64), minlength=nb)
        padded = np.concatenate([[0], k, [0]])
        s = (padded[:-2] + k * 2 + padded[2:]) / 4.0
        peaks = np.flatnonzero((s[1:-1] >= s[:-2]) & (s[1:-1] >= s[2:]) & (s[1:-1] > 0)) + 1
        if len(peaks) < 2:
            continue
        a, b = np.sort(peaks[np.lexsort((peaks, s[peaks]))[-2:]])
        valley = a + s[a:b + 1].argmin()
        if b - a >= 2 and s[valley] < min(s[a], s[b]) * 0.7:
            below = int((v < lo[j] + (valley + 0.5) * span[j] / nb).sum())
            out[j] = min(below, n[j] - below) / n[j]
    return out


# --- relationships -------------------------------------------------------------------------------------

def rows_in_state(wide: DataFrame, channels: Sequence[str], aligned: bool = True, size: int = CHUNK) -> DataFrame:
    """Channels side by side per (well, state, rn).

    aligned: rows keep their samples together. Otherwise each channel drops its own nulls first, so channels with
    gaps slide against each other.
    """
    if aligned:
        # Numbering leaves the rows of a (well, state, chunk) together, so a task hands on few matrices per group.
        return dense_positions(wide.select("well_id", "state", "pos", *channels), ["well_id", "state"], [c("pos")],
                               chunk_of("pos", size), "rn").drop("pos")
    long = wide.unpivot(["well_id", "pos", "state"], list(channels), "channel", "v")
    return ranked_in_state(long, size).groupBy("well_id", "state", "rn").pivot("channel", list(channels)).agg(F.first("v"))


def state_correlations(rows: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Pairs with at least 30 common samples and |r| of at least 0.3."""
    p = pair_correlations(rows, ["well_id", "state"], list(channels))
    return p.where((c("n") >= MIN_RELATED) & c("r").isNotNull() & ~F.isnan("r") & (F.abs("r") >= MIN_STRENGTH))


def _pair_table(rows: DataFrame, pairs: DataFrame, channels: Sequence[str], size: int) -> DataFrame:
    """(pair key, rn, va, vb) for the kept pairs; a row yields at most one entry per channel pair."""
    listed = pairs.groupBy("well_id", "state").agg(F.collect_list(F.struct("channel_a", "channel_b")).alias("_ps"))
    last = rows.groupBy("well_id", "state").agg(F.max("rn").alias("last_pos"))
    j = attach(rows, listed.join(last, ["well_id", "state"]), ["well_id", "state"], size=size, pos="rn", how="inner")
    value = F.create_map(*[x for ch in channels for x in (F.lit(ch), c(ch))])
    return (j.withColumn("_v", value).select("well_id", "state", "rn", "_v", F.explode("_ps").alias("_p"))
            .select("well_id", "state", c("_p.channel_a").alias("channel_a"), c("_p.channel_b").alias("channel_b"), "rn",
                    c("_v")[c("_p.channel_a")].alias("va"), c("_v")[c("_p.channel_b")].alias("vb")).where("va is not null and vb is not null"))


PAIR = ["well_id", "state", "channel_a", "channel_b"]


def value_buckets(df: DataFrame, keys: Sequence[str], v: str, rn: str, size: int, extra: dict[str, Column] | None = None) -> DataFrame:
    """Add ``_vb``, an orderable bucket along (v, rn) that keeps any bucket near ``size`` rows, and group statistics.

    Ranges of v between approximate quantiles, so that outliers take no room, cut at values so frequent that they would
    fill a bucket alone; such a value is split by ``rn``. Only groups large enough to hold such a value are searched for them.
    """
    keys, extra = list(keys), extra or {}
    st = stage(df.groupBy(*keys).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"), F.count(F.lit(1)).alias("_n"), F.max(rn).alias("last_pos"),
                                     *[e.alias(n) for n, e in extra.items()]), "value-ranges")
    none = F.array().cast("array<double>")
    large = st.where(c("_n") > size // 4)
    inside = attach(df, large.select(*keys, "last_pos"), keys, size=size, pos=rn, how="inner")
    heavy = inside.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("_k")).where(c("_k") > size // 4) \
        .groupBy(*keys).agg(F.sort_array(F.collect_list(v)).alias("_hv"))
    # The cuts are quantiles of large groups, of which a group has about four for every ``size`` rows; 255 at most lie in
    # one array, so the values between two of them are cut once more at equal widths.
    q = inside.groupBy(*keys).agg(F.percentile_approx(v, [i / 256 for i in range(1, 256)], 2000).alias("_q"))
    m = F.least(F.lit(255), F.ceil(c("_n") * 4 / F.lit(size)) - 1).cast("int")
    some = F.transform(F.sequence(F.lit(1), m), lambda i: F.get("_q", F.floor(i * 256 / (m + 1)).cast("int") - 1).cast("double"))
    par = st.join(heavy, keys, "left").join(q, keys, "left").withColumns({
        "_hv": F.coalesce("_hv", none), "_cuts": F.when(c("_q").isNotNull() & (m > 0), some).otherwise(none)}).drop("_q")
    j = attach(df, par, keys, size=size, pos=rn)
    near = F.size(F.filter("_cuts", lambda q: q < c(v)))
    below, above = F.coalesce(F.get("_cuts", near - 1), c("_mn")), F.coalesce(F.get("_cuts", near), c("_mx"))
    fine = F.when(above > below, F.floor((c(v) - below) / (above - below) * F.ceil(c("_n") * 4 / F.lit(size * 256)))).otherwise(F.lit(0))
    b = F.struct(near.alias("q"), fine.alias("w"))
    is_heavy = F.array_contains("_hv", c(v))
    seg = F.size(F.filter("_hv", lambda h: h < c(v))) * 2 + is_heavy.cast("int")
    return j.withColumn("_vb", F.struct(b.alias("b"), seg.alias("s"), F.when(is_heavy, chunk_of(rn, size)).otherwise(F.lit(0)).alias("k"))) \
        .drop("_mn", "_mx", "_hv", "_cuts")


def threshold_patterns(pair_rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Pairs where b, ordered by a, makes one jump over half its range and few over a tenth."""
    d = value_buckets(pair_rows, PAIR, "va", "rn", size, {"_span": F.max("vb") - F.min("vb")})
    n = neighbours(d.withColumn("_b", c("vb")), PAIR, c("_vb"), ["va", "rn"], ["_b"])
    jump = F.abs(c("_b_next") - c("vb"))
    g = n.groupBy(*PAIR).agg(F.first("_n").alias("n"), F.first("_span").alias("_span"), F.max(jump).alias("_mj"),
                             F.sum((jump > c("_span") * 0.1).cast("int")).alias("_large"))
    hit = (c("n") >= MIN_RELATED) & (c("_span") > 0) & (c("_mj") > c("_span") * 0.5) & (c("_large") <= F.greatest(F.lit(3), F.floor(c("n") / 50)))
    return g.select(*PAIR, F.coalesce(hit, F.lit(False)).alias("is_threshold"))


LAG_SIZE = 1 << 16


def _sums(parts: list[pa.RecordBatch]) -> tuple[list[int], list[float]]:
    """Sums of a[i] * b[i - lag] over one chunk's own rows i whose partner is at hand, for every lag."""
    col = lambda x: np.concatenate([p[x].to_numpy(zero_copy_only=False) for p in parts])
    a, b, m = np.where(col("_own"), col("za"), 0.0), col("zb"), parts[0]["max_lag"][0].as_py()
    n = len(a)
    at = lambda k: float(a[max(0, k):n + min(0, k)] @ b[max(0, -k):n - max(0, k)]) if abs(k) < n else 0.0
    return list(range(-m, m + 1)), [at(k) for k in range(-m, m + 1)]


def _lag_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial lag sums of rows that arrive sorted by (pair, chunk, position); one chunk is held at a time."""
    held: list[pa.RecordBatch] = []

    def close(out):
        ks, sums = _sums(held)
        out.append(pa.record_batch({**{x: pa.repeat(held[0][x][0], len(ks)) for x in PAIR}, "lag": pa.array(ks, pa.int32()), "part": pa.array(sums, pa.float64())}))

    for batch in batches:
        if batch.num_rows == 0:
            continue
        g, out = batch["_g"].to_numpy(), []
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and held[0]["_g"][0].as_py() != g[lo]:
                close(out)
                held = []
            held.append(batch.slice(lo, hi - lo))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if held:
        out = []
        close(out)
        yield out[0]


def lags(pair_rows: DataFrame, size: int = LAG_SIZE) -> DataFrame:
    """Shift in samples with the largest normalised cross-correlation, where it beats no shift by 0.05.

    Each (pair, chunk) carries the 100 neighbouring samples it needs and yields partial sums per shift, which are
    then added up. A shift counts kept rows, so the pair's rows are numbered anew before chunks are cut.
    """
    pair_rows = dense_positions(pair_rows.withColumnRenamed("rn", "_at"), PAIR, [c("_at")], chunk_of("_at", max(size, MAX_LAG)), "rn").drop("_at")
    st = pair_rows.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.avg("va").alias("_ma"), F.stddev_pop("va").alias("_sa"), F.avg("vb").alias("_mb"),
        F.stddev_pop("vb").alias("_sb"), F.max("rn").alias("last_pos"))
    st = st.withColumn("max_lag", F.least(F.floor(c("n") / 4), F.lit(MAX_LAG)).cast("int"))
    ok = st.where((c("n") >= MIN_RELATED) & (c("max_lag") >= 1) & (c("_sa") > 0) & (c("_sb") > 0))
    z = attach(pair_rows, ok, PAIR, size=size, pos="rn", how="inner")
    z = z.select(*PAIR, "rn", "max_lag", ((c("va") - c("_ma")) / c("_sa")).alias("za"), ((c("vb") - c("_mb")) / c("_sb")).alias("zb"))
    h = halo(z, MAX_LAG, MAX_LAG, max(size, MAX_LAG), "rn")
    kinds = dict(pair_rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in PAIR) + ", lag int, part double"
    # One (pair, chunk) is a run of rows in a sorted partition; its number tells runs apart.
    h = h.withColumn("_g", F.xxhash64(*PAIR, "_chunk")).repartition(*PAIR, "_chunk").sortWithinPartitions(*PAIR, "_chunk", "rn")
    parts = h.select(*PAIR, "_g", "_own", "max_lag", "za", "zb").mapInArrow(_lag_sums, schema)
    cc = parts.groupBy(*PAIR, "lag").agg(F.sum("part").alias("_s")).join(ok.select(*PAIR, "n"), PAIR)
    cc = cc.withColumn("cc", c("_s") / (c("n") - F.abs("lag")))
    best = cc.groupBy(*PAIR).agg(F.max_by("lag", F.struct("cc", (c("lag") == 0).alias("z"), (-c("lag")).alias("o"))).alias("lag"),
                                 F.max("cc").alias("_best"), F.max(F.when(c("lag") == 0, c("cc"))).alias("_zero"))
    return best.where((c("lag") != 0) & (c("_best") - c("_zero") >= 0.05)).select(*PAIR, "lag")


def patterns(rows: DataFrame, pairs: DataFrame, channels: Sequence[str], size: int = CHUNK, small: int = SMALL) -> DataFrame:
    """PAIR, is_threshold and lag (null: none) of the kept pairs.

    The rows of a (well, state) of fewer than ``small`` rows meet in one task with the list of its pairs, so no row is
    repeated for its pairs; larger ones take the chunked way. Both are branches of one plan.
    """
    last = rows.groupBy("well_id", "state").agg(F.max("rn").alias("_last"))
    p = stage(pairs.join(last, ["well_id", "state"]), "pair-sizes")
    listed = p.where(c("_last") < small).groupBy("well_id", "state").agg(F.collect_list(F.struct("channel_a", "channel_b")).alias("_ps"))
    few = rows.where(c("rn") < small).select("well_id", "state", "rn", *[c(x).cast("double").alias(x) for x in channels])
    both = few.unionByName(listed, allowMissingColumns=True).withColumn("_g", F.xxhash64("well_id", "state"))
    both = both.repartition("well_id", "state").sortWithinPartitions("well_id", "state", "rn")
    well = dict(rows.dtypes)["well_id"]
    near = both.mapInArrow(_patterns, f"well_id {well}, state string, channel_a string, channel_b string, is_threshold boolean, lag int")
    large = p.where(c("_last") >= small).drop("_last")
    pr = stage(_pair_table(rows, large, channels, size), "pair-rows")
    far = large.select(*PAIR).join(threshold_patterns(pr, size), PAIR).join(lags(pr, min(size, LAG_SIZE)), PAIR, "left")
    return near.unionByName(far.select(*PAIR, "is_threshold", "lag"))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        lists = block["_ps"].drop_null()
        if not len(lists):
            continue
        rows = block.filter(block["rn"].is_valid())
        asked = [(p["channel_a"], p["channel_b"]) for x in lists.to_pylist() for p in x]
        names = sorted({x for p in asked for x in p})
        x, present = numbers(rows, names)
        out = []
        for a, b in asked:
            i, j = names.index(a), names.index(b)
            both = present[:, i] & present[:, j]
            out.append((jumps(x[both, i], x[both, j]), shift(x[both, i], x[both, j])))
        yield pa.record_batch({"well_id": pa.repeat(block["well_id"][0], len(out)), "state": pa.repeat(block["state"][0], len(out)), "channel_a": [a for a, _ in asked],
                               "channel_b": [b for _, b in asked], "is_threshold": [t for t, _ in out], "lag": pa.array([k for _, k in out], pa.int32())})


def jumps(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether b, ordered by a, makes one jump over half its range and few over a tenth."""
    n = len(a)
    if n < MIN_RELATED:
        return False
    span, steps = b.max() - b.min(), np.abs(np.diff(b[np.argsort(a, kind="stable")]))
    return bool(span > 0 and steps.max() > span * 0.5 and (steps > span * 0.1).sum() <= max(3, n // 50))


def shift(a: np.ndarray, b: np.ndarray, part: int = 2048) -> int | None:
    """Shift of a against b with the largest mean product of the standardised values, where it beats none by 0.05."""
    n = len(a)
    if n < MIN_RELATED or a.std() == 0 or b.std() == 0:
        return None
    a, b, m = (a - a.mean()) / a.std(), (b - b.mean()) / b.std(), min(n // 4, MAX_LAG)
    padded, sums = np.concatenate([np.zeros(m), a, np.zeros(m)]), np.zeros(2 * m + 1)
    for at in range(0, n, part):
        sums += np.correlate(padded[at:at + len(b[at:at + part]) + 2 * m], b[at:at + part], "valid")
    ks = np.arange(-m, m + 1)
    cc = sums / (n - np.abs(ks))
    best = ks[np.flatnonzero(cc == cc.max())]
    k = 0 if 0 in best else int(best[0])
    return k if k and cc.max() - cc[m] >= 0.05 else None


def _related(channels: list[str], shapes: bool):
    """Sorted rows of (well, state) groups to their related pairs; with ``shapes`` also whether these have a threshold, and their lag."""

    def one(block: pa.Table) -> pa.RecordBatch | None:
        if block.num_rows < MIN_RELATED:
            return None
        x, present = numbers(block, channels)
        planes = moments(x, present)
        r = correlation(planes)
        with np.errstate(invalid="ignore"):
            kept = (planes[N] >= MIN_RELATED) & ~undefined(planes) & (np.abs(r) >= MIN_STRENGTH)
        i, j = np.nonzero(np.triu(kept, 1))
        if not len(i):
            return None
        names = np.array(channels, object)
        out = {"well_id": pa.repeat(block["well_id"][0], len(i)), "state": pa.repeat(block["state"][0], len(i)), "channel_a": pa.array(names[i], pa.string()),
               "channel_b": pa.array(names[j], pa.string()), "n": pa.array(planes[N][i, j].astype(np.int64)), "r": pa.array(r[i, j])}
        if shapes:
            both = [(x[m, a], x[m, b]) for a, b in zip(i, j) for m in [present[:, a] & present[:, b]]]
            out |= {"is_threshold": pa.array([jumps(a, b) for a, b in both], pa.bool_()), "lag": pa.array([shift(a, b) for a, b in both], pa.int32())}
        return pa.record_batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(x for x in map(one, blocks(batches)) if x is not None)

    return run


def _related_groups(wide: DataFrame, channels: Sequence[str], shapes: bool, small: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The related pairs of small groups; the names of the other groups; and the rows of these and of those whose keys are null."""
    keys = ["well_id", "state"]
    rows = wide.select(*keys, "pos", *[c(x).cast("double").alias(x) for x in channels])
    few, far = small_groups(rows, channels, small)
    schema = f"well_id {dict(rows.dtypes)['well_id']}, state string, channel_a string, channel_b string, n long, r double" + (", is_threshold boolean, lag int" if shapes else "")
    # A group's rows are sorted by position, which is their order in the state.
    near = few.drop("pos").mapInArrow(_related(list(channels), shapes), schema)
    return near, far, rows.join(F.broadcast(far), keys, "left_semi").unionByName(rows.where("well_id is null or state is null"))


def correlations_in_states(wide: DataFrame, channels: Sequence[str], small: int = SMALL) -> DataFrame:
    """``state_correlations`` of rows (well_id, pos, state, channels): the rows of a (well, state) of fewer than ``small`` rows meet in one
    task, which is less than one row of matrices per channel and task; larger groups take the way of matrices, in the same plan."""
    near, _, rest = _related_groups(wide, channels, False, small)
    return near.unionByName(state_correlations(rest, channels))


def patterns_in_states(wide: DataFrame, channels: Sequence[str], size: int = CHUNK, small: int = SMALL) -> DataFrame:
    """PAIR, n, r, is_threshold and lag of the related pairs of rows (well_id, pos, state, channels).

    Small groups are correlated and searched for thresholds and lags by the task in which their rows meet, from one shuffle and without a
    table in between; larger ones are numbered and take the chunked way."""
    near, far, rest = _related_groups(wide, channels, True, small)
    if far.isEmpty():
        return near
    rows = stage(rows_in_state(rest, channels, True, size), "rows-in-state")
    pairs = stage(state_correlations(rows, channels), "pairs")
    return near.unionByName(pairs.join(patterns(rows, pairs, channels, size, small), PAIR, "left").select(*near.columns))


def relationships(wide: DataFrame, channels: Sequence[str], aligned: bool = True, size: int = CHUNK, small: int = SMALL) -> DataFrame:
    """Two rows per related pair and state: type, strength (4 decimals) and lag, negated on the way back."""
    if aligned:
        p = patterns_in_states(wide, channels, size, small)
    else:
        rows = stage(rows_in_state(wide, channels, aligned, size), "rows-in-state")
        pairs = stage(state_correlations(rows, channels), "pairs")
        p = pairs.join(patterns(rows, pairs, channels, size, small), PAIR, "left")
    kind = F.when(c("lag").isNotNull(), "lagged").when(c("is_threshold"), "threshold").when(c("r") > 0, "proportional").otherwise("inverse")
    both = F.array(F.struct(c("channel_a").alias("channel"), c("channel_b").alias("target"), c("lag").alias("lag")),
                   F.struct(c("channel_b").alias("channel"), c("channel_a").alias("target"), (-c("lag")).alias("lag")))
    return p.select("well_id", "state", "n", kind.alias("relationship"), F.round("r", 4).alias("strength"), F.explode(both).alias("_e")) \
        .select("well_id", "state", "_e.channel", "_e.target", "relationship", "strength", c("_e.lag").alias("lag"), "n")


# --- transition responses ------------------------------------------------------------------------------

def transition_responses(transitions: DataFrame, wide: DataFrame, channels: Sequence[str], depth: str = "depth_md", size: int = LAG_SIZE) -> DataFrame:
    """Peak deviation, settling distance and time, and shape of every channel at every transition.

    Samples meet the transitions of their (well, chunk) together with the 50 samples next to the chunk, so each sample is
    shuffled once however many transitions use it, and a task holds one chunk.
    """
    n = wide.groupBy("well_id").agg((F.max("pos") + 1).alias("_n"))
    t = transitions.select("well_id", "pos", "from_state", "to_state").join(n, "well_id")
    t = t.where((c("pos") >= WINDOW) & (c("pos") + WINDOW < c("_n"))).drop("_n")
    samples = wide.select("well_id", "pos", c(depth).cast("double").alias("_d"), *[c(x).cast("double").alias(x) for x in channels])
    size = max(size, WINDOW)
    both = halo(samples, WINDOW, WINDOW, size).drop("_own").unionByName(t.withColumn("_chunk", chunk_of("pos", size)), allowMissingColumns=True)
    both = both.withColumn("_g", F.xxhash64("well_id", "_chunk")).repartition("well_id", "_chunk").sortWithinPartitions("well_id", "_chunk", "pos")
    well = dict(wide.dtypes)["well_id"]
    return both.drop("_chunk").mapInArrow(_responses(list(channels)), f"well_id {well}, at_pos long, from_state string, to_state string, channel string, "
                                          "peak double, settle_ft double, settle_samples int, shape string")


def _responses(channels: list[str]):
    """Sorted samples and transitions of chunks to one row per transition and channel that moves."""

    def one(block: pa.Table) -> pa.RecordBatch | None:
        is_move = np.asarray(block["to_state"].is_valid())
        moves, rows = block.filter(pa.array(is_move)), block.filter(pa.array(~is_move))
        if not moves.num_rows or not rows.num_rows:
            return None
        pos, at = rows["pos"].to_numpy(), moves["pos"].to_numpy()
        want = at[:, None] + np.arange(-WINDOW, WINDOW + 1)
        place = np.minimum(np.searchsorted(pos, want), len(pos) - 1)
        found = pos[place] == want
        x, present = numbers(rows, channels)
        depth, has_depth = (m[:, 0] for m in numbers(rows, ["_d"]))
        depth = np.where(found & has_depth[place], depth[place], np.nan)[:, WINDOW:]
        # transitions x channels x samples
        x, present = x[place].transpose(0, 2, 1), (present[place] & found[:, :, None]).transpose(0, 2, 1)
        before, n_before = np.where(present, x, 0.0)[:, :, :WINDOW], present[:, :, :WINDOW].sum(axis=2)
        pre = compensated(before) / np.maximum(n_before, 1)
        after, here = x[:, :, WINDOW:2 * WINDOW], present[:, :, WINDOW:2 * WINDOW]
        count = here.sum(axis=2)
        out = []
        for m in np.unique(count[(count >= 5) & (n_before >= 5)]):
            i, ch = np.nonzero((count == m) & (n_before >= 5))
            kept = here[i, ch]
            post = after[i, ch][kept].reshape(len(i), m)
            peak, settle, shape = settling(post, pre[i, ch])
            d = np.abs(depth[i, settle] - depth[i, 0])
            ok = at_least(peak, np.abs(pre[i, ch]) * 0.01)
            own = moves.take(pa.array(i[ok]))
            out.append(pa.table({
                "well_id": own["well_id"], "at_pos": own["pos"], "from_state": own["from_state"], "to_state": own["to_state"],
                "channel": pa.array(np.array(channels, object)[ch[ok]], pa.string()), "peak": peak[ok], "settle_ft": pa.array(d[ok], mask=np.isnan(d[ok])),
                "settle_samples": pa.array(settle[ok], pa.int32()), "shape": pa.array(shape[ok], pa.string())}))
        return pa.concat_tables(out).combine_chunks().to_batches() if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield from one(block) or []

    return run


def in_order(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis, added from left to right as a sequential sum does."""
    return np.add.accumulate(x, axis=-1)[..., -1]


def compensated(x: np.ndarray) -> np.ndarray:
    """Sums along the last axis with the rounding errors of the additions put back, so that their order does not count."""
    total, lost = np.zeros(x.shape[:-1]), np.zeros(x.shape[:-1])
    with np.errstate(invalid="ignore", over="ignore"):
        for v in np.moveaxis(x, -1, 0):
            new = total + v
            part = new - total
            lost += (total - (new - part)) + (v - part)
            total = new
        return np.where(np.isfinite(lost), total + lost, total)


def at_least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a >= b with NaN above all numbers, as Spark orders them."""
    return (a >= b) | np.isnan(a)


def settling(post: np.ndarray, pre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Peak deviation, first sample near the final mean (else their number) and shape, per row of values after a transition."""
    m = post.shape[1]
    dev = post - pre[:, None]
    mag = np.abs(dev)
    peak = mag.max(axis=1)
    last = post[:, max(0, m - 10):]
    near = np.abs(post - (compensated(last) / last.shape[1])[:, None]) < np.abs(peak)[:, None] * 0.1
    settle = np.where(near.any(axis=1), near.argmax(axis=1), m)
    flips = (np.diff(np.sign(dev), axis=1) != 0).sum(axis=1)
    half = m // 2
    a, b = in_order(mag[:, :half]) / half, in_order(mag[:, half:]) / (m - half)
    d = np.diff(mag, axis=1)
    falls = (d < 0).sum(axis=1) > d.shape[1] * 0.5
    with np.errstate(divide="ignore", invalid="ignore"):
        step = (m > 5) & (a > 0) & (np.abs(b - a) / a < 0.2)
    slower = in_order(np.diff(d, axis=1)) / (m - 2) > 0
    shape = np.select([flips > m * 0.3, step, falls & slower], ["oscillation", "step", "exponential_decay"], "ramp")
    return peak, settle, shape.astype(object)


def response_profiles(responses: DataFrame, least: int = 5) -> DataFrame:
    """Mean response per (well, channel, transition) with at least ``least`` occurrences; ties of shape by name."""
    keys = ["well_id", "channel", "from_state", "to_state"]
    g = responses.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("peak").alias("peak"), F.avg("settle_ft").alias("settle_ft"),
                                     F.avg("settle_samples").alias("settle_samples")).where(c("n") >= least)
    s = responses.groupBy(*keys, "shape").agg(F.count(F.lit(1)).alias("_k")) \
        .groupBy(*keys).agg(F.min_by("shape", F.struct((-c("_k")).alias("k"), "shape")).alias("shape"))
    return g.join(s, keys)
