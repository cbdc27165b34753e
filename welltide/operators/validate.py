"""Data-quality and plausibility checks, one row per well and check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from welltide.operators.quantiles import exact_percentiles
from welltide.operators.series import CHUNK, attach, previous
from welltide.operators.zones import minimum_curvature
from welltide.sources import dims

c = F.col
PSI = 0.052
# Plausible gradients (psi/ft) and dogleg bound (deg/100 ft).
PORE_GRADIENT, FRAC_GRADIENT_MAX, DLS_MAX = (0.45, 0.65), 0.95, 15.0


def _check(df: DataFrame, name: str, passed: Column, value: Column) -> DataFrame:
    return df.select("well_id", F.lit(name).alias("check"), F.coalesce(passed, F.lit(True)).alias("passed"), value.cast("double").alias("value"))


def pressure_checks(wide: DataFrame) -> DataFrame:
    """Density from annular pressure against the reported one, or within 7-22 ppg where none is reported."""
    ok = c("apwd").isNotNull() & (c("depth_tvd") > 0)
    e = F.when(ok, c("apwd") / (F.lit(PSI) * c("depth_tvd")))
    diff = F.when(c("ecd") > 0, F.abs(e - c("ecd")) / c("ecd") * 100.0)
    g = wide.groupBy("well_id").agg(F.avg(diff).alias("d"), F.min(e).alias("lo"), F.max(e).alias("hi"), F.count("ecd").alias("n"))
    a = _check(g.where("n > 0"), "ecd_vs_reported", c("d") < 5.0, c("d"))
    b = _check(g.where("n = 0 and lo is not null"), "ecd_from_apwd_range", (c("lo") >= 7.0) & (c("hi") <= 22.0), c("hi"))
    return a.unionByName(b)


def gradient_checks(wide: DataFrame, size: int = CHUNK) -> DataFrame:
    """Hydrostatic at TD, median gradient and maximum gradient of the reported density."""
    med = exact_percentiles(wide, ["well_id"], c("ecd"), {"mw": 0.5}, size=size)
    deep = exact_percentiles(wide.where("depth_tvd > 100"), ["well_id"], c("ecd") * PSI, {"grad": 0.5}, size=size)
    g = wide.groupBy("well_id").agg(F.max("depth_tvd").alias("td"), F.max(F.when(c("depth_tvd") > 100, c("ecd") * PSI)).alias("gmax"))
    j = g.join(med, "well_id", "left").join(deep, "well_id", "left")
    mw = F.coalesce("mw", F.lit(10.0))
    return (_check(j.where("td > 0"), "hydrostatic_at_td", mw.between(8.33, 20.0), F.lit(PSI) * mw * c("td"))
            .unionByName(_check(j.where("grad is not null"), "median_gradient", c("grad").between(*PORE_GRADIENT), c("grad")))
            .unionByName(_check(j.where("gmax is not null"), "below_frac_gradient", c("gmax") <= FRAC_GRADIENT_MAX, c("gmax"))))


def survey_checks(surveys: DataFrame, size: int = CHUNK) -> DataFrame:
    """Computed against reported TVD, dogleg bound, quality index and station spacing.

    ``surveys``: well_id, pos, md, inc, azm, tvd_reported, qi.
    """
    p = minimum_curvature(surveys, size)
    g = p.groupBy("well_id").agg(
        F.max(F.when(c("tvd_reported") > 0, F.abs(c("tvd") - c("tvd_reported")))).alias("d"),
        F.max_by("tvd_reported", F.when(c("tvd_reported") > 0, c("pos"))).alias("td"), F.max("dls").alias("dls"),
        (F.sum((c("qi") == 0).cast("int")) / F.count("qi") * 100.0).alias("qi"), F.count(F.lit(1)).alias("n"))
    gap = previous(surveys, ["well_id"], {"_m": c("md")}, size).withColumn("gap", c("md") - c("_m")).where("gap > 0")
    med = exact_percentiles(gap, ["well_id"], c("gap"), {"med": 0.5}, size=size).join(gap.groupBy("well_id").agg(F.max("gap").alias("gmax")), "well_id")
    g = g.where("n >= 2")
    return reduce(DataFrame.unionByName, [
        _check(g.where("d is not null"), "min_curvature_tvd", c("d") < F.greatest(F.lit(5.0), c("td") * 0.005), c("d")),
        _check(g.where("dls is not null"), "dogleg_bound", c("dls") <= DLS_MAX, c("dls")),
        _check(g.where("qi is not null"), "quality_index", c("qi") >= 80.0, c("qi")),
        _check(med, "station_spacing", c("gmax") <= c("med") * 10.0, c("gmax"))])


def quality_checks(wide: DataFrame, channels: list[str], depth: str = "depth_md", sentinel: float = -999.25) -> DataFrame:
    """Channels more than half null, channels outside their plausible range, samples per foot."""
    rng = {n: (a, b) for n, a, b in dims.VALUE_RANGES}
    missing = lambda x: F.avg(F.when(c(x).isNull() | (c(x) == sentinel), 100.0).otherwise(0.0))
    clean = lambda x: F.when(c(x) != sentinel, c(x))
    ranged = [x for x in channels if x in rng]
    aggs = [missing(x).alias(f"null_{x}") for x in channels]
    aggs += [e for x in ranged for e in (F.min(clean(x)).alias(f"lo_{x}"), F.max(clean(x)).alias(f"hi_{x}"))]
    g = wide.groupBy("well_id").agg(*aggs, F.count(F.lit(1)).alias("n"), (F.max(clean(depth)) - F.min(clean(depth))).alias("span"))
    high = reduce(lambda a, b: a + b, [(c(f"null_{x}") > 50.0).cast("int") for x in channels])
    out = reduce(lambda a, b: a + b, [F.coalesce(((c(f"lo_{x}") < rng[x][0]) | (c(f"hi_{x}") > rng[x][1])).cast("int"), F.lit(0)) for x in ranged])
    return (_check(g, "null_share", high == 0, high).unionByName(_check(g, "value_ranges", out == 0, out))
            .unionByName(_check(g.where("span > 0"), "sample_density", c("n") / c("span") > 0, c("n") / c("span"))))


def report(*checks: DataFrame) -> DataFrame:
    """All check tables together with a pass count per well."""
    al = reduce(DataFrame.unionByName, checks)
    return al.groupBy("well_id").agg(F.count(F.lit(1)).alias("n_checks"), F.sum(c("passed").cast("int")).alias("n_passed"))
