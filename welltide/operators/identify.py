"""Channel identification: which physical quantity a recorder channel carries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from welltide.sources import dims


def _lookup(rows: list[tuple[str, str]], key: Column) -> Column:
    """Constant map lookup as an expression (first entry of a repeated key wins)."""
    m: dict[str, str] = {}
    for k, v in rows:
        m.setdefault(k, v)
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])[key]


def wits_canonical(wits: Column) -> Column:
    return _lookup([(w, c) for w, c, _, _ in dims.WITS], wits)


def mnemonic_canonical(m: Column) -> Column:
    """Vendor map, then registry names and aliases, then the same without or with joined-up spaces."""
    alias = lambda key: _lookup(dims.alias_rows(), key)
    found = F.coalesce(_lookup(dims.MNEMONICS, F.upper(m)), alias(F.lower(F.trim(m))),
                       alias(F.lower(F.replace(m, F.lit(" "), F.lit("")))), alias(F.lower(F.replace(m, F.lit(" "), F.lit("_")))))
    return F.when(F.length(m) > 0, found)


def unit_domain(unit: Column) -> Column:
    u = F.lower(F.trim(unit))
    frags = F.array(*[F.struct(F.lit(f).alias("frag"), F.lit(d).alias("domain")) for f, d in dims.UNIT_DOMAIN.items()])
    hit = F.get(F.filter(frags, lambda x: F.contains(u, x["frag"])), 0)["domain"]
    return F.when(F.length(u) > 0, F.coalesce(_lookup(list(dims.UNIT_DOMAIN.items()), u), hit))


def _defs_of(domain: Column) -> Column:
    """Registry channels of a domain as an array, in registry order."""
    by: dict[str, list] = {}
    for _, name, unit, lo, hi in dims.CHANNEL_DEFS:
        d = dims.unit_domain(unit)
        if d:
            by.setdefault(d, []).append((name, lo, hi))
    arr = lambda rs: F.array(*[F.struct(F.lit(n).alias("name"), F.lit(a).alias("lo"), F.lit(b).alias("hi")) for n, a, b in rs])
    return F.create_map(*[x for d, rs in by.items() for x in (F.lit(d), arr(rs))])[domain]


def range_overlap(lo: Column, hi: Column, dlo: Column, dhi: Column) -> Column:
    """Share of the observed range inside the expected one; a single value counts fully when contained."""
    a, b = F.greatest(lo, dlo), F.least(hi, dhi)
    return F.when((dhi - dlo <= 0) | (b <= a), F.lit(0.0)).when(hi - lo <= 0, F.lit(1.0)).otherwise((b - a) / (hi - lo))


def range_candidates(domain: Column, lo: Column, hi: Column) -> Column:
    """Registry channels of the domain covering more than 30 % of the observed range, best first."""
    scored = F.transform(_defs_of(domain), lambda d, i: F.struct(
        (-range_overlap(lo, hi, d["lo"], d["hi"])).alias("neg"), i.alias("i"), d["name"].alias("name")))
    return F.sort_array(F.filter(scored, lambda s: s["neg"] < -0.3))


def resolve(channels: DataFrame) -> DataFrame:
    """Canonical name, confidence and method per channel.

    ``channels``: well_id, wits_id, mnemonic, units, and the observed robust range (obs_lo, obs_hi; null if too few).
    """
    d = channels.withColumns({"_w": wits_canonical(F.col("wits_id")), "_m": mnemonic_canonical(F.col("mnemonic")),
                              "_d": unit_domain(F.col("units"))})
    has = F.col("_d").isNotNull() & F.col("obs_lo").isNotNull()
    d = d.withColumn("_c", F.when(has, range_candidates(F.col("_d"), F.col("obs_lo"), F.col("obs_hi"))))
    d = d.withColumn("_first", F.get(_defs_of(F.col("_d")), 0)["name"])
    best, second = -F.get("_c", 0)["neg"], -F.get("_c", 1)["neg"]
    ranged = F.size("_c") > 0
    sure = (best > 0.8) & ((F.size("_c") == 1) | (second < 0.5))
    unit_only = F.col("_d").isNotNull() & F.col("obs_lo").isNull()
    by_wits, by_name = F.col("_w").isNotNull(), F.col("_m").isNotNull()
    return d.select(
        "well_id", "wits_id",
        F.coalesce("_w", "_m", F.when(ranged, F.get("_c", 0)["name"]), F.when(unit_only, F.col("_first"))).alias("canonical"),
        F.when(by_wits | by_name, "high").when(ranged & sure, "medium").otherwise("low").alias("confidence"),
        F.when(by_wits, "wits_id").when(by_name, "mnemonic").when(ranged, "unit+range").when(unit_only, "unit_only")
         .otherwise("unresolved").alias("method"),
        F.when(by_wits | by_name, F.lit(0)).when(ranged, F.size("_c") - 1)
         .when(unit_only, F.greatest(F.lit(0), F.size(_defs_of(F.col("_d"))) - 1)).otherwise(F.lit(0)).alias("n_candidates"))


def auto_assign(resolved: DataFrame, existing: DataFrame, min_confidence: str = "high") -> DataFrame:
    """Best resolution per (well, canonical), first channel on ties; never touches existing names or channels."""
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    least = {"high": 2, "medium": 1, "low": 0}[min_confidence]
    r = resolved.where(F.col("canonical").isNotNull()).withColumn("_r", rank).where(F.col("_r") >= least)
    r = r.join(existing.select("well_id", "canonical"), ["well_id", "canonical"], "left_anti")
    r = r.join(existing.select("well_id", "wits_id"), ["well_id", "wits_id"], "left_anti")
    return r.groupBy("well_id", "canonical").agg(F.max_by("wits_id", F.struct("_r", _reverse_order("wits_id"))).alias("wits_id"))


def _reverse_order(wits: str) -> Column:
    """Sorts descending where the id sorts ascending (ids are digit strings)."""
    return -F.coalesce(F.expr(f"try_cast({wits} AS BIGINT)"), F.lit(0))


def suggest_assignments(channels: DataFrame) -> DataFrame:
    """Recorder-id suggestions: the smallest id of each canonical name per well."""
    d = channels.withColumn("canonical", wits_canonical(F.col("wits_id"))).where("canonical is not null")
    return d.groupBy("well_id", "canonical").agg(F.min("wits_id").alias("wits_id"))


def tier(wits: Column, mnemonic: Column, description: Column, unit: Column) -> tuple[Column, Column]:
    """(canonical, tier): core when resolved, suggested when the unit looks like drilling, else parked."""
    known = sorted({c for _, c, _, _ in dims.WITS})
    text = F.lower(F.trim(description))
    words = F.array(*[F.struct(F.lit(k.replace("_", " ")).alias("w"), F.lit(k).alias("c")) for k in known])
    by_text = F.get(F.filter(words, lambda x: F.contains(text, x["w"])), 0)["c"]
    canonical = F.coalesce(wits_canonical(wits), mnemonic_canonical(mnemonic), by_text)
    frags = F.array(*[F.lit(f) for f in dims.SUGGESTED_FRAGMENTS])
    drilling = F.exists(frags, lambda f: F.contains(F.lower(F.trim(unit)), f))
    return canonical, F.when(canonical.isNotNull(), "core").when(drilling, "suggested").otherwise("parked")


def select_for_intents(channels: DataFrame, intents: DataFrame) -> DataFrame:
    """The channels with every intent (intent, canonical) that they belong to; a caller's own set is one more intent."""
    return channels.join(intents, "canonical")


def select_for_intent(channels: DataFrame, intents: DataFrame, intent: str) -> DataFrame:
    """Channels whose canonical name belongs to the intent. The intent dimension is a code constant."""
    return channels.join(F.broadcast(intents.where(F.col("intent") == intent)), "canonical", "left_semi")


def operational_domain(canonical: Column) -> Column:
    return F.coalesce(_lookup(dims.OPERATIONAL_DOMAINS, canonical), F.lit(dims.DEFAULT_DOMAIN))


def dossiers(channels: DataFrame) -> DataFrame:
    """Census entries: channels with data, computed ids left out, vocabulary fields or defaults."""
    vocab = {w: (c, d, i) for w, c, d, i in dims.WITS}
    field = lambda k: _lookup([(w, v[k]) for w, v in vocab.items()], F.col("wits_id"))
    d = channels.where((F.col("n_points") > 0) & ~F.col("wits_id").startswith("900"))
    return d.select("well_id", "wits_id", "n_points",
                    F.coalesce(field(0), F.when(F.length("mnemonic") > 0, F.lower("mnemonic")).otherwise(F.col("wits_id"))).alias("canonical"),
                    F.coalesce(field(1), F.lit("mechanical")).alias("domain"),
                    F.coalesce(field(2), F.lit("time_only")).alias("index_type"))
