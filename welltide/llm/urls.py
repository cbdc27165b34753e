"""URL filters against dated lists: every capture is judged by the entries that were active when it was fetched.

List entries are dated changes (add or remove of a pattern). They become validity intervals, and an as-of join on (pattern, time bucket) finds
for each capture the intervals that hold its fetch time. The most specific entry decides: exact URL, then path prefix (longest), host, domain
(longest); block beats allow; then the smaller list name.

All steps are DataFrame functions. Keys of captures are salted and intervals copied to each salt, as most captures may share a host; an
interval's copies are bounded by the time buckets in which captures were fetched.

Cases: null or relative URLs have no host and match nothing; captures without a fetch time match nothing; a change without time, list,
pattern or known kind is no entry; an add and a remove at the same instant count as an add; of repeated captures each gets a row; an empty
table of either kind is fine; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from welltide.llm.common import table

KINDS = {"domain": 1, "host": 2, "prefix": 3, "url": 4}
BUCKET_SECONDS, SALTS = 30 * 86400, 8

_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//[^/?#]*([^?#]*)"
_QUERY = r"^[^?#]*(\?[^#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    a = F.regexp_extract(F.coalesce(url, F.lit("")), _AUTHORITY, 1)
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(a, "^.*@", ""), ":[0-9]*$", ""), r"\.$", ""))


def path_of(url: Column) -> Column:
    p = F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def exact_of(url: Column) -> Column:
    """Host, path and query: the URL without scheme and fragment."""
    return F.concat(host_of(url), path_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), _QUERY, 1))


def keys_of(url: Column) -> Column:
    """The patterns that could match a URL, as (kind, pattern)."""
    host, path = host_of(url), path_of(url)
    labels, parts = F.split(host, r"\."), F.split(path, "/")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    named = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("pattern")))
    keys = F.concat(named("url", F.array(exact_of(url))), named("host", F.array(host)), named("domain", domains), named("prefix", F.array_distinct(prefixes)))
    return F.when(host != "", keys)


def validity(changes: DataFrame) -> DataFrame:
    """Intervals (list, effect, kind, pattern, since, until) from changes (list, effect, kind, pattern, action, at); an open end is null.

    The next change is looked up inside (pattern, time bucket); the last one of a bucket gets the first of the next bucket that has any.
    """
    name = ["list", "effect", "kind", "pattern"]
    ok = changes.where(F.col("at").isNotNull() & F.col("list").isNotNull() & F.col("pattern").isNotNull() & F.col("kind").isin(*KINDS))
    one = (ok.groupBy(*name, "at").agg(F.max(F.col("action") == "add").alias("active"))
           .withColumn("_b", F.floor(F.unix_seconds("at") / BUCKET_SECONDS)))
    first = one.groupBy(*name, "_b").agg(F.min("at").alias("_first"))
    later = first.select(*name, "_b", F.lead("_first").over(Window.partitionBy(*name).orderBy("_b")).alias("_later"))
    inside = one.withColumn("_next", F.lead("at").over(Window.partitionBy(*name, "_b").orderBy("at")))
    on = [inside[c].eqNullSafe(later[c]) for c in [*name, "_b"]]
    return (inside.join(later, on).where("active")
            .select(*[inside[c] for c in name], F.col("at").alias("since"), F.coalesce("_next", "_later").alias("until")))


def judge(captures: DataFrame, changes: DataFrame, key: str, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """key, url, fetched, verdict (block, allow or pass), list, kind, pattern, since of the deciding entry, and n_active."""
    own = captures.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(fetched).alias("fetched"))
    bucket = lambda c: F.floor(F.unix_seconds(c) / BUCKET_SECONDS)
    low, high = own.agg(F.min("fetched"), F.max("fetched")).select(bucket(F.col("min(fetched)")), bucket(F.col("max(fetched)"))).first()
    name = ["list", "effect", "kind", "pattern", "since"]
    base = own.select("key", "url", "fetched", F.lit(1).alias("rows"), F.lit(None).cast("struct<rank:int,size:int,block:boolean,list:string,kind:string,pattern:string,since:timestamp>").alias("hit"))
    hits = None
    if low is not None:
        spread = (validity(changes)
                  .withColumn("_from", F.greatest(bucket("since"), F.lit(low))).withColumn("_to", F.least(F.coalesce(bucket("until"), F.lit(high)), F.lit(high)))
                  .where("_from <= _to")
                  .select(*name, "until", F.explode(F.sequence("_from", "_to")).alias("_b"))
                  .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        asked = (own.where(F.col("fetched").isNotNull()).withColumn("k", F.explode(keys_of(F.col("url"))))
                 .select("key", "url", "fetched", F.col("k.kind").alias("kind"), F.col("k.pattern").alias("pattern"), bucket("fetched").alias("_b"),
                         F.pmod(F.xxhash64("key", "url", "fetched"), F.lit(SALTS)).cast("int").alias("_salt")))
        found = asked.join(spread, ["kind", "pattern", "_b", "_salt"]).where("since <= fetched and (until is null or fetched < until)")
        rank = F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v))])
        hits = found.select("key", "url", "fetched", F.lit(0).alias("rows"), F.struct(
            rank[F.col("kind")].alias("rank"), F.length("pattern").alias("size"), (F.col("effect") == "block").alias("block"), "list", "kind", "pattern", "since").alias("hit"))
    every = base if hits is None else base.union(hits)
    best = every.groupBy("key", "url", "fetched").agg(
        F.sum("rows").alias("n"), F.count("hit").alias("h"),
        F.min_by("hit", F.when(F.col("hit").isNotNull(), F.struct(-F.col("hit.rank"), -F.col("hit.size"), ~F.col("hit.block"), "hit.list", "hit.kind", "hit.pattern", "hit.since"))).alias("hit"))
    verdict = F.when(F.col("hit").isNull(), "pass").when(F.col("hit.block"), "block").otherwise("allow")
    return (best.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
            .select(F.col("key").alias(key), "url", "fetched", verdict.alias("verdict"), *[F.col(f"hit.{c}").alias(c) for c in ("list", "kind", "pattern", "since")],
                    F.floor(F.col("h") / F.col("n")).alias("n_active")))


# --- the registered query -------------------------------------------------------------------------------

#: Captures are dated by page number, lists by the hash of what they name.
START = 1704067200


def dated(pages: DataFrame) -> DataFrame:
    """page_id, url, fetched: the pages with fetch times over a year."""
    minute = F.pmod(F.col("page_id") * F.lit(7919), F.lit(525600))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(START) + minute * 60).alias("fetched"))


def lists_from(pages: DataFrame) -> DataFrame:
    """Dated changes of five lists that name hosts, domains, first path segments and URLs of ``pages``: each entry is added, removed and added again."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    hosts = pages.select(host.alias("h")).where("h <> ''").distinct()
    sections = pages.select(host.alias("h"), F.regexp_extract(path, "^(/[^/]+/)", 1).alias("s")).where("h <> '' and s <> ''").distinct()
    exact = pages.where(host != "").select(exact_of(F.col("url")).alias("p")).distinct()
    code = lambda c: F.conv(F.substring(F.md5(c), 1, 4), 16, 10).cast("long")
    named = hosts.withColumn("a", code("h"))
    entry = lambda df, name, effect, kind, pattern: df.select(F.lit(name).alias("list"), F.lit(effect).alias("effect"), F.lit(kind).alias("kind"), pattern.alias("pattern"), "a")
    every = (entry(named.where("a % 3 = 0"), "ads", "block", "host", F.col("h"))
             .union(entry(named.where("a % 3 = 1"), "malware", "block", "domain", F.col("h")))
             .union(entry(named.where("a % 2 = 0"), "partners", "allow", "domain", F.col("h")))
             .union(entry(sections.withColumn("p", F.concat("h", "s")).withColumn("a", code("p")).where("a % 4 = 0"), "sections", "block", "prefix", F.col("p")))
             .union(entry(exact.withColumn("a", code("p")).where("a % 50 = 0"), "takedown", "block", "url", F.col("p"))))
    step = F.explode(F.array(F.struct(F.lit("add").alias("action"), (F.col("a") % 200).alias("day")), F.struct(F.lit("remove").alias("action"), (F.col("a") % 200 + 30 + F.col("a") % 70).alias("day")),
                             F.struct(F.lit("add").alias("action"), (F.col("a") % 200 + 150).alias("day"))))
    return (every.distinct().withColumn("c", step)
            .select("list", "effect", "kind", "pattern", F.col("c.action").alias("action"), F.timestamp_seconds(F.lit(START) + F.col("c.day") * 86400).alias("at")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by the list entries active at its fetch time."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = judge(dated(pages), lists_from(pages), "page_id")
    return out.withColumns({"fetched": F.col("fetched").cast("timestamp_ntz"), "since": F.col("since").cast("timestamp_ntz")})


_HOST_SQL = rf"lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(coalesce(url, ''), '{_AUTHORITY}', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''))"

OP2_SQL = rf"""
WITH p AS MATERIALIZED (
  SELECT page_id, url, {_HOST_SQL} AS host,
         CASE WHEN regexp_extract(coalesce(url, ''), '{_PATH}', 1) = '' THEN '/' ELSE regexp_extract(url, '{_PATH}', 1) END AS path,
         regexp_extract(coalesce(url, ''), '{_QUERY}', 1) AS query,
         make_timestamp(({START} + (page_id * 7919 % 525600) * 60) * 1000000) AS fetched
  FROM pages),
named AS (SELECT DISTINCT host AS h, ('0x' || substr(md5(host), 1, 4))::BIGINT AS a FROM p WHERE host <> ''),
sections AS (SELECT DISTINCT host || s AS p, ('0x' || substr(md5(host || s), 1, 4))::BIGINT AS a
             FROM (SELECT host, regexp_extract(path, '^(/[^/]+/)', 1) AS s FROM p WHERE host <> '') WHERE s <> ''),
exact AS (SELECT DISTINCT host || path || query AS p, ('0x' || substr(md5(host || path || query), 1, 4))::BIGINT AS a FROM p WHERE host <> ''),
entries AS (
  SELECT 'ads' AS list, 'block' AS effect, 'host' AS kind, h AS pattern, a FROM named WHERE a % 3 = 0
  UNION SELECT 'malware', 'block', 'domain', h, a FROM named WHERE a % 3 = 1
  UNION SELECT 'partners', 'allow', 'domain', h, a FROM named WHERE a % 2 = 0
  UNION SELECT 'sections', 'block', 'prefix', p, a FROM sections WHERE a % 4 = 0
  UNION SELECT 'takedown', 'block', 'url', p, a FROM exact WHERE a % 50 = 0),
changes AS (
  SELECT list, effect, kind, pattern, make_timestamp(({START} + day * 86400) * 1000000) AS since, max(active) AS active
  FROM (SELECT *, a % 200 AS day, true AS active FROM entries
        UNION ALL SELECT *, a % 200 + 30 + a % 70, false FROM entries
        UNION ALL SELECT *, a % 200 + 150, true FROM entries) GROUP BY ALL),
valid AS MATERIALIZED (
  SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY list, effect, kind, pattern ORDER BY since) AS until FROM changes) WHERE active),
cap AS MATERIALIZED (SELECT row_number() OVER () AS c, * FROM p),
keys AS (
  SELECT DISTINCT * FROM (
    SELECT c, fetched, 'url' AS kind, host || path || query AS pattern FROM cap WHERE host <> ''
    UNION ALL SELECT c, fetched, 'host', host FROM cap WHERE host <> ''
    UNION ALL SELECT c, fetched, 'domain', array_to_string(string_split(host, '.')[i:], '.') FROM cap, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i) WHERE host <> ''
    UNION ALL SELECT c, fetched, 'prefix', host || array_to_string(string_split(path, '/')[1:i], '/') || '/'
              FROM cap, unnest(range(1, greatest(len(string_split(path, '/')) - 1, 1) + 1)) AS t(i) WHERE host <> '')),
hits AS (
  SELECT c, v.*, count(*) OVER (PARTITION BY c) AS n_active,
         row_number() OVER (PARTITION BY c ORDER BY CASE v.kind WHEN 'url' THEN 4 WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC,
                            length(v.pattern) DESC, (effect = 'block') DESC, list, v.kind, v.pattern, v.since) AS rn
  FROM keys k JOIN valid v ON k.kind = v.kind AND k.pattern = v.pattern AND v.since <= k.fetched AND (v.until IS NULL OR k.fetched < v.until))
SELECT page_id, url, fetched, coalesce(effect, 'pass') AS verdict, list, kind, pattern, since, coalesce(n_active, 0) AS n_active
FROM cap LEFT JOIN hits ON cap.c = hits.c AND rn = 1
"""
