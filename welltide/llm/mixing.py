"""Mixing sources to target weights by iterative proportional fitting.

The token mass of each cell (source, language, topic) is raked: source, language and topic margins are scaled to their targets in turn until
all agree. A cell's rate is its raked weight over its mass, scaled so that no rate is above one; a document is drawn with its cell's rate by
a hash of its key and text, so the draw is the same on every run and does not depend on partitioning.

Cells without documents can make margins contradict each other. Given targets that cannot be met together are refused with the margins they
miss; tempered shares, which no one asked for in particular, end ``ROUNDS`` rounds as they are, with a warning. ``gap`` says by how much.

Targets are given, or tempered: a category's share to the power ``temper``. The cells are at most the product of the categories; above
``MAX_CELLS`` the operator refuses instead of passing a large table through the driver.

Cases: nulls are a category of their own; a category without target gets no weight, a target without rows is left out and the rest share its
part; a null or empty text has one token; rows with equal key and text are drawn together; an empty table gives no rows; other columns pass
through, whatever their names.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import packed, table

MAX_CELLS = 200_000
ROUNDS = 50
#: Rounds for given targets, and the share of the mixture by which a margin may miss them (of tempered ones: without a warning).
GIVEN_ROUNDS, TOLERANCE = 1000, 0.001
SALT = "mix-1"

#: What a text's content shows, first match first: label, strings of which one must occur.
TOPICS = [("tabular", [" | "]), ("marked", ["$$$", "###", "&&&", "***"]), ("loud", ["!!"]), ("licensed", ["icense"])]


def topic_of(text: str = "text") -> Column:
    t, out = F.coalesce(F.col(text), F.lit("")), F.lit("prose")
    for name, marks in reversed(TOPICS):
        hit = F.contains(t, F.lit(marks[0]))
        for m in marks[1:]:
            hit = hit | F.contains(t, F.lit(m))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def tokens_of(text: str = "text") -> Column:
    """Estimate of a text's tokens: a quarter of its bytes, one at least."""
    return F.greatest(F.lit(1), F.floor((F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 3) / 4)).cast("long")


def rake(mass: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Weights proportional to ``mass`` but for one factor per category of each margin (codes of the cells, target share of each code)."""
    w = mass / mass.sum()
    for _ in range(rounds):
        for code, share in margins:
            have = np.bincount(code, weights=w, minlength=len(share))
            w = w * np.divide(share, have, out=np.zeros(len(share)), where=have > 0)[code]
    return w


def margin_gaps(w: np.ndarray, margins: list[tuple[np.ndarray, np.ndarray]]) -> list[float]:
    """For each margin, the share of the mixture that lies in other categories than the targets want."""
    return [float(np.abs(np.bincount(code, weights=w, minlength=len(share)) - share).sum() / 2) for code, share in margins]


def cell_rates(cells: pd.DataFrame, columns: list[str], targets: dict[str, dict | None], temper: float, rounds: int = ROUNDS) -> pd.DataFrame:
    """The cells with their raked share ``weight``, sampling ``rate`` (at most one) and the largest ``gap`` of a margin to its targets."""
    cells = cells.sort_values(columns, ignore_index=True, na_position="first")
    mass, margins = cells["mass"].to_numpy(dtype=float), []
    for c in columns:
        code, names = pd.factorize(cells[c], use_na_sentinel=False)
        have = np.bincount(code, weights=mass)
        given = targets.get(c)
        share = have ** temper if given is None else np.array([given.get(None if pd.isna(x) else x, 0.0) for x in names], dtype=float)
        if share.sum() <= 0:
            raise ValueError(f"no target of {c} has rows")
        margins.append((code, share / share.sum()))
    w, given = rake(mass, margins, rounds), any(targets.get(c) is not None for c in columns)
    done = rounds
    while given and done < GIVEN_ROUNDS and w.sum() > 0 and max(margin_gaps(w, margins)) > TOLERANCE:
        w, done = rake(w, margins, rounds), done + rounds
    gaps = margin_gaps(w, margins)
    if max(gaps) > TOLERANCE:
        missed = ", ".join(f"{c} by {g:.4f}" for c, g in zip(columns, gaps, strict=True))
        if given:
            raise ValueError(f"the targets cannot be met together by the cells that have documents; missed: {missed}")
        warnings.warn(f"tempered shares are not all met: {missed}", stacklevel=2)
    rate = w / mass
    return cells.assign(weight=w, rate=rate / rate.max(), gap=max(gaps))


def with_rates(docs: DataFrame, source: str = "source", lang: str = "lang", topic: Column | None = None, tokens: Column | None = None,
               targets: dict[str, dict | None] | None = None, temper: float = 0.9, text: str = "text") -> DataFrame:
    """The columns of ``docs`` as ``row``, with source, lang, topic, tokens, weight (the cell's share of the mixture) and rate."""
    own = ["source", "lang", "topic"]
    rows = packed(docs, source=F.col(source).cast("string"), lang=F.col(lang).cast("string"), topic=topic_of(text) if topic is None else topic,
                  tokens=tokens_of(text) if tokens is None else tokens)
    found = rows.groupBy(*own).agg(F.sum("tokens").cast("double").alias("mass")).limit(MAX_CELLS + 1).toPandas()
    if len(found) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of source, language and topic")
    if found.empty:
        return rows.withColumns({"weight": F.lit(None).cast("double"), "rate": F.lit(None).cast("double")})
    cells = cell_rates(found, own, targets or {}, temper)
    data = [(None if pd.isna(a) else a, None if pd.isna(b) else b, None if pd.isna(c) else c, float(w), float(r))
            for a, b, c, w, r in cells[[*own, "weight", "rate"]].itertuples(index=False)]
    small = docs.sparkSession.createDataFrame(data, "s string, l string, t string, weight double, rate double")
    on = F.col("source").eqNullSafe(F.col("s")) & F.col("lang").eqNullSafe(F.col("l")) & F.col("topic").eqNullSafe(F.col("t"))
    return rows.join(F.broadcast(small), on).drop("s", "l", "t")  # MAX_CELLS rows at most


def draw(key: str = "doc_id", text: str = "text", salt: str = SALT) -> Column:
    """A number in [0, 1) from key and text."""
    seed = F.concat_ws(":", F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit(""))))
    return F.conv(F.substring(F.md5(seed), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are drawn, with their columns."""
    return with_rates(docs, text=text, **how).where(draw(f"row.{key}", f"row.{text}") < F.col("rate")).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for a mixture with tempered source, language and topic shares, with their cell's weight and rate."""
    rows = with_rates(table(spark, sf_dir, "documents")).where(draw("row.doc_id", "row.text") < F.col("rate"))
    return rows.select("row.doc_id", "source", "lang", "topic", "tokens", F.round("weight", 9).alias("weight"), F.round("rate", 9).alias("rate"))


def _sql() -> str:
    case = " ".join(f"WHEN {' OR '.join(f'contains(t, {chr(39)}{m}{chr(39)})' for m in marks)} THEN '{name}'" for name, marks in TOPICS)
    step = "w"
    for c in ("source", "lang", "topic"):
        step = f"SELECT * REPLACE (w * share_{c} / sum(w) OVER (PARTITION BY {c}) AS w) FROM ({step if step != 'w' else 'SELECT it + 1 AS it, * EXCLUDE (it) FROM fit WHERE it < ' + str(ROUNDS)})"
    shares = ", ".join(f"power(sum(mass) OVER (PARTITION BY {c}), 0.9) AS raw_{c}" for c in ("source", "lang", "topic"))
    total = ", ".join(f"raw_{c} / (SELECT sum(x) FROM (SELECT DISTINCT {c}, raw_{c} AS x FROM raw)) AS share_{c}" for c in ("source", "lang", "topic"))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, source, lang, CASE {case} ELSE 'prose' END AS topic, greatest(1, (strlen(t) + 3) // 4)::BIGINT AS tokens,
         ('0x' || substr(md5('{SALT}:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(t)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents)),
raw AS MATERIALIZED (SELECT *, {shares} FROM (SELECT source, lang, topic, sum(tokens)::DOUBLE AS mass FROM d GROUP BY ALL)),
fit AS (
  SELECT 0 AS it, source, lang, topic, mass, mass / sum(mass) OVER () AS w, {total} FROM raw
  UNION ALL
  {step}),
rates AS MATERIALIZED (SELECT source, lang, topic, w AS weight, w / mass / max(w / mass) OVER () AS rate FROM fit WHERE it = {ROUNDS})
SELECT doc_id, d.source, d.lang, d.topic, tokens, round(weight, 9) AS weight, round(rate, 9) AS rate
FROM d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic
WHERE u < rate
"""


OP8_SQL = _sql()
