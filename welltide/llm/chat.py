"""Perspective rotation of multi-party dialogues: for every participant the dialogue with that speaker as assistant.

Other participants are users with their names, ``system`` turns stay system turns, and the mask holds the character ranges (body and end
marker) of the speaker's own turns. All steps are DataFrame functions.

A dialogue is rendered in parts of ``PART_TURNS`` consecutive turn numbers, so a dialogue of any length is never one group or one value;
spans count from the beginning of their part. A turn number with more than ``TURN_ROWS`` rows (dialogues that share an id, or a turn copied many
times) is taken out of its part and dealt to pieces, numbered from 1, by hash of speaker and text; copies are counted first and dealt in lots.

Cases: turns are ordered by number, then speaker and text; turns without a number come in parts of their own (negative, spread by hash of the text); a null role is the
participant ``unknown``, a null text an empty body; repeated rows are repeated turns; a null conversation id is a conversation; markers inside
texts and names are defused; a dialogue of system turns only has no participant and gives no rows; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import table
from welltide.session import stage

PART_TURNS = 64
#: Rows of one turn number that stay in their part; more are dealt to pieces of about as many.
TURN_ROWS = 64
START, END = "<|im_start|>", "<|im_end|>"


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _pieces(own: DataFrame, turn_rows: int) -> DataFrame:
    """conv, part, piece, turn, who, body, times (how often the row occurs there). Only keys are counted to find the crowded turn numbers.
    Their list is a written table, so that the planner knows its size and turns are moved for it only if it is too large to broadcast."""
    key = ["conv", "part", "turn"]
    crowded = own.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > turn_rows).select(*[F.col(c).alias(f"_{c}") for c in key], "n")
    crowded = stage(crowded, "crowded-turns")
    same = F.col("conv").eqNullSafe(F.col("_conv")) & F.col("part").eqNullSafe(F.col("_part")) & F.col("turn").eqNullSafe(F.col("_turn"))
    plain = own.join(crowded, same, "left_anti").select("conv", "part", F.lit(0).cast("long").alias("piece"), "turn", "who", "body", F.lit(1).alias("times"))
    copies = own.join(crowded, same).groupBy(*key, "n", "who", "body").agg(F.count(F.lit(1)).alias("k"))
    lots = copies.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / turn_rows))))
    code = F.conv(F.substring(F.md5(F.concat_ws("\n", "who", "body", F.col("lot").cast("string"))), 1, 8), 16, 10).cast("long")
    times = F.least(F.lit(turn_rows).cast("long"), F.col("k") - F.col("lot") * turn_rows).cast("int")
    return plain.union(lots.select("conv", "part", 1 + code % F.ceil(F.col("n") / turn_rows), "turn", "who", "body", times))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS,
           turn_rows: int = TURN_ROWS) -> DataFrame:
    """conv, perspective, part, piece, rendered, spans (array of start, end), n_turns, n_trained (characters in the mask)."""
    body = _safe(F.coalesce(F.col(text), F.lit("")))
    own = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), _safe(F.replace(F.coalesce(F.col(role), F.lit("unknown")), F.lit("\n"), F.lit(" "))).alias("who"), body.alias("body"))
    loose = -1 - F.conv(F.substring(F.md5("body"), 1, 2), 16, 10).cast("long")
    own = own.withColumn("part", F.coalesce(F.floor(F.col("turn") / part_turns), loose))
    lots = F.array_sort(F.collect_list(F.struct("turn", "who", "body", "times")))
    parts = (_pieces(own, turn_rows).groupBy("conv", "part", "piece").agg(lots.alias("lots"))
             .select("conv", "part", "piece", F.flatten(F.transform("lots", lambda t: F.array_repeat(t, t["times"]))).alias("turns")))
    speakers = own.where("who <> 'system'").select("conv", F.col("who").alias("perspective")).distinct()
    seen = parts.join(speakers.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    head = lambda t: F.when(t["who"] == F.col("perspective"), F.lit(f"{START}assistant\n")).when(t["who"] == "system", F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), t["who"], F.lit("\n")))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), t["body"].alias("body"), (t["who"] == F.col("perspective")).alias("own")))
    rows = seen.withColumn("pieces", pieces)
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(s: Column, p: Column) -> Column:
        begin = (s["at"] + F.length(p["head"])).cast("int")
        end = (begin + F.length(p["body"]) + len(END)).cast("int")
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).cast("int").alias("at"), F.when(p["own"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    spans = F.aggregate("pieces", empty, walk, lambda s: s["spans"])
    rendered = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(f"{END}\n"))), "")
    out = rows.select(F.col("conv").alias(conv), "perspective", "part", "piece", rendered.alias("rendered"), spans.alias("spans"), F.size("turns").cast("long").alias("n_turns"))
    return out.withColumn("n_trained", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]))


def op4_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations`` from every participant's view; the mask as text."""
    out = rotate(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("conv_id", "perspective", "part", "piece", "rendered", mask.alias("mask"), "n_turns", "n_trained")


OP4_SQL = f"""
WITH own AS (
  SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), chr(10), ' '), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS body FROM conversations),
banded AS (SELECT *, coalesce(floor(turn / {PART_TURNS})::BIGINT, -1 - ('0x' || substr(md5(body), 1, 2))::BIGINT) AS part FROM own),
lots AS (SELECT *, count(*) OVER (PARTITION BY conv_id, part, turn) AS n, (row_number() OVER (PARTITION BY conv_id, part, turn, who, body) - 1) // {TURN_ROWS} AS lot FROM banded),
t AS (SELECT *, CASE WHEN n <= {TURN_ROWS} THEN 0
                ELSE 1 + ('0x' || substr(md5(who || chr(10) || body || chr(10) || lot), 1, 8))::BIGINT % ceil(n / {TURN_ROWS})::BIGINT END AS piece FROM lots),
speakers AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
seg AS (
  SELECT t.conv_id, perspective, part, piece, who = perspective AS mine, body,
         CASE WHEN who = perspective THEN '{START}assistant' || chr(10) WHEN who = 'system' THEN '{START}system' || chr(10) ELSE '{START}user name=' || who || chr(10) END AS head,
         row_number() OVER (PARTITION BY t.conv_id, perspective, part, piece ORDER BY turn NULLS FIRST, who, body) AS i
  FROM t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
pos AS (
  SELECT *, sum(length(head) + length(body) + {len(END) + 1}) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY i) - length(body) - {len(END) + 1} AS a,
         sum(length(head) + length(body) + {len(END) + 1}) OVER (PARTITION BY conv_id, perspective, part, piece ORDER BY i) - 1 AS b
  FROM seg)
SELECT conv_id, perspective, part, piece, string_agg(head || body || '{END}' || chr(10), '' ORDER BY i) AS rendered,
       coalesce(string_agg(a::BIGINT::VARCHAR || '-' || b::BIGINT::VARCHAR, ',' ORDER BY i) FILTER (WHERE mine), '') AS mask,
       count(*) AS n_turns, coalesce(sum(b - a) FILTER (WHERE mine), 0)::BIGINT AS n_trained
FROM pos GROUP BY conv_id, perspective, part, piece
"""
