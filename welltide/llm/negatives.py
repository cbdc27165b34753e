"""Hard negatives by a vertical scan of the vectors' dimensions.

Rows are dealt by hash to splits, anchors to groups; a task holds one split against one group. It stores its rows by dimension. For an anchor
the dimensions are read in the order of the anchor's own magnitudes, largest first. After each step a row's score lies between what has been
read plus the least, and plus the most, that the unread dimensions can add given their smallest and largest values; rows whose range misses
what is looked for leave the anchor's bitmap, and the next step reads only the rest. What remains at the end has exact integer scores.

The first scan finds each anchor's positives. The second looks, for every different score of a positive, for the best rows of another label
inside the window of that score. Each task returns at most as many rows per anchor and window as are wanted, so merging stays small. Every
anchor meets every row: the work is rows times anchors, as asked for, and the scan lowers what a meeting costs.

Cases: rows with a null key or label, or vectors that are null or hold null or non-finite components take no part; shorter vectors count as
padded with zeros; of rows that share a key, the one with the smallest label, then vector, does; ties go to the smaller key; a
positive with a negative score has an empty window; an empty table gives no rows; other columns are not read. Components beyond 2^27 after
scaling are refused, as a score would not fit a long.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from welltide.llm.common import table
from welltide.llm.kmeans import complete, whole_numbers
from welltide.session import stage_path

#: Rows of a split and anchors of a group at most (on average, as keys are dealt by hash), and dimensions of a scan's first step.
SPLIT_ROWS, GROUP_ANCHORS, STEP = 16_384, 2_048, 4


class Vertical:
    """Rows (one at least) sorted by label, stored by dimension, with each dimension's smallest and largest value."""

    def __init__(self, f: pd.DataFrame):
        label = f["label"].to_numpy()
        order = np.argsort(label, kind="stable")
        self.ids, self.label = f["id"].to_numpy()[order], label[order]
        rows = np.frombuffer(b"".join(f["ints"]), dtype=np.int32).reshape(len(f), -1)[order]
        # Doubles hold the integers exactly while no sum can leave 2^53.
        big = int(np.abs(rows.astype(np.int64)).max(initial=0))
        self.kind = np.float64 if big * big * rows.shape[1] < 1 << 53 else np.int64
        self.columns = np.ascontiguousarray(rows.T).astype(self.kind)
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)

    def place(self, label: int) -> tuple[int, int]:
        return tuple(np.searchsorted(self.label, [label, label + 1]))

    def scan(self, anchor: np.ndarray, at: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of the rows ``at`` those that ``keep`` (lower bounds, upper bounds) never drops, and their scores."""
        score = np.zeros(len(at), dtype=self.kind)
        if not len(at):
            return at, score.astype(np.int64)
        order = np.argsort(-np.abs(anchor), kind="stable")
        a = anchor[order].astype(self.kind)
        low, high = self.least[order] * a, self.most[order] * a
        low, high = np.minimum(low, high), np.maximum(low, high)
        left_low, left_high = (np.concatenate([np.cumsum(x[::-1])[::-1], [0]]) for x in (low, high))
        done, step = 0, STEP
        while done < len(a) and len(at):
            to = min(done + step, len(a))
            part = self.columns[order[done:to]]
            score += a[done:to] @ (part if len(at) == part.shape[1] else part[:, at])
            done, step = to, 2 * step
            stay = keep(score + left_low[done], score + left_high[done])
            if not stay.all():
                at, score = at[stay], score[stay]
        return at, score.astype(np.int64)


def _top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def _kth(values: np.ndarray, k: int):
    return np.partition(values, len(values) - k)[len(values) - k]


def best(rows: Vertical, anchor: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` rows of ``at`` with the largest scores, and these."""
    at, score = rows.scan(anchor, at, lambda low, high: high >= _kth(low, k) if len(low) > k else np.ones(len(low), dtype=bool))
    o = _top(rows.ids[at], score, k)
    return at[o], score[o]


def within(rows: Vertical, anchor: np.ndarray, at: np.ndarray, windows: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``at`` that hold, for each window (least, most), the ``k`` largest scores inside of it; and their scores."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        stay = np.zeros(len(low), dtype=bool)
        for least, most in windows:
            sure = low[(high <= most) & (low >= least)]
            stay |= (low <= most) & (high >= (max(least, _kth(sure, k)) if len(sure) >= k else least))
        return stay

    return rows.scan(anchor, at, keep)


def _positives(k: int):
    def run(_, mine: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(anchors):
            rows = Vertical(mine)
            for i, label, raw in zip(anchors["id"], anchors["label"], anchors["ints"], strict=True):
                at = np.arange(*rows.place(label))
                got, score = best(rows, np.frombuffer(raw, dtype=np.int32), at[rows.ids[at] != i], k)
                out.append(pd.DataFrame({"anchor_id": i, "positive_id": rows.ids[got], "positive_score": score}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_id": [], "positive_score": []}, dtype="int64")

    return run


def _negatives(k: int, low: int, high: int):
    def run(_, mine: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(mine) and len(anchors):
            rows = Vertical(mine)
            for i, label, raw, scores in zip(anchors["id"], anchors["label"], anchors["ints"], anchors["scores"], strict=True):
                a, b = rows.place(label)
                windows = [(-(-low * s // 100), high * s // 100) for s in map(int, scores)]
                at, score = within(rows, np.frombuffer(raw, dtype=np.int32), np.concatenate([np.arange(a), np.arange(b, len(rows.ids))]), windows, k)
                for s, (least, most) in zip(scores, windows, strict=True):
                    fits = np.flatnonzero((score >= least) & (score <= most))
                    o = fits[_top(rows.ids[at[fits]], score[fits], k)]
                    out.append(pd.DataFrame({"anchor_id": i, "positive_score": s, "negative_id": rows.ids[at[o]], "negative_score": score[o]}))
        return pd.concat(out) if out else pd.DataFrame({"anchor_id": [], "positive_score": [], "negative_id": [], "negative_score": []}, dtype="int64")

    return run


def _whole(dim: int, scale: int):
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "label": f["label"], "ints": [r.tobytes() for r in whole_numbers(f["vec"], dim, scale).astype(np.int32)]})

    return run


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, key: str = "vec_id",
                   label: str = "label", vec: str = "embedding", split_rows: int = SPLIT_ROWS, group_anchors: int = GROUP_ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is over column ``id``. For each anchor's best ``positives`` rows of its label, the best ``negatives`` rows of other labels with
    a score between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    some = rows.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vec).cast("array<double>").alias("vec"))
    some = some.where(F.col("id").isNotNull() & F.col("label").isNotNull())
    dim = some.agg(F.max(F.size("vec"))).first()[0] or 0
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dim < 1:
        return spark.createDataFrame([], schema)
    padded = some.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("vec"))))
    one = padded.where(complete("vec", dim)).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")
    base, path = stage_path(one.mapInPandas(_whole(dim, scale), "id long, label long, ints binary"), "negatives-rows")
    n, m = base.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n / 1024))
    splits, groups = max(math.ceil(n / split_rows), spread, 1), max(math.ceil(m / group_anchors), 1)

    def dealt(df: DataFrame, own: str, of: int, other: str, times: int) -> DataFrame:
        """Rows with their own place in one direction of the grid, repeated along the other."""
        return df.withColumns({own: F.pmod(F.xxhash64("id"), F.lit(of)), other: F.explode(F.sequence(F.lit(0), F.lit(times - 1)).cast("array<long>"))})

    mine = dealt(base, "split", splits, "grp", groups).groupBy("split", "grp")
    anchors = spark.read.schema(base.schema).parquet(path).where(is_anchor)
    found = mine.cogroup(dealt(anchors, "grp", groups, "split", splits).groupBy("split", "grp")).applyInPandas(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best_, _ = stage_path(found.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= positives).drop("rn"), "negatives-positives")
    # A window of a negative score is empty.
    wanted = best_.where("positive_score >= 0").groupBy("anchor_id").agg(F.collect_set("positive_score").alias("scores"))
    asked = anchors.join(wanted.withColumnRenamed("anchor_id", "id"), "id")
    got = mine.cogroup(dealt(asked, "grp", groups, "split", splits).groupBy("split", "grp")).applyInPandas(
        _negatives(negatives, low, high), "anchor_id long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    top = got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return best_.join(top, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of ``embeddings`` whose id is divisible by 100; labels of ids divisible by 7 are moved on by one first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


OP11_SQL = """
WITH rows_ AS MATERIALIZED (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM rows_ a JOIN rows_ b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY rank <= 10
"""
