"""Ordered-series building blocks that survive one well holding most of the rows.

A well's samples are ordered by a dense 0-based ``pos``. A plain window over ``well_id`` would put a whole
well in one task, so everything here works on fixed-size chunks of positions:

* ``halo`` copies the few rows next to a chunk edge into the neighbour, which makes bounded frames
  (lag, lead, centred means) exact inside (well, chunk);
* ``carry`` makes unbounded frames (last known value, running sum) exact from one summary row per chunk;
* ``attach`` joins per-well parameters on (well, chunk), so a huge well is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 1 << 20


def dense_positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
                    name: str = "pos") -> DataFrame:
    """0-based row number per key, in ``order``.

    ``bucket`` is any non-decreasing function of the order (a day, a key range). Rows are numbered inside
    (key, bucket) and shifted by the number of rows in earlier buckets. The rows are already partitioned for the
    numbering, so the shifts join by hash on the same partitioning.
    """
    keys = list(keys)
    b = df.withColumn("_b", bucket)
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    shift = (b.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
             .withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return (b.withColumn("_rn", F.row_number().over(inside))
            .join(shift.hint("shuffle_hash"), [*keys, "_b"])
            .withColumn(name, (F.col("_rn") - 1 + F.col("_off")).cast("long"))
            .drop("_b", "_rn", "_off"))


def chunk_of(pos: str | Column, size: int) -> Column:
    c = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(c / F.lit(size)).cast("long")


def with_chunk(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    return df.withColumn("_chunk", chunk_of(pos, size))


def halo(df: DataFrame, before: int, after: int, size: int, pos: str = "pos") -> DataFrame:
    """Rows plus copies next to chunk edges; ``_own`` marks the originals. Needs before, after <= size."""
    if before > size or after > size:
        raise ValueError("halo wider than a chunk")
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - after) / F.lit(size)))
    last = F.floor((F.col(pos) + before) / F.lit(size))
    return (df.withColumn("_chunk", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
            .withColumn("_own", F.col("_chunk") == chunk_of(pos, size)))


def chunk_window(keys: Sequence[str], pos: str = "pos"):
    return Window.partitionBy(*keys, "_chunk").orderBy(pos)


def bounded(df: DataFrame, keys: Sequence[str], before: int, after: int, make, size: int = CHUNK,
            pos: str = "pos", keep_chunk: bool = False) -> DataFrame:
    """Add columns from frames reaching at most ``before`` rows back and ``after`` rows on.

    ``make(w)`` gets the ordered window and returns {name: column}. With ``keep_chunk`` the rows stay partitioned by
    (key, chunk), so a ``carry`` of the same size that follows needs no further shuffle of them.
    """
    h = halo(df, before, after, size, pos)
    out = h.withColumns(make(chunk_window(keys, pos))).where("_own").drop("_own")
    return out if keep_chunk else out.drop("_chunk")


def carry(df: DataFrame, keys: Sequence[str], last: dict[str, Column] | None = None,
          total: dict[str, Column] | None = None, following: dict[str, Column] | None = None,
          size: int = CHUNK, pos: str = "pos") -> DataFrame:
    """Unbounded frames over each key's series, chunk by chunk.

    last:      name -> latest non-null value at or before the row
    total:     name -> running sum up to and including the row
    following: name -> first non-null value strictly after the row

    ``df`` is read twice (summary and rows); stage it first when it is expensive.
    """
    last, total, following = last or {}, total or {}, following or {}
    keys = list(keys)
    src = {f"_s_{n}": c for n, c in {**last, **total, **following}.items()}
    d = (df if "_chunk" in df.columns else with_chunk(df, size, pos)).withColumns(src)
    aggs = []
    for n in last:
        aggs.append(F.max_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col(pos))).alias(f"_c_{n}"))
    for n in total:
        aggs.append(F.sum(f"_s_{n}").alias(f"_c_{n}"))
    for n in following:
        aggs.append(F.min_by(f"_s_{n}", F.when(F.col(f"_s_{n}").isNotNull(), F.col(pos))).alias(f"_c_{n}"))
    w = Window.partitionBy(*keys).orderBy("_chunk")
    prev = w.rowsBetween(Window.unboundedPreceding, -1)
    # Frames that end at the last row are computed anew for every row; backwards they are running frames.
    nxt = Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    summary = d.groupBy(*keys, "_chunk").agg(*aggs).select(
        *keys, "_chunk",
        *[F.last(f"_c_{n}", ignorenulls=True).over(prev).alias(f"_p_{n}") for n in last],
        *[F.coalesce(F.sum(f"_c_{n}").over(prev), F.lit(0)).alias(f"_p_{n}") for n in total],
        *[F.last(f"_c_{n}", ignorenulls=True).over(nxt).alias(f"_p_{n}") for n in following])
    upto = chunk_window(keys, pos).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys, "_chunk").orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, -1)
    # The rows must be partitioned by (key, chunk) for their windows anyway; a hash join there adds no sort.
    out = d.join(summary.hint("shuffle_hash"), [*keys, "_chunk"])
    cols = {n: F.coalesce(F.last(f"_s_{n}", ignorenulls=True).over(upto), F.col(f"_p_{n}")) for n in last}
    cols |= {n: F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0)) + F.col(f"_p_{n}") for n in total}
    cols |= {n: F.coalesce(F.last(f"_s_{n}", ignorenulls=True).over(after), F.col(f"_p_{n}")) for n in following}
    names = [*last, *total, *following]
    return out.withColumns(cols).drop("_chunk", *[f"_s_{n}" for n in names], *[f"_p_{n}" for n in names])


def attach(rows: DataFrame, params: DataFrame, keys: Sequence[str], last_pos: str = "last_pos",
           size: int = CHUNK, pos: str = "pos", how: str = "left") -> DataFrame:
    """Join one parameter row per key onto rows by (key, chunk of pos).

    ``params`` must carry the key's largest position in ``last_pos``; it is repeated once per chunk.
    """
    spread = (params.where(F.col(last_pos).isNotNull())
              .withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunk_of(last_pos, size))))
              .drop(last_pos))
    return with_chunk(rows, size, pos).join(spread, [*keys, "_chunk"], how).drop("_chunk")


def previous(df: DataFrame, keys: Sequence[str], cols: dict[str, Column], size: int = CHUNK,
             pos: str = "pos", keep_chunk: bool = False) -> DataFrame:
    """Value of each column one row earlier (null on the first row)."""
    return bounded(df, keys, 1, 0, lambda w: {n: F.lag(c).over(w) for n, c in cols.items()}, size, pos, keep_chunk)


def runs(df: DataFrame, keys: Sequence[str], state: str, size: int = CHUNK, pos: str = "pos") -> DataFrame:
    """Add ``run_start``: position of the first row of the row's run of equal ``state``."""
    p = previous(df, keys, {"_prev": F.col(state)}, size, pos, keep_chunk=True)
    starts = F.when(F.col("_prev").isNull() | ~F.col("_prev").eqNullSafe(F.col(state)), F.col(pos))
    return carry(p.withColumn("_start", starts), keys, last={"run_start": F.col("_start")}, size=size, pos=pos) \
        .drop("_prev", "_start")
