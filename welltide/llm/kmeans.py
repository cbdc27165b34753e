"""Clustering of vectors around integer centroids, with candidates filtered in rotated coordinates.

Vectors are scaled, floored to integers, and stored once with their leading coordinates in the directions of largest variance (principal
components of all vectors) and the norm of what those leave out. The squared distance of the leading coordinates plus the squared difference
of the two norms is never more than the squared distance, so a centroid whose bound exceeds a distance already known is out; the remaining
ones are measured in integers. The rotation decides the cost, never the result: bounds are compared with an allowance for rounding.

A round is one pass over the stored vectors; each task returns one row of integer sums per cluster, and the driver holds the centroids only.

Cases: vectors that are null, of another length, or hold null or non-finite components are not kept; a null key is kept and starts no
centroid before all others; rows that repeat a key count each; ties go to the smaller cluster number; with fewer vectors than clusters there
are as many centroids as vectors; an empty table gives no rows; other columns are not read. Components beyond 2^27 after scaling are refused,
as a distance would not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import table
from welltide.session import release, stage_path

#: Leading rotated coordinates that are stored, and the largest scaled component.
LEADING, LARGEST = 16, 1 << 27


def complete(vec: str, dim: int) -> Column:
    """Whether a vector has ``dim`` components, none null or non-finite."""
    v = F.col(vec)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) == dim) & finite, F.lit(False))


def whole_numbers(column: pd.Series, dim: int, scale: int, largest: int = LARGEST) -> np.ndarray:
    """floor(scale * x) of vectors of doubles, one row each."""
    x = np.floor(np.concatenate(column.to_numpy()).reshape(-1, dim) * float(scale)) if len(column) else np.zeros((0, dim))
    if len(x) and np.abs(x).max() > largest:
        raise ValueError(f"a component is larger than {largest} after scaling by {scale}")
    return x.astype(np.int64)


def _moments(dim: int, scale: int):
    """One row per task and dimension: the row of sums of products; in the row ``dim`` the sums and the count."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim + 1, dim + 1))
        for f in frames:
            x = np.concatenate([whole_numbers(f["vec"], dim, scale).astype(np.float64), np.ones((len(f), 1))], axis=1)
            total += x.T @ x
        if total[dim, dim]:
            yield pd.DataFrame({"i": np.arange(dim + 1), "sums": list(total)})

    return run


def rotation(kept: DataFrame, dim: int, scale: int, leading: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean, and the ``leading`` principal directions as columns, of all vectors."""
    parts = kept.select("vec").mapInPandas(_moments(dim, scale), "i int, sums array<double>").select("i", F.posexplode("sums").alias("j", "x"))
    total = np.zeros((dim + 1, dim + 1))
    for r in parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect():
        total[r["i"], r["j"]] = r["x"]
    mean = total[dim, :dim] / max(total[dim, dim], 1.0)
    spread = total[:dim, :dim] / max(total[dim, dim], 1.0) - np.outer(mean, mean)
    return mean, np.linalg.eigh(spread)[1][:, ::-1][:, :leading]


def rotated(x: np.ndarray, mean: np.ndarray, directions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leading coordinates of the rows, and the norms of what they leave out."""
    y = x - mean
    lead = y @ directions
    return lead, np.linalg.norm(y - lead @ directions.T, axis=1)


def _stored(dim: int, scale: int, mean: np.ndarray, directions: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = whole_numbers(f["vec"], dim, scale)
            lead, rest = rotated(x, mean, directions)
            yield pd.DataFrame({"id": f["id"], "ints": [r.tobytes() for r in x.astype(np.int32)], "lead": [r.tobytes() for r in lead], "rest": rest})

    return run


def nearest_centroid(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centres: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid (ties: the smaller number) of integer vectors."""
    bound = np.stack([((lead - a) ** 2).sum(axis=1) + (rest - b) ** 2 for a, b in zip(c_lead, c_rest, strict=True)], axis=1)
    size = (lead**2).sum(axis=1) + rest**2 + ((c_lead**2).sum(axis=1) + c_rest**2).max()
    cluster = bound.argmin(axis=1)
    distance = ((x - centres[cluster]) ** 2).sum(axis=1)
    # Rounding of the rotation and of the sums is far below a billionth of the lengths involved.
    open_ = bound <= (distance + 1e-9 * (size + distance) + 1.0)[:, None]
    open_[np.arange(len(x)), cluster] = False
    for c in np.flatnonzero(open_.any(axis=0)):
        at = np.flatnonzero(open_[:, c])
        d = ((x[at] - centres[c]) ** 2).sum(axis=1)
        better = (d < distance[at]) | ((d == distance[at]) & (c < cluster[at]))
        cluster[at[better]], distance[at[better]] = c, d[better]
    return cluster, distance


def _read(f: pd.DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(f["ints"]), dtype=np.int32).reshape(-1, dim).astype(np.int64)
    return x, np.frombuffer(b"".join(f["lead"]), dtype=np.float64).reshape(len(f), -1), f["rest"].to_numpy()


def _sums(dim: int, centres: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray):
    """One row per task and cluster: the sums of its vectors' components, and after them their number."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(centres), dim + 1), dtype=np.int64)
        for f in frames:
            if len(f):
                x, lead, rest = _read(f, dim)
                cluster, _ = nearest_centroid(x, lead, rest, centres, c_lead, c_rest)
                for c in range(len(centres)):
                    total[c, :dim] += x[cluster == c].sum(axis=0)
                total[:, dim] += np.bincount(cluster, minlength=len(centres))
        at = np.flatnonzero(total[:, dim])
        yield pd.DataFrame({"cluster": at, "sums": list(total[at])})

    return run


def _assigned(dim: int, centres: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                cluster, distance = nearest_centroid(*_read(f, dim), centres, c_lead, c_rest)
                yield pd.DataFrame({"id": f["id"], "cluster": cluster, "distance": distance})

    return run


def clustered(rows: DataFrame, clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3", key: str = "vec_id", vec: str = "embedding",
              leading: int = LEADING) -> DataFrame:
    """key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector kept.

    The first centroids are the vectors with the smallest SHA-256 of ``seed:key``. A round assigns all vectors and replaces each centroid that
    has any by the floor of their mean; it ends early once no centroid moves, as no later round would move one.
    """
    spark = rows.sparkSession
    kept = rows.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("vec")).where(complete("vec", dim))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "id", "vec").limit(clusters).collect()
    schema = f"`{key}` long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centres = whole_numbers(pd.Series([np.array(r["vec"]) for r in first]), dim, scale)
    mean, directions = rotation(kept, dim, scale, min(leading, dim))
    store, path = stage_path(kept.mapInPandas(_stored(dim, scale, mean, directions), "id long, ints binary, lead binary, rest double"), "kmeans-vectors")
    for _ in range(rounds):
        parts = store.mapInPandas(_sums(dim, centres, *rotated(centres, mean, directions)), "cluster int, sums array<long>")
        each = parts.select("cluster", F.posexplode("sums").alias("j", "x")).groupBy("cluster", "j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
        total = {(r["cluster"], r["j"]): int(r["x"]) for r in each}
        moved = np.array([[total[c, j] // total[c, dim] for j in range(dim)] if (c, dim) in total else own.tolist() for c, own in enumerate(centres)], dtype=np.int64)
        if (moved == centres).all():
            break
        centres = moved
    out, _ = stage_path(store.mapInPandas(_assigned(dim, centres, *rotated(centres, mean, directions)), "id long, cluster int, distance long"), "kmeans-assigned")
    release(spark, path)
    inertia = {r["cluster"]: int(r["s"]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centres]
    found = spark.createDataFrame([(c, s, sum(inertia.values()), names[c]) for c, s in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # At most one row per centroid.
    return out.join(F.broadcast(found), "cluster").select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all complete vectors of ``embeddings`` after ten rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql(clusters: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> str:
    steps = [f"""kept AS MATERIALIZED (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
    parts AS MATERIALIZED (SELECT vec_id, unnest(range({dim})) AS j, unnest(v) AS x FROM kept),
    c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM kept ORDER BY c LIMIT {clusters})"""]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
        SELECT vec_id, c, d FROM (
            SELECT vec_id, c, list_sum(list_transform(list_zip(kept.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM kept CROSS JOIN c{r})
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < rounds:
            # Integer division truncates, so the remainder is taken off first.
            steps.append(f"""c{r + 1} AS MATERIALIZED (
        WITH m AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM a{r} JOIN parts USING (vec_id) GROUP BY c, j),
             moved AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM m GROUP BY c)
        SELECT c{r}.c, coalesce(moved.v, c{r}.v) AS v FROM c{r} LEFT JOIN moved ON moved.c = c{r}.c)""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(list_aggregate(v, 'string_agg', ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)"""


OP12_SQL = _sql()
