"""SimHash fingerprints and all pairs of them within a Hamming radius, by covering locality-sensitive hashing.

Each of the 64 bit positions gets a nonzero vector of radius + 1 bits. A table belongs to each nonzero vector v and keeps the positions
whose vector has an odd product with v. At most ``radius`` differing positions span too little to reach every v, so some table keeps none of
them: every pair within the radius agrees in that table, and each table keeps about half of the bits.

Distinct fingerprints only are compared. A bucket gives the links of a breadth-first search instead of its pairs; buckets beyond a bound are
divided by the tables of a second assignment of vectors (a third, a fourth), which loses no pair either and ends at buckets of a fixed size.

Cases: null and empty texts have the fingerprint zero and are linked like any other; equal rows share a fingerprint; null keys never name a
component unless all keys in it are null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.llm.common import packed, per_batch, table
from welltide.llm.components import components
from welltide.session import stage, stage_path

#: Members of a bucket that one task compares; larger buckets are divided first.
BUCKET = 4096
#: Assignments at most. Any four tables of the first four assignments for radius 4 leave at most 12 of the 64 bits free, so no bucket then
#: holds more than 2 ** 12 distinct fingerprints, however many there are; the fifth is for other radii and smaller bounds.
LEVELS = 5


def fingerprint(text: str | None, words_per_shingle: int = 4) -> int:
    """64 bits; a bit is set if more than half of the shingles' XXH64 values (seed 42) have it."""
    words = text.encode("utf-8").lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    body, k, digest = b" ".join(words), words_per_shingle, xxhash.xxh64_intdigest
    if n <= k:
        return digest(body, 42)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n - k + 1, 1 << 16):
        a, b = starts[at:min(at + (1 << 16), n - k + 1)].tolist(), ends[at + k - 1:at + k - 1 + (1 << 16)].tolist()
        hashes = np.array([digest(body[x:y], 42) for x, y in zip(a, b, strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n - k + 1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words_per_shingle: int = 4) -> DataFrame:
    """key, fp (the 64 bits as a signed long) of every row."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def make(f: pd.DataFrame) -> pd.DataFrame:
        fps = np.array([fingerprint(t, words_per_shingle) for t in f["text"]], dtype=np.uint64)
        return pd.DataFrame({"key": f["key"], "fp": fps.view(np.int64)})

    return src.mapInPandas(per_batch(make), f"key {src.schema['key'].dataType.simpleString()}, fp long")


def covering_masks(radius: int, level: int = 0, bits: int = 64) -> list[int]:
    """2 ** (radius + 1) - 1 masks such that any ``radius`` positions are all outside of some mask. ``level`` picks the assignment."""
    size = 1 << (radius + 1)
    order = np.random.default_rng(level + 1).permutation(bits)
    vector = [0] * bits
    for i, p in enumerate(order):
        vector[p] = 1 + i % (size - 1)
    return [sum(1 << p for p in range(bits) if (vector[p] & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _search(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links that connect exactly the fingerprints (distinct) that pairs within ``radius`` connect."""
    a, b, rest = [], [], fps.view(np.uint64)
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found, rest = rest[near], rest[~near]
                a.extend([x] * len(found))
                b.extend(found)
                queue.extend(found)
    return a, b


def _bucket_links(radius: int, most: int):
    """Rows (path, fp) sorted by path: links of each bucket; members of buckets above ``most`` come out again with their path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, held_path, large = [], None, False  # the fingerprints of the bucket at hand, unless it is known to be large

        def linked(a, b) -> pd.DataFrame:
            return pd.DataFrame({"a": np.array(a, dtype=np.uint64).view(np.int64), "b": np.array(b, dtype=np.uint64).view(np.int64), "path": None})

        def later(fps: np.ndarray, path: int) -> pd.DataFrame:
            return pd.DataFrame({"a": fps, "b": pd.array([None] * len(fps), dtype="Int64"), "path": path})

        def close() -> Iterator[pd.DataFrame]:
            if held and not large:
                fps = np.unique(np.concatenate(held))
                if len(fps) > 1:
                    a, b = _search(fps, radius)
                    if a:
                        yield linked(a, b)

        for f in frames:
            path, fp = f["path"].to_numpy(), f["fp"].to_numpy()
            cuts = np.flatnonzero(path[1:] != path[:-1]) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(path)]])
            size = ends - starts
            inner = np.zeros(len(size), dtype=bool)
            inner[1:-1] = True
            # Buckets of two inside the batch are most of those with any pair.
            two = starts[inner & (size == 2)]
            near = np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= radius
            two = two[near & (fp[two] != fp[two + 1])]
            if len(two):
                yield linked(fp[two].view(np.uint64), fp[two + 1].view(np.uint64))
            for s, e in zip(starts[(size > 2) | ~inner], ends[(size > 2) | ~inner], strict=True):
                if path[s] != held_path:
                    yield from close()
                    held, held_path, large = [], path[s], False
                part = fp[s:e]
                if not large and sum(map(len, held)) + len(part) > most:
                    large = True
                    for h in held:
                        yield later(h, held_path)
                    held = []
                if large:
                    yield later(part, held_path)
                else:
                    held.append(part)
        yield from close()

    return run


def radius_links(fps: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) whose components are those of all pairs within ``radius``."""
    now, old, found = fps.select("fp", F.lit(0).cast("long").alias("path")), None, None
    for level in range(LEVELS):
        masks = covering_masks(radius, level)
        keys = F.array(*[F.xxhash64(F.col("path"), F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
        # A bucket is named by a hash of (earlier bucket, table, masked bits); two that share a name are merely compared together.
        rows = now.select("fp", F.explode(keys).alias("path")).repartition("path").sortWithinPartitions("path")
        most = bucket if level + 1 < LEVELS else 1 << 62
        out, path = stage_path(rows.mapInPandas(_bucket_links(radius, most), "a long, b long, path long"), "simhash")
        links = out.where("b is not null").select("a", "b")
        found = links if found is None else found.union(links)
        now = out.where("b is null").select(F.col("a").alias("fp"), "path")
        if now.isEmpty():
            return found
    return found


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4, words_per_shingle: int = 4) -> DataFrame:
    """key, fp, component (smallest key reachable over links) of every document."""
    rows = stage(fingerprints(docs, key, text, words_per_shingle), "fingerprints")
    fps = rows.groupBy("fp").agg(F.min("key").alias("least"))
    roots = stage(components(radius_links(fps.select("fp"), radius)), "roots")
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    member = named.select("fp", "root").join(least, "root").select("fp", "component")
    return rows.join(member, "fp").select(F.col("key").alias(key), "fp", "component")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole text of ``documents``."""
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose key is the smallest of their component, with their columns. Rows that share a key stay or go together."""
    stay = near_groups(docs, key, text, radius).where(F.col(key).eqNullSafe(F.col("component"))).select(F.col(key).alias("stays")).distinct()
    return packed(docs, key=F.col(key)).join(stay, F.col("key").eqNullSafe(F.col("stays"))).select("row.*")
