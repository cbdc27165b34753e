"""Correlations of all channel pairs from blocks of rows: every task adds up matrices per group, so no row is repeated for its pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of matrices a task holds before it hands them on.
HELD_BYTES = 64 << 20
#: Planes of the matrices: number of rows with both channels; over these the mean, squared deviations, least and largest value of the first
#: channel, the same of the second, and the product of deviations.
N, MEAN_A, DEV_A, LEAST_A, MOST_A, MEAN_B, DEV_B, LEAST_B, MOST_B, BOTH = range(10)


def moments(x: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Planes (10, channels, channels) of rows x channels values; values that are not ``present`` are not looked at."""
    k = x.shape[1]
    first = np.where(present.any(axis=0), x[present.argmax(axis=0), np.arange(k)], 0.0)
    y, m = np.where(present, x - first, 0.0), present.astype(np.float64)
    n = m.T @ m
    sums, squares, products = y.T @ m, (y * y).T @ m, y.T @ y
    size = np.maximum(n, 1.0)
    least, most = np.empty((k, k)), np.empty((k, k))
    if present.all():
        least[:], most[:] = x.min(axis=0)[:, None], x.max(axis=0)[:, None]
    else:
        for b in range(k):
            both = present & present[:, b:b + 1]
            least[:, b], most[:, b] = np.where(both, x, np.inf).min(axis=0), np.where(both, x, -np.inf).max(axis=0)
    mean, dev = first[:, None] + sums / size, np.maximum(squares - sums * sums / size, 0.0)
    mean = np.where(n > 0, mean, 0.0)
    return np.stack([n, mean, dev, least, most, mean.T, dev.T, least.T, most.T, products - sums * sums.T / size])


def merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Planes of the rows of both."""
    n = x[N] + y[N]
    size, part = np.maximum(n, 1.0), x[N] * y[N] / np.maximum(n, 1.0)
    da, db = y[MEAN_A] - x[MEAN_A], y[MEAN_B] - x[MEAN_B]
    return np.stack([n, x[MEAN_A] + da * y[N] / size, x[DEV_A] + y[DEV_A] + da * da * part, np.minimum(x[LEAST_A], y[LEAST_A]), np.maximum(x[MOST_A], y[MOST_A]),
                     x[MEAN_B] + db * y[N] / size, x[DEV_B] + y[DEV_B] + db * db * part, np.minimum(x[LEAST_B], y[LEAST_B]), np.maximum(x[MOST_B], y[MOST_B]),
                     x[BOTH] + y[BOTH] + da * db * part])


def undefined(x: np.ndarray) -> np.ndarray:
    """Where a channel does not vary over the rows with both."""
    return (x[N] < 1) | (x[LEAST_A] == x[MOST_A]) | (x[LEAST_B] == x[MOST_B])


def correlation(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.clip(x[BOTH] / np.sqrt(x[DEV_A] * x[DEV_B]), -1.0, 1.0)


def _partial(keys: Sequence[str], channels: Sequence[str]):
    """Batches to one row per group and first channel, with the planes over the channels after it."""
    k = len(channels)
    most = max(1, HELD_BYTES // (80 * k * k))

    def rows(held: dict, kinds: list) -> pa.RecordBatch:
        every = [(*key, a, planes[:, a, a + 1:].tobytes()) for key, planes in held.items() for a in range(k - 1)]
        return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*every, strict=True), [*kinds, pa.int32(), pa.binary()], strict=True)], names=[*keys, "_a", "_m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kinds: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.schema.field(x).type for x in keys]
            own = [batch.column(x).to_pylist() for x in keys]
            present = np.stack([np.asarray(batch.column(x).is_valid()) for x in channels], axis=1)
            values = np.stack([batch.column(x).to_numpy(zero_copy_only=False).astype(np.float64) for x in channels], axis=1)
            places: dict = {}
            for i, key in enumerate(zip(*own, strict=True)):
                places.setdefault(key, []).append(i)
            for key, at in places.items():
                part = moments(values[at], present[at])
                held[key] = merged(held[key], part) if key in held else part
            if len(held) >= most:
                yield rows(held, kinds)
                held = {}
        if held:
            yield rows(held, kinds)

    return run


def _final(keys: Sequence[str], channels: Sequence[str]):
    """Rows sorted by group and first channel to n and r of all its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, planes, kinds = None, None, None

        def done() -> pa.RecordBatch:
            *key, a = now
            n, r = planes[N].astype(np.int64), correlation(planes)
            size = len(n)
            return pa.RecordBatch.from_arrays([*(pa.array([v] * size, type=t) for v, t in zip(key, kinds, strict=True)), pa.array([channels[a]] * size), pa.array(list(channels[a + 1:])),
                                               pa.array(n), pa.array(r, mask=undefined(planes))], names=[*keys, "channel_a", "channel_b", "n", "r"])

        for batch in batches:
            kinds = [batch.schema.field(x).type for x in keys]
            names = zip(*(batch.column(x).to_pylist() for x in [*keys, "_a"]), strict=True)
            for key, raw in zip(names, batch.column("_m").to_pylist(), strict=True):
                part = np.frombuffer(raw, dtype=np.float64).reshape(10, -1)
                if key == now:
                    planes = merged(planes, part)
                else:
                    if now is not None:
                        yield done()
                    now, planes = key, part
        if now is not None:
            yield done()

    return run


def pair_correlations(df: DataFrame, keys: Sequence[str], channels: list[str]) -> DataFrame:
    """keys, channel_a, channel_b, n, r: correlations of all channel pairs per group, over the rows that have both.

    Tasks add up matrices per group and hand on one row per group and channel; these meet by group and channel. r is null where a channel is
    constant over the rows that count, NaN where a value is.
    """
    if len(channels) < 2:
        raise ValueError("at least two channels")
    keys = list(keys)
    kinds = [f"`{x}` {dict(df.dtypes)[x]}" for x in keys]
    some = df.select(*keys, *[F.col(x).cast("double").alias(x) for x in channels])
    parts = some.mapInArrow(_partial(keys, channels), ", ".join([*kinds, "_a int", "_m binary"]))
    met = parts.repartition(*keys, "_a").sortWithinPartitions(*keys, "_a")
    return met.mapInArrow(_final(keys, channels), ", ".join([*kinds, "channel_a string", "channel_b string", "n long", "r double"]))
