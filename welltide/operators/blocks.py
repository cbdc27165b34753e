"""Arrow batches of a sorted partition cut into its groups, for helpers that work on one bounded group at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def blocks(batches: Iterator[pa.RecordBatch], mark: str = "_g") -> Iterator[pa.Table]:
    """One table per run of equal ``mark`` (a number per group); a single group is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        g = batch[mark].to_numpy()
        cuts = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and now != g[lo]:
                yield pa.Table.from_batches(held)
                held = []
            now = g[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def numbers(table: pa.Table, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Values (rows x columns, 0 where null) and where they are present."""
    cols = [table[x] for x in names]
    present = np.stack([np.asarray(x.is_valid()) for x in cols], axis=1)
    return np.stack([x.fill_null(0.0).to_numpy() for x in cols], axis=1), present


def joined(parts: Iterator[pa.RecordBatch], least: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small batches as fewer ones of about ``least`` rows."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n >= least:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, n = [], 0
    if n:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()
