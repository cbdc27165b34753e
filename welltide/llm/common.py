"""Reading the tables and small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.session import ensure_settings

#: The white space of the text contracts: blank, and tab to carriage return.
WS_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ensure_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with all its columns in one struct, ``row``, next to the given ones, so that no name can clash; ``row.*`` gives them back."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *[c.alias(n) for n, c in columns.items()])


def slices(text: pd.Series, most: int) -> Iterator[slice]:
    """Consecutive row slices of about ``most`` characters, one row at least, so that a batch of long texts stays small in memory."""
    start, held = 0, 0
    for i, n in enumerate(text.str.len().fillna(0).astype("int64")):
        if i > start and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += int(n)
    if start < len(text):
        yield slice(start, len(text))


def per_batch(fn: Callable[[pd.DataFrame], pd.DataFrame], column: str = "text", most: int = 4_000_000):
    """A mapInPandas function that hands ``fn`` frames of about ``most`` characters of ``column``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for s in slices(frame[column], most):
                yield fn(frame.iloc[s].reset_index(drop=True))

    return run
