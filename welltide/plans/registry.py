"""Named queries and, where SQL can state them over whole tables, the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from welltide.session import ensure_settings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Added before rounding on both sides, so that exact decimal ties do not depend on the last bit of a sum.
TIE = 3.3e-8
SAME_TYPE = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "timestamp": "timestamp_ntz"}


def query(name: str, sql: str | None = None, dbl: str = "", digits: int = 4, whole: str = ""):
    """Register a query.

    Columns in ``dbl`` (``name`` or ``name:digits``) are rounded on both sides; columns in ``whole`` are integers
    the checking SQL gives another width. Integers come out as BIGINT and instants without a zone (UTC).
    """
    spec = [(p.split(":")[0], int(p.split(":")[1]) if ":" in p else digits) for p in dbl.split()]

    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = fn(ensure_settings(spark), sf)
            plain = {f.name: F.col(f.name).cast(SAME_TYPE[f.dataType.simpleString()]) for f in out.schema
                     if f.dataType.simpleString() in SAME_TYPE}
            out = out.withColumns(plain) if plain else out
            return out.withColumns({c: F.round(F.col(c).cast("double") + F.lit(TIE), d) + F.lit(0.0) for c, d in spec}) if spec else out

        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            if spec or whole:
                rep = ", ".join([f"round(CAST({c} AS DOUBLE) + {TIE!r}::DOUBLE, {d}) + 0.0 AS {c}" for c, d in spec]
                                + [f"CAST({c} AS BIGINT) AS {c}" for c in whole.split()])
                ORACLES[name] = f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS checked"
            else:
                ORACLES[name] = sql
        return fn

    return deco
