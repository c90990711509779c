"""Registry of named queries: a Spark callable, the survey ids it covers, its SQL counterpart."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelane import session

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session.ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r6(c: Column | str, places: int = 6) -> Column:
    """Rounded double; both engines round so that summation order does not show."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places)


# Interpolation of two-decimal data often lands on ...5 in the seventh place, where the last bit
# decides; queries and SQL then both round a value moved by this much.
TIE = 3e-8


def pick(df: DataFrame, *cols: str, tie: float = 0.0) -> DataFrame:
    """Project; doubles are rounded to 6 places."""
    kinds = dict(df.dtypes)
    return df.select(
        *[r6(F.col(c) + tie if tie else c).alias(c) if kinds[c] == "double" else F.col(c) for c in cols]
    )
