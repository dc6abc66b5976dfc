"""Registration of queries with their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def r6(c: Column | str) -> Column:
    """Six digits, never -0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def d6(expr: str) -> str:
    return f"(round({expr}, 6) + 0::double)"


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


def joined(c: str) -> Column:
    """An array as text, for comparison."""
    return F.array_join(F.col(c).cast("array<string>"), ",")
