"""Assertions that run inside the plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def require(ok: Column, value: Column, message: str) -> Column:
    """``value`` where ``ok`` holds, otherwise the query fails."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))
